"""Patch hierarchies: levels of boxed grids, restriction, prolongation, halos, stepping.

``patches(level, patch, lo, hi)`` is the catalogue; ``cells(level, patch, id, lo, hi, volume)`` and
fields over ``id`` hold the data. Ids are unique over all levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import overlap, remap


def inside(dim: int, p: str = "", q: str = "up_"):
    get = lambda c, d: F.get(c, F.lit(d))
    test = F.lit(True)
    for d in range(dim):
        test = test & (get(q + "lo", d) <= get(p + "lo", d)) & (get(p + "hi", d) <= get(q + "hi", d))
    return test


def parents(patches: DataFrame, dim: int) -> DataFrame:
    """Per patch above level 0 the first patch of the next coarser level that holds it (null: none)."""
    # The level is one more axis of the boxes, so that patches of other levels never meet.
    lifted = lambda df, up: df.select("level", "patch", *[F.concat(c, F.array(F.col("level") + up + e)).cast("array<double>").alias(c) for e, c in enumerate(("lo", "hi"))])
    fine = patches.where("level > 0")
    pairs = overlap.box_pairs(lifted(fine, 0), lifted(patches, 1), dim + 1)
    found = pairs.where(inside(dim, "a_", "b_")).groupBy(F.col("a_level").alias("level"), F.col("a_patch").alias("patch")).agg(F.min("b_patch").alias("parent"))
    return fine.select("level", "patch").join(found, ["level", "patch"], "left")


def patches_at(patches: DataFrame, level: int) -> DataFrame:
    return patches.where(F.col("level") == level)


def n_levels(patches: DataFrame) -> int:
    return (patches.agg(F.max("level")).first()[0] or 0) + 1


def validate(patches: DataFrame, dim: int) -> None:
    """An error if a patch isn't inside one of the next coarser level."""
    bad = parents(patches, dim).where("parent is null")
    if not bad.isEmpty():
        raise ValueError("a patch lies outside all patches of the level below")


def restrict(coarse: DataFrame, fine: DataFrame, field: DataFrame, dim: int, side: list[float] | None = None) -> DataFrame:
    """``id``, ``value`` of the coarse cells: the volume-weighted mean of the fine cells where there
    are any, else the old value. ``field(id, value)`` holds both levels."""
    ov = overlap.overlap_boxes(fine.select("id", "lo", "hi"), coarse.select("id", "lo", "hi"), dim, 0, side)
    j = ov.join(field.select(F.col("id").alias("a_id"), "value"), "a_id")
    new = j.groupBy(F.col("b_id").alias("id")).agg((F.sum(F.col("volume") * F.col("value")) / F.sum("volume")).alias("new"))
    return coarse.select("id").join(field, "id").join(new, "id", "left").select("id", F.coalesce("new", "value").alias("value"))


def prolong(coarse: DataFrame, fine: DataFrame, field: DataFrame, dim: int, side: list[float] | None = None) -> DataFrame:
    """``id``, ``value`` of the fine cells: that of the coarse cell with the largest overlap."""
    ov = overlap.overlap_boxes(coarse.select("id", "lo", "hi"), fine.select("id", "lo", "hi"), dim, 0, side)
    best = remap.best_source(ov)
    return best.join(field.select(F.col("id").alias("a_id"), "value"), "a_id").select(F.col("b_id").alias("id"), "value")


def _own_frames(cells: DataFrame, dim: int, order: int, coeffs: str | None = None) -> DataFrame:
    lo, hi = ([F.get(c, F.lit(d)) for d in range(dim)] for c in ("lo", "hi"))
    size = S.product([h - a for a, h in zip(lo, hi, strict=True)])
    return cells.select("id", *([F.col(coeffs).alias("coeffs")] if coeffs else []), remap.box_pullback(lo, hi, order).alias("pullback"), size.alias("jacobian"))


def _projected(src: DataFrame, dst: DataFrame, field: DataFrame, dim: int, order: int, side: list[float] | None) -> DataFrame:
    ov = overlap.overlap_boxes(src.select("id", "lo", "hi"), dst.select("id", "lo", "hi"), dim, 2 * order, side).select(F.col("a_id").alias("lag_idx"), F.col("b_id").alias("eul_idx"), "moments")
    known = src.select("id", "lo", "hi").join(field.select("id", "coeffs"), "id")
    covered = dst.select("id", "lo", "hi").join(ov.select(F.col("eul_idx").alias("id")).distinct(), "id", "left_semi")
    return remap.polynomial(ov, _own_frames(known, dim, order, "coeffs"), _own_frames(covered, dim, order), dim, order, order)


def restrict_polynomial(coarse: DataFrame, fine: DataFrame, field: DataFrame, dim: int, order: int, side: list[float] | None = None) -> DataFrame:
    """``id``, ``coeffs`` of the coarse cells: the L2 projection of the fine cells' polynomials (in each
    cell's own coordinates) where there are any, else the old ones. ``field(id, coeffs)`` holds both levels."""
    new = _projected(fine, coarse, field, dim, order, side).withColumnRenamed("coeffs", "new")
    return coarse.select("id").join(field.select("id", "coeffs"), "id").join(new, "id", "left").select("id", F.coalesce("new", "coeffs").alias("coeffs"))


def prolong_polynomial(coarse: DataFrame, fine: DataFrame, field: DataFrame, dim: int, order: int, side: list[float] | None = None) -> DataFrame:
    """``id``, ``coeffs`` of the fine cells: the L2 projection of the coarse cells' polynomials."""
    return _projected(coarse, fine, field, dim, order, side)


def for_each_patch(cells: DataFrame, field: DataFrame, coarse: DataFrame, coarse_field: DataFrame, kernel: Callable[[Column, dict[tuple[int, int], Column]], Column], reads: list[tuple[int, int]], dim: int, level: int, walls: Callable | None = None) -> DataFrame:
    """``id``, ``value`` = kernel(own value, what is read across faces (axis from 1, side)) of a level's cells.

    What lies beyond a patch is read as ``patch_halo`` says; null is what nothing gives.
    """
    out = cells.select("id").join(field.select("id", F.col("value").alias("own")), "id")
    for axis, side in reads:
        seen = patch_halo(cells, field, coarse, coarse_field, axis, side, dim, level, walls)
        out = out.join(seen.withColumnRenamed("value", f"r{axis}{side}"), "id", "left")
    return out.select("id", kernel(F.col("own"), {(a, s): F.col(f"r{a}{s}") for a, s in reads}).alias("value"))


def advected(cells: DataFrame, field: DataFrame, coarse: DataFrame, coarse_field: DataFrame, courant: list[float], dim: int, level: int) -> DataFrame:
    """One upwind step against the low sides; where nothing is to be read a cell's own value stands in."""

    def kernel(own: Column, read: dict[tuple[int, int], Column]) -> Column:
        out = own
        for d, c in enumerate(courant):
            out = out - c * (own - F.coalesce(read[d + 1, 1], own))
        return out

    return for_each_patch(cells, field, coarse, coarse_field, kernel, [(d + 1, 1) for d in range(dim)], dim, level)


def leaf_at(points: DataFrame, leaves: DataFrame, dim: int, depth: int) -> DataFrame:
    """``pid``, ``cell``: the first leaf (``cell_id``, ``level``, ``ix`` in the unit box) that holds a
    point (closed); none outside. Points ask the levels that leaves have; on faces they try the cells on
    both sides."""
    get = lambda c, d: F.get(c, F.lit(d))
    levels = sorted(r[0] for r in leaves.where(F.col("level") <= depth).select("level").distinct().collect())  # a row per level
    tries = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    for d in range(dim):
        x = get("x", d) * F.pow(F.lit(2.0), F.col("level"))
        low = F.floor(x)
        both = F.when(x == low, F.array(low - 1, low)).otherwise(F.array(low))
        tries = tries.withColumn(f"i{d}", F.explode(both))
    keyed = leaves.select("cell_id", "level", *[get("ix", d).alias(f"i{d}") for d in range(dim)])
    return tries.join(keyed, ["level", *[f"i{d}" for d in range(dim)]]).groupBy("pid").agg(F.min("cell_id").alias("cell"))


def patch_halo(cells: DataFrame, field: DataFrame, coarse: DataFrame, coarse_field: DataFrame, axis: int, side: int, dim: int, level: int, walls: Callable | None = None) -> DataFrame:
    """``id``, ``value``: what each cell of a level's patches sees across one face (axis from 1).

    ``cells(patch, id, ix, lo, hi)`` are uniform within a patch. First the neighbour in the same
    patch, then the coarse leaf (``cell_id``, ``level``, ``ix`` in the unit box, of depth ``level`` at
    most) at the centre of the ghost cell, then ``walls``, a function of the cell's own value, else
    null. Patches of one level don't see each other.
    """
    get = lambda c, d: F.get(c, F.lit(d))
    step, a = 2 * side - 3, axis - 1
    own = cells.join(field.select("id", F.col("value").alias("own")), "id")
    beyond = F.transform("ix", lambda x, i: F.when(i == a, x + step).otherwise(x))
    near = cells.select("patch", F.col("ix").alias("to"), F.col("id").alias("n_id")).join(field.select(F.col("id").alias("n_id"), F.col("value").alias("near")), "n_id").select("patch", "to", "near")
    seen = own.withColumn("to", beyond).join(near, ["patch", "to"], "left")
    width = get("hi", a) - get("lo", a)
    ghost = F.array(*[(get("lo", d) + get("hi", d)) / 2 + (width * step if d == a else F.lit(0.0)) for d in range(dim)])
    at = leaf_at(seen.where("near is null").select(F.col("id").alias("pid"), ghost.alias("x")), coarse, dim, level)
    far = at.join(coarse_field.select(F.col("id").alias("cell"), F.col("value").alias("far")), "cell").select(F.col("pid").alias("id"), "far")
    wall = walls(F.col("own")) if walls else F.lit(None).cast("double")
    return seen.join(far, "id", "left").select("id", F.coalesce("near", "far", wall).alias("value"))


def step_pipeline(levels: int, state, prolong_level: Callable, update: Callable, restrict_level: Callable):
    """Prolong coarse to fine, update finest first, then the base, then restrict finest first."""
    for k in range(1, levels):
        state = prolong_level(state, k)
    for k in range(levels - 1, -1, -1):
        state = update(state, k)
    for k in range(levels - 1, 0, -1):
        state = restrict_level(state, k)
    return state
