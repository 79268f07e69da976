"""Hierarchical grids as tables of cells.

A cell is named by its path: the sibling numbers from the root on. Spark sorts arrays with the
shorter prefix first, which is the depth-first order of the tree. ``lev`` and ``ix`` hold the level
and the integer place per axis, so boxes, parents and neighbours come from arithmetic, not from
walks. ``split_mask`` is the mask a cell came from, ``own_mask`` the one it was split with (null
for leaves).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import scalars as S
from tessera.plans.store import stored

COLUMNS = ["path", "masks", "level", "lev", "ix", "is_leaf", "sibling_index", "split_mask", "own_mask"]


def shift_left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x.cast("long"), n.cast("int"))


def root(spark: SparkSession, dim: int) -> DataFrame:
    """One leaf that is the whole unit box."""
    ints = lambda v, t: F.array(*[F.lit(v)] * dim).cast(f"array<{t}>")
    none = F.array().cast("array<int>")
    return spark.range(1).select(none.alias("path"), none.alias("masks"), F.lit(0).alias("level"), ints(0, "int").alias("lev"), ints(0, "bigint").alias("ix"), F.lit(True).alias("is_leaf"), F.lit(0).alias("sibling_index"), F.lit(0).alias("split_mask"), F.lit(None).cast("int").alias("own_mask"))


def uniform_level(spark: SparkSession, dim: int, level: int, is_leaf: bool = True) -> DataFrame:
    """All cells of one level of an isotropic tree, in closed form."""
    full = S.isotropic_mask(dim)
    i = F.col("id")
    ix = [F.shiftright(i, level * d).bitwiseAND((1 << level) - 1) for d in range(dim)]
    path = [S.total([F.getbit(x, F.lit(level - 1 - s)).cast("int") * (1 << d) for d, x in enumerate(ix)]) for s in range(level)]
    steps = F.array(*path).cast("array<int>") if level else F.array().cast("array<int>")
    return spark.range(1 << (level * dim)).select(
        steps.alias("path"),
        F.array_repeat(F.lit(full), level).alias("masks"),
        F.lit(level).alias("level"),
        F.array_repeat(F.lit(level), dim).alias("lev"),
        F.array(*ix).alias("ix"),
        F.lit(is_leaf).alias("is_leaf"),
        (path[-1] if level else F.lit(0)).cast("int").alias("sibling_index"),
        F.lit(full if level else 0).alias("split_mask"),
        (F.lit(None) if is_leaf else F.lit(full)).cast("int").alias("own_mask"),
    )


def uniform(spark: SparkSession, dim: int, level: int) -> DataFrame:
    """The whole tree of ``level`` isotropic refinements of the root."""
    return reduce(DataFrame.unionByName, [uniform_level(spark, dim, k, k == level) for k in range(level + 1)])


def numbered(cells: DataFrame) -> DataFrame:
    """``cell_id`` (from 1, depth first) and ``parent_id``; ranges are numbered in parallel."""
    parts = stored(cells.repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "cells")
    before = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))  # a row per partition
    within = F.row_number().over(W.partitionBy("_part").orderBy("path"))
    out = parts.withColumn("_row", within).join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    out = out.select((F.col("_row") + F.col("_before")).cast("long").alias("cell_id"), *cells.columns)
    up = out.select(F.col("path").alias("_up"), F.col("cell_id").alias("parent_id"))
    parent = F.when(F.col("level") > 0, F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    return out.withColumn("_up", parent).join(up, "_up", "left").drop("_up")


def leaves(cells: DataFrame) -> DataFrame:
    return cells.where("is_leaf")


def with_boxes(cells: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """Adds the physical box (``lo``, ``hi`` arrays) and its volume within a frame."""
    if any(not h > a for a, h in zip(lo, hi, strict=True)):
        raise ValueError("hi must exceed lo on every axis")
    at = lambda d, k: (F.lit(float(lo[d])) + (F.get("ix", F.lit(d)) + k) / shift_left(F.lit(1), F.get("lev", F.lit(d))) * float(hi[d] - lo[d])).cast("double")
    dims = range(len(lo))
    out = cells.withColumn("lo", F.array(*[at(d, 0) for d in dims])).withColumn("hi", F.array(*[at(d, 1) for d in dims]))
    return out.withColumn("volume", S.product([F.get("hi", F.lit(d)) - F.get("lo", F.lit(d)) for d in dims]))


def center(dim: int) -> list[Column]:
    return [(F.get("lo", F.lit(d)) + F.get("hi", F.lit(d))) / 2 for d in range(dim)]


# Navigation ------------------------------------------------------------------------------------


def parent_path(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))


def common_path(a: Column, b: Column) -> Column:
    """The path of the lowest common ancestor."""
    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y)
    at = F.array_position(differ, True)
    return F.slice(a, 1, F.when(at == 0, n).otherwise(at.cast("int") - 1))


def subtree_sizes(cells: DataFrame) -> DataFrame:
    """``path``, ``subtree_size``: every cell counts once for each of its prefixes."""
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))
    return cells.select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("subtree_size"))


def children(cells: DataFrame, of: Column) -> DataFrame:
    """Children of the cell at a path, in sibling order."""
    return cells.where((F.size("path") > 0) & (parent_path(F.col("path")) == of)).orderBy("sibling_index")


def place_in_parent(sibling: Column, mask: Column, dim: int) -> list[Column]:
    """0 or 1 per axis; 0 on axes that aren't split."""
    return [F.when(S.bit(mask, d) == 1, F.getbit(sibling.cast("long"), S.bit_for_axis(mask, F.lit(d))).cast("int")).otherwise(0) for d in range(dim)]


def center_in_parent(sibling: Column, mask: Column, dim: int) -> list[Column]:
    """-1 or +1 on split axes, else 0."""
    return [F.when(S.bit(mask, d) == 1, 2 * p - 1).otherwise(0) for d, p in enumerate(place_in_parent(sibling, mask, dim))]


def denominators(lev: Column) -> Column:
    """2 ** level per axis."""
    return F.transform(lev, lambda k: shift_left(F.lit(1), k))


def volume_exponent(lev: Column) -> Column:
    """k with volume 2 ** -k."""
    return F.aggregate(lev, F.lit(0), lambda a, k: a + k)


def relative_place(ix: Column, lev: Column, aix: Column, alev: Column) -> Column:
    """Lower corner relative to an ancestor's, in units of the cell."""
    moved = F.zip_with(aix, F.zip_with(lev, alev, lambda x, y: x - y), shift_left)
    return F.zip_with(ix, moved, lambda x, y: x - y)


def distance_squared(a: Column, b: Column) -> Column:
    """Squared distance of two relative places, exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


def uniform_dimensions(cells: DataFrame) -> DataFrame:
    """One row: ``depth`` if all leaves have one level and all splits are isotropic, else null."""
    r = cells.agg(F.min(F.when(F.col("is_leaf"), F.col("level"))).alias("a"), F.max(F.when(F.col("is_leaf"), F.col("level"))).alias("b"), F.bool_and(F.coalesce(F.col("own_mask") == shift_left(F.lit(1), F.size("lev")) - 1, F.lit(True))).alias("iso"))
    return r.select(F.when((F.col("a") == F.col("b")) & F.col("iso"), F.col("a")).alias("depth"))


def uniform_grid(cells: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """One row for a uniform tree over a frame, none for others: ``depth``, cells per axis, ``spacing``."""
    r = uniform_dimensions(cells).where("depth is not null")
    n = shift_left(F.lit(1), F.col("depth"))
    return r.select("depth", n.alias("n"), F.array(*[(F.lit(float(h - a)) / n).cast("double") for a, h in zip(lo, hi, strict=True)]).alias("spacing"))


def voxels(cells: DataFrame) -> DataFrame:
    """``ix`` (from 0), ``cell_id`` of the leaves of a uniform tree; no row for others."""
    r = uniform_dimensions(cells).where("depth is not null")
    return leaves(cells).join(r, F.col("level") == F.col("depth")).select("ix", "cell_id")


def at_path(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(path, masks)`` with the ``cell_id`` that is there, 0 if there is none or it came by other masks."""
    have = cells.select("path", "cell_id", F.col("masks").alias("_masks"))
    found = wanted.join(have, "path", "left")
    return found.select(*wanted.columns, F.when(F.col("_masks") == F.col("masks"), F.col("cell_id")).otherwise(F.lit(0)).cast("long").alias("cell_id"))


# Structural updates ----------------------------------------------------------------------------


def children_of(parents: DataFrame, dim: int) -> DataFrame:
    """The children of cells whose ``own_mask`` is set."""
    k = F.col("_k")
    born = parents.withColumn("_k", F.explode(F.sequence(F.lit(0), (S.children_count(F.col("own_mask")) - 1).cast("int"))))
    place = place_in_parent(k, F.col("own_mask"), dim)
    split = [S.bit(F.col("own_mask"), d) for d in range(dim)]
    return born.select(
        F.concat("path", F.array(k)).alias("path"),
        F.concat("masks", F.array("own_mask")).alias("masks"),
        (F.col("level") + 1).alias("level"),
        F.array(*[F.get("lev", F.lit(d)) + split[d] for d in range(dim)]).alias("lev"),
        F.array(*[F.get("ix", F.lit(d)) * (1 + split[d]) + place[d] for d in range(dim)]).cast("array<bigint>").alias("ix"),
        F.lit(True).alias("is_leaf"),
        k.cast("int").alias("sibling_index"),
        F.col("own_mask").alias("split_mask"),
        F.lit(None).cast("int").alias("own_mask"),
    )


def refine(cells: DataFrame, targets: DataFrame, dim: int, check: bool = True) -> DataFrame:
    """Splits the leaves at ``targets.path`` with ``targets.mask`` (isotropic where there is none)."""
    mask = F.coalesce(F.col("mask"), F.lit(S.isotropic_mask(dim))) if "mask" in targets.columns else F.lit(S.isotropic_mask(dim))
    wanted = targets.select("path", mask.cast("int").alias("_mask")).dropDuplicates(["path"])
    if check:
        bad = wanted.join(leaves(cells).select("path"), "path", "left_anti").union(wanted.where("_mask <= 0"))
        if not bad.isEmpty():
            raise ValueError("only leaves can be refined, with a mask that is not zero")
    marked = cells.join(wanted, "path", "left")
    split = marked.where("_mask is not null").withColumn("own_mask", F.col("_mask")).select(*COLUMNS)
    kept = marked.select(*[F.when(F.col("_mask").isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_leaf" else F.coalesce("_mask", c).alias(c) if c == "own_mask" else c for c in COLUMNS])
    return kept.unionByName(children_of(split, dim))


def coarsen(cells: DataFrame, parents: DataFrame, check: bool = True) -> DataFrame:
    """Drops the children of ``parents.path``, all of which have to be leaves."""
    wanted = parents.select("path").distinct()
    if check:
        own = cells.where("level > 0").groupBy(parent_path(F.col("path")).alias("path")).agg(F.bool_and("is_leaf").alias("ok"))
        if not wanted.join(own.where("ok"), "path", "left_anti").isEmpty():
            raise ValueError("only cells whose children are all leaves can be coarsened")
    rest = cells.withColumn("_up", parent_path(F.col("path"))).join(wanted.select(F.col("path").alias("_up")), "_up", "left_anti").select(*COLUMNS)
    hit = rest.join(wanted.withColumn("_hit", F.lit(True)), "path", "left")
    back = F.col("_hit").isNotNull()
    return hit.select(*[F.when(back, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "is_leaf" else F.when(~back, F.col(c)).alias(c) if c == "own_mask" else c for c in COLUMNS])


def refine_by_indicator(cells: DataFrame, indicator: DataFrame, dim: int, refine_threshold: float, coarsen_threshold: float | None = None, max_level: int = 62) -> tuple[DataFrame, bool, bool]:
    """Splits leaves above the threshold, or, only if there are none, undoes splits whose leaves all
    lie below the other one. ``indicator(path, value)``. Returns the cells, and what was done."""
    low = refine_threshold / 4 if coarsen_threshold is None else coarsen_threshold
    judged = leaves(cells).select("path", "level").join(indicator, "path", "left")
    up = judged.where((F.col("value") > refine_threshold) & (F.col("level") < max_level)).select("path")
    if not up.isEmpty():
        return refine(cells, up, dim, check=False), True, False
    calm = cells.where("level > 0").select("path", "is_leaf").join(indicator, "path", "left")
    down = calm.groupBy(parent_path(F.col("path")).alias("path")).agg(F.bool_and(F.col("is_leaf") & F.coalesce(F.col("value") < low, F.lit(False))).alias("ok")).where("ok").select("path")
    if not down.isEmpty():
        return coarsen(cells, down, check=False), False, True
    return cells, False, False


def from_pyramid(pyramid: DataFrame, dim: int, above: float, depth: int, value: str = "n") -> DataFrame:
    """The tree that splits a cell while its value exceeds ``above``, to ``depth`` levels, in one pass.

    ``pyramid`` has the value of the cells of every level (``level``, ``ix``); absent cells have none.
    The value must not grow from a cell to its children, as counts and sums of what is inside do
    not: then a cell is there if its parent exceeds the limit, whatever lies further up. This gives
    what ``refine_by_indicator`` gives when it is repeated until nothing is split.
    """
    split = pyramid.where((F.col(value) > above) & (F.col("level") < depth)).select("level", "ix")
    k, mask = F.col("level"), S.isotropic_mask(dim)
    bits = F.sequence(F.lit(1), k)
    step = lambda s: S.total([F.call_function("shiftright", F.get("ix", F.lit(d)), k - s).bitwiseAND(1) * (1 << d) for d in range(dim)]).cast("int")
    path = F.when(k > 0, F.transform(bits, step)).otherwise(F.array().cast("array<int>"))
    sound = split.select("level", "ix", path.alias("path"), F.array_repeat(F.lit(mask), k).alias("masks"), F.array_repeat(k, dim).alias("lev"), F.lit(mask).cast("int").alias("own_mask"))
    born = children_of(sound, dim).unionByName(root(pyramid.sparkSession, dim))
    again = split.withColumn("_split", F.lit(True))
    both = born.join(again, ["level", "ix"], "left")
    more = F.col("_split").isNotNull()
    return both.select(*[(~more).alias(c) if c == "is_leaf" else F.when(more, F.lit(mask)).cast("int").alias(c) if c == "own_mask" else c for c in COLUMNS])


def remap(before: DataFrame, after: DataFrame) -> DataFrame:
    """``old_id``, ``new_id``, ``kind``: what an update did to the numbered cells."""
    a = before.select("path", F.col("cell_id").alias("old_id"), F.col("is_leaf").alias("was"))
    b = after.select("path", F.col("cell_id").alias("new_id"), F.col("is_leaf").alias("is"))
    kind = F.when(F.col("old_id").isNull(), "created").when(F.col("new_id").isNull(), "removed").when(F.col("was") & ~F.col("is"), "refined").when(~F.col("was") & F.col("is"), "coarsened").otherwise("kept")
    return a.join(b, "path", "full_outer").select("path", "old_id", "new_id", kind.alias("kind"))
