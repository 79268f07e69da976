"""Simplicial meshes and bundles of meshes: advection, periodic walls, pixelisation, cached overlaps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import flows
from tessera.functions import simplex as X
from tessera.operators import grid, overlap, remap
from tessera.plans.store import stored


def advanced(vertices: DataFrame, m: flows.Map, t: float) -> DataFrame:
    """Vertices moved from their reference positions (``ref_pos``) by a flow map."""
    x, y = flows.applied(m, F.get("ref_pos", F.lit(0)), F.get("ref_pos", F.lit(1)), t)
    return vertices.withColumn("pos", F.array(x, y))


def triangles_of(simplices: DataFrame, vertices: DataFrame, pos: str = "pos") -> DataFrame:
    """``id``, x1 ... y3 of a triangle mesh."""
    p = X.with_positions(simplices, vertices.select("vid", F.col(pos).alias("pos")))
    at = lambda k, d: F.get(F.get("points", F.lit(k)), F.lit(d)).alias(f"{'xy'[d]}{k + 1}")
    return p.select(F.col("sid").alias("id"), *[at(k, d) for k in range(3) for d in range(2)])


def density_factors(now: DataFrame, ref: DataFrame) -> DataFrame:
    """``id``, ``factor``: reference area over present area, which is held above 1e-14."""
    a = now.select("id", F.abs(overlap.signed_area()).alias("a"))
    b = ref.select("id", F.abs(overlap.signed_area()).alias("b"))
    return a.join(b, "id").select("id", (F.col("b") / F.greatest("a", F.lit(1e-14))).alias("factor"))


def resolution_indicator(ov: DataFrame, target: int) -> DataFrame:
    """``eul_idx``, ``value``: by how many cells the worst-resolved simplex of a cell misses the target."""
    per = ov.groupBy("lag_idx").agg(F.count(F.lit(1)).alias("n"))
    return ov.join(per, "lag_idx").groupBy("eul_idx").agg(F.greatest(F.max(F.lit(target) - F.col("n")), F.lit(0)).cast("double").alias("value"))


def pixelized(cells: DataFrame, tri: DataFrame, target: int, max_depth: int, max_iters: int = 12) -> DataFrame:
    """Refines the unit square until each triangle meets ``target`` cells or the depth is reached."""
    for _ in range(max_iters):
        boxes = grid.with_boxes(grid.leaves(cells), [0.0, 0.0], [1.0, 1.0]).select(F.col("path").alias("id"), "lo", "hi")
        ov = overlap.overlap_triangles(tri, boxes)
        value = stored(resolution_indicator(ov, target).select(F.col("eul_idx").alias("path"), "value"), "resolution")
        cells, more, _ = grid.refine_by_indicator(cells, value, 2, 0.5, -1.0, max_depth)
        if not more:
            break
        cells = stored(cells, "cells")
    return cells


def density(cells: DataFrame, now: DataFrame, ref: DataFrame) -> DataFrame:
    """``id`` (the path), ``rho`` on the leaves of the unit square."""
    boxes = grid.with_boxes(grid.leaves(cells), [0.0, 0.0], [1.0, 1.0]).select(F.col("path").alias("id"), "lo", "hi", "volume")
    return remap.density(overlap.overlap_triangles(now, boxes), density_factors(now, ref), boxes)


def faces_of(simplices: DataFrame) -> DataFrame:
    """``sid``, ``face`` (from 0: the one opposite that vertex), ``key`` (its vertices in order)."""
    each = simplices.select("sid", "vids", F.posexplode("vids").alias("face", "_v"))
    return each.select("sid", "face", F.sort_array(F.filter("vids", lambda v, i: i != F.col("face"))).alias("key"))


def face_neighbors(simplices: DataFrame) -> DataFrame:
    """``sid``, ``face``, ``neighbor``: the simplex on the other side of each face, null at the boundary."""
    same = W.partitionBy("key")
    both = faces_of(simplices).select("sid", "face", F.min("sid").over(same).alias("a"), F.max("sid").over(same).alias("b"))
    return both.select("sid", "face", F.when(F.col("a") != F.col("b"), F.when(F.col("sid") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("neighbor"))


def mesh_faults(simplices: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """``sid``, ``fault`` of simplices that make no mesh: not dim + 1 ``vertices``, one of them ``repeated``,
    one that is ``missing``, or a face ``shared`` by more than two."""
    size = simplices.where(F.size("vids") != dim + 1).select("sid", F.lit("vertices").alias("fault"))
    again = simplices.where(F.size(F.array_distinct("vids")) != F.size("vids")).select("sid", F.lit("repeated").alias("fault"))
    lost = simplices.select("sid", F.explode("vids").alias("vid")).join(vertices.select("vid"), "vid", "left_anti").select("sid", F.lit("missing").alias("fault"))
    crowded = faces_of(simplices).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where("n > 2").select("sid", F.lit("shared").alias("fault"))
    return size.union(again).union(lost).union(crowded).distinct()


def checked(simplices: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """The simplices; an error if they make no mesh."""
    bad = mesh_faults(simplices, vertices, dim).first()
    if bad is not None:
        raise ValueError(f"simplex {bad['sid']}: {bad['fault']}")
    return simplices


def pinned(simplices: DataFrame, which: DataFrame) -> DataFrame:
    """Adds ``pinned``: whether a simplex is among ``which.sid``; an error if one of these is none."""
    if not which.join(simplices.select("sid"), "sid", "left_anti").isEmpty():
        raise ValueError("no such simplex")
    mark = which.select("sid").distinct().withColumn("_pin", F.lit(True))
    return simplices.join(mark, "sid", "left").withColumn("pinned", F.col("_pin").isNotNull()).drop("_pin")


def face_centers(simplices: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """``sid``, ``face``, ``center``, ``least``, ``most`` (per axis) of the boundary faces."""
    open_ = face_neighbors(simplices).where("neighbor is null").select("sid", "face")
    corner = faces_of(simplices).join(open_, ["sid", "face"]).select("sid", "face", F.explode("key").alias("vid")).join(vertices.select("vid", "pos"), "vid")
    per = lambda f: F.array(*[f(F.get("pos", F.lit(d))) for d in range(dim)])
    return corner.groupBy("sid", "face").agg(per(F.avg).alias("center"), per(F.min).alias("least"), per(F.max).alias("most"))


def periodic(simplices: DataFrame, vertices: DataFrame, axis: int, lo: float, hi: float, dim: int, tol: float = 1e-10) -> DataFrame:
    """``sid``, ``face``, ``neighbor`` with the faces of one wall rewired to the nearest ones of the other.

    Faces lie on a wall if all their vertices do. Their centres are matched across the other axes,
    to within ``tol`` times the extent: by lattice cells of that width and those beside them, and
    of what is within reach each face takes the nearest that takes it too.
    """
    reach = tol * (hi - lo)
    faces = face_centers(simplices, vertices, dim)
    others = [d for d in range(dim) if d != axis]
    get = lambda c, d: F.get(c, F.lit(d))

    def wall(at: float, p: str) -> DataFrame:
        on = (F.abs(get("least", axis) - at) <= reach) & (F.abs(get("most", axis) - at) <= reach)
        return faces.where(on).select(F.col("sid").alias(p + "sid"), F.col("face").alias(p + "face"), *[get("center", d).alias(f"{p}{d}") for d in others])

    cell = lambda c: F.floor(F.col(c) / (2 * reach))
    low, high = wall(lo, "l"), wall(hi, "h")
    for d in others:
        low = low.withColumn(f"k{d}", F.explode(F.array(*[cell(f"l{d}") + i for i in (-1, 0, 1)])))
        high = high.withColumn(f"k{d}", cell(f"h{d}"))
    met = low.join(high, [f"k{d}" for d in others]) if others else low.crossJoin(high)  # in one dimension a wall is one face
    gap = reduce(lambda x, y: x + y, [F.abs(F.col(f"l{d}") - F.col(f"h{d}")) for d in others], F.lit(0.0))
    near = met.withColumn("gap", gap).where(F.col("gap") <= reach)
    near = near.withColumn("r", F.row_number().over(W.partitionBy("lsid", "lface").orderBy("gap", "hsid", "hface"))).withColumn("q", F.row_number().over(W.partitionBy("hsid", "hface").orderBy("gap", "lsid", "lface")))
    pair = near.where("r = 1 and q = 1")
    new = pair.select(F.col("lsid").alias("sid"), F.col("lface").alias("face"), F.col("hsid").alias("_new")).union(pair.select("hsid", "hface", "lsid"))
    return face_neighbors(simplices).join(new, ["sid", "face"], "left").select("sid", "face", F.coalesce("neighbor", "_new").alias("neighbor"))


class Paired:
    """A Lagrangian and an Eulerian table whose overlap is made when first asked for."""

    def __init__(self, lagrangian: DataFrame, eulerian: DataFrame, compute: Callable[[DataFrame, DataFrame], DataFrame] = overlap.overlap_triangles) -> None:
        self.lagrangian, self.eulerian, self.compute = lagrangian, eulerian, compute
        self._overlap: DataFrame | None = None

    @property
    def overlap(self) -> DataFrame:
        if self._overlap is None:
            self._overlap = stored(self.compute(self.lagrangian, self.eulerian), "overlap")
        return self._overlap

    def invalidate(self) -> None:
        self._overlap = None

    def move(self, lagrangian: DataFrame) -> None:
        """New vertex positions; the overlap is forgotten."""
        self.lagrangian = lagrangian
        self.invalidate()


class Composite(dict):
    """A named bundle of meshes: ``bundle["gas"]`` or ``bundle.gas``."""

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None
