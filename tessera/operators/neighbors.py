"""Face neighbours of leaves, face tables, adjacency, 2:1 balance, halo reads.

A neighbour is found by integers alone. Each leaf asks, per face, for the place beyond it at its
own level and at every coarser level; an equi-join with the leaves answers. That finds equal and
coarser neighbours, and read the other way round the finer ones. Trees with anisotropic splits are
joined by the plane of the face and tiles across it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.grid import leaves, refine, shift_left
from tessera.plans.store import stored

PERIODIC, INFLOW, OUTFLOW, REFLECTING, DIRICHLET = "periodic", "inflow", "outflow", "reflecting", "dirichlet"


def check_boundaries(spec: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Per axis the kinds of the low and high side; both or none may be periodic."""
    kinds = {PERIODIC, INFLOW, OUTFLOW, REFLECTING, DIRICHLET}
    for lo, hi in spec:
        if lo not in kinds or hi not in kinds or (lo == PERIODIC) != (hi == PERIODIC):
            raise ValueError("an axis is periodic on both sides or on none")
    return spec


def default_boundaries(dim: int) -> list[tuple[str, str]]:
    return [(REFLECTING, REFLECTING)] * dim


def is_periodic(spec: list[tuple[str, str]], axis: int) -> bool:
    return spec[axis] == (PERIODIC, PERIODIC)


def neighbors(cells: DataFrame, dim: int, boundaries: list[tuple[str, str]] | None = None) -> DataFrame:
    """``cell``, ``axis`` (from 1), ``side`` (1 low, 2 high), ``nbr`` of an isotropic, numbered tree.

    Places are plain integer columns, and only levels that leaves have are asked for, so on a uniform
    grid each face asks once. The leaves are the hashed side of a shuffled join: what is asked is
    several times as many rows, which must not be broadcast on a guess from the leaves' file size.
    Across a periodic wall only the lowest-numbered partner of a face is kept.
    """
    periodic = [is_periodic(check_boundaries(boundaries), a) for a in range(dim)] if boundaries else [False] * dim
    names = [f"i{d}" for d in range(dim)]
    own = leaves(cells).select("cell_id", "level", *[F.get("ix", F.lit(d)).alias(n) for d, n in enumerate(names)])
    lowest = own.agg(F.min("level")).first()[0] or 0
    faces = own.select("*", F.explode(F.array(*[F.struct(F.lit(a + 1).alias("axis"), F.lit(s).alias("side")) for a in range(dim) for s in (1, 2)])).alias("f"))
    n = shift_left(F.lit(1), F.col("level"))
    step = F.col("f.side") * 2 - 3
    beyond = [F.when(F.col("f.axis") == d + 1, F.col(x) + step).otherwise(F.col(x)) for d, x in enumerate(names)]
    places = [F.pmod(x, n) if p else x for x, p in zip(beyond, periodic, strict=True)]
    crossed = reduce(lambda a, b: a | b, [x != y for x, y in zip(beyond, places, strict=True)])
    asked = faces.select(F.col("cell_id").alias("cell"), F.col("f.axis").alias("axis"), F.col("f.side").alias("side"), F.col("level").alias("own_level"), crossed.alias("crossed"), *[x.alias(name) for x, name in zip(places, names, strict=True)])
    size = shift_left(F.lit(1), F.col("own_level"))
    asked = asked.where(reduce(lambda a, b: a & b, [(F.col(x) >= 0) & (F.col(x) < size) for x in names]))
    up = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("own_level") - lowest)).alias("k"))
    keyed = up.select("cell", "axis", "side", "crossed", "own_level", (F.col("own_level") - F.col("k")).alias("level"), *[F.call_function("shiftright", F.col(x), F.col("k")).alias(x) for x in names])
    known = own.withColumnRenamed("cell_id", "nbr").hint("shuffle_hash")
    found = keyed.join(known, ["level", *names])
    # A coarser neighbour has this cell among its finer ones.
    there = F.struct("cell", "axis", "side", "nbr")
    back = F.struct(F.col("nbr").alias("cell"), "axis", (3 - F.col("side")).alias("side"), F.col("cell").alias("nbr"))
    both = F.when(F.col("level") < F.col("own_level"), F.array(there, back)).otherwise(F.array(there))
    every = found.select("crossed", F.explode(both).alias("e")).select("e.*", "crossed")
    if not any(periodic):
        return every.drop("crossed")
    inner = every.where("not crossed").drop("crossed")
    walls = every.where("crossed").groupBy("cell", "axis", "side").agg(F.min("nbr").alias("nbr"))
    return inner.unionByName(walls)


def neighbors_anisotropic(cells: DataFrame, dim: int) -> DataFrame:
    """The same for any tree: faces on one plane whose other axes overlap, brought together by the
    plane and by the ancestor tiles of their boxes."""
    depth = leaves(cells).agg(F.max(F.array_max("lev"))).first()[0] or 0
    own = leaves(cells).select(F.col("cell_id").alias("cell"), F.transform(F.arrays_zip("lev", "ix"), lambda z: shift_left(z["ix"], depth - z["lev"])).alias("lo"), F.transform(F.arrays_zip("lev", "ix"), lambda z: shift_left(z["ix"] + 1, depth - z["lev"])).alias("hi"))
    out = []
    for a in range(dim):
        others = [d for d in range(dim) if d != a]
        lows = own.select(F.col("cell").alias("b"), F.get("lo", F.lit(a)).alias("plane"), *[F.get(c, F.lit(d)).alias(f"b{c}{d}") for d in others for c in ("lo", "hi")])
        highs = own.select(F.col("cell").alias("a"), F.get("hi", F.lit(a)).alias("plane"), *[F.get(c, F.lit(d)).alias(f"a{c}{d}") for d in others for c in ("lo", "hi")])
        # Widths are powers of two and aligned: the wider of two overlapping sides holds the other,
        # so that one of both starts within the tile of the other's width.
        side = 1 << (depth - depth // 2)
        tile = lambda df, p: reduce(lambda x, d: x.withColumn(f"t{d}", F.explode(F.sequence(F.floor(F.col(f"{p}lo{d}") / side), F.floor((F.col(f"{p}hi{d}") - 1) / side)))), others, df)
        pair = tile(highs, "a").join(tile(lows, "b"), ["plane", *[f"t{d}" for d in others]])
        for d in others:
            at = F.greatest(F.col(f"alo{d}"), F.col(f"blo{d}"))
            pair = pair.where((F.col(f"ahi{d}") > F.col(f"blo{d}")) & (F.col(f"bhi{d}") > F.col(f"alo{d}")) & (F.floor(at / side) == F.col(f"t{d}")))
        out += [pair.select(F.col("a").alias("cell"), F.lit(a + 1).alias("axis"), F.lit(2).alias("side"), F.col("b").alias("nbr")), pair.select(F.col("b").alias("cell"), F.lit(a + 1).alias("axis"), F.lit(1).alias("side"), F.col("a").alias("nbr"))]
    return reduce(DataFrame.unionByName, out)


def representatives(nbrs: DataFrame, cells: DataFrame, dim: int) -> DataFrame:
    """Per leaf one neighbour for each face (the lowest number; 0 at a wall) as ``faces``."""
    found = nbrs.groupBy("cell").agg(*[F.coalesce(F.min(F.when((F.col("axis") == a) & (F.col("side") == s), F.col("nbr"))), F.lit(0)).alias(f"f{a}{s}") for a in range(1, dim + 1) for s in (1, 2)])
    names = [f"f{a}{s}" for a in range(1, dim + 1) for s in (1, 2)]
    return leaves(cells).select(F.col("cell_id").alias("cell")).join(found, "cell", "left").select("cell", F.array(*[F.coalesce(F.col(n), F.lit(0)).cast("long") for n in names]).alias("faces"))


def fine_neighbors(nbrs: DataFrame) -> DataFrame:
    """All neighbours of each face, sorted."""
    return nbrs.groupBy("cell", "axis", "side").agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))


def faces(nbrs: DataFrame) -> DataFrame:
    """Each interior face once: ``left``, ``right``, ``axis``, ``hanging`` (several cells on the high side)."""
    up = nbrs.where("side = 2")
    several = F.count(F.lit(1)).over(W.partitionBy("cell", "axis")) > 1
    return up.select(F.col("cell").alias("left"), F.col("nbr").alias("right"), "axis", several.alias("hanging"))


def boundary_faces(nbrs: DataFrame, cells: DataFrame, dim: int) -> DataFrame:
    """Faces of leaves without a neighbour."""
    every = leaves(cells).select(F.col("cell_id").alias("cell"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in range(1, dim + 1) for s in (1, 2)])).alias("f")).select("cell", "f.*")
    return every.join(nbrs.select("cell", "axis", "side").distinct(), ["cell", "axis", "side"], "left_anti")


def adjacency(nbrs: DataFrame, cells: DataFrame, depth: int = 1) -> DataFrame:
    """``cell``, ``other``: pairs within ``depth`` face hops, each cell with itself."""
    edges = nbrs.select(F.col("cell").alias("other"), F.col("nbr").alias("next")).distinct()
    newest = reach = leaves(cells).select(F.col("cell_id").alias("cell"), F.col("cell_id").alias("other"))
    for _ in range(depth):
        # Only what was reached last leads further.
        newest = newest.join(edges, "other").select("cell", F.col("next").alias("other")).distinct().join(reach, ["cell", "other"], "left_anti")
        reach = reach.unionByName(newest)
    return reach


def balance(cells: DataFrame, dim: int, number) -> DataFrame:
    """Refines leaves with a neighbour more than one level finer, until there are none."""
    while True:
        now = number(cells)
        level = now.select("cell_id", "level", "path")
        n = neighbors(now, dim)
        coarse = n.join(level.select(F.col("cell_id").alias("cell"), F.col("level").alias("l1")), "cell").join(level.select(F.col("cell_id").alias("nbr"), F.col("level").alias("l2"), "path"), "nbr")
        targets = stored(coarse.where(F.col("l1") - F.col("l2") > 1).select("path").distinct(), "unbalanced")
        if targets.isEmpty():
            return cells
        cells = stored(refine(cells, targets, dim, check=False), "cells")


def halo(field: DataFrame, nbrs: DataFrame, offset: list[tuple[int, int]], boundaries: list[tuple[str, str]] | None = None, value: str = "value") -> DataFrame:
    """``cell``, ``value`` of the cell reached by hops (axis from 1, side), one after the other.

    At a reflecting or outflow wall the walk stops and reads the cell where it is; at other walls
    there is nothing to read. Among several neighbours the lowest number is taken.
    """
    first = nbrs.groupBy("cell", "axis", "side").agg(F.min("nbr").alias("nbr"))
    at = field.select(F.col("cell"), F.col("cell").alias("at"), F.lit(False).alias("stopped"))
    for axis, side in offset:
        kind = boundaries[axis - 1][side - 1] if boundaries else None
        hop = first.where((F.col("axis") == axis) & (F.col("side") == side)).select(F.col("cell").alias("at"), "nbr")
        stays = kind in (REFLECTING, OUTFLOW)
        gone: Column = F.col("at") if stays else F.lit(None).cast("long")
        at = at.join(hop, "at", "left").select("cell", F.when(F.col("stopped"), F.col("at")).otherwise(F.coalesce("nbr", gone)).alias("at"), (F.col("stopped") | F.col("nbr").isNull()).alias("stopped"))
    return at.join(field.select(F.col("cell").alias("at"), F.col(value).alias("value")), "at", "left").select("cell", "value")
