"""Geometric overlap: boxes with boxes, segments, triangles and tetrahedra with boxes.

Pairs come from a tile join, never from a theta join: both sides are dealt to the tiles their
bounding boxes touch, meet by tile, and a pair is kept only in the tile that holds the greater of
both low corners. Tiles are half open, so no pair is found twice. Tiles have levels, each twice as wide
as the one below, and a box lies in tiles of its own width, so a few huge boxes cost no more than
others. The join is a plain equi-join, which Spark splits where a tile is crowded. The measures of boxes and segments
are column expressions; those of triangles, tetrahedra, and exact rational ones, are made in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import product
from math import comb, factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalars as S
from tessera.plans import constants as K
from tessera.plans.store import bound


def extents(df: DataFrame, dim: int) -> list[Column]:
    return [F.get("hi", F.lit(d)) - F.get("lo", F.lit(d)) for d in range(dim)]


def tile_sides(a: DataFrame, b: DataFrame, dim: int) -> list[float]:
    """Least tile widths: the greater of both median extents per axis (one row of statistics)."""
    half = lambda df: df.agg(*[F.percentile_approx(x.cast("double"), 0.5, F.lit(1000)) for x in extents(df, dim)]).first()
    return [max(x or 0.0, y or 0.0, 1e-9) for x, y in zip(half(a), half(b), strict=True)]


def leveled(df: DataFrame, base: list[float]) -> DataFrame:
    """Adds ``_lev``: the level whose tiles (``base`` times a power of two) are as wide as the row's box."""
    need = [F.ceil(F.log2(F.greatest(x.cast("double") / s, F.lit(1.0)))) for x, s in zip(extents(df, len(base)), base, strict=True)]
    return df.withColumn("_lev", F.least(F.greatest(*need, F.lit(0)), F.lit(60)).cast("int"))


def levels_of(a: DataFrame, b: DataFrame) -> tuple[list[int], list[int]]:
    """The levels of both sides (at most 61 each), in one job."""
    rows = a.select("_lev", F.lit(0).alias("side")).union(b.select("_lev", F.lit(1))).distinct().collect()
    return tuple(sorted(r[0] for r in rows if r[1] == k) for k in (0, 1))


def tiled(df: DataFrame, base: list[float], others: list[int] | None = None) -> DataFrame:
    """A row for each tile that a box touches, at its own level and at wider levels that the other side
    has: at most two per axis and level, however wide the box is. Without ``others`` there is one level."""
    if others is not None:
        wider = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("_lev"))
        df = df.withColumn("t_lev", F.explode(F.concat(F.array("_lev"), wider)))
    for d, s in enumerate(base):
        side = F.lit(s) if others is None else F.pow(F.lit(2.0), F.col("t_lev")) * s
        df = df.withColumn(f"t{d}", F.explode(F.sequence(F.floor(F.get("lo", F.lit(d)) / side), F.floor(F.get("hi", F.lit(d)) / side))))
    return df


def box_pairs(a: DataFrame, b: DataFrame, dim: int, side: list[float] | None = None) -> DataFrame:
    """Pairs of rows whose boxes (``lo``, ``hi`` arrays) overlap strictly on every axis.

    A pair meets at the level of the wider of both, in the tile that holds the greater low corners.
    With ``side`` the least tiles have these widths. Columns of ``a`` come back with the prefix
    ``a_``, those of ``b`` with ``b_``.
    """
    base = side or tile_sides(a, b, dim)
    a, b = leveled(a, base), leveled(b, base)
    la, lb = levels_of(a, b)
    even = {*la, *lb} <= {0}
    tiles = [*([] if even else ["t_lev"]), *[f"t{d}" for d in range(dim)]]

    def named(df: DataFrame, p: str, others: list[int]) -> DataFrame:
        return tiled(df, base, None if even else others).select(*[F.col(c).alias(c if c in tiles else p + c) for c in [*df.columns, *tiles]])

    pairs = named(a, "a_", lb).join(named(b, "b_", la), tiles)
    if not even:
        pairs = pairs.where(F.col("t_lev") == F.greatest("a__lev", "b__lev"))
    get = lambda c, d: F.get(c, F.lit(d))
    for d, s in enumerate(base):
        at = F.greatest(get("a_lo", d), get("b_lo", d))
        width = F.lit(s) if even else F.pow(F.lit(2.0), F.col("t_lev")) * s
        pairs = pairs.where((get("a_hi", d) > get("b_lo", d)) & (get("b_hi", d) > get("a_lo", d)) & (F.floor(at / width) == F.col(f"t{d}")))
    return pairs.drop(*tiles, "a__lev", "b__lev")


def within_range(boxes: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """Rows whose boxes overlap a given box strictly on every axis."""
    get = lambda c, d: F.get(c, F.lit(d))
    return boxes.where(reduce(lambda x, y: x & y, [(get("lo", d) < h) & (get("hi", d) > x) for d, (x, h) in enumerate(zip(lo, hi, strict=True))]))


def overlap_boxes(a: DataFrame, b: DataFrame, dim: int, order: int = 0, side: list[float] | None = None) -> DataFrame:
    """``a_id``, ``b_id``, ``volume``, ``centroid``, ``moments`` of all strictly overlapping boxes (``id``, ``lo``, ``hi``)."""
    get = lambda c, d: F.get(c, F.lit(d))
    pairs = box_pairs(a.select("id", "lo", "hi"), b.select("id", "lo", "hi"), dim, side)
    lo = [F.greatest(get("a_lo", d), get("b_lo", d)) for d in range(dim)]
    hi = [F.least(get("a_hi", d), get("b_hi", d)) for d in range(dim)]
    volume = S.product([h - x for x, h in zip(lo, hi, strict=True)])
    middle = F.array(*[(x + h) / 2 for x, h in zip(lo, hi, strict=True)])
    return pairs.select("a_id", "b_id", volume.alias("volume"), middle.alias("centroid"), A.box_moments(lo, hi, order).alias("moments"))


def ghosts(df: DataFrame, periods: list[float | None]) -> DataFrame:
    """Copies shifted by -1, 0, +1 periods on periodic axes (a factor of at most 3 ** axes)."""
    out = df.withColumn("_s", F.explode(shifts(periods)))
    moved = lambda c: F.zip_with(c, "_s", lambda x, y: x + y)
    return out.withColumn("lo", moved("lo")).withColumn("hi", moved("hi")).drop("_s")


def shifts(periods: list[float | None]) -> Column:
    """All moves by -1, 0, +1 periods, as arrays."""
    return F.array(*[F.array(*map(F.lit, s)) for s in product(*[(0.0,) if p is None else (-p, 0.0, p) for p in periods])])


def ghost_triangles(tri: DataFrame, periods: list[float | None]) -> DataFrame:
    """Triangles (``id``, x1 ... y3) and their images beyond periodic walls, under the same ids."""
    out = tri.withColumn("_s", F.explode(shifts(periods)))
    return out.select(*[(F.col(c) + F.get("_s", F.lit("xy".index(c[0])))).alias(c) if c in {f"{x}{k}" for x in "xy" for k in (1, 2, 3)} else F.col(c) for c in tri.columns])


def ghost_simplices(simplices: DataFrame, periods: list[float | None]) -> DataFrame:
    """The same for simplices (``id``, ``points``)."""
    moved = F.transform("points", lambda p: F.zip_with(p, "_s", lambda x, y: x + y))
    return simplices.withColumn("_s", F.explode(shifts(periods))).withColumn("points", moved).drop("_s")


# Triangles -------------------------------------------------------------------------------------


def clip_polygon(poly: Column, lo: list[Column], hi: list[Column]) -> Column:
    """A polygon (array of x, y structs) cut by the four sides of a box, one after the other."""

    def side(a: float, b: float, c: Column) -> Column:
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("c"))

    def cut(p: Column, h: Column) -> Column:
        above = lambda v: h["a"] * v["x"] + h["b"] * v["y"] + h["c"]

        def edge(v: Column, i: Column) -> Column:
            u = F.get(p, F.when(i == 0, F.size(p) - 1).otherwise(i - 1))
            du, dv = above(u), above(v)
            t = du / F.when(du == dv, F.lit(1.0)).otherwise(du - dv)
            cross = F.struct((u["x"] + t * (v["x"] - u["x"])).alias("x"), (u["y"] + t * (v["y"] - u["y"])).alias("y"))
            none = F.filter(F.array(v), lambda _: F.lit(False))
            return F.concat(F.when((du < 0) != (dv < 0), F.array(cross)).otherwise(none), F.when(dv >= 0, F.array(v)).otherwise(none))

        return F.flatten(F.transform(p, edge))

    sides = F.array(side(1.0, 0.0, -lo[0]), side(-1.0, 0.0, hi[0]), side(0.0, 1.0, -lo[1]), side(0.0, -1.0, hi[1]))
    return F.aggregate(sides, poly, cut)


def polygon_moments(poly: Column, order: int) -> Column:
    """Integrals of monomials over a polygon, from its edges (Steger's formula)."""

    def edge(v: Column, i: Column) -> Column:
        u = F.get(poly, F.when(i == 0, F.size(poly) - 1).otherwise(i - 1))
        w = u["x"] * v["y"] - v["x"] * u["y"]
        out = []
        for p, q in K.multi_indices(2, order):
            parts = []
            for k in range(p + 1):
                for m in range(q + 1):
                    c = comb(k + m, m) * comb(p + q - k - m, q - m)
                    parts.append(reduce(lambda a, b: a * b, [F.lit(float(c)), A.power(v["x"], k), A.power(u["x"], p - k), A.power(v["y"], m), A.power(u["y"], q - m)]))
            out.append(w * A.added(parts) / ((p + q + 2) * (p + q + 1) * comb(p + q, p)))
        return F.array(*out)

    zero = F.array(*[F.lit(0.0)] * K.n_coeffs(2, order))
    return F.aggregate(F.transform(poly, edge), zero, lambda a, m: F.zip_with(a, m, lambda x, y: x + y))


def triangle_bounds(tri: DataFrame) -> DataFrame:
    """Adds ``lo``, ``hi`` of a triangle given by x1, y1 ... y3."""
    xs, ys = ["x1", "x2", "x3"], ["y1", "y2", "y3"]
    return tri.withColumn("lo", F.array(F.least(*xs), F.least(*ys)).cast("array<double>")).withColumn("hi", F.array(F.greatest(*xs), F.greatest(*ys)).cast("array<double>"))


def signed_area(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    return ((c("x2") - c("x1")) * (c("y3") - c("y1")) - (c("x3") - c("x1")) * (c("y2") - c("y1"))) / 2


def clip_batch(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polygons of a batch (rows) cut by the sides of their boxes: vertices and their number per row.

    One vertex of all rows at a time, so the work is a few dozen array operations per batch. A
    triangle cut four times has at most seven vertices.
    """
    rows = np.arange(len(x))
    n = np.full(len(x), x.shape[1])
    for axis, sign, at in ((0, 1, lo[:, 0]), (0, -1, hi[:, 0]), (1, 1, lo[:, 1]), (1, -1, hi[:, 1])):
        v = x if axis == 0 else y
        d = sign * (v - at[:, None])
        nx, ny, m = np.zeros((len(x), x.shape[1] + 1)), np.zeros((len(x), x.shape[1] + 1)), np.zeros(len(x), np.int64)
        last = np.maximum(n - 1, 0)
        ux, uy, du = x[rows, last], y[rows, last], d[rows, last]
        for k in range(x.shape[1]):
            live = k < n
            wx, wy, dw = x[:, k], y[:, k], d[:, k]
            cross = np.flatnonzero(live & ((du < 0) != (dw < 0)))
            t = du[cross] / (du[cross] - dw[cross])
            nx[cross, m[cross]] = ux[cross] + t * (wx[cross] - ux[cross])
            ny[cross, m[cross]] = uy[cross] + t * (wy[cross] - uy[cross])
            m[cross] += 1
            keep = np.flatnonzero(live & (dw >= 0))
            nx[keep, m[keep]], ny[keep, m[keep]] = wx[keep], wy[keep]
            m[keep] += 1
            ux, uy, du = np.where(live, wx, ux), np.where(live, wy, uy), np.where(live, dw, du)
        x, y, n = nx, ny, m
    return x, y, n


def moments_batch(x: np.ndarray, y: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Steger's edge sums for all polygons of a batch."""
    ix = K.multi_indices(2, order)
    out = np.zeros((len(x), len(ix)))
    rows = np.arange(len(x))
    last = np.maximum(n - 1, 0)
    ux, uy = x[rows, last], y[rows, last]
    for k in range(x.shape[1]):
        live = k < n
        vx, vy = x[:, k], y[:, k]
        w = np.where(live, ux * vy - vx * uy, 0.0)
        px, pu, py, pv = ([c**i for i in range(order + 1)] for c in (vx, ux, vy, uy))
        for c, (p, q) in enumerate(ix):
            term = sum(comb(i + j, j) * comb(p + q - i - j, q - j) * px[i] * pu[p - i] * py[j] * pv[q - j] for i in range(p + 1) for j in range(q + 1))
            out[:, c] += w * term / ((p + q + 2) * (p + q + 1) * comb(p + q, p))
        ux, uy = np.where(live, vx, ux), np.where(live, vy, uy)
    return out


def overlap_triangles(tri: DataFrame, boxes: DataFrame, order: int = 0, side: list[float] | None = None, columns_only: bool = False) -> DataFrame:
    """``lag_idx``, ``eul_idx``, ``volume``, ``centroid``, ``moments`` of triangles (``id``, x1 ... y3)
    with boxes (``id``, ``lo``, ``hi``). Triangles of negative area are turned, degenerate ones left out.

    Pairs come from the tile join. Their measures are taken in Arrow batches, which is some tens of
    times faster here than the same as column expressions (``columns_only``).
    """
    corners = [f"{c}{k}" for k in (1, 2, 3) for c in "xy"]
    sound = triangle_bounds(tri.where(signed_area() != 0))
    pairs = box_pairs(sound.select("id", "lo", "hi", *corners), boxes.select("id", "lo", "hi"), 2, side)
    get = lambda c, d: F.get(c, F.lit(d))
    if columns_only:
        corner = lambda k: F.struct(F.col(f"a_x{k}").cast("double").alias("x"), F.col(f"a_y{k}").cast("double").alias("y"))
        poly = F.when(signed_area("a_") > 0, F.array(corner(1), corner(2), corner(3))).otherwise(F.array(corner(1), corner(3), corner(2)))
        clipped = clip_polygon(poly, [get("b_lo", 0), get("b_lo", 1)], [get("b_hi", 0), get("b_hi", 1)])
        cut = bound(pairs, "poly", clipped).select(F.col("a_id").alias("lag_idx"), F.col("b_id").alias("eul_idx"), "poly")
        measured = bound(cut, "moments", polygon_moments(F.col("poly"), order)).select("lag_idx", "eul_idx", "moments")
        v = A.moment_volume(F.col("moments"))
        middle = A.moment_centroid(F.col("moments"), 2) if order else F.array(F.lit(0.0), F.lit(0.0))
        return measured.where(v > 0).select("lag_idx", "eul_idx", v.alias("volume"), middle.alias("centroid"), "moments")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([col.to_numpy(zero_copy_only=False) for col in batch.columns[2:]], axis=1) if batch.num_rows else np.zeros((0, 10))
            x, y = c[:, [0, 2, 4]], c[:, [1, 3, 5]]
            turned = (x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) < (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])
            x[turned], y[turned] = x[turned][:, [0, 2, 1]], y[turned][:, [0, 2, 1]]
            m = moments_batch(*clip_batch(x, y, c[:, 6:8], c[:, 8:10]), order)
            hit = m[:, 0] > 0
            m = m[hit]
            middle = m[:, 1:3] / m[:, :1] if order else np.zeros((len(m), 2))
            who = pa.array(np.flatnonzero(hit))
            rows = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(m[:, 0]), rows(middle), rows(m)], ["lag_idx", "eul_idx", "volume", "centroid", "moments"])

    flat = pairs.select("a_id", "b_id", *[F.col("a_" + c).cast("double").alias(c) for c in corners], *[get("b_" + c, d).cast("double").alias(f"{c}{d}") for c in ("lo", "hi") for d in range(2)])
    kinds = dict(flat.dtypes)
    return flat.mapInArrow(measure, f"lag_idx {kinds['a_id']}, eul_idx {kinds['b_id']}, volume double, centroid array<double>, moments array<double>")


# Simplices of any dimension, in floating point or exactly ----------------------------------------


# A batch of simplices is an array (simplex, vertex, coordinate). Coordinates are homogeneous: the
# last one is what the others are divided by. In floating point it is 1; on the integer lattice
# nothing is divided before the end, and the arrays hold Python's integers, which don't overflow.


def cut_at(points: np.ndarray, owner: np.ndarray, axis: int, at: np.ndarray, keep_above: bool, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pieces on one side of a plane per owner: an edge that crosses is divided at the plane, all
    simplices of the batch at a time, until none crosses."""
    done, owners = [], []
    rows = np.arange
    while len(points):
        d = points[:, :, axis] - at[owner][:, None] * points[:, :, -1]
        d = d if keep_above else -d
        below, above = d < 0, d > 0
        inside = above.any(axis=1) & ~below.any(axis=1)
        done.append(points[inside])
        owners.append(owner[inside])
        crossing = above.any(axis=1) & below.any(axis=1)
        p, d, own = points[crossing], d[crossing], owner[crossing]
        if not len(p):
            break
        k = rows(len(p))
        i, j = below[crossing].argmax(axis=1), above[crossing].argmax(axis=1)
        on = p[k, i] * d[k, j][:, None] - p[k, j] * d[k, i][:, None]
        if exact:
            on //= np.gcd.reduce(on, axis=1)[:, None]
        else:
            on /= on[:, -1:]
            on[:, axis] = at[own]
        first, second = p.copy(), p.copy()
        first[k, i], second[k, j] = on, on
        points, owner = np.concatenate([first, second]), np.concatenate([own, own])
    shape = (0, *points.shape[1:])
    return np.concatenate([np.empty(shape, points.dtype), *done]), np.concatenate([np.empty(0, np.int64), *owners])


def determinants(m: np.ndarray) -> np.ndarray:
    """Of a batch of small square matrices, by their first row; exact for integers and fractions."""
    if m.shape[1] == 1:
        return m[:, 0, 0]
    minors = (determinants(np.delete(m[:, 1:], k, axis=2)) for k in range(m.shape[1]))
    return sum((-1) ** k * m[:, 0, k] * d for k, d in enumerate(minors))


def simplex_moments(points: np.ndarray, order: int) -> list[np.ndarray]:
    """Integrals of monomials over simplices (plain coordinates): powers of their affine maps, term by term."""
    dim = points.shape[2]
    one = Fraction(1) if points.dtype == object else 1.0
    edges = points[:, 1:] - points[:, :1]
    jac = np.abs(determinants(edges))
    unit = [tuple(int(j == k) for j in range(dim)) for k in range(dim)]
    maps = [{(0,) * dim: points[:, 0, a]} | {unit[k]: edges[:, k, a] for k in range(dim)} for a in range(dim)]
    out = []
    for e in K.multi_indices(dim, order):
        poly = {(0,) * dim: one}
        for a, n in enumerate(e):
            for _ in range(n):
                new: dict = {}
                for x, u in poly.items():
                    for y, v in maps[a].items():
                        key = tuple(i + j for i, j in zip(x, y, strict=True))
                        new[key] = new.get(key, 0) + u * v
                poly = new
        # Over the unit simplex a monomial has the integral of its factorials over that of all.
        out.append(sum(c * (one * prod(map(factorial, g)) / factorial(sum(g) + dim)) for g, c in poly.items()) * jac)
    return out


def simplex_boxes(points: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: int) -> np.ndarray:
    """Moments of each simplex within its box, a row each; exact if the coordinates are Python's integers."""
    n, corners, dim = points.shape
    exact = points.dtype == object
    ones = np.full((n, corners, 1), 1, object) if exact else np.ones((n, corners, 1))
    pieces, owner = np.concatenate([points, ones], axis=2), np.arange(n)
    for a in range(dim):
        for at, above in ((lo[:, a], True), (hi[:, a], False)):
            pieces, owner = cut_at(pieces, owner, a, at, above, exact)
    plain = pieces[:, :, :-1]
    if exact and len(pieces):
        plain = np.frompyfunc(Fraction, 2, 1)(plain, pieces[:, :, -1:])
    out = np.full((n, K.n_coeffs(dim, order)), Fraction(0) if exact else 0.0)
    if len(pieces):
        for k, m in enumerate(simplex_moments(plain, order)):
            np.add.at(out[:, k], owner, m)
    return out


def along(points: str, axis: int) -> Column:
    """One coordinate of all points of an array."""
    return F.transform(points, lambda p: F.get(p, F.lit(axis)))


#: Pairs that are measured together.
PAIRS = 2048


def whole(x: np.ndarray) -> np.ndarray:
    """Python's integers."""
    return np.frompyfunc(int, 1, 1)(np.rint(x))



def unit_cells(simplices: DataFrame, dim: int) -> DataFrame:
    """``id``, ``lo``, ``hi`` of all boxes of side 1 with integer corners that the bounding boxes of
    ``simplices`` (``points``) reach into, wherever they lie; the id is the low corner."""
    for d in range(dim):
        x = along("points", d)
        low = F.floor(F.array_min(x))
        simplices = simplices.withColumn(f"_{d}", F.explode(F.sequence(low, F.greatest(low, F.ceil(F.array_max(x)) - 1))))
    at = simplices.select(F.array(*[f"_{d}" for d in range(dim)]).alias("id")).distinct()
    return at.select("id", F.transform("id", lambda i: i.cast("double")).alias("lo"), F.transform("id", lambda i: i + 1.0).alias("hi"))


def overlap_simplices(simplices: DataFrame, boxes: DataFrame, dim: int, order: int = 0, exact_bits: int | None = None, side: list[float] | None = None, lattice: tuple[list[float], float] | None = None) -> DataFrame:
    """Simplices (``id``, ``points`` array of arrays) with boxes (``id``, ``lo``, ``hi``).

    With ``exact_bits`` all coordinates are put on an integer lattice over the boxes first (or on
    the one of a given origin and steps per unit, ``lattice``), and measured in integers and
    rational numbers; results come back in the original units. ``drop_kind`` tells why a candidate pair
    has no volume: ``flat`` (the simplex has none of its own), ``empty``, or ``none`` for pairs that have.
    """
    axes = [along("points", d) for d in range(dim)]
    bounds = simplices.withColumn("lo", F.array(*map(F.array_min, axes))).withColumn("hi", F.array(*map(F.array_max, axes)))
    pairs = box_pairs(bounds.select("id", "lo", "hi", "points"), boxes.select("id", "lo", "hi"), dim, side).select("a_id", "b_id", "a_points", "b_lo", "b_hi")
    if exact_bits and lattice is None:
        r = boxes.agg(*[F.min(F.get("lo", F.lit(d))) for d in range(dim)], *[F.max(F.get("hi", F.lit(d))) for d in range(dim)]).first()
        if r[0] is not None:
            lattice = list(r[:dim]), ((1 << exact_bits) - 1) / max(h - x for x, h in zip(r[:dim], r[dim:], strict=True))
    ix = K.multi_indices(dim, order)

    def in_units(m: np.ndarray) -> np.ndarray:
        base, scale = lattice
        raw = m.astype(float) / [scale ** (dim + sum(e)) for e in ix]
        return np.array([shifted(row, [-o for o in base], dim, order) for row in raw.tolist()]).reshape(raw.shape)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        values = lambda k, *shape: np.array(batch.column(k).flatten().to_pylist() if k > 2 else batch.column(k).flatten().flatten().to_pylist(), float).reshape(n, *shape)
        points, lo, hi = values(2, dim + 1, dim), values(3, dim), values(4, dim)
        if lattice is not None:
            points, lo, hi = (whole((x - np.array(lattice[0])) * lattice[1]) for x in (points, lo, hi))
        flat = determinants(points[:, 1:] - points[:, :1]) == 0
        m = simplex_boxes(points, lo, hi, order)
        m = np.asarray(m if lattice is None else in_units(m), float).reshape(n, len(ix))
        some = m[:, 0] > 0
        m = np.where(some[:, None], m, 0.0)
        middle = m[:, 1 : dim + 1] / np.where(some, m[:, 0], 1.0)[:, None] if order else np.zeros((n, dim))
        kind = np.where(some, "none", np.where(flat.astype(bool), "flat", "empty"))
        rows = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m[:, 0]), rows(middle), rows(m), pa.array(kind.tolist(), pa.string())], ["lag_idx", "eul_idx", "volume", "centroid", "moments", "drop_kind"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                yield measured(batch.slice(i, PAIRS))

    kinds = dict(pairs.dtypes)
    doubles = lambda c: F.transform(c, lambda x: x.cast("double")).alias(c)
    flat = pairs.select("a_id", "b_id", F.transform("a_points", lambda p: F.transform(p, lambda x: x.cast("double"))).alias("a_points"), doubles("b_lo"), doubles("b_hi"))
    return flat.mapInArrow(measure, f"lag_idx {kinds['a_id']}, eul_idx {kinds['b_id']}, volume double, centroid array<double>, moments array<double>, drop_kind string")


def shifted(m: list[float], delta: list[float], dim: int, order: int) -> list[float]:
    """Moments about an origin moved by ``delta``."""
    ix = K.multi_indices(dim, order)
    return [sum(m[j] * float(np.prod([comb(p, q) * (-d) ** (p - q) for p, q, d in zip(a, b, delta, strict=True)])) for j, b in enumerate(ix) if all(q <= p for p, q in zip(a, b, strict=True))) for a in ix]


# Reports ---------------------------------------------------------------------------------------


def per_side(ov: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Number of entries per id of one side, 0 where there are none (``every`` has column ``id``)."""
    n = ov.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return every.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def describe(ov: DataFrame) -> DataFrame:
    """One row: entries, total volume, volume percentiles, extremes (least pair first)."""
    p = F.percentile("volume", F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.9, 1.0)]))
    pair = F.struct("lag_idx", "eul_idx")
    return ov.agg(F.count(F.lit(1)).alias("n_entries"), F.sum("volume").alias("total_volume"), p.alias("p"), F.min_by(pair, F.struct("volume", "lag_idx", "eul_idx")).alias("least"), F.max_by(pair, F.struct(F.col("volume"), -F.col("lag_idx"), -F.col("eul_idx"))).alias("most"))


def pair_differences(a: DataFrame, b: DataFrame, dim: int = 0, atol: float = 1e-10) -> DataFrame:
    """Per pair of either side: volumes in floating point (``a``) and exactly (``b``), the absolute and
    relative difference, that of the centroids (of the first ``dim`` axes), and ``kind``: ``exact_dropped``,
    ``float_missing``, ``volume_mismatch``, ``centroid_mismatch`` or ``same``."""
    cols = lambda df, p: df.select("lag_idx", "eul_idx", F.col("volume").alias(p + "_volume"), *([F.col("centroid").alias(p + "_centroid")] if dim else []))
    j = cols(a, "float").join(cols(b, "exact"), ["lag_idx", "eul_idx"], "full_outer")
    u, v = F.coalesce("float_volume", F.lit(0.0)), F.coalesce("exact_volume", F.lit(0.0))
    off = [F.abs(F.get("float_centroid", F.lit(d)) - F.get("exact_centroid", F.lit(d))) for d in range(dim)]
    far = F.coalesce(F.greatest(*off) if dim > 1 else off[0], F.lit(0.0)) if dim else F.lit(0.0)
    j = j.withColumn("volume_diff", F.abs(u - v)).withColumn("rel_diff", F.coalesce(F.abs(u - v) / F.nullif(F.greatest(F.abs(u), F.abs(v)), F.lit(0.0)), F.lit(0.0))).withColumn("centroid_diff", far)
    kind = F.when(F.col("volume_diff") <= atol, F.when(F.col("centroid_diff") > atol, "centroid_mismatch").otherwise("same"))
    kind = kind.when(F.col("exact_volume").isNull(), "exact_dropped").when(F.col("float_volume").isNull(), "float_missing").otherwise("volume_mismatch")
    return j.select("lag_idx", "eul_idx", kind.alias("kind"), "float_volume", "exact_volume", "volume_diff", "rel_diff", "centroid_diff")


def audit(a: DataFrame, b: DataFrame, atol: float = 1e-10, top: int = 32, dim: int = 0) -> DataFrame:
    """Entries of ``a`` (float) and ``b`` (exact) that disagree, worst first."""
    bad = pair_differences(a, b, dim, atol).where("kind <> 'same'")
    return bad.orderBy(F.desc("volume_diff"), "lag_idx", "eul_idx").limit(top)


def audit_summary(a: DataFrame, b: DataFrame, dim: int = 0, atol: float = 1e-10) -> DataFrame:
    """One row: pairs, how many agree and not, and the greatest relative difference."""
    d = pair_differences(a, b, dim, atol)
    return d.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("kind") == "same").alias("n_same"), F.count_if(F.col("kind") != "same").alias("n_failed"), F.coalesce(F.max("rel_diff"), F.lit(0.0)).alias("max_rel_diff"))


def drop_report(measured: DataFrame) -> DataFrame:
    """Candidate pairs by ``drop_kind``, with the least pair of each; all kinds but ``none`` have no entry."""
    pair = F.struct("lag_idx", "eul_idx")
    return measured.groupBy("drop_kind").agg(F.count(F.lit(1)).alias("n"), F.min(pair).alias("first"))
