"""Simplex geometry in columns: signed volume, deformation gradient, distortion, edges, vertices."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import total

Points = list[list[Column]]


def edge_matrix(p: Points) -> list[list[Column]]:
    """Rows are axes, columns the edges from the first vertex."""
    return [[q[a] - p[0][a] for q in p[1:]] for a in range(len(p[0]))]


def det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    return total([(1 if j % 2 == 0 else -1) * m[0][j] * det([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m))])


def volume(p: Points) -> Column:
    """Signed length, area or volume."""
    return det(edge_matrix(p)) / {1: 1, 2: 2, 3: 6}[len(p[0])]


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    n, d = len(m), det(m)
    if n == 1:
        return [[F.try_divide(F.lit(1.0), m[0][0])]]
    minor = lambda i, j: det([r[:j] + r[j + 1 :] for k, r in enumerate(m) if k != i])
    return [[F.try_divide((1 if (i + j) % 2 == 0 else -1) * minor(j, i), d) for j in range(n)] for i in range(n)]


def times(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[total([x * y for x, y in zip(r, c, strict=True)]) for c in zip(*b, strict=True)] for r in a]


def deformation_gradient(cur: Points, ref: Points) -> list[list[Column]]:
    """F with dx = F dX."""
    return times(edge_matrix(cur), inverse(edge_matrix(ref)))


def volume_jacobian(cur: Points, ref: Points) -> Column:
    return F.try_divide(volume(cur), volume(ref))


def norm(m: list[list[Column]]) -> Column:
    return F.sqrt(total([x * x for r in m for x in r]))


def distortion(cur: Points, ref: Points) -> Column:
    """|F| |inv F| / D: 1 for similar simplices, null for degenerate ones."""
    f = deformation_gradient(cur, ref)
    return norm(f) * norm(inverse(f)) / len(cur[0])


def inverted(cur: Points, ref: Points) -> Column:
    """Aggregate: whether any simplex is degenerate or turned over."""
    v, r = volume(cur), volume(ref)
    return F.bool_or((v == 0) | (F.signum(v) != F.signum(r)))


def edges(simplices: DataFrame) -> DataFrame:
    """Distinct pairs (``a`` < ``b``) of vertices of simplices (``vids``)."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("vids") - 2), lambda i: F.transform(F.sequence(i + 1, F.size("vids") - 1), lambda j: F.struct(F.least(F.get("vids", i), F.get("vids", j)).alias("a"), F.greatest(F.get("vids", i), F.get("vids", j)).alias("b")))))
    return simplices.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()


def with_positions(simplices: DataFrame, vertices: DataFrame) -> DataFrame:
    """``sid`` and ``points`` in the order of ``vids``; vertices are looked up by a join."""
    each = simplices.select("sid", F.posexplode("vids").alias("k", "vid")).join(vertices.select("vid", "pos"), "vid")
    return each.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pos"))), lambda s: s["pos"]).alias("points"))


def unit_square_mesh(spark, n: int) -> tuple[DataFrame, DataFrame]:
    """n x n vertices and 2 (n - 1)^2 triangles of the unit square."""
    v = spark.range(n * n).select(F.col("id").alias("vid"), F.array((F.col("id") % n) / (n - 1), F.floor(F.col("id") / n) / (n - 1)).alias("pos"))
    m = n - 1
    i, j = F.col("id") % m, F.floor(F.col("id") / m)
    at = lambda a, b: (i + a + n * (j + b)).cast("long")
    t = spark.range(m * m).select("id", F.explode(F.array(F.struct(F.lit(0).alias("h"), F.array(at(0, 0), at(1, 0), at(0, 1)).alias("vids")), F.struct(F.lit(1).alias("h"), F.array(at(1, 0), at(1, 1), at(0, 1)).alias("vids")))).alias("t"))
    return v, t.select((F.col("id") * 2 + F.col("t.h")).alias("sid"), F.col("t.vids").alias("vids"))
