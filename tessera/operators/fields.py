"""Fields on cells: initialisation by projection, and transfer through refinement and coarsening."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.grid import parent_path
from tessera.plans import constants as K
from tessera.plans.store import bound

Function = Callable[[list[Column]], Column]


def allocate(cells: DataFrame, name: str, n: int = 1) -> DataFrame:
    """A zero field: one number, or n coefficients or samples per cell."""
    return cells.withColumn(name, F.lit(0.0) if n == 1 else F.array_repeat(F.lit(0.0), n))


def resized(field: DataFrame, every: DataFrame, key: str = "cell_id") -> DataFrame:
    """The field on another set of cells; new cells have null."""
    return every.select(key).join(field, key, "left")


def _projection(kind: str, dim: int, order: int, basis: str, quadrature: int) -> tuple[list[tuple[float, ...]], np.ndarray]:
    """Nodes, and the matrix from values at the nodes to coefficients."""
    nodes, weights = K.gauss_box(dim, -(-(quadrature + 1) // 2)) if kind == "box" else K.gauss_simplex(dim, quadrature)
    phi = np.array([K.basis_values(basis, dim, order, x) for x in nodes])
    mass = (phi * np.array(weights)[:, None]).T @ phi
    return nodes, np.linalg.solve(mass, (phi * np.array(weights)[:, None]).T)


def init_on_boxes(cells: DataFrame, f: Function, dim: int, order: int, basis: str = "monomial", quadrature: int | None = None) -> DataFrame:
    """Adds ``coeffs``: the L2 projection of f on every cell (``lo``, ``hi``), leaf or not.

    f is evaluated at the quadrature nodes in place and multiplied by one constant matrix, so there
    is neither a join nor a shuffle.
    """
    nodes, m = _projection("box", dim, order, basis, 2 * order + 1 if quadrature is None else quadrature)
    lo, hi = [F.get("lo", F.lit(d)) for d in range(dim)], [F.get("hi", F.lit(d)) for d in range(dim)]
    values = F.array(*[f([a + (b - a) * t for a, b, t in zip(lo, hi, x, strict=True)]) for x in nodes])
    return bound(bound(cells, "_f", values), "coeffs", A.matrix_times(m, F.col("_f"))).drop("_f")


def init_on_simplices(simplices: DataFrame, f: Function, dim: int, order: int, basis: str = "monomial", quadrature: int | None = None) -> DataFrame:
    """The same on simplices (``points``)."""
    nodes, m = _projection("simplex", dim, order, basis, 2 * order + 1 if quadrature is None else quadrature)
    p = lambda k, d: F.get(F.get("points", F.lit(k)), F.lit(d))
    values = F.array(*[f([p(0, d) + A.added([(p(k + 1, d) - p(0, d)) * t for k, t in enumerate(x)]) for d in range(dim)]) for x in nodes])
    return bound(bound(simplices, "_f", values), "coeffs", A.matrix_times(m, F.col("_f"))).drop("_f")


def refined(field: DataFrame, cells: DataFrame) -> DataFrame:
    """Values after a refinement: cells that were there keep theirs, new ones copy the parent's."""
    own = cells.select("path").join(field, "path", "left").withColumnRenamed("value", "_own")
    up = field.select(F.col("path").alias("_up"), F.col("value").alias("_parent"))
    return own.withColumn("_up", parent_path(F.col("path"))).join(up, "_up", "left").select("path", F.coalesce("_own", "_parent").alias("value"))


def coarsened_mean(field: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Values after a coarsening: parents that lost their children get the mean of them."""
    gone = before.where("is_leaf").select("path").join(after.select("path"), "path", "left_anti")
    means = gone.join(field, "path").groupBy(parent_path(F.col("path")).alias("path")).agg(F.avg("value").alias("_mean"))
    return after.select("path").join(field, "path", "left").join(means, "path", "left").select("path", F.coalesce("_mean", "value").alias("value"))


def coarsened_projection(field: DataFrame, before: DataFrame, after: DataFrame, dim: int, order: int, basis: str = "monomial") -> DataFrame:
    """The same for ``coeffs``: the exact L2 projection from the children, by constant matrices."""
    n = K.n_coeffs(dim, order)
    gone = before.where("is_leaf").join(after.select("path"), "path", "left_anti").join(field, "path").select("path", "sibling_index", "split_mask", "coeffs")
    to, back = (np.eye(n), np.eye(n)) if basis == "monomial" else (K.bernstein_to_monomial(dim, order), K.monomial_to_bernstein(dim, order))
    share = F.lit(None).cast("array<double>")
    for mask in range(1, 1 << dim):
        for k in range(1 << mask.bit_count()):
            hit = (F.col("split_mask") == mask) & (F.col("sibling_index") == k)
            share = F.when(hit, A.matrix_times(back @ K.child_matrix(dim, order, mask, k) @ to, F.col("coeffs"))).otherwise(share)
    parts = gone.select(parent_path(F.col("path")).alias("path"), share.alias("s")).select("path", *[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(n)])
    sums = parts.groupBy("path").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).select("path", F.array(*[f"s{i}" for i in range(n)]).alias("_new"))
    return after.select("path").join(field, "path", "left").join(sums, "path", "left").select("path", F.coalesce("_new", "coeffs").alias("coeffs"))


def strictly_positive(field: DataFrame, atol: float = 0.0) -> DataFrame:
    """First cell and coefficient at which a Bernstein field may fail to be positive; no row if none."""
    bad = field.select("path", A.first_not_positive(F.col("coeffs"), atol).alias("at")).where("at > 0")
    return bad.agg(F.min(F.struct("path", "at")).alias("m")).where("m is not null").select("m.path", "m.at")


def gradient_indicator(field: DataFrame, nbrs: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell``, ``value``: greatest difference to the lowest-numbered neighbour of each face; 0 off leaves."""
    first = nbrs.groupBy("cell", "axis", "side").agg(F.min("nbr").alias("nbr"))
    own, other = field.select("cell", F.col("value").alias("a")), field.select(F.col("cell").alias("nbr"), F.col("value").alias("b"))
    jumps = first.join(own, "cell").join(other, "nbr").groupBy("cell").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("value"))
    return cells.select(F.col("cell_id").alias("cell")).join(jumps, "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("value"))
