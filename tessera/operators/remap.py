"""Remapping of fields through an overlap: a join and a weighted group-by.

Overlaps have a source key, a target key and ``volume``. Targets that nothing covers get 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import arrays as A
from tessera.functions import scalars as S
from tessera.functions import simplex as X
from tessera.plans import constants as K


def _filled(got: DataFrame, every: DataFrame, cols: list[str]) -> DataFrame:
    return every.select("id").join(got, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def mean(ov: DataFrame, src: DataFrame, every: DataFrame, source: str = "lag_idx", target: str = "eul_idx") -> DataFrame:
    """Volume-weighted mean of ``src(id, value)`` per target."""
    j = ov.join(src.select(F.col("id").alias(source), "value"), source)
    got = j.groupBy(F.col(target).alias("id")).agg((F.sum(F.col("volume") * F.col("value")) / F.sum("volume")).alias("value"))
    return _filled(got, every, ["value"])


def flux(ov: DataFrame, src: DataFrame, every: DataFrame, source: str = "lag_idx", target: str = "eul_idx") -> DataFrame:
    """Each source value is shared out by volume, over the covered volume of the source.

    The covered volumes are a group-by joined back by source, so that no window has to hold all
    entries of a source at once.
    """
    covered = ov.groupBy(source).agg(F.sum("volume").alias("_covered"))
    weighted = src.select(F.col("id").alias(source), "value").join(covered, source).select(source, (F.col("value") / F.col("_covered")).alias("_per"))
    got = ov.join(weighted, source).groupBy(F.col(target).alias("id")).agg(F.sum(F.col("_per") * F.col("volume")).alias("value"))
    return _filled(got, every, ["value"])


def covariance(ov: DataFrame, src: DataFrame, every: DataFrame, source: str = "lag_idx", target: str = "eul_idx") -> DataFrame:
    """Mean and total variance (within and between sources) of ``src(id, mu, var)``."""
    j = ov.join(src.select(F.col("id").alias(source), "mu", "var"), source)
    means = j.groupBy(target).agg((F.sum(F.col("volume") * F.col("mu")) / F.sum("volume")).alias("m"))
    spread = j.join(means, target)
    got = spread.groupBy(F.col(target).alias("id")).agg(F.first("m").alias("mu"), (F.sum(F.col("volume") * (F.col("var") + (F.col("mu") - F.col("m")) * (F.col("mu") - F.col("m")))) / F.sum("volume")).alias("var"))
    return _filled(got, every, ["mu", "var"])


def cumulants(order: int) -> None:
    """Cumulants up to 2 are ``mean`` and ``covariance``; higher ones don't exist."""
    if order <= 2:
        raise ValueError("use mean or covariance")
    raise NotImplementedError("cumulants above 2")


KINDS = {"mass_weighted_average": mean, "conservative_flux": flux, "total_covariance": covariance}


def by_kind(kind: str, ov: DataFrame, src: DataFrame, every: DataFrame, source: str = "lag_idx", target: str = "eul_idx") -> DataFrame:
    """A remap by the name of its kind; cumulants of any order are refused as ``cumulants`` says."""
    if kind.startswith("total_cumulants_"):
        cumulants(int(kind.rpartition("_")[2]))
    return KINDS[kind](ov, src, every, source, target)


# Polynomials -----------------------------------------------------------------------------------


def box_pullback(lo: list[Column], hi: list[Column], order: int) -> Column:
    """Rows a: the monomial xi^a of the reference box as a polynomial in x."""
    dim = len(lo)
    ix = K.multi_indices(dim, order)
    rows = []
    for a in ix:
        row = []
        for b in ix:
            if any(q > p for p, q in zip(a, b, strict=True)):
                row.append(F.lit(0.0))
                continue
            v = F.lit(1.0)
            for d, (p, q) in enumerate(zip(a, b, strict=True)):
                if p:
                    h = hi[d] - lo[d]
                    v = v * (float(np.prod([(p - i) / (i + 1) for i in range(q)])) * A.power(-lo[d], p - q) / A.power(h, p))
            row.append(v)
        rows.append(F.array(*row))
    return F.array(*rows)


def simplex_pullback(points: list[list[Column]], order: int) -> Column:
    """The same for a simplex: xi = inv(E) (x - v0), expanded term by term. Null for flat simplices."""
    dim = len(points[0])
    inv = X.inverse(X.edge_matrix(points))
    unit = [tuple(int(j == k) for j in range(dim)) for k in range(dim)]
    lines = [{(0,) * dim: -A.added([inv[d][k] * points[0][k] for k in range(dim)])} | {unit[k]: inv[d][k] for k in range(dim)} for d in range(dim)]
    ix = K.multi_indices(dim, order)
    rows = []
    for a in ix:
        poly: dict = {(0,) * dim: F.lit(1.0)}
        for d, n in enumerate(a):
            for _ in range(n):
                new: dict = {}
                for x, u in poly.items():
                    for y, v in lines[d].items():
                        new.setdefault(tuple(i + j for i, j in zip(x, y, strict=True)), []).append(u * v)
                poly = {e: A.added(parts) for e, parts in new.items()}
        rows.append(F.array(*[poly.get(e, F.lit(0.0)).cast("double") for e in ix]))
    return F.array(*rows)


def polynomial(ov: DataFrame, src: DataFrame, dst: DataFrame, dim: int, p_src: int, p_dst: int, kind: str = "box", source: str = "lag_idx", target: str = "eul_idx") -> DataFrame:
    """Conservative L2 remap of coefficients between boxes or simplices.

    ``src(id, coeffs, pullback)``, ``dst(id, pullback, jacobian)``; pullbacks map reference monomials
    to physical ones, moments are physical and of order p_src + p_dst. As the mass matrix on the
    reference cell is the same for all cells, its inverse is one constant matrix.
    """
    order = p_src + p_dst
    n_src, n_dst = K.n_coeffs(dim, p_src), K.n_coeffs(dim, p_dst)
    at = {e: i for i, e in enumerate(K.multi_indices(dim, order))}
    own = F.array(*[A.added([A.coef(F.col("coeffs"), a) * A.coef(A.coef(F.col("pullback"), a), d) for a in range(n_src)]) for d in range(n_src)])
    known = src.select(F.col("id").alias(source), own.alias("_p"))
    per = []
    for g in K.multi_indices(dim, p_dst):
        per.append(A.added([A.coef(F.col("_p"), d) * A.coef(F.col("moments"), at[tuple(x + y for x, y in zip(g, e, strict=True))]) for d, e in enumerate(K.multi_indices(dim, p_src))]))
    parts = ov.join(known, source).select(F.col(target).alias("id"), *[v.alias(f"g{i}") for i, v in enumerate(per)])
    sums = parts.groupBy("id").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(n_dst)])
    rhs = F.array(*[A.added([A.coef(A.coef(F.col("pullback"), a), g) * F.col(f"g{g}") for g in range(n_dst)]) for a in range(n_dst)])
    solved = dst.join(sums, "id", "left").select("id", "jacobian", rhs.alias("_rhs"))
    inverse = np.linalg.inv(K.mass_matrix(kind, dim, p_dst))
    scaled = F.transform(A.matrix_times(inverse, F.col("_rhs")), lambda v: F.coalesce(v / F.abs(F.col("jacobian")), F.lit(0.0)))
    return solved.select("id", scaled.alias("coeffs"))


def box_frame(cells: DataFrame, dim: int, order: int) -> DataFrame:
    """``id``, ``pullback``, ``jacobian`` of boxes (``lo``, ``hi``): what ``polynomial`` needs to know of a side."""
    lo, hi = ([F.get(c, F.lit(d)) for d in range(dim)] for c in ("lo", "hi"))
    return cells.select("id", box_pullback(lo, hi, order).alias("pullback"), S.product([h - a for a, h in zip(lo, hi, strict=True)]).alias("jacobian"))


def simplex_frame(simplices: DataFrame, dim: int, order: int) -> DataFrame:
    """The same of simplices (``points``); the Jacobian is signed."""
    corners = [[F.get(F.get("points", F.lit(k)), F.lit(d)) for d in range(dim)] for k in range(dim + 1)]
    return simplices.select("id", simplex_pullback(corners, order).alias("pullback"), X.det(X.edge_matrix(corners)).alias("jacobian"))


def polynomial_fields(ov: DataFrame, fields: DataFrame, names: list[str], src_frame: DataFrame, dst_frame: DataFrame, dim: int, p_src: int, p_dst: int, kind: str = "box", source: str = "lag_idx", target: str = "eul_idx") -> DataFrame:
    """Several fields by name: ``fields(id, <names>)`` hold coefficients on the source side; returns the same
    columns on the target side."""
    out = dst_frame.select("id")
    for name in names:
        src = src_frame.join(fields.select("id", F.col(name).alias("coeffs")), "id")
        out = out.join(polynomial(ov, src, dst_frame, dim, p_src, p_dst, kind, source, target).withColumnRenamed("coeffs", name), "id", "left")
    return out


def diagnostics(ov: DataFrame, volumes: DataFrame, source: str = "lag_idx") -> DataFrame:
    """One row: extremes of volume / |source volume|, total, entries without volume."""
    j = ov.join(volumes.select(F.col("id").alias(source), F.abs("volume").alias("_v")), source)
    r = F.col("volume") / F.col("_v")
    return j.agg(F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"), F.sum("volume").alias("total"), F.count_if(F.col("volume") <= 0).alias("n_nonpositive"))


def density(ov: DataFrame, factors: DataFrame, cells: DataFrame) -> DataFrame:
    """Mass per cell volume: sum of factor times overlap over the cell's volume."""
    j = ov.join(factors.select(F.col("id").alias("lag_idx"), "factor"), "lag_idx")
    got = j.groupBy(F.col("eul_idx").alias("id")).agg(F.sum(F.col("factor") * F.col("volume")).alias("mass"))
    return cells.select("id", "volume").join(got, "id", "left").select("id", (F.coalesce("mass", F.lit(0.0)) / F.col("volume")).alias("rho"))


def best_source(ov: DataFrame, source: str = "a_id", target: str = "b_id") -> DataFrame:
    """Per target the source with the largest overlap; of equals the lowest id."""
    return ov.groupBy(target).agg(F.max_by(source, F.struct(F.col("volume"), -F.col(source))).alias(source))


def shares(ov: DataFrame, source: str = "lag_idx") -> DataFrame:
    """Each entry's share of its source's covered volume."""
    return ov.withColumn("share", F.col("volume") / F.sum("volume").over(W.partitionBy(source)))
