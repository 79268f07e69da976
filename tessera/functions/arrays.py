"""Column functions over coefficient and moment arrays. Constants are unrolled into arithmetic, so
that expressions stay in generated code."""

from __future__ import annotations

from functools import reduce
from math import comb, prod

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans import constants as K


def power(x: Column, n: int) -> Column:
    return F.lit(1.0) if n == 0 else reduce(lambda a, b: a * b, [x] * n)


def added(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) if cols else F.lit(0.0)


def coef(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i))


def matrix_times(m: np.ndarray, c: Column) -> Column:
    """Constant matrix times an array column."""
    return F.array(*[added([F.lit(float(v)) * coef(c, j) for j, v in enumerate(row) if v] or [F.lit(0.0)]) for row in m])


def monomials(x: list[Column], order: int) -> list[Column]:
    return [reduce(lambda a, b: a * b, [power(c, k) for c, k in zip(x, e, strict=True) if k] or [F.lit(1.0)]) for e in K.multi_indices(len(x), order)]


def poly_eval(c: Column, x: list[Column], order: int, basis: str = "monomial") -> Column:
    """Value of a polynomial given by coefficients."""
    own = c if basis == "monomial" else matrix_times(K.bernstein_to_monomial(len(x), order), c)
    return added([coef(own, i) * m for i, m in enumerate(monomials(x, order))])


def poly_gradient(c: Column, x: list[Column], order: int, basis: str = "monomial") -> list[Column]:
    own = c if basis == "monomial" else matrix_times(K.bernstein_to_monomial(len(x), order), c)
    out = []
    for axis in range(len(x)):
        parts = []
        for i, e in enumerate(K.multi_indices(len(x), order)):
            if e[axis]:
                parts.append(coef(own, i) * e[axis] * reduce(lambda a, b: a * b, [power(v, k - (d == axis)) for d, (v, k) in enumerate(zip(x, e, strict=True))]))
        out.append(added(parts))
    return out


def change_basis(c: Column, dim: int, order: int, to: str) -> Column:
    """Coefficients in the other basis (``to``: monomial or bernstein)."""
    return matrix_times(K.bernstein_to_monomial(dim, order) if to == "monomial" else K.monomial_to_bernstein(dim, order), c)


def lagrange_eval(values: Column, x: list[Column], n: int) -> Column:
    """Tensor-product interpolation of n ** D node values, first axis fastest."""
    nodes = K.lagrange_nodes(n)

    def one(t: Column, k: int) -> Column:
        return reduce(lambda a, b: a * b, [(t - nodes[j]) / F.lit(nodes[k] - nodes[j]) for j in range(n) if j != k] or [F.lit(1.0)])

    out = []
    for flat in range(n ** len(x)):
        at = [flat // n**d % n for d in range(len(x))]
        out.append(coef(values, flat) * reduce(lambda a, b: a * b, [one(t, k) for t, k in zip(x, at, strict=True)]))
    return added(out)


def flat_of_multi(ix: list[Column], n: int) -> Column:
    """1-based column-major place of 1-based indices."""
    return added([(i - 1) * n**d for d, i in enumerate(ix)]) + 1


def multi_of_flat(flat: Column, n: int, dim: int) -> list[Column]:
    return [F.floor((flat - 1) / n**d) % n + 1 for d in range(dim)]


def positive_certificate(c: Column, atol: float = 0.0) -> Column:
    """Whether all Bernstein coefficients exceed -atol (sufficient for positivity)."""
    return F.forall(c, lambda v: v > -atol)


def first_not_positive(c: Column, atol: float = 0.0) -> Column:
    """1-based place of the first coefficient that fails; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(c, lambda v: v > -atol), False), F.lit(0)).cast("long")


def box_moments(lo: list[Column], hi: list[Column], order: int) -> Column:
    """Integrals of all monomials over a box."""
    out = []
    for e in K.multi_indices(len(lo), order):
        out.append(reduce(lambda a, b: a * b, [(power(h, k + 1) - power(x, k + 1)) / (k + 1) for x, h, k in zip(lo, hi, e, strict=True)]))
    return F.array(*out)


def moment_volume(m: Column) -> Column:
    return coef(m, 0)


def moment_centroid(m: Column, dim: int) -> Column:
    return F.array(*[coef(m, d + 1) / coef(m, 0) for d in range(dim)])


def shift_moments(m: Column, delta: list[Column], order: int) -> Column:
    """Moments about an origin moved by ``delta``."""
    dim = len(delta)
    ix = K.multi_indices(dim, order)
    at = {e: i for i, e in enumerate(ix)}
    out = []
    for a in ix:
        parts = []
        for b in ix:
            if all(q <= p for p, q in zip(a, b, strict=True)):
                times = prod(comb(p, q) for p, q in zip(a, b, strict=True))
                factors = [power(-d, p - q) for d, p, q in zip(delta, a, b, strict=True) if p > q]
                parts.append(reduce(lambda x, y: x * y, [coef(m, at[b]) * times, *factors]))
        out.append(added(parts))
    return F.array(*out)


def integrate_subinterval(c: Column, order: int, lo: Column, hi: Column, a: Column, b: Column) -> Column:
    """Integral over [a, b] within the cell [lo, hi] of a polynomial in the cell's own coordinate."""
    x, w = K.gauss_interval(order // 2 + 1)
    begin, end = F.greatest(lo, a), F.least(hi, b)
    value = added([poly_eval(c, [(begin + (end - begin) * t - lo) / (hi - lo)], order) * v for t, v in zip(x, w, strict=True)])
    return F.when(end > begin, value * (end - begin)).otherwise(0.0)


def action_error(low: Column, p: int, high: Column, q: int, residual: Column, dim: int) -> Column:
    """sqrt of the integral of the squared difference of two polynomials on the unit box plus residual squared."""
    nodes, weights = K.gauss_box(dim, max(p, q) + 1)
    at = [[F.lit(v) for v in n] for n in nodes]
    parts = [power(poly_eval(high, x, q) - poly_eval(low, x, p), 2) * w for x, w in zip(at, weights, strict=True)]
    return F.sqrt(added(parts) + residual * residual)


def polynomial_over_overlap(c: Column, pullback: Column, moments: Column, n: int) -> Column:
    """Sum over b of (sum over a of c_a T_ab) m_b, with T an array of rows."""
    return added([added([coef(c, a) * coef(coef(pullback, a), b) for a in range(n)]) * coef(moments, b) for b in range(n)])
