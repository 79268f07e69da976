"""Constants of the numerical operators, made by rule on the driver and shipped as literals:
multi-indices, quadrature, mass matrices, basis changes, transfer matrices of refined cells."""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from math import comb, factorial, prod

import numpy as np

Index = tuple[int, ...]


@lru_cache
def multi_indices(dim: int, order: int) -> tuple[Index, ...]:
    """Exponents up to a total degree, by degree, within it the first axis first and descending."""

    def of(total: int, axes: int) -> list[Index]:
        if axes == 1:
            return [(total,)]
        return [(k, *rest) for k in range(total, -1, -1) for rest in of(total - k, axes - 1)]

    return tuple(e for total in range(order + 1) for e in of(total, dim))


def n_coeffs(dim: int, order: int) -> int:
    return comb(dim + order, dim)


def index_of(dim: int, order: int, e: Index) -> int:
    """1-based place of an exponent; an error if there is none."""
    if len(e) != dim or min(e) < 0 or sum(e) > order:
        raise ValueError(f"{e} is no exponent of order {order} in {dim} dimensions")
    return multi_indices(dim, order).index(e) + 1


def multinomial(order: int, e: Index) -> int:
    return factorial(order) // (prod(map(factorial, e)) * factorial(order - sum(e)))


@lru_cache
def gauss_interval(n: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Gauss-Legendre nodes and weights on [0, 1]; exact to degree 2n - 1."""
    x, w = np.polynomial.legendre.leggauss(n)
    return tuple((x + 1) / 2), tuple(w / 2)


def gauss_box(dim: int, n: int) -> tuple[list[tuple[float, ...]], list[float]]:
    x, w = gauss_interval(n)
    at = list(product(range(n), repeat=dim))
    return [tuple(x[i] for i in k) for k in at], [prod(w[i] for i in k) for k in at]


def gauss_simplex(dim: int, order: int) -> tuple[list[tuple[float, ...]], list[float]]:
    """Rule on the unit simplex, exact to ``order``: a Gauss rule on the cube, collapsed.

    Weights sum to 1/2 for triangles and 1/6 for tetrahedra.
    """
    n = (order + dim) // 2 + 1
    nodes, weights = [], []
    for u, w in zip(*gauss_box(dim, n), strict=True):
        x, rest, scale = [], 1.0, 1.0
        for k, t in enumerate(u):
            x.append(rest * t)
            scale *= (1 - t) ** (dim - 1 - k)
            rest *= 1 - t
        nodes.append(tuple(x))
        weights.append(w * scale)
    return nodes, weights


@lru_cache
def mass_matrix(kind: str, dim: int, order: int) -> np.ndarray:
    """Integrals of products of monomials over the unit box or the unit simplex."""
    ix = multi_indices(dim, order)

    def entry(a: Index, b: Index) -> float:
        g = [x + y for x, y in zip(a, b, strict=True)]
        if kind == "box":
            return prod(1 / (x + 1) for x in g)
        return prod(map(factorial, g)) / factorial(sum(g) + dim)

    return np.array([[entry(a, b) for b in ix] for a in ix])


def moments_of_unit(kind: str, dim: int, order: int) -> np.ndarray:
    return mass_matrix(kind, dim, order)[0]


@lru_cache
def bernstein_to_monomial(dim: int, order: int) -> np.ndarray:
    """Column j: the monomial coefficients of the Bernstein polynomial of multi-index j on the unit simplex."""
    ix = multi_indices(dim, order)
    at = {e: i for i, e in enumerate(ix)}
    out = np.zeros((len(ix), len(ix)))
    for j, e in enumerate(ix):
        rest = order - sum(e)
        for k in multi_indices(dim, rest):
            out[at[tuple(x + y for x, y in zip(e, k, strict=True))], j] += multinomial(order, e) * (-1) ** sum(k) * multinomial(rest, k)
    return out


@lru_cache
def monomial_to_bernstein(dim: int, order: int) -> np.ndarray:
    return np.linalg.inv(bernstein_to_monomial(dim, order))


def basis_values(basis: str, dim: int, order: int, x: tuple[float, ...]) -> np.ndarray:
    m = np.array([prod(c**k for c, k in zip(x, e, strict=True)) for e in multi_indices(dim, order)])
    return m if basis == "monomial" else bernstein_to_monomial(dim, order).T @ m


@lru_cache
def child_matrix(dim: int, order: int, mask: int, sibling: int) -> np.ndarray:
    """Coefficients on a child -> its share of the parent's L2 projection (monomials on the unit box)."""
    split = [mask >> d & 1 for d in range(dim)]
    bits, k = [], 0
    for s in split:
        bits.append(sibling >> k & 1 if s else 0)
        k += s
    scale = [0.5 if s else 1.0 for s in split]
    ix = multi_indices(dim, order)
    nodes, weights = gauss_box(dim, order + 1)
    cross = np.zeros((len(ix), len(ix)))
    for x, w in zip(nodes, weights, strict=True):
        at = tuple(s * (b + c) if t else c for s, b, c, t in zip(scale, bits, x, split, strict=True))
        cross += w * prod(scale) * np.outer(basis_values("monomial", dim, order, at), basis_values("monomial", dim, order, x))
    return np.linalg.solve(mass_matrix("box", dim, order), cross)


def lagrange_nodes(n: int) -> list[float]:
    """Equispaced nodes on [0, 1]; one node means a constant."""
    return [0.0] if n == 1 else [k / (n - 1) for k in range(n)]
