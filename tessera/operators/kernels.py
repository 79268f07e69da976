"""Kernels on cells, faces and blocks, and the solvers made of them.

A kernel is a function of columns. Face kernels see both cells of a face, and what they return is
added to one side and taken from the other in a group-by, so there are no races to avoid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.store import stored

FaceKernel = Callable[..., Column]


def for_each_cell(field: DataFrame, out: str, kernel: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """Adds ``out`` = kernel(column getter) per row."""
    return field.withColumn(out, kernel(F.col))


def for_each_cell_pandas(field: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """For kernels beyond column expressions: batches of rows in, batches of rows out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(kernel, batches)

    return field.mapInPandas(run, schema)


def face_fluxes(faces: DataFrame, field: DataFrame, kernel: FaceKernel, columns: list[str]) -> DataFrame:
    """``left``, ``right``, ``axis``, ``flux``: the kernel's value on every face. ``field`` has ``cell``."""
    side = lambda p, k: field.select(F.col("cell").alias(k), *[F.col(c).alias(p + c) for c in columns])
    both = faces.join(side("l_", "left"), "left").join(side("r_", "right"), "right")
    return both.withColumn("flux", kernel(lambda c: F.col("l_" + c), lambda c: F.col("r_" + c), F.col("axis")))


def boundary_fluxes(walls: DataFrame, field: DataFrame, kernel: FaceKernel, columns: list[str]) -> DataFrame:
    """``cell``, ``axis``, ``side``, ``flux``: a kernel of the cell, the axis and the outward sign (-1 or +1)
    on faces without a neighbour (``walls``). The flux is what leaves the cell."""
    own = walls.join(field.select("cell", *columns), "cell")
    return own.select("cell", "axis", "side", kernel(F.col, F.col("axis"), F.col("side") * 2 - 3).alias("flux"))


def net_flux(fluxes: DataFrame, flux: str = "flux") -> DataFrame:
    """``cell``, ``net``: what flows in less what flows out."""
    ends = fluxes.select(F.explode(F.array(F.struct(F.col("left").alias("cell"), (-F.col(flux)).alias("f")), F.struct(F.col("right").alias("cell"), F.col(flux).alias("f")))).alias("e")).select("e.*")
    return ends.groupBy("cell").agg(F.sum("f").alias("net"))


def advected(field: DataFrame, faces: DataFrame, velocity: list[float], dt: float) -> DataFrame:
    """One upwind step of ``value`` on cells with ``volume`` and face extents ``area`` (array per axis).

    Faces across a periodic wall belong to the face table like any other.
    """

    def kernel(left: Callable[[str], Column], right: Callable[[str], Column], axis: Column) -> Column:
        v = F.get(F.array(*map(F.lit, velocity)), axis - 1)
        area = F.least(F.get(left("area"), axis - 1), F.get(right("area"), axis - 1))
        return v * F.when(v > 0, left("value")).otherwise(right("value")) * area * dt

    net = net_flux(face_fluxes(faces, field, kernel, ["value", "area"]))
    return field.join(net, "cell", "left").withColumn("value", F.col("value") + F.coalesce("net", F.lit(0.0)) / F.col("volume")).drop("net")


def stable_dt(field: DataFrame, speed: Column, extent: Column, cfl: float) -> DataFrame:
    """One row: cfl * least extent / greatest speed."""
    return field.agg((F.min(extent) * cfl / F.max(speed)).alias("dt"))


def for_each_block(field: DataFrame, out: str, kernel: Callable[[Callable[[list[int]], Column]], list[Column]], n: int, dim: int, samples: str = "samples") -> DataFrame:
    """Adds ``out``: n ** dim values per block, made from a getter of the block's own samples.

    The getter takes 1-based indices, the first axis fastest; the kernel lists values in that order.
    """
    def get(ix: list[int]) -> Column:
        return F.get(samples, F.lit(sum((i - 1) * n**d for d, i in enumerate(ix))))

    values = kernel(get)
    if len(values) != n**dim:
        raise ValueError(f"a block has {n**dim} samples")
    return field.withColumn(out, F.array(*values))


def exploded_samples(field: DataFrame, n: int, samples: str = "samples") -> DataFrame:
    """``i``, ``j``, ``value``: the nodes of blocks (``ix``) that share their edge nodes, as one grid."""
    each = field.select("ix", F.posexplode(samples).alias("k", "value"))
    at = lambda d: (F.get("ix", F.lit(d)) * (n - 1) + F.floor(F.col("k") / n**d) % n).cast("long")
    return each.select(at(0).alias("i"), at(1).alias("j"), "ix", "value").groupBy("i", "j").agg(F.min_by("value", "ix").alias("value"))


def with_block_halo(field: DataFrame, size: list[int] | None = None, samples: str = "samples") -> DataFrame:
    """Adds ``_halo``: the samples of the blocks beside each block (``ix``), by axis and side; null where
    there is none. With ``size`` (blocks per axis) the grid is periodic. Blocks send their samples to
    their neighbours, in one shuffle."""
    dim = len(size) if size else field.select(F.size("ix")).first()[0]
    wrap = lambda x, d: F.pmod(x, F.lit(size[d])) if size else x
    to = lambda a, s: F.array(*[wrap(F.get("ix", F.lit(d)) + (s if d == a else 0), d) for d in range(dim)]).cast("array<bigint>")
    # What a block sends to the block on its high side is that block's low halo.
    sent = field.select(F.explode(F.array(*[F.struct(to(a, s).alias("ix"), F.lit(2 * a + (s < 0)).alias("k"), F.col(samples).alias("x")) for a in range(dim) for s in (1, -1)])).alias("m")).select("m.*")
    got = sent.groupBy("ix").agg(F.array(*[F.first(F.when(F.col("k") == k, F.col("x")), True) for k in range(2 * dim)]).alias("_halo"))
    return field.withColumn("ix", F.col("ix").cast("array<bigint>")).join(got, "ix", "left")


def for_each_block_with_halo(field: DataFrame, out: str, kernel: Callable[[Callable[[list[int]], Column]], list[Column]], n: int, dim: int, size: list[int] | None = None, samples: str = "samples") -> DataFrame:
    """Like ``for_each_block``, with a getter that takes indices from 0 to n + 1: those beyond the block, on
    one axis, are the nearest samples of the block there; without one, the block's own edge."""
    field = with_block_halo(field, size, samples)

    def get(ix: list[int]) -> Column:
        beyond = [d for d, i in enumerate(ix) if not 1 <= i <= n]
        flat = lambda at: F.lit(sum((i - 1) * n**d for d, i in enumerate(at)))
        held = [min(max(i, 1), n) for i in ix]
        if not beyond:
            return F.get(samples, flat(ix))
        if len(beyond) > 1:
            raise ValueError("blocks at corners aren't read")
        d = beyond[0]
        there = [(n if ix[d] < 1 else 1) if e == d else i for e, i in enumerate(ix)]
        return F.coalesce(F.get(F.get("_halo", F.lit(2 * d + (ix[d] > n))), flat(there)), F.get(samples, flat(held)))

    values = kernel(get)
    if len(values) != n**dim:
        raise ValueError(f"a block has {n**dim} samples")
    return field.withColumn(out, F.array(*values)).drop("_halo")


# Gas dynamics ------------------------------------------------------------------------------------

GAMMA = 1.4


def to_primitive(rho: Column, mx: Column, my: Column, e: Column) -> tuple[Column, Column, Column, Column]:
    u, v = mx / rho, my / rho
    return rho, u, v, (GAMMA - 1) * (e - (u * mx + v * my) / 2)


def to_conserved(rho: Column, u: Column, v: Column, p: Column) -> tuple[Column, Column, Column, Column]:
    return rho, rho * u, rho * v, p / (GAMMA - 1) + rho * (u * u + v * v) / 2


def sound_speed(rho: Column, p: Column) -> Column:
    return F.sqrt(F.lit(GAMMA) * p / rho)


def euler_flux(rho: Column, u: Column, v: Column, p: Column, axis: Column) -> list[Column]:
    n = F.when(axis == 1, u).otherwise(v)
    _, mx, my, e = to_conserved(rho, u, v, p)
    return [rho * n, mx * n + F.when(axis == 1, p).otherwise(0.0), my * n + F.when(axis == 2, p).otherwise(0.0), (e + p) * n]


def hll_flux(left: list[Column], right: list[Column], axis: Column) -> list[Column]:
    """Two-wave fluxes between conserved states."""
    a, b = to_primitive(*left), to_primitive(*right)
    na, nb = (F.when(axis == 1, s[1]).otherwise(s[2]) for s in (a, b))
    ca, cb = sound_speed(a[0], a[3]), sound_speed(b[0], b[3])
    slow, fast = F.least(na - ca, nb - cb), F.greatest(na + ca, nb + cb)
    out = []
    for fa, fb, ua, ub in zip(euler_flux(*a, axis), euler_flux(*b, axis), left, right, strict=True):
        middle = (fast * fa - slow * fb + slow * fast * (ub - ua)) / (fast - slow)
        out.append(F.when(slow >= 0, fa).when(fast <= 0, fb).otherwise(middle))
    return out


CONSERVED = ["rho", "mx", "my", "e"]


def euler_step(field: DataFrame, faces: DataFrame, dt: float, walls: DataFrame | None = None) -> DataFrame:
    """One step of all conserved fields over ``cell``, ``volume``, ``area``.

    ``walls(cell, axis, side)`` lists outflow faces, where the cell's own state is met.
    """
    side = lambda p, k: field.select(F.col("cell").alias(k), *[F.col(c).alias(p + c) for c in [*CONSERVED, "area"]])
    both = faces.select("left", "right", "axis").join(side("l_", "left"), "left").join(side("r_", "right"), "right")
    f = hll_flux([F.col("l_" + c) for c in CONSERVED], [F.col("r_" + c) for c in CONSERVED], F.col("axis"))
    area = F.least(F.get("l_area", F.col("axis") - 1), F.get("r_area", F.col("axis") - 1))
    flows = both.select("left", "right", *[(x * area * dt).alias(c) for c, x in zip(CONSERVED, f, strict=True)])
    ends = flows.select(F.explode(F.array(F.struct(F.col("left").alias("cell"), *[(-F.col(c)).alias(c) for c in CONSERVED]), F.struct(F.col("right").alias("cell"), *[F.col(c) for c in CONSERVED]))).alias("z")).select("z.*")
    if walls is not None:
        at = walls.join(field, "cell")
        g = hll_flux([F.col(c) for c in CONSERVED], [F.col(c) for c in CONSERVED], F.col("axis"))
        sign = F.col("side") * 2 - 3
        ends = ends.unionByName(at.select("cell", *[(-sign * x * F.get("area", F.col("axis") - 1) * dt).alias(c) for c, x in zip(CONSERVED, g, strict=True)]))
    net = ends.groupBy("cell").agg(*[F.sum(c).alias("d_" + c) for c in CONSERVED])
    return field.join(net, "cell", "left").select("cell", "volume", "area", *[(F.col(c) + F.coalesce("d_" + c, F.lit(0.0)) / F.col("volume")).alias(c) for c in CONSERVED])


def exact_riemann(x_over_t: np.ndarray, left: tuple[float, float, float], right: tuple[float, float, float]) -> np.ndarray:
    """Density, velocity, pressure of the exact solution along rays (Toro's iteration)."""
    g = GAMMA
    c = [np.sqrt(g * s[2] / s[0]) for s in (left, right)]

    def branch(p: float, s: tuple[float, float, float], a: float) -> tuple[float, float]:
        rho, _, ps = s
        if p > ps:
            k, b = 2 / (g + 1) / rho, (g - 1) / (g + 1) * ps
            q = np.sqrt(k / (p + b))
            return (p - ps) * q, q * (1 - (p - ps) / (2 * (p + b)))
        return 2 * a / (g - 1) * ((p / ps) ** ((g - 1) / (2 * g)) - 1), (p / ps) ** (-(g + 1) / (2 * g)) / (rho * a)

    p = max(1e-8, (left[2] + right[2]) / 2)
    for _ in range(60):
        fl, dl = branch(p, left, c[0])
        fr, dr = branch(p, right, c[1])
        new = max(1e-10, p - (fl + fr + right[1] - left[1]) / (dl + dr))
        if abs(new - p) < 1e-14 * p:
            break
        p = new
    u = (left[1] + right[1] + branch(p, right, c[1])[0] - branch(p, left, c[0])[0]) / 2
    out = np.empty((len(x_over_t), 3))
    for i, s in enumerate(x_over_t):
        (rho, v, q), a, sign = ((left, c[0], 1), (right, c[1], -1))[int(s > u)]
        z = sign * (s - v)
        if p > q:
            wave = -a * np.sqrt((g + 1) / (2 * g) * p / q + (g - 1) / (2 * g))
            out[i] = (rho, v, q) if z < wave else (rho * (p / q + (g - 1) / (g + 1)) / ((g - 1) / (g + 1) * p / q + 1), u, p)
        else:
            star = a * (p / q) ** ((g - 1) / (2 * g))
            if z < -a:
                out[i] = rho, v, q
            elif z > sign * (u - v) - star:
                out[i] = rho * (p / q) ** (1 / g), u, p
            else:
                m = 2 / (g + 1) + (g - 1) / ((g + 1) * a) * sign * (v - s)
                out[i] = rho * m ** (2 / (g - 1)), 2 / (g + 1) * (sign * a + (g - 1) / 2 * v + s), q * m ** (2 * g / (g - 1))
    return out


# Blocks of samples -------------------------------------------------------------------------------


def diffused(nodes: DataFrame, kappa: float, h: float, dt: float, n: int) -> DataFrame:
    """One midpoint (RK2) step of the five-point Laplacian on a periodic grid of n x n nodes (``i``, ``j``, ``value``).

    Nodes of all blocks form one grid, so that a stencil is a join by integers.
    """

    def laplacian(f: DataFrame) -> DataFrame:
        shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in ((0, 0, -4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0))])
        spread = f.select("i", "j", "value", F.explode(shifts).alias("s"))
        return spread.groupBy(F.pmod(F.col("i") + F.col("s.a"), F.lit(n)).alias("i"), F.pmod(F.col("j") + F.col("s.b"), F.lit(n)).alias("j")).agg((F.sum(F.col("value") * F.col("s.w")) * (kappa / (h * h))).alias("lap"))

    half = nodes.join(laplacian(nodes), ["i", "j"]).select("i", "j", (F.col("value") + F.col("lap") * (dt / 2)).alias("value"))
    return nodes.join(laplacian(half), ["i", "j"]).select("i", "j", (F.col("value") + F.col("lap") * dt).alias("value"))


def steps(field: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, every: int = 1, what: str = "step") -> DataFrame:
    """Applies a step n times; lineage is cut by a table in the shared folder each ``every`` steps."""
    for k in range(1, n + 1):
        field = step(field)
        if k % every == 0:
            field = stored(field, what)
    return field


def step_with_amr(state, step, indicator, adapt, n: int, interval: int = 3):
    """n steps; after every ``interval``-th one (never if not positive) the grid is adapted."""
    for k in range(1, n + 1):
        state = step(state)
        if interval > 0 and k % interval == 0:
            state = adapt(state, indicator(state))
    return state


def totals(field: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of value times volume over the cells."""
    return field.agg(*[F.sum(F.col(c) * F.col("volume")).alias(c) for c in columns])


def l1_error(field: DataFrame, exact: Column) -> DataFrame:
    return field.agg((F.sum(F.abs(F.col("value") - exact) * F.col("volume")) / F.sum("volume")).alias("l1"))
