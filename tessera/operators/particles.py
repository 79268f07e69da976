"""Particles: motion, binning, sampling, totals, and collisions by the no-time-counter scheme."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import cell_of_position, nan, wrap

AXES = "xyz"


def initial(spark: SparkSession, n: int, length: float, widths: tuple[float, float, float], seed: int = 1) -> DataFrame:
    """Uniform positions, normal velocities of given widths, without mean drift."""
    p = spark.range(n).select(F.col("id").alias("pid"), *[(F.rand(seed + i) * length).alias(c) for i, c in enumerate(AXES)], *[(F.randn(seed + 3 + i) * w).alias("v" + c) for i, (c, w) in enumerate(zip(AXES, widths, strict=True))])
    drift = p.agg(*[F.avg("v" + c).alias("m" + c) for c in AXES])
    return p.crossJoin(F.broadcast(drift)).select("pid", *AXES, *[(F.col("v" + c) - F.col("m" + c)).alias("v" + c) for c in AXES])  # one row of means


def moved(p: DataFrame, dt: float, length: float) -> DataFrame:
    return p.withColumns({c: wrap(F.col(c) + F.col("v" + c) * dt, length) for c in AXES})


def sorted_into_cells(p: DataFrame, n: int, length: float, open_below: bool = False) -> DataFrame:
    return p.withColumn("cell", cell_of_position([F.col(c) for c in AXES], n, length, open_below).cast("long"))


def sampled(p: DataFrame) -> DataFrame:
    """Per cell: count, sums of velocities and of their squares."""
    return p.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum("v" + c).alias("s" + c) for c in AXES], *[F.sum(F.col("v" + c) * F.col("v" + c)).alias("q" + c) for c in AXES])


def accumulated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two samplings."""
    return a.unionByName(b).groupBy("cell").agg(*[F.sum(c).alias(c) for c in a.columns if c != "cell"])


def profile(s: DataFrame, n_samples: int, volume: float) -> DataFrame:
    """Density, mean velocity and temperature per axis (NaN below two particles)."""
    hot: list[Column] = [F.when(F.col("n") < 2, nan()).otherwise(F.col("q" + c) / F.col("n") - (F.col("s" + c) / F.col("n")) * (F.col("s" + c) / F.col("n"))).alias("t" + c) for c in AXES]
    return s.select("cell", "n", (F.col("n") / F.lit(n_samples * volume)).alias("density"), *[(F.col("s" + c) / F.col("n")).alias("u" + c) for c in AXES], *hot)


def totals(p: DataFrame) -> DataFrame:
    sq = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return p.agg(F.count(F.lit(1)).alias("n"), *[F.sum("v" + c).alias("p" + c) for c in AXES], (F.sum(sq) * 0.5).alias("energy"), *[F.avg("v" + c).alias("u" + c) for c in AXES], *[F.var_pop("v" + c).alias("t" + c) for c in AXES])


#: Particles of a cell that collide in one task; larger cells are dealt to groups at random.
GROUP = 4096


def collided(p: DataFrame, sigma: float, c_max: float, dt: float, volume: float, seed: int = 0, group: int = GROUP) -> DataFrame:
    """Hard-sphere collisions within cells; each cell draws from a seed of its own.

    Partners are drawn at random, so a crowded cell is dealt to random groups, each with its share of
    the cell's volume: as many pairs are tried, none of them by one task alone. Pairs are tried many at
    a time, in rounds in which no particle is drawn twice.
    """

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        cell, part, parts = key
        df = df.sort_values("pid").reset_index(drop=True)
        n = len(df)
        if n < 2:
            return df[columns]
        rng = np.random.default_rng([seed, int(cell), int(part)])
        v = df[["vx", "vy", "vz"]].to_numpy(copy=True)
        expected = 0.5 * n * (n - 1) * sigma * c_max * dt / (volume / parts)
        todo = int(expected) + int(rng.random() < expected % 1)
        while todo > 0:
            k = min(todo, n // 2)
            drawn = rng.permutation(n)
            a, b = drawn[:k], drawn[k : 2 * k]
            rel = np.linalg.norm(v[a] - v[b], axis=1)
            hit = rng.random(k) * c_max < rel
            a, b, rel = a[hit], b[hit], rel[hit]
            cos, phi = 2 * rng.random(len(a)) - 1, 2 * np.pi * rng.random(len(a))
            sin = np.sqrt(1 - cos * cos)
            middle, half = (v[a] + v[b]) / 2, rel[:, None] / 2 * np.stack([cos, sin * np.cos(phi), sin * np.sin(phi)], axis=1)
            v[a], v[b] = middle + half, middle - half
            todo -= k
        df[["vx", "vy", "vz"]] = v
        return df[columns]

    columns = p.columns
    size = p.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("_parts"))
    dealt = p.join(size, "cell").withColumn("_part", F.pmod(F.xxhash64("pid", F.lit(seed)), F.col("_parts")).cast("int"))
    return dealt.groupBy("cell", "_part", "_parts").applyInPandas(run, p.schema)


def step(p: DataFrame, n: int, length: float, dt: float, sigma: float, c_max: float, seed: int = 0) -> DataFrame:
    """Move, sort into cells, collide."""
    return collided(sorted_into_cells(moved(p, dt, length), n, length), sigma, c_max, dt, (length / n) ** 3, seed)
