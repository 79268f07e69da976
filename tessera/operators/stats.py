"""Running statistics: moments as built-in aggregates, mergeable states, moving averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import nan


def or_nan(c: Column) -> Column:
    return F.coalesce(c.cast("double"), nan())


def welford(x: str) -> list[Column]:
    """n, mean, variance, standard deviation, skewness, raw and excess kurtosis; NaN where undefined."""
    c = F.col(x)
    return [
        F.count(c).alias("n"),
        or_nan(F.avg(c)).alias("mean"),
        or_nan(F.var_samp(c)).alias("variance"),
        or_nan(F.stddev_samp(c)).alias("std_dev"),
        or_nan(F.when((F.count(c) >= 2) & (F.var_pop(c) > 0), F.skewness(c))).alias("skewness"),
        or_nan(F.when((F.count(c) >= 2) & (F.var_pop(c) > 0), F.kurtosis(c) + 3)).alias("kurtosis"),
        or_nan(F.when((F.count(c) >= 2) & (F.var_pop(c) > 0), F.kurtosis(c))).alias("excess_kurtosis"),
    ]


def per_cell(df: DataFrame, cell: str, x: str) -> DataFrame:
    return df.groupBy(cell).agg(*welford(x))


def state(x: str) -> Column:
    """A mergeable state: n, mean and the sums of the second to fourth powers of deviations."""
    c, n = F.col(x), F.count(F.col(x)).cast("double")
    v = F.coalesce(F.var_pop(c), F.lit(0.0))
    third = F.when(v > 0, F.skewness(c) * F.pow(v, F.lit(1.5)) * n).otherwise(0.0)
    fourth = F.when(v > 0, (F.kurtosis(c) + 3) * v * v * n).otherwise(0.0)
    return F.struct(n.alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("m1"), (v * n).alias("m2"), third.alias("m3"), fourth.alias("m4"))


def merge(states: Column) -> Column:
    """Merges an array of states pairwise (Pebay's update)."""

    def two(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["m1"] - a["m1"]
        q = d / F.when(n == 0, F.lit(1.0)).otherwise(n)
        ab = a["n"] * b["n"]
        return F.struct(
            n.alias("n"),
            (a["m1"] + q * b["n"]).alias("m1"),
            (a["m2"] + b["m2"] + d * q * ab).alias("m2"),
            (a["m3"] + b["m3"] + d * q * q * ab * (a["n"] - b["n"]) + 3 * q * (a["n"] * b["m2"] - b["n"] * a["m2"])).alias("m3"),
            (a["m4"] + b["m4"] + d * q * q * q * ab * (a["n"] * a["n"] - ab + b["n"] * b["n"]) + 6 * q * q * (a["n"] * a["n"] * b["m2"] + b["n"] * b["n"] * a["m2"]) + 4 * q * (a["n"] * b["m3"] - b["n"] * a["m3"])).alias("m4"),
        )

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "m1", "m2", "m3", "m4")])
    return F.aggregate(states, zero, two)


def of_state(s: Column) -> list[Column]:
    """The statistics of a state."""
    n, m2 = s["n"], s["m2"]
    sound = (n >= 2) & (m2 > 0)
    return [n.cast("long").alias("n"), F.when(n > 0, s["m1"]).otherwise(nan()).alias("mean"), F.when(n >= 2, m2 / (n - 1)).otherwise(nan()).alias("variance"), F.when(sound, F.sqrt(n) * s["m3"] / F.pow(m2, F.lit(1.5))).otherwise(nan()).alias("skewness"), F.when(sound, n * s["m4"] / (m2 * m2)).otherwise(nan()).alias("kurtosis")]


def ema(df: DataFrame, key: str, order: list[str], x: str, alpha: float) -> DataFrame:
    """Exponential moving average per key in a given order; the first sample begins it.

    The average is a weighted sum with weights known from the place in the order, so it is a window
    (which spills) and a sum, not a list per key.
    """
    from pyspark.sql import Window as W

    if not 0 < alpha <= 1:
        raise ValueError("0 < alpha <= 1")
    place = df.select(key, F.col(x).cast("double").alias("_x"), F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("_n"))
    age = (F.col("_n") - F.col("_i")).cast("double")
    weight = F.pow(F.lit(1.0 - alpha), age) * F.when(F.col("_i") == 1, 1.0).otherwise(alpha)
    return place.groupBy(key).agg(F.sum(weight * F.col("_x")).alias("ema"))


REDUCTIONS = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}


def reduce_cells(df: DataFrame, value: Column, op: str | Callable[[Column], Column] = "sum", by: list[str] | None = None) -> DataFrame:
    """A map and an associative reduction over all rows, or over those of each group.

    ``op`` is a name of ``REDUCTIONS`` or any aggregate function of a column.
    """
    fold = REDUCTIONS[op] if isinstance(op, str) else op
    return df.groupBy(*(by or [])).agg(fold(value).alias("value"))
