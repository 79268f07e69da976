"""Incremental state on Structured Streaming: running statistics, moving averages, sampling,
adaptive grids per micro-batch, and refinement events as versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import grid, particles, stats
from tessera.plans.store import own_dir, stored


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there, in micro-batches, and returns its last state (complete
    mode) or all its rows (append and update modes).

    Each micro-batch has a folder of its own and replaces it, so one that is run again after a
    failure leaves its rows once.
    """
    spark = stream.sparkSession
    path = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        replaced(batch, f"{path}/data" if mode == "complete" else f"{path}/data/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data").select(*stream.columns)


def replaced(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def running_statistics(samples: DataFrame, cell: str, x: str) -> DataFrame:
    """Count, mean, variance, skewness and kurtosis per cell of a stream of samples."""
    return stats.per_cell(samples, cell, x)


def running_sampling(p: DataFrame) -> DataFrame:
    """Sums per cell of a stream of binned particles."""
    return particles.sampled(p)


def running_ema(samples: DataFrame, key: str, order: str, x: str, alpha: float) -> DataFrame:
    """The average after each micro-batch, per key; the first sample begins it.

    Rows of one micro-batch are taken in the given order; batches have to arrive in order.
    """
    if not 0 < alpha <= 1:
        raise ValueError("0 < alpha <= 1")
    kind = dict(samples.dtypes)[key]

    def step(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, begun = state.get if state.exists else (0.0, False)
        for df in sorted_batches(rows):
            for v in df[x].astype(float):
                value, begun = (alpha * v + (1 - alpha) * value, True) if begun else (v, True)
        state.update((float(value), begun))
        yield pd.DataFrame({key: [k[0]], "ema": [float(value)]})

    def sorted_batches(rows: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
        return [pd.concat(list(rows)).sort_values(order)]

    return samples.select(key, order, x).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ema double", "value double, begun boolean", "update", "NoTimeout")


def adaptive_stream(points: DataFrame, cells: DataFrame, indicator: Callable[[DataFrame, DataFrame], DataFrame], dim: int, threshold: float, max_level: int, every: int = 1, path: str | None = None) -> DataFrame:
    """One micro-batch is one step; after every ``every``-th the grid is refined where the indicator
    (of the batch's rows and the cells) is above the threshold. Returns all versions of the cells
    (``version``: 0 is the grid at the start, n + 1 what batch n left), one for each batch.

    The versions are the state: a batch begins from the one before it and replaces its own, so
    a stream that is begun again in the same ``path`` goes on where it ended.
    """
    spark: SparkSession = points.sparkSession
    path = path or f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    at = lambda n: f"{path}/cells/version={n}"
    if not exists(spark, at(0)):
        replaced(cells.select(*grid.COLUMNS), at(0))
    schema = cells.select(*grid.COLUMNS).schema

    def step(batch: DataFrame, number: int) -> None:
        now = spark.read.schema(schema).parquet(at(number))
        if every > 0 and (number + 1) % every == 0:
            now, _, _ = grid.refine_by_indicator(now, stored(indicator(batch, now), "indicator"), dim, threshold, -1.0, max_level)
        replaced(now, at(number + 1))

    points.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/cells").select("version", *grid.COLUMNS)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def refinement_events(versions: DataFrame) -> DataFrame:
    """``version``, ``path``, ``kind``: what became of each cell from one version to the next."""
    old = versions.select((F.col("version") + 1).alias("version"), "path", F.col("is_leaf").alias("was"))
    new = versions.where("version > 0").select("version", "path", F.col("is_leaf").alias("now"))
    last = versions.agg(F.max("version").alias("last"))
    both = old.join(last, F.col("version") <= F.col("last")).drop("last").join(new, ["version", "path"], "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "removed").when(F.col("was") & ~F.col("now"), "refined").when(~F.col("was") & F.col("now"), "coarsened").otherwise("kept")
    return both.select("version", "path", kind.alias("kind"))


class Listeners:
    """Functions that are told the events of each version, in the order in which they were registered.

    All are called, whatever one of them raises; then the first error is raised.
    """

    def __init__(self) -> None:
        self._held: dict[int, Callable[[DataFrame], None]] = {}
        self._next = 0

    def register(self, listener: Callable[[DataFrame], None]) -> int:
        self._next += 1
        self._held[self._next] = listener
        return self._next

    def unregister(self, handle: int) -> None:
        self._held.pop(handle, None)

    def fire(self, events: DataFrame) -> None:
        errors = []
        for listener in list(self._held.values()):
            try:
                listener(events)
            except Exception as e:  # all listeners hear of it first
                errors.append(e)
        if errors:
            raise errors[0]


def windowed(events: DataFrame, ts: str, x: str, width: str, late: str, key: str) -> DataFrame:
    """Statistics per event-time window, with a watermark for late rows (beyond the grid's own needs)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))
