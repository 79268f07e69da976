"""Geometry derived from the driver's tables: segments, points, boxes, triangles, particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lag_idx``, ``lo``, ``hi``, ``v``: orders as intervals of days."""
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("lag_idx"), day.alias("lo"), F.col("o_totalprice").cast("double").alias("v"))
    return o.select("lag_idx", "lo", (F.col("lo") + 1 + F.col("lag_idx") % 30).cast("double").alias("hi"), "v")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``x`` in [0, 64), ``y`` in [0, 16), ``w``: line items."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount") * 100).cast("int").cast("double").alias("y"), F.col("l_extendedprice").cast("double").alias("w"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``lx``, ``hx``, ``ly``, ``hy``: orders by their quantities and line numbers."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.min(q).alias("lx"), (F.max(q) + 1).alias("hx"), F.min(n).alias("ly"), (F.max(n) + 1).alias("hy"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, x1 ... y3: parts."""
    k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    d = lambda c, n: c.cast("double").alias(n)
    return table(spark, sf_dir, "part").select(k.alias("id"), d(s, "x1"), d(k % 50, "y1"), d(s + 1 + k % 5, "x2"), d(k % 50 + k % 3, "y2"), d(s + k % 2, "x3"), d(k % 50 + 1 + k % 7, "y3"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid``, positions in the unit cube, velocities."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("pid"), *[(e(i + 1) + 0.5).alias(c) for i, c in enumerate("xyz")], *[e(i + 4).alias("v" + c) for i, c in enumerate("xyz")])


def grid_boxes(spark: SparkSession, level: int, lo: list[float], hi: list[float]) -> DataFrame:
    """``id`` (from 0, first axis fastest), ``lo``, ``hi``, ``volume`` of a uniform grid."""
    n, dim = 1 << level, len(lo)
    i = [F.floor(F.col("id") / n**d) % n for d in range(dim)]
    h = [(b - a) / n for a, b in zip(lo, hi, strict=True)]
    at = lambda k: F.array(*[(F.lit(float(a)) + (x + k) * float(s)).cast("double") for a, x, s in zip(lo, i, h, strict=True)])
    volume = 1.0
    for s in h:
        volume *= s
    return spark.range(n**dim).select("id", at(0).alias("lo"), at(1).alias("hi"), F.lit(volume).alias("volume"))


SEG = """seg AS (SELECT lag_idx, lo, lo + 1 + lag_idx % 30 AS hi, v FROM (SELECT CAST(o_orderkey AS BIGINT) AS lag_idx,
 CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS lo, CAST(o_totalprice AS DOUBLE) AS v FROM orders))"""
PT = """pt AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id, CAST(l_quantity AS DOUBLE) AS x,
 CAST(CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) AS y, CAST(l_extendedprice AS DOUBLE) AS w FROM lineitem)"""
BOX = """box AS (SELECT CAST(l_orderkey AS BIGINT) AS id, min(CAST(l_quantity AS DOUBLE)) AS lx, max(CAST(l_quantity AS DOUBLE)) + 1 AS hx,
 min(CAST(l_linenumber AS DOUBLE)) AS ly, max(CAST(l_linenumber AS DOUBLE)) + 1 AS hy FROM lineitem GROUP BY l_orderkey)"""
TRI = """tri AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS x1, CAST(p_partkey % 50 AS DOUBLE) AS y1,
 CAST(p_size + 1 + p_partkey % 5 AS DOUBLE) AS x2, CAST(p_partkey % 50 + p_partkey % 3 AS DOUBLE) AS y2,
 CAST(p_size + p_partkey % 2 AS DOUBLE) AS x3, CAST(p_partkey % 50 + 1 + p_partkey % 7 AS DOUBLE) AS y3 FROM part)"""
PART = """particle AS (SELECT CAST(vec_id AS BIGINT) AS pid, CAST(embedding[1] AS DOUBLE) + 0.5 AS x, CAST(embedding[2] AS DOUBLE) + 0.5 AS y,
 CAST(embedding[3] AS DOUBLE) + 0.5 AS z, CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy, CAST(embedding[6] AS DOUBLE) AS vz FROM embeddings)"""
BINS = "bins AS (SELECT range AS id, CAST(range * 64 AS DOUBLE) AS lo, CAST(range * 64 + 64 AS DOUBLE) AS hi FROM range(64))"
OV1 = """ov AS (SELECT lag_idx, b.id AS eul_idx, least(s.hi, b.hi) - greatest(s.lo, b.lo) AS volume FROM seg s JOIN bins b ON s.hi > b.lo AND b.hi > s.lo)"""
