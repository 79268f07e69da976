"""Statistics, intervals, boxes, remaps, lattices, bits and polynomials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalars as S
from tessera.operators import overlap, remap, stats
from tessera.sources.fixtures import BINS, BOX, OV1, PART, PT, SEG, TRI, boxes, grid_boxes, particles, points, segments, table, triangles

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


CENTRED = """SELECT {k}, n, m AS mean, CASE WHEN n >= 2 THEN m2 / (n - 1) ELSE 'NaN'::DOUBLE END AS variance,
 CASE WHEN n >= 2 THEN sqrt(m2 / (n - 1)) ELSE 'NaN'::DOUBLE END AS std_dev,
 CASE WHEN n >= 2 AND m2 > 0 THEN sqrt(n) * m3 / pow(m2, 1.5) ELSE 'NaN'::DOUBLE END AS skewness,
 CASE WHEN n >= 2 AND m2 > 0 THEN n * m4 / (m2 * m2) ELSE 'NaN'::DOUBLE END AS kurtosis,
 CASE WHEN n >= 2 AND m2 > 0 THEN n * m4 / (m2 * m2) - 3 ELSE 'NaN'::DOUBLE END AS excess_kurtosis
 FROM (SELECT {k}, count(*) AS n, any_value(m) AS m, sum(pow(x - m, 2)) AS m2, sum(pow(x - m, 3)) AS m3, sum(pow(x - m, 4)) AS m4
 FROM (SELECT {k}, {x} AS x, avg({x}) OVER (PARTITION BY {k}) AS m FROM {t}) GROUP BY {k})"""
ROUNDED = "SELECT {k}, n, round(mean, 6) AS mean, round(variance, 4) AS variance, round(std_dev, 6) AS std_dev, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(excess_kurtosis, 6) AS excess_kurtosis FROM ("


def _rounded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "n", *[F.round(c, 4 if c == "variance" else 6).alias(c) for c in ("mean", "variance", "std_dev", "skewness", "kurtosis", "excess_kurtosis")])


@query(ROUNDED.format(k="l_returnflag") + CENTRED.format(k="l_returnflag", x="CAST(l_quantity AS DOUBLE)", t="lineitem") + ")")
def welford_by_flag(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"))
    return _rounded(stats.per_cell(src, "l_returnflag", "x"), "l_returnflag")


@query(ROUNDED.format(k="user_id") + CENTRED.format(k="user_id", x="CAST(value AS DOUBLE)", t="events") + ")")
def welford_by_user(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "events").select("user_id", F.col("value").cast("double").alias("x"))
    return _rounded(stats.per_cell(src, "user_id", "x"), "user_id")


@query("SELECT l_linestatus, n, round(mean, 6) AS mean, round(variance, 4) AS variance, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM (" + CENTRED.format(k="l_linestatus", x="CAST(l_quantity AS DOUBLE)", t="lineitem") + ")")
def merged_states(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "lineitem").select("l_linestatus", "l_linenumber", F.col("l_quantity").cast("double").alias("x"))
    parts = src.groupBy("l_linestatus", "l_linenumber").agg(stats.state("x").alias("s"))
    m = parts.groupBy("l_linestatus").agg(F.collect_list("s").alias("ss")).select("l_linestatus", stats.merge(F.col("ss")).alias("s"))
    return m.select("l_linestatus", *stats.of_state(F.col("s"))).select("l_linestatus", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query("""WITH s AS (SELECT user_id, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(sum(pow(0.7, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.3 END * x), 6) AS ema FROM s GROUP BY user_id""")
def ema_by_user(spark: SparkSession, d: str) -> DataFrame:
    return stats.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.3).select("user_id", r6(F.col("ema"), "ema"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select(F.col("lag_idx").alias("id"), F.array("lo").alias("lo"), F.array("hi").alias("hi"), "v")


def _bins(spark: SparkSession) -> DataFrame:
    return grid_boxes(spark, 6, [0.0], [4096.0])


def _overlap_1d(spark: SparkSession, d: str) -> DataFrame:
    ov = overlap.overlap_boxes(_segments(spark, d), _bins(spark), 1, side=[64.0])
    return ov.select(F.col("a_id").alias("lag_idx"), F.col("b_id").alias("eul_idx"), "volume")


@query(f"WITH {SEG}, {BINS}, {OV1} SELECT * FROM ov")
def interval_overlap_1d(spark: SparkSession, d: str) -> DataFrame:
    return _overlap_1d(spark, d)


@query(f"WITH {SEG}, {BINS}, {OV1} SELECT count(*) AS n, sum(volume) AS total, max(volume) AS longest FROM ov")
def total_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap_1d(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("total"), F.max("volume").alias("longest"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select(F.col("lag_idx").alias("id"), F.col("v").alias("value"))


@query(f"WITH {SEG}, {BINS}, {OV1}, r AS (SELECT eul_idx, sum(volume * v) / sum(volume) AS value FROM ov JOIN seg USING (lag_idx) GROUP BY 1) SELECT id, round(coalesce(value, 0), 4) AS value FROM bins LEFT JOIN r ON id = eul_idx")
def remap_mean_1d(spark: SparkSession, d: str) -> DataFrame:
    return remap.mean(_overlap_1d(spark, d), _values(spark, d), _bins(spark)).select("id", F.round("value", 4).alias("value"))


@query(f"WITH {SEG}, {BINS}, {OV1}, w AS (SELECT *, sum(volume) OVER (PARTITION BY lag_idx) AS c FROM ov), r AS (SELECT eul_idx, sum(v * volume / c) AS value FROM w JOIN seg USING (lag_idx) GROUP BY 1) SELECT id, round(coalesce(value, 0), 2) AS value FROM bins LEFT JOIN r ON id = eul_idx")
def remap_flux_1d(spark: SparkSession, d: str) -> DataFrame:
    return remap.flux(_overlap_1d(spark, d), _values(spark, d), _bins(spark)).select("id", F.round("value", 2).alias("value"))


@query(f"WITH {SEG}, {BINS}, {OV1}, f AS (SELECT id, CAST(id * id AS DOUBLE) AS g FROM bins), r AS (SELECT lag_idx, sum(volume * g) / sum(volume) AS value FROM ov JOIN f ON f.id = eul_idx GROUP BY 1) SELECT s.lag_idx AS id, round(coalesce(value, 0), 6) AS value FROM seg s LEFT JOIN r USING (lag_idx)")
def remap_back_1d(spark: SparkSession, d: str) -> DataFrame:
    field = _bins(spark).select("id", (F.col("id") * F.col("id")).cast("double").alias("value"))
    every = segments(spark, d).select(F.col("lag_idx").alias("id"))
    return remap.mean(_overlap_1d(spark, d), field, every, "eul_idx", "lag_idx").select("id", r6(F.col("value"), "value"))


@query(f"WITH {SEG}, {BINS}, {OV1}, f AS (SELECT id, CAST(id * id AS DOUBLE) AS g, sum(volume) AS c FROM bins JOIN ov ON id = eul_idx GROUP BY 1, 2), r AS (SELECT lag_idx, sum(volume * g / c) AS value FROM ov JOIN f ON f.id = eul_idx GROUP BY 1) SELECT s.lag_idx AS id, round(coalesce(value, 0), 8) AS value FROM seg s LEFT JOIN r USING (lag_idx)")
def remap_flux_back_1d(spark: SparkSession, d: str) -> DataFrame:
    field = _bins(spark).select("id", (F.col("id") * F.col("id")).cast("double").alias("value"))
    every = segments(spark, d).select(F.col("lag_idx").alias("id"))
    return remap.flux(_overlap_1d(spark, d), field, every, "eul_idx", "lag_idx").select("id", F.round("value", 8).alias("value"))


@query(f"""WITH {SEG}, {BINS}, {OV1}, j AS (SELECT eul_idx, volume, v AS mu, CAST(lag_idx % 7 AS DOUBLE) AS var FROM ov JOIN seg USING (lag_idx)),
m AS (SELECT eul_idx, sum(volume * mu) / sum(volume) AS mm FROM j GROUP BY 1), r AS (SELECT eul_idx, any_value(mm) AS mu, sum(volume * (var + (mu - mm) * (mu - mm))) / sum(volume) AS var FROM j JOIN m USING (eul_idx) GROUP BY 1)
SELECT id, round(coalesce(mu, 0), 4) AS mu, round(coalesce(var, 0), 0) AS var FROM bins LEFT JOIN r ON id = eul_idx""")
def remap_covariance(spark: SparkSession, d: str) -> DataFrame:
    src = segments(spark, d).select(F.col("lag_idx").alias("id"), F.col("v").alias("mu"), (F.col("lag_idx") % 7).cast("double").alias("var"))
    return remap.covariance(_overlap_1d(spark, d), src, _bins(spark)).select("id", F.round("mu", 4).alias("mu"), F.round("var", 0).alias("var"))


@query(f"""WITH {SEG}, {BINS}, s AS (SELECT lag_idx, lo + p AS lo, hi + p AS hi FROM seg, (VALUES (-2048.0), (0.0), (2048.0)) t(p)), w AS (SELECT * FROM bins WHERE id < 32)
SELECT lag_idx, w.id AS eul_idx, least(s.hi, w.hi) - greatest(s.lo, w.lo) AS volume FROM s JOIN w ON s.hi > w.lo AND w.hi > s.lo""")
def periodic_overlap_1d(spark: SparkSession, d: str) -> DataFrame:
    ov = overlap.overlap_boxes(overlap.ghosts(_segments(spark, d), [2048.0]), grid_boxes(spark, 5, [0.0], [2048.0]), 1, side=[64.0])
    return ov.select(F.col("a_id").alias("lag_idx"), F.col("b_id").alias("eul_idx"), "volume")


@query(f"""WITH {SEG}, {BINS}, {OV1}, p AS (SELECT quantile_cont(volume, [0.0, 0.1, 0.5, 0.9, 1.0]) AS p, count(*) AS n, sum(volume) AS t FROM ov),
l AS (SELECT lag_idx, eul_idx FROM ov ORDER BY volume, lag_idx, eul_idx LIMIT 1), m AS (SELECT lag_idx, eul_idx FROM ov ORDER BY volume DESC, lag_idx, eul_idx LIMIT 1)
SELECT n AS n_entries, t AS total_volume, p[1] AS p0, p[2] AS p10, p[3] AS p50, p[4] AS p90, p[5] AS p100, l.lag_idx AS least_lag, l.eul_idx AS least_eul, m.lag_idx AS most_lag, m.eul_idx AS most_eul FROM p, l, m""")
def describe_volumes(spark: SparkSession, d: str) -> DataFrame:
    r = overlap.describe(_overlap_1d(spark, d))
    return r.select("n_entries", "total_volume", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p0", "p10", "p50", "p90", "p100"))], F.col("least.lag_idx").alias("least_lag"), F.col("least.eul_idx").alias("least_eul"), F.col("most.lag_idx").alias("most_lag"), F.col("most.eul_idx").alias("most_eul"))


@query(f"WITH {SEG}, {BINS}, {OV1}, c AS (SELECT eul_idx, count(*) AS n FROM ov GROUP BY 1) SELECT id, coalesce(n, 0) AS n FROM bins LEFT JOIN c ON id = eul_idx")
def entries_per_cell(spark: SparkSession, d: str) -> DataFrame:
    return overlap.per_side(_overlap_1d(spark, d), _bins(spark), "eul_idx")


@query(f"WITH {SEG}, {BINS}, {OV1}, r AS (SELECT volume / (hi - lo) AS q, volume FROM ov JOIN seg USING (lag_idx)) SELECT round(min(q), 6) AS min_ratio, round(max(q), 6) AS max_ratio, sum(volume) AS total, CAST(count(*) FILTER (volume <= 0) AS BIGINT) AS n_nonpositive FROM r")
def remap_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    v = segments(spark, d).select(F.col("lag_idx").alias("id"), (F.col("hi") - F.col("lo")).alias("volume"))
    r = remap.diagnostics(_overlap_1d(spark, d), v)
    return r.select(r6(F.col("min_ratio"), "min_ratio"), r6(F.col("max_ratio"), "max_ratio"), "total", "n_nonpositive")


G8 = "g AS (SELECT range AS id, CAST(range % 16 AS DOUBLE) * 4 AS lx, CAST(range % 16 AS DOUBLE) * 4 + 4 AS hx, CAST(range // 16 AS DOUBLE) / 2 AS ly, CAST(range // 16 AS DOUBLE) / 2 + 0.5 AS hy FROM range(256))"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("id", F.array("lx", "ly").alias("lo"), F.array("hx", "hy").alias("hi"))


def _box_overlap(spark: SparkSession, d: str, order: int) -> DataFrame:
    return overlap.overlap_boxes(_boxes(spark, d), grid_boxes(spark, 4, [0.0, 0.0], [64.0, 8.0]), 2, order, side=[8.0, 1.0])


@query(f"WITH {BOX}, {G8} SELECT b.id AS a_id, g.id AS b_id, (least(b.hx, g.hx) - greatest(b.lx, g.lx)) * (least(b.hy, g.hy) - greatest(b.ly, g.ly)) AS volume FROM box b JOIN g ON b.hx > g.lx AND g.hx > b.lx AND b.hy > g.ly AND g.hy > b.ly")
def box_overlap_2d(spark: SparkSession, d: str) -> DataFrame:
    return _box_overlap(spark, d, 0).select("a_id", "b_id", "volume")


BM = f"""WITH {BOX}, {G8}, o AS (SELECT b.id AS a_id, g.id AS b_id, greatest(b.lx, g.lx) AS a, least(b.hx, g.hx) AS b, greatest(b.ly, g.ly) AS c, least(b.hy, g.hy) AS d FROM box b JOIN g ON b.hx > g.lx AND g.hx > b.lx AND b.hy > g.ly AND g.hy > b.ly),
m AS (SELECT *, b - a AS x0, (b * b - a * a) / 2 AS x1, (b * b * b - a * a * a) / 3 AS x2, d - c AS y0, (d * d - c * c) / 2 AS y1, (d * d * d - c * c * c) / 3 AS y2 FROM o)"""


@query(BM + " SELECT b_id, round(sum(x0 * y0), 4) AS m00, round(sum(x1 * y0), 4) AS m10, round(sum(x0 * y1), 4) AS m01, round(sum(x2 * y0), 3) AS m20, round(sum(x1 * y1), 4) AS m11, round(sum(x0 * y2), 4) AS m02, round(avg((a + b) / 2), 6) AS cx FROM m GROUP BY b_id")
def box_moments_2d(spark: SparkSession, d: str) -> DataFrame:
    ov = _box_overlap(spark, d, 2)
    m = lambda i, n, p: F.round(F.sum(F.get("moments", F.lit(i))), p).alias(n)
    return ov.groupBy("b_id").agg(m(0, "m00", 4), m(1, "m10", 4), m(2, "m01", 4), m(3, "m20", 3), m(4, "m11", 4), m(5, "m02", 4), r6(F.avg(F.get("centroid", F.lit(0))), "cx"))


@query(BM + " SELECT b_id, round(sum(x1 * y0 - 3 * x0 * y0), 4) AS m10, round(sum(x0 * y1 + 2 * x0 * y0), 4) AS m01, round(sum(x2 * y0 - 6 * x1 * y0 + 9 * x0 * y0), 3) AS m20, round(sum((x1 - 3 * x0) * (y1 + 2 * y0)), 4) AS m11 FROM m GROUP BY b_id")
def shift_moments(spark: SparkSession, d: str) -> DataFrame:
    ov = _box_overlap(spark, d, 2).select("b_id", A.shift_moments(F.col("moments"), [F.lit(3.0), F.lit(-2.0)], 2).alias("m"))
    m = lambda i, n, p: F.round(F.sum(F.get("m", F.lit(i))), p).alias(n)
    return ov.groupBy("b_id").agg(m(1, "m10", 4), m(2, "m01", 4), m(3, "m20", 3), m(4, "m11", 4))


@query(f"WITH {BOX}, {G8}, o AS (SELECT b.id AS a_id, g.id AS b_id, (least(b.hx, g.hx) - greatest(b.lx, g.lx)) * (least(b.hy, g.hy) - greatest(b.ly, g.ly)) AS volume FROM box b JOIN g ON b.hx > g.lx AND g.hx > b.lx AND b.hy > g.ly AND g.hy > b.ly) SELECT b_id, arg_max(a_id, (volume, -a_id)) AS a_id FROM o GROUP BY b_id")
def largest_source(spark: SparkSession, d: str) -> DataFrame:
    return remap.best_source(_box_overlap(spark, d, 0))


# Points, particles, lattices ---------------------------------------------------------------------


@query(f"WITH {PART}, p AS (SELECT pid, x + 3 * vx - floor(x + 3 * vx) AS x, y + 3 * vy - floor(y + 3 * vy) AS y, z + 3 * vz - floor(z + 3 * vz) AS z FROM particle) SELECT pid, CAST(least(greatest(floor(x * 4), 0), 3) + 4 * least(greatest(floor(y * 4), 0), 3) + 16 * least(greatest(floor(z * 4), 0), 3) + 1 AS BIGINT) AS cell FROM p")
def bin_particles(spark: SparkSession, d: str) -> DataFrame:
    p = particles(spark, d)
    moved = [S.wrap(F.col(c) + 3 * F.col("v" + c), 1.0) for c in "xyz"]
    return p.select("pid", S.cell_of_position(moved, 4, 1.0).cast("long").alias("cell"))


@query(f"""WITH {PART}, c AS (SELECT CAST(least(greatest(floor(x * 4), 0), 3) + 4 * least(greatest(floor(y * 4), 0), 3) + 16 * least(greatest(floor(z * 4), 0), 3) + 1 AS BIGINT) AS cell, * FROM particle)
SELECT cell, count(*) AS n, round(count(*) / (1.0 / 64), 6) AS density, round(avg(vx), 6) AS ux, CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE ELSE round(sum(vx * vx) / count(*) - pow(sum(vx) / count(*), 2), 6) END AS tx FROM c GROUP BY cell""")
def cell_sampling(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import particles as P

    return P.profile(P.sampled(P.sorted_into_cells(particles(spark, d), 4, 1.0)), 1, 1.0 / 64).select("cell", "n", r6(F.col("density"), "density"), r6(F.col("ux"), "ux"), r6(F.col("tx"), "tx"))


@query(f"WITH {PART} SELECT count(*) AS n, round(sum(vx), 6) AS px, round(sum(vy), 6) AS py, round(sum(vz), 6) AS pz, round(0.5 * sum(vx * vx + vy * vy + vz * vz), 6) AS energy, round(avg(vx), 6) AS ux, round(var_pop(vx), 6) AS tx, round(var_pop(vy), 6) AS ty, round(var_pop(vz), 6) AS tz FROM particle")
def momentum_energy(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import particles as P

    r = P.totals(particles(spark, d))
    return r.select("n", *[r6(F.col(c), c) for c in ("px", "py", "pz", "energy", "ux", "tx", "ty", "tz")])


@query(f"WITH {PT}, q AS (SELECT id, round_even((x / 1.5 - 0) * (65535.0 / 64), 0) AS qx, round_even((y / 3 - 0) * (65535.0 / 64), 0) AS qy FROM pt) SELECT id, CAST(qx AS BIGINT) AS qx, CAST(qy AS BIGINT) AS qy, round(qx / (65535.0 / 64), 9) AS bx FROM q")
def quantize_points(spark: SparkSession, d: str) -> DataFrame:
    lat = S.Lattice([0.0, 0.0], [64.0, 16.0], 16)
    q = points(spark, d).select("id", lat.quantize(F.col("x") / 1.5, 0).alias("qx"), lat.quantize(F.col("y") / 3, 1).alias("qy"))
    return q.select("id", "qx", "qy", F.round(lat.dequantize(F.col("qx"), 0), 9).alias("bx"))


BITS = """WITH b AS (SELECT CAST(o_orderkey % 1024 AS BIGINT) AS x, CAST(o_custkey % 1024 AS BIGINT) AS m, o_orderkey AS id FROM orders),
s AS (SELECT id, x, m, i, (m >> i) & 1 AS on_, bit_count(m & ((1::BIGINT << i) - 1)) AS k FROM b, (SELECT CAST(range AS INTEGER) AS i FROM range(10)))"""


@query(BITS + """ SELECT id, CAST(sum(CASE WHEN on_ = 1 THEN ((x >> k) & 1) << i ELSE 0 END) AS BIGINT) AS deposited, CAST(sum(CASE WHEN on_ = 1 THEN ((x >> i) & 1) << k ELSE 0 END) AS BIGINT) AS extracted,
CAST(any_value(bit_count(x)) AS INTEGER) AS ones, CAST(10 - coalesce(max(CASE WHEN (x >> i) & 1 = 1 THEN i + 1 END), 0) AS INTEGER) AS leading, CAST(coalesce(min(CASE WHEN (x >> i) & 1 = 1 THEN i END), 10) AS INTEGER) AS trailing,
CAST(coalesce(min(CASE WHEN on_ = 1 AND k = 2 THEN i END), 10) AS INTEGER) AS third, CAST(1::BIGINT << any_value(bit_count(m)) AS BIGINT) AS n_children FROM s GROUP BY id""")
def pdep_pext(spark: SparkSession, d: str) -> DataFrame:
    x, m = F.col("x"), F.col("m")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1024).cast("long").alias("x"), (F.col("o_custkey") % 1024).cast("long").alias("m"))
    return o.select("id", S.pdep(x, m, 10).alias("deposited"), S.pext(x, m, 10).alias("extracted"), S.count_ones(x).alias("ones"), S.leading_zeros(x, 10).alias("leading"), S.trailing_zeros(x, 10).alias("trailing"), S.nth_set_bit(m, F.lit(2), 10).alias("third"), S.children_count(m).alias("n_children"))


@query(f"WITH {SEG}, s AS (SELECT lag_idx, lo, hi, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM seg WINDOW w AS (PARTITION BY lag_idx % 50 ORDER BY lag_idx)) SELECT lag_idx, hi - lo AS len, CASE WHEN least(hi, hi2) > greatest(lo, lo2) THEN least(hi, hi2) - greatest(lo, lo2) ELSE 0.0 END AS shared, lo + 1 BETWEEN lo2 AND hi2 AS inside, round((lo2 - lo) / (hi - lo), 6) AS t FROM s WHERE lo2 IS NOT NULL")
def intervals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy(F.col("lag_idx") % 50).orderBy("lag_idx")
    s = segments(spark, d).select("lag_idx", "lo", "hi", F.lead("lo").over(w).alias("lo2"), F.lead("hi").over(w).alias("hi2")).where("lo2 is not null")
    i = S.interval_intersection(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))
    return s.select("lag_idx", S.interval_length(F.col("lo"), F.col("hi")).alias("len"), i.alias("i"), S.interval_contains(F.col("lo2"), F.col("hi2"), F.col("lo") + 1).alias("inside"), r6(S.to_reference(F.col("lo"), F.col("hi"), F.col("lo2")), "t")).select("lag_idx", "len", S.interval_length(F.col("i.lo"), F.col("i.hi")).alias("shared"), "inside", "t")


# Polynomials -------------------------------------------------------------------------------------

COEF = "c AS (SELECT id, x / 64 AS x, y / 16 AS y, 1.0 + id % 3 AS c0, id % 5 - 2.0 AS c1, id % 7 / 2.0 AS c2, 0.5 AS c3, id % 2 - 0.5 AS c4, -1.25 AS c5 FROM pt)"


def _coeffs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    c = F.array(1.0 + i % 3, i % 5 - 2.0, i % 7 / 2.0, F.lit(0.5), i % 2 - 0.5, F.lit(-1.25)).cast("array<double>")
    return points(spark, d).select("id", (F.col("x") / 64).alias("x"), (F.col("y") / 16).alias("y"), c.alias("c"))


@query(f"WITH {PT}, {COEF} SELECT id, round(c0 + c1*x + c2*y + c3*x*x + c4*x*y + c5*y*y, 8) AS value, round(c1 + 2*c3*x + c4*y, 8) AS dx, round(c2 + c4*x + 2*c5*y, 8) AS dy FROM c")
def poly_eval(spark: SparkSession, d: str) -> DataFrame:
    at = [F.col("x"), F.col("y")]
    g = A.poly_gradient(F.col("c"), at, 2)
    return _coeffs(spark, d).select("id", F.round(A.poly_eval(F.col("c"), at, 2), 8).alias("value"), F.round(g[0], 8).alias("dx"), F.round(g[1], 8).alias("dy"))


@query(f"WITH {PT}, {COEF}, b AS (SELECT *, 1 - x - y AS l FROM c) SELECT id, round(c0*l*l + 2*c1*x*l + 2*c2*y*l + c3*x*x + 2*c4*x*y + c5*y*y, 8) AS value FROM b")
def bernstein_eval(spark: SparkSession, d: str) -> DataFrame:
    return _coeffs(spark, d).select("id", F.round(A.poly_eval(F.col("c"), [F.col("x"), F.col("y")], 2, "bernstein"), 8).alias("value"))


@query(f"WITH {PT}, {COEF} SELECT id, round(CAST(c0 AS DOUBLE), 8) AS m0, round(CAST(2*(c1-c0) AS DOUBLE), 8) AS m1, round(2*(c2-c0), 8) AS m2, round(CAST(c0-2*c1+c3 AS DOUBLE), 8) AS m3, round(2*(c0-c1-c2+c4), 8) AS m4, round(c0-2*c2+c5, 8) AS m5, round(CAST(c1 AS DOUBLE), 8) AS back FROM c")
def basis_change(spark: SparkSession, d: str) -> DataFrame:
    m = A.change_basis(F.col("c"), 2, 2, "monomial")
    r = _coeffs(spark, d).select("id", m.alias("m")).select("id", "m", A.change_basis(F.col("m"), 2, 2, "bernstein").alias("b"))
    return r.select("id", *[F.round(F.get("m", F.lit(i)), 8).alias(f"m{i}") for i in range(6)], F.round(F.get("b", F.lit(1)), 8).alias("back"))


@query(f"WITH {PT}, {COEF} SELECT id, c0 > 0 AND c1 > 0 AND c2 > 0 AND c3 > 0 AND c4 > 0 AND c5 > 0 AS positive, CAST(CASE WHEN NOT c0 > 0 THEN 1 WHEN NOT c1 > 0 THEN 2 WHEN NOT c2 > 0 THEN 3 WHEN NOT c3 > 0 THEN 4 WHEN NOT c4 > 0 THEN 5 ELSE 6 END AS BIGINT) AS first_failing FROM c")
def positivity(spark: SparkSession, d: str) -> DataFrame:
    return _coeffs(spark, d).select("id", A.positive_certificate(F.col("c")).alias("positive"), A.first_not_positive(F.col("c")).alias("first_failing"))


@query(f"WITH {PT}, {COEF}, q AS (SELECT id, c0 AS a, c1 AS b, c2 AS c, c3 AS d FROM c) SELECT id, round(sqrt((b*b + c*c/3 + d*d/5 + b*c + 2*b*d/3 + c*d/2) + 0.01), 6) AS err FROM q")
def action_error(spark: SparkSession, d: str) -> DataFrame:
    c = lambda i: F.get("c", F.lit(i))
    low, high = F.array(c(0), c(1)), F.array(c(0) + c(1), c(1) + c(2), c(3))
    return _coeffs(spark, d).select("id", r6(A.action_error(low, 1, high, 2, F.lit(0.1), 1), "err"))


@query(f"WITH {PT}, {COEF}, s AS (SELECT *, greatest(x, 0.25) AS a, least(x + 0.5, 1.25) AS b FROM c) SELECT id, round(CASE WHEN b > a THEN c0*(b-a) + c1*((b-x)*(b-x)-(a-x)*(a-x))/2 + c2*(pow(b-x,3)-pow(a-x,3))/3 ELSE 0 END, 8) AS value FROM s")
def subinterval_integral(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _coeffs(spark, d).select("id", F.round(A.integrate_subinterval(F.col("c"), 2, x, x + 1.0, F.lit(0.25), F.least(x + 0.5, F.lit(1.25))), 8).alias("value"))


@query(f"WITH {PT}, {COEF} SELECT id, round(c0*(2*x-1)*(x-1) + c1*4*x*(1-x) + c2*x*(2*x-1), 8) AS value FROM c")
def point_samples(spark: SparkSession, d: str) -> DataFrame:
    return _coeffs(spark, d).select("id", F.round(A.lagrange_eval(F.col("c"), [F.col("x")], 3), 8).alias("value"))


# Triangles ---------------------------------------------------------------------------------------

AREA = "((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2"
REF = "r AS (SELECT *, x2 - x1 AS a, x3 - x1 AS b, y2 - y1 AS c, y3 - y1 AS d FROM tri)"


@query(f"WITH {TRI}, {REF} SELECT id, (a*d - b*c) / 2 AS area, a*d - b*c AS jacobian, a AS f11, b AS f12, c AS f21, d AS f22, CASE WHEN a*d - b*c = 0 THEN NULL ELSE round((a*a + b*b + c*c + d*d) / abs(a*d - b*c) / 2, 6) END AS distortion FROM r")
def simplex_metrics(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions import simplex as X

    t = triangles(spark, d)
    cur = [[F.col(f"{c}{k}") for c in "xy"] for k in (1, 2, 3)]
    ref = [[F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0)]]
    f = X.deformation_gradient(cur, ref)
    return t.select("id", X.volume(cur).alias("area"), X.volume_jacobian(cur, ref).alias("jacobian"), f[0][0].alias("f11"), f[0][1].alias("f12"), f[1][0].alias("f21"), f[1][1].alias("f22"), r6(X.distortion(cur, ref), "distortion"))


@query(f"WITH {TRI}, {REF} SELECT bool_or(a*d - b*c <= 0) AS inverted, round(greatest(0, max((a*a + b*b + c*c + d*d) / nullif(abs(a*d - b*c), 0) / 2)), 6) AS worst FROM r")
def mesh_health(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions import simplex as X

    cur = [[F.col(f"{c}{k}") for c in "xy"] for k in (1, 2, 3)]
    ref = [[F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0)]]
    return triangles(spark, d).agg(X.inverted(cur, ref).alias("inverted"), r6(F.greatest(F.lit(0.0), F.max(X.distortion(cur, ref))), "worst"))


@query(f"WITH {TRI} SELECT id, round(abs({AREA}), 6) AS area, round(abs({AREA}) * (x1 + x2 + x3) / 3, 4) AS mx FROM tri WHERE {AREA} <> 0")
def triangle_area_conserved(spark: SparkSession, d: str) -> DataFrame:
    ov = overlap.overlap_triangles(triangles(spark, d), grid_boxes(spark, 5, [0.0, 0.0], [64.0, 64.0]), 1, side=[4.0, 4.0])
    return ov.groupBy(F.col("lag_idx").alias("id")).agg(r6(F.sum("volume"), "area"), F.round(F.sum(F.get("moments", F.lit(1))), 4).alias("mx"))


@query(f"WITH {TRI} SELECT count(*) AS n_simplices, round(sum(abs({AREA})), 4) AS mass FROM tri WHERE {AREA} <> 0")
def mass_deposit(spark: SparkSession, d: str) -> DataFrame:
    tri, cells = triangles(spark, d), grid_boxes(spark, 5, [0.0, 0.0], [64.0, 64.0])
    ov = overlap.overlap_triangles(tri, cells, 0, side=[4.0, 4.0])
    rho = remap.density(ov, tri.select("id", F.lit(1.0).alias("factor")), cells)
    n = tri.where(overlap.signed_area() != 0).agg(F.count(F.lit(1)).alias("n_simplices"))
    return rho.agg(F.round(F.sum(F.col("rho") * 4.0), 4).alias("mass")).crossJoin(n).select("n_simplices", "mass")


@query("WITH v AS (SELECT CAST(p_partkey AS BIGINT) AS a, CAST(p_partkey % 97 + 10000 AS BIGINT) AS b, CAST(p_partkey % 53 + 20000 AS BIGINT) AS c FROM part) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT a AS x, b AS y FROM v UNION ALL SELECT b, c FROM v UNION ALL SELECT a, c FROM v)")
def edges(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions import simplex as X

    k = F.col("p_partkey").cast("long")
    return X.edges(table(spark, d, "part").select(F.array(k, k % 97 + 10000, k % 53 + 20000).cast("array<bigint>").alias("vids")))
