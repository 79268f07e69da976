"""Adaptive trees over points: refinement, navigation, neighbours, halos, solvers, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import fields, grid, kernels, neighbors, overlap, patches, remap
from tessera.plans.store import stored
from tessera.queries.basics import r6
from tessera.sources.fixtures import PT, SEG, grid_boxes, points, segments

Q, SQL = {}, {}
DEPTH, MANY = 5, 400


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def pyramid(pts: DataFrame, depth: int) -> DataFrame:
    """``level``, ``ix``, ``n``, ``w``: points per cell of every level, each level from the finer one's sums."""
    at = lambda c, span, k: F.floor(F.col(c) / span * (1 << k)).cast("long")
    base = pts.groupBy(at("x", 64.0, depth).alias("i"), at("y", 16.0, depth).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    up = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("k"))
    return up.groupBy((F.lit(depth) - F.col("k")).alias("level"), F.array(shift("i"), shift("j")).alias("ix")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return stored(pyramid(points(spark, d), DEPTH), "pyramid")


def counted(cells: DataFrame, counts: DataFrame) -> DataFrame:
    return cells.join(counts, ["level", "ix"], "left").select("path", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("value"))


def tree(spark: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    """Cells split while they hold more than ``MANY`` points, to ``DEPTH`` levels."""
    counts = _counts(spark, d) if counts is None else counts
    return grid.from_pyramid(counts, 2, MANY, DEPTH)


def tree_by_passes(counts: DataFrame) -> DataFrame:
    """The same, level by level."""
    cells, more = grid.root(counts.sparkSession, 2), True
    while more:
        cells, more, _ = grid.refine_by_indicator(cells, counted(cells, counts), 2, MANY, -1.0, DEPTH)
        cells = stored(cells, "cells") if more else cells
    return cells


TREE = f"""{PT}, lv AS (SELECT CAST(range AS INTEGER) AS l FROM range({DEPTH + 1})),
cnt AS (SELECT l, CAST(floor(x / 64 * (1 << l)) AS BIGINT) AS i, CAST(floor(y / 16 * (1 << l)) AS BIGINT) AS j, count(*) AS n, sum(w) AS w FROM pt, lv GROUP BY 1, 2, 3),
split AS (SELECT * FROM cnt WHERE n > {MANY} AND l < {DEPTH}),
born AS (SELECT 0 AS l, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j UNION ALL SELECT l + 1, 2 * i + a, 2 * j + b FROM split, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(a, b)),
raw AS (SELECT b.l, b.i, b.j, coalesce(c.n, 0) AS n, coalesce(c.w, 0) AS w, NOT (coalesce(c.n, 0) > {MANY} AND b.l < {DEPTH}) AS leaf,
 list_transform(range(b.l), lambda s: ((b.i >> CAST(b.l - 1 - s AS INTEGER)) & 1) + 2 * ((b.j >> CAST(b.l - 1 - s AS INTEGER)) & 1)) AS path FROM born b LEFT JOIN cnt c ON b.l = c.l AND b.i = c.i AND b.j = c.j),
tree AS (SELECT row_number() OVER (ORDER BY path) AS id, * FROM raw),
lf AS (SELECT id, l, n, w, path, i << ({DEPTH} - l) AS x0, (i + 1) << ({DEPTH} - l) AS x1, j << ({DEPTH} - l) AS y0, (j + 1) << ({DEPTH} - l) AS y1 FROM tree WHERE leaf)"""
NB = f"""nb AS (SELECT a.id AS cell, 1 AS axis, 2 AS side, b.id AS nbr FROM lf a JOIN lf b ON a.x1 = b.x0 AND a.y1 > b.y0 AND b.y1 > a.y0
 UNION ALL SELECT b.id, 1, 1, a.id FROM lf a JOIN lf b ON a.x1 = b.x0 AND a.y1 > b.y0 AND b.y1 > a.y0
 UNION ALL SELECT a.id, 2, 2, b.id FROM lf a JOIN lf b ON a.y1 = b.y0 AND a.x1 > b.x0 AND b.x1 > a.x0
 UNION ALL SELECT b.id, 2, 1, a.id FROM lf a JOIN lf b ON a.y1 = b.y0 AND a.x1 > b.x0 AND b.x1 > a.x0)"""
TN = f"WITH {TREE}, {NB}"


def _numbered(spark: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    return stored(grid.numbered(tree(spark, d, counts)), "numbered")


@query(f"WITH {TREE} SELECT t.id AS cell_id, u.id AS parent_id, t.l AS level, t.i, t.j, t.leaf AS is_leaf, CAST(len(t.path) AS BIGINT) AS steps FROM tree t LEFT JOIN tree u ON t.l > 0 AND u.path = t.path[1:t.l - 1]")
def adaptive_grid(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("cell_id", "parent_id", "level", F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"), "is_leaf", F.size("path").cast("long").alias("steps"))


@query(f"WITH {TREE} SELECT l AS level, i, j, leaf AS is_leaf, array_to_string(path, '') AS path FROM tree")
def refine_passes(spark: SparkSession, d: str) -> DataFrame:
    """The grid made by an indicator that is asked again after each pass."""
    c = tree_by_passes(_counts(spark, d))
    return c.select("level", F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"), "is_leaf", F.array_join("path", "").alias("path"))


@query(f"""WITH {TREE}, s AS (SELECT a.id, count(*) AS size FROM tree a JOIN tree b ON b.l >= a.l AND b.path[1:a.l] = a.path GROUP BY 1)
SELECT a.id AS cell_id, s.size AS subtree_size, CAST(1 << a.l AS BIGINT) AS denominator, 2 * a.l AS volume_exponent, round(1.0 / (1 << (2 * a.l)), 9) AS volume, CASE WHEN a.l = 0 THEN 0 ELSE 2 * (a.i % 2) - 1 END AS cx FROM tree a JOIN s USING (id)""")
def tree_nav(spark: SparkSession, d: str) -> DataFrame:
    c = _numbered(spark, d)
    boxes = grid.with_boxes(c, [0.0, 0.0], [1.0, 1.0]).join(grid.subtree_sizes(c), "path")
    cx = F.when(F.col("level") == 0, 0).otherwise(grid.center_in_parent(F.col("sibling_index"), F.col("split_mask"), 2)[0])
    return boxes.select("cell_id", "subtree_size", F.get(grid.denominators(F.col("lev")), F.lit(0)).alias("denominator"), grid.volume_exponent(F.col("lev")).alias("volume_exponent"), F.round("volume", 9).alias("volume"), cx.cast("long").alias("cx"))


@query(f"""WITH {TREE}, p AS (SELECT a.id AS a, b.id AS b, a.path AS pa, b.path AS pb, a.l AS la, b.l AS lb, a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj FROM tree a JOIN tree b ON b.id = a.id + 3),
q AS (SELECT *, len(list_filter(range(1, least(la, lb) + 1), lambda k: pa[1:k] = pb[1:k])) AS k FROM p)
SELECT q.a, q.b, t.id AS lca, ai - (t.i << CAST(la - k AS INTEGER)) - (bi - (t.i << CAST(lb - k AS INTEGER))) AS dx, aj - (t.j << CAST(la - k AS INTEGER)) - (bj - (t.j << CAST(lb - k AS INTEGER))) AS dy FROM q JOIN tree t ON t.path = pa[1:k]""")
def common_ancestors(spark: SparkSession, d: str) -> DataFrame:
    c = _numbered(spark, d).select("cell_id", "path", "lev", "ix")
    a = c.select(*[F.col(x).alias("a_" + x) for x in c.columns])
    b = c.select(*[F.col(x).alias("b_" + x) for x in c.columns])
    p = a.join(b, F.col("b_cell_id") == F.col("a_cell_id") + 3).withColumn("path", grid.common_path(F.col("a_path"), F.col("b_path")))
    j = p.join(c, "path")
    ra, rb = (grid.relative_place(F.col(x + "_ix"), F.col(x + "_lev"), F.col("ix"), F.col("lev")) for x in "ab")
    diff = F.zip_with(ra, rb, lambda x, y: x - y)
    return j.select(F.col("a_cell_id").alias("a"), F.col("b_cell_id").alias("b"), F.col("cell_id").alias("lca"), F.get(diff, F.lit(0)).alias("dx"), F.get(diff, F.lit(1)).alias("dy"))


@query(f"""WITH {TREE}, ok AS (SELECT path[1:l - 1] AS up FROM tree WHERE l > 0 GROUP BY 1 HAVING bool_and(leaf AND n < 150)),
after AS (SELECT l, i, j, w, leaf FROM tree t WHERE (l = 0 OR path[1:l - 1] NOT IN (SELECT up FROM ok)) AND path NOT IN (SELECT up FROM ok) AND leaf),
made AS (SELECT l - 1 AS l, i // 2 AS i, j // 2 AS j, avg(n) AS v FROM tree WHERE l > 0 AND path[1:l - 1] IN (SELECT up FROM ok) GROUP BY 1, 2, 3),
same AS (SELECT l, i, j, CAST(n AS DOUBLE) AS v FROM tree WHERE leaf AND (l = 0 OR path[1:l - 1] NOT IN (SELECT up FROM ok)))
SELECT l AS level, i, j, round(v, 6) AS value FROM (SELECT * FROM made UNION ALL SELECT * FROM same)""")
def coarsen_pass(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    cells = stored(tree(spark, d, counts), "cells")
    value = stored(counted(cells, counts), "value")
    after, _, done = grid.refine_by_indicator(cells, value, 2, 1e18, 150.0, DEPTH)
    new = fields.coarsened_mean(value, cells, after) if done else value
    return grid.leaves(after).join(new, "path").select("level", F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"), r6(F.col("value"), "value"))


@query(f"{TN} SELECT cell, axis, side, nbr FROM nb")
def face_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(_numbered(spark, d), 2)


@query(f"{TN} SELECT cell, axis, side, nbr FROM nb")
def face_neighbors_general(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors_anisotropic(_numbered(spark, d), 2)


@query(f"{TN} SELECT cell, axis, side, string_agg(nbr, ',' ORDER BY nbr) AS nbrs FROM nb GROUP BY 1, 2, 3")
def fine_neighbors(spark: SparkSession, d: str) -> DataFrame:
    n = neighbors.fine_neighbors(neighbors.neighbors(_numbered(spark, d), 2))
    return n.select("cell", "axis", "side", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query(f"{TN}, f AS (SELECT cell, coalesce(min(nbr) FILTER (axis = 1 AND side = 1), 0) AS a, coalesce(min(nbr) FILTER (axis = 1 AND side = 2), 0) AS b, coalesce(min(nbr) FILTER (axis = 2 AND side = 1), 0) AS c, coalesce(min(nbr) FILTER (axis = 2 AND side = 2), 0) AS d FROM nb GROUP BY 1) SELECT lf.id AS cell, coalesce(a, 0) AS xlo, coalesce(b, 0) AS xhi, coalesce(c, 0) AS ylo, coalesce(d, 0) AS yhi FROM lf LEFT JOIN f ON cell = id")
def representative_neighbors(spark: SparkSession, d: str) -> DataFrame:
    c = _numbered(spark, d)
    r = neighbors.representatives(neighbors.neighbors(c, 2), c, 2)
    return r.select("cell", *[F.get("faces", F.lit(k)).alias(n) for k, n in enumerate(("xlo", "xhi", "ylo", "yhi"))])


PER = f"""per AS (SELECT cell, axis, side, nbr FROM nb UNION ALL
SELECT a.id, 1, 1, min(b.id) FROM lf a JOIN lf b ON a.x0 = 0 AND b.x1 = {1 << DEPTH} AND a.y1 > b.y0 AND b.y1 > a.y0 GROUP BY 1 UNION ALL
SELECT a.id, 1, 2, min(b.id) FROM lf a JOIN lf b ON b.x0 = 0 AND a.x1 = {1 << DEPTH} AND a.y1 > b.y0 AND b.y1 > a.y0 GROUP BY 1)"""
SIDES = [(neighbors.PERIODIC, neighbors.PERIODIC), (neighbors.REFLECTING, neighbors.DIRICHLET)]


@query(f"{TN}, {PER} SELECT * FROM per")
def periodic_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbors(_numbered(spark, d), 2, SIDES)


@query(f"{TN}, e AS (SELECT DISTINCT cell AS a, nbr AS b FROM nb), one AS (SELECT id AS a, id AS b FROM lf UNION SELECT a, b FROM e) SELECT a AS cell, b AS other FROM one UNION SELECT one.a, e.b FROM one JOIN e ON one.b = e.a")
def adjacency_2hop(spark: SparkSession, d: str) -> DataFrame:
    c = _numbered(spark, d)
    return neighbors.adjacency(stored(neighbors.neighbors(c, 2), "nbrs"), c, 2)


@query(f"""{TN} SELECT cell AS "left", nbr AS "right", axis, count(*) OVER (PARTITION BY cell, axis) > 1 AS hanging FROM nb WHERE side = 2""")
def face_table(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.faces(neighbors.neighbors(_numbered(spark, d), 2))


@query(f"WITH {TREE} SELECT id AS cell, a AS axis, s AS side FROM lf, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) t(a, s) WHERE (a = 1 AND s = 1 AND x0 = 0) OR (a = 1 AND s = 2 AND x1 = {1 << DEPTH}) OR (a = 2 AND s = 1 AND y0 = 0) OR (a = 2 AND s = 2 AND y1 = {1 << DEPTH})")
def boundary_faces(spark: SparkSession, d: str) -> DataFrame:
    c = _numbered(spark, d)
    return neighbors.boundary_faces(neighbors.neighbors(c, 2), c, 2)


def _balanced_sql() -> str:
    """Cells that a balanced tree splits, level by level from the finest: those of the tree, and the parents
    of the face neighbours of finer ones."""
    parts = [f"s{DEPTH - 1} AS (SELECT i, j FROM split WHERE l = {DEPTH - 1})"]
    for k in range(DEPTH - 2, -1, -1):
        near = f"SELECT (i + a) // 2 AS i, (j + b) // 2 AS j FROM s{k + 1}, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(a, b) WHERE i + a BETWEEN 0 AND {(1 << (k + 1)) - 1} AND j + b BETWEEN 0 AND {(1 << (k + 1)) - 1}"
        parts.append(f"s{k} AS (SELECT i, j FROM split WHERE l = {k} UNION {near})")
    every = " UNION ALL ".join(f"SELECT {k} AS l, i, j FROM s{k}" for k in range(DEPTH))
    return ", ".join(parts) + f", every AS ({every}), kids AS (SELECT 0 AS l, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j UNION ALL SELECT l + 1, 2 * i + a, 2 * j + b FROM every, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(a, b))"


@query(f"WITH {TREE}, {_balanced_sql()} SELECT l AS level, i, j FROM kids ANTI JOIN every USING (l, i, j)")
def balance_2to1(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of the grid once no two face neighbours are more than a level apart."""
    c = neighbors.balance(tree(spark, d), 2, grid.numbered)
    return grid.leaves(c).select("level", F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"))


@query(f"""{TN}, {PER}, one AS (SELECT cell, min(nbr) FILTER (axis = 1 AND side = 2) AS e, min(nbr) FILTER (axis = 2 AND side = 1) AS s, min(nbr) FILTER (axis = 2 AND side = 2) AS n FROM per GROUP BY 1),
h AS (SELECT lf.id, coalesce(o.e, NULL) AS e, coalesce(o.s, lf.id) AS s, o.n AS n FROM lf LEFT JOIN one o ON o.cell = lf.id),
v AS (SELECT id, CAST(n AS DOUBLE) AS q FROM lf)
SELECT h.id AS cell, ve.q AS east, vs.q AS south, vn.q AS north, vd.q AS east_south FROM h LEFT JOIN v ve ON ve.id = h.e LEFT JOIN v vs ON vs.id = h.s LEFT JOIN v vn ON vn.id = h.n
LEFT JOIN h he ON he.id = h.e LEFT JOIN v vd ON vd.id = he.s""")
def halo_stencil(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    c = _numbered(spark, d, counts)
    n = stored(neighbors.neighbors(c, 2, SIDES), "nbrs")
    f = stored(grid.leaves(c).join(counts, ["level", "ix"], "left").select(F.col("cell_id").alias("cell"), F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("value")), "field")
    out = f.select("cell")
    for name, hops in (("east", [(1, 2)]), ("south", [(2, 1)]), ("north", [(2, 2)]), ("east_south", [(1, 2), (2, 1)])):
        out = out.join(neighbors.halo(f, n, hops, SIDES).withColumnRenamed("value", name), "cell")
    return out


@query(f"{TN}, f AS (SELECT cell, axis, side, min(nbr) AS nbr FROM nb GROUP BY 1, 2, 3), v AS (SELECT id, CAST(n AS DOUBLE) AS q FROM lf), g AS (SELECT cell, max(abs(a.q - b.q)) AS value FROM f JOIN v a ON a.id = cell JOIN v b ON b.id = nbr GROUP BY 1) SELECT t.id AS cell, coalesce(value, 0.0) AS value FROM tree t LEFT JOIN g ON g.cell = t.id")
def gradient_indicator(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    c = _numbered(spark, d, counts)
    f = grid.leaves(c).join(counts, ["level", "ix"], "left").select(F.col("cell_id").alias("cell"), F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("value"))
    return fields.gradient_indicator(f, neighbors.neighbors(c, 2), c)


# Solvers on a uniform grid -----------------------------------------------------------------------

UNI = f"{PT}, u AS (SELECT CAST(range % 16 AS BIGINT) AS i, CAST(range // 16 AS BIGINT) AS j FROM range(256)), c AS (SELECT floor(x / 4) AS i, floor(y) AS j, count(*) AS n FROM pt GROUP BY 1, 2), q AS (SELECT u.i, u.j, coalesce(CAST(n AS DOUBLE), 0.0) AS v FROM u LEFT JOIN c USING (i, j))"


def _uniform(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The field of point counts on 16 x 16 cells, and the periodic face table."""
    cells = stored(grid.numbered(grid.uniform_level(spark, 2, 4).withColumn("path", F.col("path"))), "uniform")
    n = points(spark, d).groupBy(F.array(F.floor(F.col("x") / 4).cast("long"), F.floor("y").cast("long")).alias("ix")).count()
    area = F.array(F.lit(1 / 16), F.lit(1 / 16))
    f = cells.join(n, "ix", "left").select(F.col("cell_id").alias("cell"), "ix", F.coalesce(F.col("count").cast("double"), F.lit(0.0)).alias("value"), F.lit(1 / 256).alias("volume"), area.alias("area"))
    nb = neighbors.neighbors(cells, 2, [(neighbors.PERIODIC,) * 2] * 2)
    return stored(f, "field"), stored(neighbors.faces(nb).select("left", "right", "axis"), "faces")


@query(f"WITH {UNI} SELECT q.i, q.j, round(q.v - 0.3 * (q.v - a.v) - 0.2 * (b.v * -1 + q.v), 6) AS value FROM q JOIN q a ON a.i = (q.i + 15) % 16 AND a.j = q.j JOIN q b ON b.j = (q.j + 15) % 16 AND b.i = q.i")
def advection_step(spark: SparkSession, d: str) -> DataFrame:
    f, faces = _uniform(spark, d)
    g = kernels.advected(f, faces, [0.3 / 16, 0.2 / 16], 1.0)
    return g.select(F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"), r6(F.col("value"), "value"))


@query(f"WITH {UNI} SELECT round(sum(v) / 256, 6) AS before, round(sum(v) / 256, 6) AS after FROM q")
def flux_conservation(spark: SparkSession, d: str) -> DataFrame:
    f, faces = _uniform(spark, d)
    g = kernels.steps(f, lambda x: kernels.advected(x, faces, [0.3 / 16, 0.2 / 16], 1.0), 3)
    mass = lambda x, n: kernels.totals(x, ["value"]).select(r6(F.col("value"), n))
    return mass(f, "before").crossJoin(mass(g, "after"))


@query(f"""WITH {UNI}, l AS (SELECT q.i, q.j, q.v, a.v + b.v + c.v + d.v - 4 * q.v AS g FROM q JOIN q a ON a.i = (q.i + 1) % 16 AND a.j = q.j JOIN q b ON b.i = (q.i + 15) % 16 AND b.j = q.j JOIN q c ON c.j = (q.j + 1) % 16 AND c.i = q.i JOIN q d ON d.j = (q.j + 15) % 16 AND d.i = q.i),
h AS (SELECT i, j, v, v + g * 0.05 AS m FROM l)
SELECT h.i, h.j, round(h.v + 0.1 * (a.m + b.m + c.m + d.m - 4 * h.m), 6) AS value FROM h JOIN h a ON a.i = (h.i + 1) % 16 AND a.j = h.j JOIN h b ON b.i = (h.i + 15) % 16 AND b.j = h.j JOIN h c ON c.j = (h.j + 1) % 16 AND c.i = h.i JOIN h d ON d.j = (h.j + 15) % 16 AND d.i = h.i""")
def diffusion_step(spark: SparkSession, d: str) -> DataFrame:
    f, _ = _uniform(spark, d)
    nodes = f.select(F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"), "value")
    return kernels.diffused(nodes, 1.0, 1.0, 0.1, 16).select("i", "j", r6(F.col("value"), "value"))


@query("SELECT 1.0::DOUBLE AS mass_kept, 1.0::DOUBLE AS energy_kept, true AS positive")
def euler_conservation(spark: SparkSession, d: str) -> DataFrame:
    f, faces = _uniform(spark, d)
    dense = F.col("value") / 1000 + 1
    start = f.select("cell", "volume", "area", *[c.cast("double").alias(n) for n, c in zip(kernels.CONSERVED, kernels.to_conserved(dense, F.lit(0.1), F.lit(0.0), dense), strict=True)])
    end = kernels.steps(start, lambda x: kernels.euler_step(x, faces, 0.005), 2)
    a = kernels.totals(start, ["rho", "e"]).select(F.col("rho").alias("r0"), F.col("e").alias("e0"))
    b = end.agg(F.sum(F.col("rho") * F.col("volume")).alias("r1"), F.sum(F.col("e") * F.col("volume")).alias("e1"), F.min("rho").alias("low"))
    return a.crossJoin(b).select(F.round(F.col("r1") / F.col("r0"), 9).alias("mass_kept"), F.round(F.col("e1") / F.col("e0"), 9).alias("energy_kept"), (F.col("low") > 0).alias("positive"))


# Patches, polynomial fields ----------------------------------------------------------------------


def _levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A 8 x 8 base over the points' frame, a 8 x 8 patch over its middle, and counts on both."""
    base = grid_boxes(spark, 3, [0.0, 0.0], [64.0, 16.0])
    fine = grid_boxes(spark, 3, [16.0, 4.0], [48.0, 12.0]).withColumn("id", F.col("id") + 1000)
    p = points(spark, d)
    n0 = p.groupBy((F.floor(F.col("x") / 8) + 8 * F.floor(F.col("y") / 2)).alias("id")).count()
    inside = p.where("x >= 16 and x < 48 and y >= 4 and y < 12")
    n1 = inside.groupBy((1000 + F.floor((F.col("x") - 16) / 4) + 8 * F.floor(F.col("y") - 4)).alias("id")).count()
    every = base.select("id").union(fine.select("id")).join(n0.union(n1), "id", "left").select("id", F.coalesce(F.col("count").cast("double"), F.lit(0.0)).alias("value"))
    return base, fine, every


PATCH = f"""{PT}, b AS (SELECT range AS id, CAST(range % 8 AS BIGINT) AS i, CAST(range // 8 AS BIGINT) AS j FROM range(64)),
n0 AS (SELECT CAST(floor(x / 8) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, count(*) AS n FROM pt GROUP BY 1, 2), n1 AS (SELECT CAST(floor((x - 16) / 4) AS BIGINT) AS i, CAST(floor(y - 4) AS BIGINT) AS j, count(*) AS n FROM pt WHERE x >= 16 AND x < 48 AND y >= 4 AND y < 12 GROUP BY 1, 2),
v0 AS (SELECT id, i, j, coalesce(n, 0) AS v FROM b LEFT JOIN n0 USING (i, j)), v1 AS (SELECT id + 1000 AS id, i, j, coalesce(n, 0) AS v FROM b LEFT JOIN n1 USING (i, j))"""


@query(f"WITH {PATCH}, m AS (SELECT i // 2 + 2 AS i, j // 2 + 2 AS j, avg(v) AS v FROM v1 GROUP BY 1, 2) SELECT v0.id, round(coalesce(m.v, CAST(v0.v AS DOUBLE)), 6) AS value FROM v0 LEFT JOIN m USING (i, j)")
def restrict(spark: SparkSession, d: str) -> DataFrame:
    base, fine, f = _levels(spark, d)
    return patches.restrict(base, fine, f, 2, [8.0, 2.0]).select("id", r6(F.col("value"), "value"))


@query(f"WITH {PATCH} SELECT v1.id, CAST(v0.v AS DOUBLE) AS value FROM v1 JOIN v0 ON v0.i = v1.i // 2 + 2 AND v0.j = v1.j // 2 + 2")
def prolong(spark: SparkSession, d: str) -> DataFrame:
    base, fine, f = _levels(spark, d)
    return patches.prolong(base, fine, f, 2, [8.0, 2.0])


@query(f"WITH {TREE} SELECT p.id AS pid, min(lf.id) AS cell FROM pt p JOIN lf ON p.x / 64 * {1 << DEPTH} BETWEEN x0 AND x1 AND p.y / 16 * {1 << DEPTH} BETWEEN y0 AND y1 GROUP BY 1")
def locate_points(spark: SparkSession, d: str) -> DataFrame:
    c = grid.leaves(_numbered(spark, d)).select("cell_id", "level", "ix")
    p = points(spark, d).select(F.col("id").alias("pid"), F.array(F.col("x") / 64, F.col("y") / 16).alias("x"))
    return patches.leaf_at(p, c, 2, DEPTH)


@query(f"WITH {TREE}, b AS (SELECT id, i / (1 << l) AS x, j / (1 << l) AS y, 1.0 / (1 << l) AS h FROM tree) SELECT id AS cell_id, round(1 + 2 * x - 3 * y + x * y + 1e-9, 5) AS c0, round(h * (2 + y) + 1e-9, 5) AS c1, round(h * (x - 3) + 1e-9, 5) AS c2, CAST(0 AS DOUBLE) AS c3, round(h * h + 1e-9, 5) AS c4 FROM b")
def init_projection(spark: SparkSession, d: str) -> DataFrame:
    c = grid.with_boxes(_numbered(spark, d), [0.0, 0.0], [1.0, 1.0])
    f = fields.init_on_boxes(c, lambda x: 1.0 + 2 * x[0] - 3 * x[1] + x[0] * x[1], 2, 2)
    return f.select("cell_id", *[(F.round(F.get("coeffs", F.lit(k)) + 1e-9, 5)).alias(f"c{k}") for k in range(5)])


@query(f"WITH {SEG}, u AS (SELECT DISTINCT unnest(range(CAST(floor((lo + 4096) / 128) AS BIGINT), CAST(ceil((hi + 4096) / 128) AS BIGINT))) AS id FROM seg) SELECT id, round(CAST(5 + 3 * (128.0 * id - 4096) AS DOUBLE), 4) AS c0, 384.0::DOUBLE AS c1 FROM u")
def poly_remap_linear(spark: SparkSession, d: str) -> DataFrame:
    """A linear field given on cells of 64 days, remapped to bins of 128 days, is the same field: in all bins with orders."""
    src, dst = grid_boxes(spark, 7, [-4096.0], [4096.0]), grid_boxes(spark, 6, [-4096.0], [4096.0])
    ov = overlap.overlap_boxes(src, dst, 1, 2, [128.0]).select(F.col("a_id").alias("lag_idx"), F.col("b_id").alias("eul_idx"), "moments")
    lo, hi = [F.get("lo", F.lit(0))], [F.get("hi", F.lit(0))]
    coeffs = F.array(5 + 3 * lo[0], 3 * (hi[0] - lo[0]))
    s = src.select("id", coeffs.alias("coeffs"), remap.box_pullback(lo, hi, 1).alias("pullback"))
    t = dst.select("id", remap.box_pullback(lo, hi, 1).alias("pullback"), F.col("volume").alias("jacobian"))
    used = segments(spark, d).select(F.explode(F.sequence(F.floor((F.col("lo") + 4096) / 128), F.ceil((F.col("hi") + 4096) / 128) - 1)).alias("id")).distinct()
    r = remap.polynomial(ov, s, t, 1, 1, 1)
    return r.join(used, "id").select("id", F.round(F.get("coeffs", F.lit(0)), 4).alias("c0"), F.round(F.get("coeffs", F.lit(1)), 6).alias("c1"))


@query(f"WITH {TREE}, k AS (SELECT l - 1 AS l, i // 2 AS i, j // 2 AS j, list(n ORDER BY path) AS v FROM tree WHERE l > 0 GROUP BY 1, 2, 3 HAVING bool_and(leaf)) SELECT l AS level, i, j, round((v[1] + v[2] + v[3] + v[4]) / 4.0, 6) AS mean FROM k")
def coarsen_projection(spark: SparkSession, d: str) -> DataFrame:
    """The integral of the projected parent is the mean of the children's constants."""
    counts = _counts(spark, d)
    cells = stored(tree(spark, d, counts), "cells")
    value = counted(cells, counts).select("path", F.array(F.col("value"), F.lit(0.0), F.lit(0.0)).alias("coeffs"))
    own = cells.where("level > 0").groupBy(grid.parent_path(F.col("path")).alias("path")).agg(F.bool_and("is_leaf").alias("ok")).where("ok").select("path")
    after = stored(grid.coarsen(cells, own), "coarse")
    new = fields.coarsened_projection(value, cells, after, 2, 1)
    c = lambda k: F.get("coeffs", F.lit(k))
    return after.join(own, "path").join(new, "path").select("level", F.get("ix", F.lit(0)).alias("i"), F.get("ix", F.lit(1)).alias("j"), r6(c(0) + c(1) / 2 + c(2) / 2, "mean"))


@query(f"WITH {TREE} SELECT CASE WHEN min(l) FILTER (leaf) = max(l) FILTER (leaf) THEN min(l) FILTER (leaf) END AS depth, CAST(count(*) FILTER (leaf) AS BIGINT) AS n_leaves, round(sum(CASE WHEN leaf THEN 1.0 / (1 << (2 * l)) ELSE 0 END), 9) AS volume FROM tree")
def mesh_summary(spark: SparkSession, d: str) -> DataFrame:
    c = stored(tree(spark, d), "cells")
    s = c.agg(F.count_if("is_leaf").alias("n_leaves"), F.round(F.sum(F.when(F.col("is_leaf"), F.pow(F.lit(2.0), -2 * F.col("level"))).otherwise(0.0)), 9).alias("volume"))
    return grid.uniform_dimensions(c).crossJoin(s)


@query(f"WITH {TREE}, a AS (SELECT id, path, l, leaf FROM tree), g AS (SELECT path FROM a WHERE leaf AND l < 2) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN leaf AND l >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS kept_leaves FROM a")
def refine_events(spark: SparkSession, d: str) -> DataFrame:
    """Splitting nothing but coarse leaves on the first axis, told as events against the old numbering."""
    c = _numbered(spark, d)
    t = c.where("is_leaf and level < 2").select("path", F.lit(1).alias("mask"))
    after = grid.numbered(grid.refine(c.select(*grid.COLUMNS), t, 2))
    e = grid.remap(c, after)
    return e.agg(F.count_if(F.col("kind") != "created").alias("n"), F.count_if((F.col("kind") == "kept") & F.col("path").isNotNull() & F.col("old_id").isNotNull() & (F.size("path") >= 2)).alias("k")).crossJoin(c.agg(F.count_if(F.col("is_leaf") & (F.col("level") >= 2)).alias("kept_leaves"))).select("n", "kept_leaves")


@query(f"""WITH {PATCH}, w AS (SELECT v1.id, v1.i, v1.j, n.v AS near, c.v AS far FROM v1 LEFT JOIN v1 n ON n.i = v1.i - 1 AND n.j = v1.j LEFT JOIN v0 c ON v1.i = 0 AND c.i = 1 AND c.j = v1.j // 2 + 2)
SELECT id, CAST(coalesce(near, far) AS DOUBLE) AS value FROM w""")
def patch_halo(spark: SparkSession, d: str) -> DataFrame:
    """West of each fine cell: its patch, or the coarse cell beyond the patch's edge."""
    _, fine, f = _levels(spark, d)
    k = F.col("id") - 1000
    cells = fine.select(F.lit(0).alias("patch"), "id", F.array(k % 8, F.floor(k / 8)).cast("array<bigint>").alias("ix"), *[F.array(F.get(c, F.lit(0)) / 64, F.get(c, F.lit(1)) / 16).alias(c) for c in ("lo", "hi")])
    coarse = grid.uniform_level(spark, 2, 3).select((F.get("ix", F.lit(0)) + 8 * F.get("ix", F.lit(1))).alias("cell_id"), "level", "ix")
    return patches.patch_halo(cells, f, coarse, f.where("id < 1000"), 1, 1, 2, 3)


@query(f"WITH {UNI} SELECT i AS ix, j AS jx, round(v, 6) AS a, round(2 * v + 1, 6) AS b, round(v + 3, 6) AS c FROM q")
def block_kernel(spark: SparkSession, d: str) -> DataFrame:
    """A kernel on blocks of 2 x 2 samples that only reads its own block."""
    f, _ = _uniform(spark, d)
    blocks = f.select("ix", F.array(*[F.col("value") + k for k in range(4)]).alias("samples"))
    out = kernels.for_each_block(blocks, "out", lambda s: [s([1, 1]), s([1, 1]) + s([2, 1]), s([2, 2]), s([1, 2])], 2, 2)
    g = lambda k: F.get("out", F.lit(k))
    return out.select(F.get("ix", F.lit(0)).alias("ix"), F.get("ix", F.lit(1)).alias("jx"), r6(g(0), "a"), r6(g(1), "b"), r6(g(2), "c"))
