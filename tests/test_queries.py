"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessera.queries import basics, meshing, motion, trees

DATA = Path("/root/testdata/sf0.001")
OWN = basics.Q | trees.Q | motion.Q | meshing.Q
SQL = basics.SQL | trees.SQL | motion.SQL | meshing.SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return v


def rows(columns, got):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in got), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, str(DATA))
    got = df.collect()
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def beyond_the_cube(spark, at):
    """The tables with particles on all sides of the unit cube, as a folder and its view."""
    rng = random.Random(2)
    places = [[rng.uniform(-0.49, 0.49) for _ in range(3)] for _ in range(40)]
    places += [[-0.515, 0.1, 0.2], [0.1, -0.75, 0.2], [0.3, 0.2, -1.75], [0.53, 0.1, 0.2], [-0.6, 0.9, -0.51], [-0.5, 0.5, -0.5], [1.25, -2.5, 0.0]]
    rows = [(i, [float(np.float32(x)) for x in [*p, *(rng.uniform(-1, 1) for _ in range(5))]]) for i, p in enumerate(places)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["accumulated_sampling", "streaming_sampling", "tetrahedra_3d", "tetrahedra_exact"])
def test_particles_beyond_the_cube(spark, tmp_path, name):
    duck = beyond_the_cube(spark, tmp_path)
    df, want = OWN[name](spark, str(tmp_path)), duck.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(OWN) <= set(__spark_entry__.queries())
