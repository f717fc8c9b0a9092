import math
import os

import pytest

import __spark_entry__ as entry
from gridloom import workloads

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"

    return sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", workloads.QUERIES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = workloads.QUERIES[name](spark, SF_DIR)
    want = con.sql(workloads.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_queries_of_whole_tables(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    e = rng.integers(-99, 99, (530, 3)) / 8  # more vectors than the arrays of the bounded queries have
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    size = rng.integers(0, 9, 450).tolist()
    spark.createDataFrame(list(enumerate(size)), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, k + 0.5) for k in range(1300)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")

    def run(name):
        return [tuple(r) for r in workloads.QUERIES[name](spark, str(tmp_path)).collect()]

    index = run("linear_index_all")
    assert len(index) == 1590 and all((r, c) == (i * 3 + j, i + j * 530) for i, j, r, c in index)
    got, want = np.full((530, 530), np.nan), e @ e.T
    for i, j, v in run("matmul_gram_all"):
        got[i, j] = v
    assert np.abs(got - want).max() <= 5.1e-5
    pairs = [(a, b) for a in range(450) for b in range(a + 1, min(450, a + size[a])) if size[b]]
    assert sorted(run("bounds_overlaps_all")) == pairs
    assert sorted(run("vector_add_zip_all")) == [(k, k * 101 + 50) for k in range(1300)]
    moved = run("linear_index")
    assert len(moved) == 1590 and all((r, c, s) == ((i - 100) * 3 + j - 42, i - 100 + (j - 42) * 530, (i - 100) * 1000 + (j - 42) * 3) for i, j, r, c, s in moved)
    q = np.trunc(e.astype(np.float32).astype(float) * 1000).astype(int)
    blocks = np.full((530, 530), -1)
    for i, j, v in run("matmul_gram"):
        blocks[i, j] = v
    assert (blocks == q @ q.T).all()
    counts = np.bincount(np.array(pairs).reshape(-1), minlength=450)
    assert sorted(run("bounds_overlaps")) == list(enumerate(counts))
    assert len(run("distribution_cells")) == 36 and len(run("view_shift")) == 1300 and len(run("view_drop_axis")) == 3


def test_gram_shuffles_blocks_and_keeps_every_row(spark, tmp_path):
    vectors = [(5, [1.5, -2.0]), (-7, None), (None, [0.25, 0.125]), (5, [1.0, 1.0])]  # ids need neither be dense nor given nor distinct
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = workloads.QUERIES["matmul_gram_all"](spark, str(tmp_path))
    want = [(i, j, None if a is None or b is None else round(a[0] * b[0] + a[1] * b[1], 4) + 0.0) for i, a in vectors for j, b in vectors]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashAggregate" not in plan  # terms of sums aren't rows


@pytest.mark.parametrize(("name", "most"), [("matmul_gram", 4.2), ("matmul_gram_all", 1.7)])  # bytes a row; 5.0 and 1.9 if every product is in the files twice
def test_gram_files_hold_products_once(spark, tmp_path, name, most):
    import numpy as np
    import pyarrow.parquet as pq

    n = 1100
    e = np.random.default_rng(6).normal(size=(n, 64)).astype(np.float32)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    workloads.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = pq.read_table(f"{tmp_path}/out")
    i, j, v = (got[c].to_numpy() for c in ("d0", "d1", "v"))
    assert len(v) == n * n and len(np.unique(i * n + j)) == n * n
    q = np.trunc(e.astype(float) * 1000) if name == "matmul_gram" else e.astype(float)
    assert np.abs(v - (q @ q.T)[i, j]).max() <= (0 if name == "matmul_gram" else 5.1e-5)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < most * n * n


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
