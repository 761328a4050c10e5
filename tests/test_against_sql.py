"""Queries on clouds of odd shapes, held against their own SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__


def embeddings(folder, rows):
    """An embeddings table whose first components are the rows."""
    wide = np.random.default_rng(5).normal(0, 0.1, (len(rows), 64)).astype(np.float32)
    wide[:, : np.shape(rows)[1]] = rows
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(wide.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(len(rows))], pa.int32())})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return str(folder)


def same(spark, folder, name):
    """Rows of a query, if they are those of its SQL."""
    df = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).to_arrow_table().to_pylist()
    rows = lambda found: sorted(str([r[c] for c in df.columns]) for r in found)
    got = df.toArrow().to_pylist()
    assert rows(got) == rows(want)
    return got


def test_normals_off_the_walk_keep_the_sign_of_their_cross_product(spark, tmp_path):
    rng = np.random.default_rng(3)
    got = same(spark, embeddings(tmp_path, np.vstack([rng.normal(0, 0.1, (15, 3)), rng.normal(-30, 0.1, (15, 3))])), "orient_normals")
    assert any(r["nz"] < 0 for r in got if r["id"] >= 15)


def test_smoothed_normals_where_the_highest_point_stands_alone(spark, tmp_path):
    """Its normal is (0, 0, 1), its own neighbourhood is itself, and the filter leaves it no direction."""
    cloud = np.vstack([np.random.default_rng(3).normal(0, 0.1, (30, 3)), [[0, 0, 5]]])
    got = {r["id"]: r for r in same(spark, embeddings(tmp_path, cloud), "smoothed_normals")}
    assert np.isnan(got[30]["nz"]) and not np.isnan([got[i]["nz"] for i in range(30)]).any()
