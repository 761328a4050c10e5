import datetime

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from pointframe.operators import counts, folds, stats


def brute(q, at, n, r):
    with np.errstate(all="ignore"):
        d = at[:, None] - q[:, :, None]
        return np.where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= r * r, n, 0).sum(1)


@pytest.mark.parametrize("few", [200, 0.05])
@pytest.mark.parametrize("shape, r", [("even", 0.2), ("steps", 0.05), ("shifted", 0.75), ("outliers", 1e-3), ("one place", 0.05), ("wide", 5.0), ("overflow", 0.3)])
def test_counts_by_columns_against_all_pairs(monkeypatch, shape, r, few):
    """Places on borders, far off and repeated; wide columns and narrow ones."""
    monkeypatch.setattr(counts, "FEW", few)
    monkeypatch.setattr(counts, "PAIRS", 100)
    rng = np.random.default_rng(3)
    at = {"steps": rng.integers(0, 6, (3, 300)) / 20, "shifted": rng.integers(0, 6, (3, 300)) / 4 + 1e6, "one place": np.zeros((3, 300)), "outliers": rng.normal(0, 1e-3, (3, 300))}.get(shape, rng.uniform(0, 1, (3, 300)))
    if shape == "outliers":
        at[:, 0] = 1e30, -1e30, 5
    if shape == "overflow":
        at[:, 0], at[:, 1] = 1.7e308, -1.7e308
    q = np.hstack([at, at[:, :100] + rng.choice([0, r, -r], (3, 100))])
    n = rng.integers(1, 4, 300)
    assert (counts.near_counts(q, at, n, r) == brute(q, at, n, r)).all()


def test_few_places_are_looked_at(monkeypatch):
    """In a dense cloud binary searches count most of a ball; leaves of 64 looked at more than all of it."""
    looked, plain = [], counts._looked
    monkeypatch.setattr(counts, "_looked", lambda q, s, row, first, last, held, out: looked.append((last - first).sum()) or plain(q, s, row, first, last, held, out))
    at = np.random.default_rng(4).uniform(0, 1, (3, 40_000))
    got = counts.near_counts(at[:, :500], at, np.ones(40_000, int), 0.3)
    assert (got == brute(at[:, :500], at, 1, 0.3)).all() and sum(looked) < got.sum() * 0.9


@pytest.mark.parametrize("block, size, held", [(1 << 16, 1 << 16, 1 << 19), (60, 25, 70)])
@pytest.mark.parametrize("r", [0.25, 1.0, 200.0])
def test_ball_counts_against_all_pairs(spark, monkeypatch, block, size, held, r):
    """Small blocks in slices and chunks, blocks wholly in reach, copies on either side; no leaves are folded."""
    for name, value in (("BLOCK", block), ("SLICE", size), ("HELD", held)):
        monkeypatch.setattr(counts, name, value)
    monkeypatch.setattr(folds, "ball_sums", None)
    rng = np.random.default_rng(6)
    points = np.vstack([rng.uniform(0, 1, (300, 3)), np.full((60, 3), 0.25), rng.integers(0, 5, (100, 3)) / 4, [[50.0, 50, 50]]])
    more = np.vstack([points[rng.integers(0, 40, 900)], [[-9.0, 0, 0]]])
    frame = lambda x: spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **dict(zip("xyz", x.T, strict=True))}))
    c = frame(points)
    for x in (points, more):
        got = {a.id: a.n for a in stats.ball_counts(frame(x), c, r).collect()}
        assert got == {i: n for i, n in enumerate(brute(x.T, points.T, 1, r).tolist()) if n}
    assert stats.ball_counts(c.limit(0), c, r).count() == 0 and stats.ball_counts(c, c.limit(0), r).count() == 0


def test_events_of_odd_values_are_counted_as_by_sql(spark, tmp_path):
    """Rows of one id are counted together; what is null, infinite or no number is near nothing."""
    rng = np.random.default_rng(7)
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(s)) for s in rng.integers(0, 9000, 400)]
    value = [None, float("nan"), float("inf"), -float("inf"), *rng.integers(0, 50, 396).astype(float).tolist()]
    events = pa.table({"event_id": pa.array([*range(390), 5, 5, 6, 7, None, None, *range(390, 394)], pa.int64()), "ts": pa.array([*at[:-1], None], pa.timestamp("us")), "user_id": pa.array([*rng.integers(0, 15, 398).tolist(), None, 3], pa.int64()), "value": pa.array(value, pa.float64())})
    pq.write_table(events, f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["range_join_count"]).fetchall()
    got = [(r.id, r.n) for r in __spark_entry__.queries()["range_join_count"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 380
