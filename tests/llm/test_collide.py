"""Recall against brute force, ties, and rows that take no part."""

import numpy as np

from folioscope.llm import collide
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k=5, every=50):
    keep = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in keep:
        if q % every == 0:
            scores = sorted((-(y @ x) / np.sqrt((x @ x) * (y @ y)), i) for i, y in keep if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(table):
    out = {}
    for r in table.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(collide, "SHARD_ROWS", 700)
    monkeypatch.setattr(collide, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(32).astype(np.float32).tolist(), "x") for i in range(3000)]
    want = brute(rows)
    got = found(collide.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    true = {i: np.array(v, np.float64) for i, v, _ in rows}
    for q, near in got.items():
        assert len(near) == 5 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        for i, score in near:
            a, b = true[q], true[i]
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_ties_and_rows_that_take_no_part(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(0, v, "x"), (9, v, "x"), (3, v, "x"), (3, v, "x"), (7, [2.0, 4.0], "x"), (50, [1.0, 0.0], "x")]
    rows += [(8, None, "x"), (10, [], "x"), (11, [0.0, 0.0], "x"), (12, [nan, 1.0], "x"), (13, [inf, 1.0], "x"), (14, [None, 1.0], "x"), (None, v, "x"), (100, [1.0, 2.0, 3.0], "x"), (150, [0.0, 0.0], "x")]
    got = found(collide.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    assert [i for i, _ in got[0]] == [3, 3, 7, 9, 50]
    assert [i for i, _ in got[50]] == [0, 3, 3, 7, 9]
    assert set(got) == {0, 50}
    empty = spark.createDataFrame([], SCHEMA)
    assert collide.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0
