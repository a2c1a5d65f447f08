"""The vector index against brute force: recall, exact mode, pruned lists, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.operators.vector_index import VectorIndex
from folioscope.queries import retrieval
from test_plans import plan_of

FOLDER = "/root/testdata/sf0.1"


def brute(ids, matrix, query, k):
    scores = np.round(matrix @ query / np.linalg.norm(matrix, axis=1) / np.linalg.norm(query), 9)
    return [ids[i] for i in np.lexsort((ids, -scores))[:k]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    held = rows.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in held])
    matrix = np.array([r.embedding for r in held], float)
    index = VectorIndex.build(rows, ["vec_id"], str(tmp_path_factory.mktemp("vectors")))
    return index, ids, matrix


def test_recall_at_ten(corpus):
    index, ids, matrix = corpus
    found = 0
    places = range(0, len(ids), max(1, len(ids) // 15))
    for place in places:
        got = {r.vec_id for r in index.nearest(matrix[place], 10).collect()}
        found += len(got & set(brute(ids, matrix, matrix[place], 10)))
    assert found / (10 * len(places)) >= 0.9


def test_exact_mode_equals_brute_force(corpus):
    index, ids, matrix = corpus
    for place, k in ((0, 10), (17, 1), (5, len(ids) + 5)):
        got = [r.vec_id for r in index.exact(matrix[place], k).collect()]
        assert got == brute(ids, matrix, matrix[place], k)


def test_lists_are_pruned_by_partition(corpus):
    index, _, matrix = corpus
    assert len(index.centres) > 16
    plan = plan_of(index.nearest(matrix[3], 5, probes=2))
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:80]
    # Codes are read without vectors first.
    assert any("codes" in s and "vector" not in s.split(">")[0] for s in plan.split("ReadSchema: ")[1:])


def test_exact_mode_leaves_far_lists_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 10
    rows = [(int(k), (centres[k % 8] + rng.normal(size=8) * 0.2).tolist()) for k in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(frame, ["vec_id"], str(tmp_path / "v"), lists=8)
    query = rows[0][1]
    assert len(index.lists_needed(query, 5, first=1)) < 8
    want = brute(np.arange(400), np.array([r[1] for r in rows]), np.array(query), 5)
    assert [r.vec_id for r in index.exact(query, 5, first=1).collect()] == want


def test_batches_ties_and_rows_without_a_cosine(spark, tmp_path):
    rows = [(k, [1.0, float(k % 5), 2.0]) for k in range(40)]
    out = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan")] * 3), (104, [1.0])]
    schema = "vec_id long, embedding array<double>"
    index = VectorIndex.build(spark.createDataFrame(rows[:30] + out, schema), ["vec_id"], str(tmp_path / "v"), lists=3)
    for _ in range(2):  # a repeated batch overwrites itself
        index.add(spark.createDataFrame(rows[30:] + out, schema), 1)
    got = [r.vec_id for r in index.exact([1.0, 0.0, 2.0], 12).collect()]
    assert got[:8] == [0, 5, 10, 15, 20, 25, 30, 35]
    assert sorted(r.vec_id for r in index.exact([1.0, 0.0, 2.0], 99).collect()) == list(range(40))
    again = VectorIndex(spark, index.folder, ["vec_id"])
    assert [r.vec_id for r in again.nearest([1.0, 0.0, 2.0], 8, probes=3).collect()] == got[:8]
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame(out[:4], schema), ["vec_id"], str(tmp_path / "none"))


def test_one_vector(spark, tmp_path):
    frame = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    index = VectorIndex.build(frame, ["vec_id"], str(tmp_path / "v"))
    assert [tuple(r) for r in index.nearest([3.0, 4.0], 3).collect()] == [(1, 1.0)]


def test_query_finds_most_of_the_nearest(spark, sf_dir):
    found = {r.vec_id for r in retrieval.ann_topk(spark, sf_dir).collect()}
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    best = search.top_k(search.vector_score(vectors, retrieval._query_vector(spark, sf_dir)), "vector", ["vec_id"], 30)
    assert len(found & {r.vec_id for r in best.collect()}) >= 27
    assert vectors.where(F.col("vec_id").isin(sorted(found))).count() == 30


def test_distances_are_held_in_bounded_parts(monkeypatch):
    from folioscope.operators import vector_index

    class Rows(np.ndarray):
        def __matmul__(self, other):
            held.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    held = []
    monkeypatch.setattr(vector_index, "CELLS", 64, raising=False)
    rng = np.random.default_rng(5)
    rows, among = rng.normal(size=(100, 6)), rng.normal(size=(16, 6))
    got = vector_index._nearest_row(rows.view(Rows), among)
    assert got.tolist() == ((rows[:, None] - among) ** 2).sum(2).argmin(1).tolist()
    assert max(held) <= 64
    assert vector_index._nearest_row(rows[:0], among).tolist() == []
