"""Whitening against numpy on exact whole numbers, and rows that take no part."""

import math

import numpy as np
import pytest

from folioscope.llm import queries, whiten


def expected(vectors, components, scale=64, offset=1_000_000):
    """Exact deviations, whitened rows and shares of all sound vectors."""
    dims = max(len(v) for v in vectors)
    x = [[math.floor(scale * float(c)) + offset for c in v] + [offset] * (dims - len(v)) for v in vectors]
    n, sums = len(x), [sum(row[k] for row in x) for k in range(dims)]
    exact = [[n * c - s for c, s in zip(row, sums)] for row in x]
    deviation = [sum(d * d for d in row) for row in exact]
    centred = np.array(exact, float) / n
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return deviation, centred @ directions / np.sqrt(values), values / np.trace(covariance)


def close(got, want):
    """Equal up to one sign for each component."""
    signs = np.sign((got * want).sum(0))
    return np.abs(got - want * signs).max() < 1e-7


def made(seed, count, dims):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(count, dims)) * np.arange(1, dims + 1)).astype(np.float32).tolist()


@pytest.mark.parametrize("block", [7, 4096])
def test_matches_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", block)
    vectors = made(1, 200, 9)
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, vector array<float>").repartition(5)
    rows, fit = whiten.whiten(frame, components=6)
    got = sorted(rows.collect(), key=lambda r: r.row.vec_id)
    deviation, whitened, shares = expected(vectors, 6)
    assert [int(r.deviation) for r in got] == deviation
    assert close(np.array([r.whitened for r in got]), whitened)
    assert np.allclose(fit.values / fit.trace, shares) and fit.n == 200
    assert fit.identity_error < 1e-9


def test_edge_rows(spark):
    sound = [(k, v, k, "x") for k, v in enumerate(made(2, 30, 4))]
    sound += [(100, [1.0, 2.0], 1, "x"), (101, [], 1, "x"), (None, [3.0] * 4, 1, None), (3, [3.0] * 4, 1, None)]
    out = [
        (200, None, 1, "x"), (201, [1.0, None, 2.0, 3.0], 1, "x"), (202, [float("nan")] * 4, 1, "x"),
        (203, [float("inf"), 0.0, 0.0, 0.0], 1, "x"), (204, [1e30, 0.0, 0.0, 0.0], 1, "x"),
    ]
    frame = spark.createDataFrame(sound + out, "vec_id long, vector array<float>, x int, row string")
    rows, fit = whiten.whiten(frame)
    got = rows.collect()
    deviation, whitened, shares = expected([v for _, v, *_ in sound], 4)
    assert fit.n == len(got) == len(sound) and len(fit.values) == 4
    assert sorted(int(r.deviation) for r in got) == sorted(deviation)
    assert np.allclose(sorted(np.abs(np.array([r.whitened for r in got])).sum(1)), sorted(np.abs(whitened).sum(1)))
    assert fit.identity_error < 1e-9


def test_tables_without_variance(spark):
    schema = "vec_id long, vector array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(k, [1.0, 2.0]) for k in range(9)]):
        result, fit = whiten.whiten(spark.createDataFrame(rows, schema))
        taken = [r for r in rows if r[1] is not None]
        assert fit.n == len(taken) and len(fit.values) == 0 and fit.identity_error == 0
        assert all(r.deviation == 0 and r.whitened == [] for r in result.collect())
        assert result.count() == len(taken)


def test_a_flat_direction_has_no_component(spark):
    vectors = [[a, b, a + b, 5.0] for a, b in made(3, 60, 2)]
    vectors = [[round(c * 64) / 64 for c in v[:2]] for v in vectors]
    vectors = [[a, b, a + b, 5.0] for a, b in vectors]  # rank two, exactly
    rows, fit = whiten.whiten(spark.createDataFrame([(v,) for v in vectors], "vector array<double>"))
    assert len(fit.values) == 2 and fit.identity_error < 1e-9
    assert all(len(r.whitened) == 2 for r in rows.collect())


def test_large_numbers_stay_exact(spark):
    vectors = [[float(k * 2**38), float(-k)] for k in range(50)]
    rows, fit = whiten.whiten(spark.createDataFrame([(v,) for v in vectors], "vector array<double>"))
    assert sorted(int(r.deviation) for r in rows.collect()) == sorted(expected(vectors, 2)[0])


def test_query_matches_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    sound = {r.vec_id: r.embedding for r in table if r.embedding is not None and all(
        c is not None and math.isfinite(c) for c in r.embedding)}
    ids = sorted(sound)
    deviation, whitened, shares = expected([sound[i] for i in ids], 32)
    got = queries.QUERIES["op13_whitening"](spark, sf_dir).collect()
    assert len(got) == 32 * len(ids)
    place = {i: k for k, i in enumerate(ids)}
    matrix = np.zeros((len(ids), 32))
    for r in got:
        assert r.n == len(ids) and r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-4
        assert abs(r.explained - shares[r.component - 1]) < 1e-9
        matrix[place[r.vec_id], r.component - 1] = r.whitened
    assert close(matrix, whitened)
