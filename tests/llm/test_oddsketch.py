"""Near duplicates against brute force, and how well the sketches estimate."""

import random

import numpy as np
import pytest

from folioscope.llm import common, oddsketch
from test_jaccard import brute, made


@pytest.mark.parametrize(
    ("n", "num", "den", "rows"),
    [
        (5, 85, 100, made(1, 40, 4, 120, 5)),
        (5, 80, 100, made(2, 20, 5, 90, 6)),
        (3, 90, 100, made(3, 1, 150, 150, 6)),  # one group of near copies
        (2, 85, 100, made(4, 60, 3, 12, 1)),  # short texts
    ],
)
def test_components_match_brute_force(spark, monkeypatch, n, num, den, rows):
    monkeypatch.setattr(oddsketch, "BLOCK_NODES", 8)  # buckets of many blocks
    monkeypatch.setattr(oddsketch, "BLOCK_GRAMS", 2000)
    monkeypatch.setattr(oddsketch, "BUCKET_NODES", 8)
    monkeypatch.setattr(oddsketch, "TASK_ROWS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = oddsketch.near_duplicates(docs, n=n, num=num, den=den).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows, n, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, "One", "x"), (5, "one", "x"), (5, "one", "x"),
        (6, "a b", "x"), (7, "word " * 30000, "x"), (8, "WORD " * 9, "x"), (None, "lone text", "x"), (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = sorted((tuple(r) for r in oddsketch.near_duplicates(docs).collect()), key=lambda r: (r[0] or 0, r[1]))
    assert got == [
        (None, 0, None, True), (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True),
        (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False),
    ]
    assert oddsketch.near_duplicates(docs.where("false")).count() == 0


def _pair(rng, size, share):
    """Two sets of random numbers whose Jaccard is about `share`."""
    common_part = round(2 * size * share / (1 + share))
    values = [rng.getrandbits(64) for _ in range(2 * size - common_part)]
    both = values[:common_part]
    return [np.array(both + values[common_part:size], np.uint64), np.array(both + values[size:], np.uint64)]


def test_sketches_estimate_high_similarities():
    rng = random.Random(3)
    for share in (0.95, 0.9, 0.85):
        errors = []
        for _ in range(60):
            one, other = _pair(rng, 400, share)
            bits = oddsketch.sketches(oddsketch.samples([one, other]))
            true = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
            errors.append(oddsketch.similarity(int(np.bitwise_count(bits[0] ^ bits[1]).sum())) - true)
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045


def test_pairs_at_the_threshold_meet_in_a_band_and_pass_the_sketch():
    rng = random.Random(4)
    most = oddsketch.most_differing(85, 100)
    for _ in range(300):
        values = oddsketch.samples(_pair(rng, 200, 0.855))
        keys, bits = oddsketch.bands(values), oddsketch.sketches(values)
        assert (keys[0] == keys[1]).any()
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= most
    # Far pairs fail: the sketch does decide.
    passed = 0
    for _ in range(100):
        bits = oddsketch.sketches(oddsketch.samples(_pair(rng, 200, 0.45)))
        passed += int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= most
    assert passed == 0


def test_a_sketch_is_the_parity_of_its_values():
    values = oddsketch.samples([common.mix(np.arange(50, dtype=np.uint64))])
    bits = np.unpackbits(oddsketch.sketches(values).view(np.uint8))
    want = np.zeros(oddsketch.BITS, np.uint8)
    for value, seed in zip(values[0], oddsketch._SEEDS):
        want[int(common.mix(np.array([value + seed]))[0]) % oddsketch.BITS] ^= 1
    assert (bits == want).all()
