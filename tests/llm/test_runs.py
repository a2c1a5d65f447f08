"""Lyndon arrays, extensions and runs against brute force, and the query on whole tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import queries, runs


def lyndon(word):
    """The next smaller suffix ends the longest Lyndon word."""
    n = len(word)
    return [next((k for k in range(i + 1, n) if word[k:] < word[i:]), n) - i for i in range(n)]


def brute_runs(words, exponent=4, shortest=6):
    """(start, period, length) by comparing the text with itself at every distance."""
    n, found = len(words), []
    for period in range(1, n // exponent + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if j - i + period >= max(exponent * period, shortest):
                found.append((i, period, j - i + period))
            i = j + 1

    def smallest(start, period, length):
        part = words[start : start + length]
        return not any(part[p:] == part[:-p] for p in range(1, period))

    return sorted(run for run in found if smallest(*run))


def made(seed, count, most=40):
    rng = random.Random(seed)
    return [[rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, most))] for _ in range(count)]


def test_lyndon_arrays():
    for word in made(1, 600, 30):
        assert runs.lyndon_array(word) == lyndon(word)
        negative = [-x for x in word]
        assert runs.lyndon_array(negative) == lyndon(negative)


@pytest.mark.parametrize("primes", [None, ((7, 3), (5, 2))])
@pytest.mark.parametrize(("exponent", "shortest"), [(4, 6), (2, 2), (3, 9)])
def test_runs_of_sequences_laid_end_to_end(monkeypatch, primes, exponent, shortest):
    """Also with primes so small that fingerprints mislead all the time."""
    if primes:
        monkeypatch.setattr(runs, "_PRIMES", primes)
    for seed in range(150):
        parts = made(seed, 3)
        edges = np.cumsum([0] + [len(part) for part in parts])
        ids = np.array(sum(parts, []), np.int64)
        start, length, period = runs.find_runs(ids, edges, exponent, shortest)
        got = sorted(zip(start.tolist(), period.tolist(), length.tolist()))
        want = [(s + int(edges[k]), p, n) for k, part in enumerate(parts) for s, p, n in brute_runs(part, exponent, shortest)]
        assert got == sorted(want)


def expected(text, places=None, exponent=4, shortest=6):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if places is not None:
        words = [words[p] for p in places]
    found = brute_runs(words, exponent, shortest)
    dropped = {i for s, p, n in found for i in range(s + p, s + n)}
    kept = [w for i, w in enumerate(words) if i not in dropped]
    s, p, n = max(found, key=lambda r: (r[2], -r[0], -r[1])) if found else (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, p, n in found)
    return (
        len(words), len(found), s, n, p,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def texts(seed, count):
    rng = random.Random(seed)
    result = []
    for _ in range(count):
        words = [rng.choice(["a", "b", "The", "the", "é", "x y"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and words:
            words[rng.randrange(len(words)) :] = words[: rng.randint(1, 4)] * rng.randint(3, 9)
        result.append(rng.choice([" ", "\n", " \t "]).join(words))
    return result


@pytest.mark.parametrize(("exponent", "shortest"), [(4, 6), (2, 3)])
def test_collapse_matches_brute_force(spark, exponent, shortest):
    rows = list(enumerate(texts(7, 300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = runs.collapse(docs, exponent=exponent, shortest=shortest, keep=("doc_id",)).collect()
    want = {i: expected(text, None, exponent, shortest) for i, text in rows}
    assert {r.row.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(w[1] for w in want.values()) > 100


def test_edge_rows(spark):
    rows = [
        (1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "a " * 5, 4), (5, "a " * 6, 5), (5, "a " * 6, 5),
        (None, "a b " * 4, None), (6, "a b " * 40000 + "end", 6), (7, "one two three", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = runs.collapse(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n_words, n_runs, start, length, period, listed, kept = tuple(r)[1:]
        if r.row.doc_id == 6:
            assert (n_words, n_runs, start, length, period) == (80001, 1, 0, 80000, 2)
            assert kept == hashlib.sha256(b"a b end").hexdigest()
        else:
            assert tuple(r)[1:] == expected(r.row.text)
    assert runs.collapse(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.collapse(docs, exponent=1)


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want, rearranged = {}, 0
    for r in docs:
        n = len(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()))
        h = zlib.crc32(str(r.doc_id).encode())
        g, places = h // 10, None
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            places = [i if i < a else a + (i - a) % p for i in range(n)]
            rearranged += 1
        _, count, s, length, p, listed, kept = expected(r.text, places)
        want[r.doc_id] = (count, s, length, p, None if s is None else 1000 * length // p, listed, kept)
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert got == want and rearranged > 5
    assert sum(w[0] for w in want.values()) > 3
