"""Components against brute force on random near copies, hot groups and edge rows."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from folioscope.llm import jaccard
from folioscope.llm.components import components

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, num, den):
    """Component of every row by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(least[find(i)])) for i in range(len(rows))), key=str)


def made(seed, groups, copies, words, edits):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(groups):
        base = [random.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(random.randint(0, edits)):
                text[random.randrange(len(text))] = random.choice(vocabulary + ["Neu", "WORT"])
            rows.append((len(rows), " ".join(text)))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    ("n", "num", "den", "rows"),
    [
        (3, 90, 100, made(1, 40, 4, 120, 6)),
        (5, 80, 100, made(2, 20, 5, 90, 6)),
        (3, 90, 100, made(3, 1, 150, 150, 6)),  # one group of near copies
        (3, 90, 100, made(4, 60, 3, 12, 1)),  # short texts at the smallest sizes that can differ
    ],
)
def test_components_match_brute_force(spark, n, num, den, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_components(docs, n=n, num=num, den=den).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n, num, den)


def test_edge_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, "One", "x"), (5, "one", "x"),
        (5, "one", "x"), (6, "a b", "x"), (7, "word " * 30000, "x"), (8, "WORD " * 5, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = sorted(tuple(r) for r in jaccard.near_components(docs).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7)]
    assert jaccard.near_components(docs.where("false")).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [
        (3, text, "en"), (1, text.upper(), "en"), (1, text.upper(), "en"), (2, "other words here", "de"),
        (None, None, None), (4, "", "en"), (4, "", "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, text.upper()), (2, "other words here"), (0, ""), (4, ""), (4, "")]
    )


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 5, "a", True, "k", 1, 2), (2, text, 6, "b", False, "k", 3, 4), (2, text, 6, "b", False, "k", 3, 4)]
    names = "doc_id long, text string, _id long, _digest string, _leave boolean, key string, mark int, leave int"
    kept = jaccard.distinct_documents(spark.createDataFrame(rows, names))
    assert kept.columns == [n.split()[0] for n in names.split(", ")]
    assert [tuple(r) for r in kept.collect()] == rows[:1]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 3), (3, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 160)} | {3: 3, 7: 3}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_list_of_copies_gives_the_same_documents(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in made(5, 10, 4, 60, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(tuple(r) for r in jaccard.distinct_documents(docs).collect())
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    assert sorted(tuple(r) for r in jaccard.distinct_documents(docs).collect()) == want


def test_all_links_inside_a_component(spark, monkeypatch):
    # Near copies of one text: hubs connect them by few links, most true ones are between others.
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 16)
    rows = made(7, 2, 60, 150, 3) + made(8, 30, 3, 12, 1) + made(9, 1, 5, 40, 0)
    rows = [(i, text) for i, (_, text) in enumerate(rows)] + [(1000, None), (1001, " ")]
    sets = {i: shingles(text, 3) for i, text in rows}
    want = set()
    for i in sets:
        for j in sets:
            shared = len(sets[i] & sets[j])
            if i < j and shared and 100 * shared >= 90 * (len(sets[i]) + len(sets[j]) - shared):
                want.add((i, j))
    assert len(want) > 2 * len(rows)  # far more links than a component needs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, membership = jaccard.near_pairs(docs)
    pairs = [tuple(p) for p in pairs.collect()]
    node = {r.doc_id: r.node for r in membership.collect()}
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    near = set(pairs)
    got = {
        (i, j) for i in sets for j in sets if i < j and node[i] is not None and node[j] is not None
        and (node[i] == node[j] or (min(node[i], node[j]), max(node[i], node[j])) in near)
    }
    assert got == want
    counts = {r.doc_id: r.n_links for r in jaccard.near_links(docs).collect()}
    assert counts == {i: sum(i in p for p in want) for i in sets}


@pytest.mark.parametrize("heavy", [2, 8, 64])
@pytest.mark.parametrize("same", [True, False])
def test_meetings_of_blocks_match_brute_force(monkeypatch, heavy, same):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "WIDTH", 64)
    random.seed(heavy)
    sets = []
    for base in ([random.getrandbits(40) for _ in range(80)] for _ in range(4)):
        for _ in range(15):
            grams = set(base)
            for _ in range(random.randint(0, 6)):
                grams.discard(random.choice(base))
                grams.add(random.randrange(12))
            sets.append(sorted(grams))
    random.shuffle(sets)
    # Any order of n-grams serves; here large ones are rare.
    keep = [len(s) - -(-9 * len(s) // 10) + 1 for s in sets]
    table = pa.table({
        "low": [0] * len(sets), "high": [0 if same else 1] * len(sets),
        "block": [0 if same else i % 2 for i in range(len(sets))],
        "sig": list(range(len(sets))), "copies": [1 + i % 3 for i in range(len(sets))],
        "prefix": [sorted(s, reverse=True)[:k] for s, k in zip(sets, keep)], "grams": sets,
    })
    want = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
        if (same or (i + j) % 2) and 10 * len(set(sets[i]) & set(sets[j])) >= 9 * len(set(sets[i]) | set(sets[j]))
    }
    assert len(want) > 20
    pairs = jaccard._meet(9, 10, True)(table).to_pylist()
    assert sorted((p["a"], p["b"]) for p in pairs) == sorted(want)
    counts = defaultdict(int)
    for row in jaccard._meet(9, 10, False)(table).to_pylist():
        counts[row["sig"]] += row["linked"]
    for i in range(len(sets)):
        assert counts[i] == sum(1 + (b if a == i else a) % 3 for a, b in want if i in (a, b))
