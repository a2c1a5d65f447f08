"""The segmented word index against scores over all live chunks."""

import random

import pytest

from folioscope.operators import postings, search
from folioscope.operators.segments import SegmentedIndex

KEY = ["content_id", "start_line"]
WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta"]


def made(seed, count, start=0):
    rng = random.Random(seed)
    rows = []
    for k in range(start, start + count):
        words = rng.choices(WORDS, [1, 2, 4, 8, 16, 32], k=rng.randint(0, 40))
        rows.append((f"c{k}", 1 + k % 3, " ".join(words)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "content_id string, start_line int, content string")


def expected(spark, rows, terms, k):
    scored = search.bm25(search.with_words(frame(spark, rows)), terms)
    return [tuple(r) for r in search.top_k(scored, "bm25", KEY, k).select(*KEY, "bm25").collect()]


@pytest.fixture
def index(spark, tmp_path):
    return SegmentedIndex(spark, str(tmp_path / "words"), KEY, window=8, buckets=4)


TERMS = (["alpha"], ["beta", "zeta"], ["alpha  beta", "gamma"], ["delta  zeta  zeta"], ["absent", "alpha"])


def check(spark, index, rows, k=10):
    for terms in TERMS:
        got = [tuple(r) for r in index.top(terms, k).collect()]
        assert got == expected(spark, rows, terms, k), terms


def test_add_replace_delete_and_merge_equal_a_scan(spark, index):
    live = {}
    for part in range(3):
        rows = made(part, 60, 60 * part)
        index.add(frame(spark, rows))
        live |= {r[:2]: r for r in rows}
    check(spark, index, list(live.values()))
    rows = made(9, 40, 100)
    index.replace(frame(spark, rows))  # across two segments
    live |= {r[:2]: r for r in rows}
    gone = list(live)[::4]
    index.delete(frame(spark, [(*key, "") for key in gone]).select(*KEY))
    for key in gone:
        del live[key]
    check(spark, index, list(live.values()))
    assert index.live().count() == len(live)
    before = index.segments
    assert len(index.merge(fanout=5)) == 0 and index.segments == before
    merged = index.merge(fanout=4)
    assert len(merged) >= 3 and len(index.segments) < len(before)
    check(spark, index, list(live.values()), k=1)
    check(spark, index, list(live.values()), k=1000)
    # A merge leaves the dead behind.
    assert sum(docs for docs, _ in index.segments.values()) < sum(docs for docs, _ in before.values())


def test_an_opened_generation_does_not_change(spark, index):
    first, second = made(1, 30), made(2, 30, 30)
    index.add(frame(spark, first))
    reader = SegmentedIndex(spark, index.folder, KEY, window=8, buckets=4)
    index.add(frame(spark, second))
    index.delete(frame(spark, first))
    check(spark, reader, first)
    check(spark, SegmentedIndex(spark, index.folder, KEY, 8, 4), second)
    check(spark, SegmentedIndex(spark, index.folder, KEY, 8, 4, generation=2), first + second)


def test_a_write_touches_its_own_segment_only(spark, index, tmp_path):
    index.add(frame(spark, made(1, 40)))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "words").rglob("*.parquet")}
    index.add(frame(spark, made(2, 5, 40)))
    index.delete(frame(spark, made(2, 2, 40)))
    assert {p: p.stat().st_mtime_ns for p in before} == before
    added = {p.parts[-2] if "bucket" not in p.parts[-2] else p.parts[-3]
             for p in (tmp_path / "words").rglob("*.parquet") if p not in before}
    assert added == {"segment=2", "gen=2", "gen=3"}


def test_a_write_that_died_is_not_seen(spark, index, monkeypatch):
    rows = made(1, 30)
    index.add(frame(spark, rows))
    monkeypatch.setattr(SegmentedIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.replace(frame(spark, made(5, 30)))
    monkeypatch.undo()
    again = SegmentedIndex(spark, index.folder, KEY, window=8, buckets=4)
    check(spark, again, rows)
    more = made(6, 10, 100)
    again.add(frame(spark, more))
    check(spark, again, rows + more)


def test_windows_read_grow_with_k(spark, index):
    rng, rows = random.Random(3), []
    for k in range(1500):  # most texts hardly mention the words, a few are about them
        weights = rng.choice([[0.05, 0.05], [0.1, 0.05], [0.05, 0.1], [9, 6]] if k % 50 == 0 else [[0.05, 0.05], [0.1, 0.05]])
        rows.append((f"c{k}", 1, " ".join(rng.choices(WORDS, [*weights, 4, 8, 16, 32], k=rng.randint(10, 60)))))
    index.add(frame(spark, rows))
    units = [["alpha"], ["beta"]]
    known = index._statistics(units)
    every = index.bounds(units, known).count()
    needed = [index.needed(units, known, k)[0].count() for k in (1, 10, 100, 1500)]
    assert needed == sorted(needed)
    assert needed[0] < every / 4 and needed[-1] == every


def test_many_windows_meet_the_blocks_in_a_join(spark, index, monkeypatch):
    rows = made(3, 200)
    index.add(frame(spark, rows))
    monkeypatch.setattr("folioscope.operators.segments.NAMED_WINDOWS", 1)
    check(spark, index, rows, k=100)


def test_empty_tables_and_texts(spark, index):
    assert index.top(["alpha"], 5).count() == 0
    index.add(frame(spark, []))
    index.delete(frame(spark, made(1, 3)))
    assert index.top(["alpha"], 5).columns == [*KEY, "bm25"]
    index.add(frame(spark, [("c1", 1, ""), ("c2", 1, "...")]))
    assert index.top(["alpha"], 5).count() == 0 and index.top([], 5).count() == 0
    index.add(frame(spark, [("c3", 1, "alpha")]))
    assert [r.content_id for r in index.top(["alpha"], 5).collect()] == ["c3"]


def test_postings_group_words_without_a_second_shuffle(spark):
    plan = postings.postings(frame(spark, made(1, 5)), KEY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_blocks_are_written_without_shuffling_postings(spark):
    docs = spark.createDataFrame([(k, 3, ["a", "b", "a"]) for k in range(5)], "ordinal long, length long, words array<string>")
    blocks = postings.word_blocks(docs, 4, 2)
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    found = {}
    for row in blocks.collect():
        assert row.n == len(row.entries) and row.shortest == 3 and row.most == (2 if row.word == "a" else 1)
        for e in row.entries:
            assert e.ordinal // 2 == row["at"]
            found[row.word, e.ordinal] = e.positions
    assert found == {(w, k): p for k in range(5) for w, p in (("a", [0, 2]), ("b", [1]))}


def test_words_are_grouped_in_bounded_parts(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(0, 0, []), (1, 4, list("abca")), (2, 0, []), (3, 1, ["a"]), (4, 2, ["c", "é"])],
        "ordinal long, length long, words array<string>",
    ).coalesce(1)
    monkeypatch.setattr(postings, "GROUPED", 2)
    found = sorted((r.word, e.ordinal, tuple(e.positions)) for r in postings.word_blocks(docs).collect() for e in r.entries)
    assert found == [("a", 1, (0, 3)), ("a", 3, (0,)), ("b", 1, (1,)), ("c", 1, (2,)), ("c", 4, (0,)), ("é", 4, (1,))]


def test_a_tombstone_holds_no_words(spark, index, tmp_path):
    index.add(frame(spark, made(1, 20)))
    index.delete(frame(spark, made(1, 5)))
    assert spark.read.parquet(str(tmp_path / "words" / "removed")).columns == ["segment", "ordinal", "length", "gen"]
    check(spark, index, made(1, 20)[5:])
