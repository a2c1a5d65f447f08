import random

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import context, jobs, postings, search


def fused(rows, k, limit):
    """Reciprocal Rank Fusion over complete lists, in plain Python."""
    scores = {}
    for leg in (1, 2):
        ranked = sorted((r for r in rows if r[leg] is not None), key=lambda r: (-r[leg], r[0]))
        for i, r in enumerate(ranked, 1):
            scores[r[0]] = scores.get(r[0], 0.0) + 1.0 / (k + i)
    return sorted(((-round(s, 12), key) for key, s in scores.items()))[:limit]


def test_fusion_equals_complete_lists(spark):
    rng = random.Random(11)
    for size, k in ((400, 5), (7, 60), (250, 1)):
        rows = [
            (
                i,
                round(rng.random(), 1) if rng.random() < 0.6 else None,
                round(rng.random(), 2) if rng.random() < 0.9 else None,
            )
            for i in range(size)
        ]
        df = spark.createDataFrame(rows, "id long, a double, b double")
        for limit in (1, 4, 9):
            got = search.rrf_top(df, ["id"], ["a", "b"], limit, k).collect()
            assert [(-r.score, r.id) for r in got] == fused(rows, k, limit)


def test_fusion_with_one_empty_leg(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, None)], "id long, a double, b double")
    got = search.rrf_top(df, ["id"], ["a", "b"], 5).collect()
    assert [r.id for r in got] == [2, 1]
    assert all(r.score > 0 for r in got)


def overlaps(spark, rows):
    df = spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int, score double")
    kept = search.drop_overlaps(df, ["repo", "path"])
    return sorted((r.repo, r.path, r.start_line) for r in kept.collect())


def test_overlaps(spark):
    assert len(overlaps(spark, [("r", "a", 1, 5, 0.9), ("r", "a", 10, 15, 0.7)])) == 2
    assert overlaps(spark, [("r", "a", 1, 10, 0.9), ("r", "a", 5, 15, 0.3)]) == [("r", "a", 1)]
    assert len(overlaps(spark, [("r", "a", 1, 10, 0.9), ("r", "b", 5, 15, 0.7)])) == 2
    assert len(overlaps(spark, [("q", "a", 1, 10, 0.9), ("r", "a", 5, 15, 0.7)])) == 2
    # The dropped middle row must not block the third one.
    chain = [("r", "a", 1, 4, 0.9), ("r", "a", 4, 8, 0.8), ("r", "a", 8, 9, 0.1)]
    assert overlaps(spark, chain) == [("r", "a", 1), ("r", "a", 8)]


def test_phrases_and_words(spark):
    assert search.query_terms(spark, '"Error handling" parseJson the') == [
        "error  handling", "parse", "json", "the",
    ]
    assert search.query_terms(spark, '""') == []


def test_scan_and_postings_agree(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(80)]
    chunks = spark.createDataFrame(rows, "id long, content string")
    postings.write_index(chunks, ["id"], str(tmp_path), buckets=4)
    index = postings.read_index(spark, str(tmp_path))
    assert index.buckets == 4
    for terms in (["beta", "delta"], ["beta  delta", "alpha"], ["alpha  alpha"], ["none"], ["none  alpha"]):
        scan = search.bm25(search.with_words(chunks), terms)
        a = {r.id: r.bm25 for r in scan.where("bm25 is not null").collect()}
        b = {r.id: r.bm25 for r in postings.score_postings(index, terms).collect()}
        assert a.keys() == b.keys()
        assert all(abs(a[i] - b[i]) < 1e-8 for i in a)


def test_phrases_may_overlap_themselves(spark):
    chunks = spark.createDataFrame([(1, "la la la"), (2, "la ba la")], "id long, content string")
    counted = search.with_words(chunks).select("id", text.padded_term_count(F.col("words"), "la  la").alias("n"))
    assert {r.id: r.n for r in counted.collect()} == {1: 2, 2: 0}


def test_trim_is_a_prefix(spark):
    rng = random.Random(9)
    rows = [("p%02d" % rng.randrange(20), i, i, "x" * rng.randrange(200)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "file_path string, start_line int, end_line int, content string")
    for budget in (5, 100, 1000):
        used, expected = 0, []
        for path, start, end, content in sorted(rows):
            head = f"\n--- {path} L{start}-{end} ---\n"
            cost = -(-len(head) // 3) + -(-len(content) // 3)
            if used + cost > budget:
                break
            used += cost
            expected.append((path, start))
        got = context.trim_to_budget(df, budget).orderBy("position").collect()
        assert [(r.file_path, r.start_line) for r in got] == expected


def test_format(spark):
    rows = [("a", 1, 2, "one", None), ("a", 5, 6, "two", "added"), ("b", 0, 0, "(file deleted)", "deleted")]
    df = spark.createDataFrame(
        rows, "file_path string, start_line int, end_line int, content string, annotation string"
    )
    text = context.format_pack(context.trim_to_budget(df)).first()["text"]
    assert text == (
        "--- a L1-2 ---\none\n\n--- L5-6 ---\n[added]\ntwo\n\n--- b L0-0 ---\n[deleted]\n(file deleted)"
    )


def test_previous_value_across_buckets(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.choice("ab") if rng.random() < 0.8 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = jobs.previous_value(df, ["k"], ["t"], "v", (F.col("t") / 25).cast("int")).collect()
    by_key = {}
    for k, t, v in rows:
        by_key.setdefault(k, []).append((t, v))
    expected = {
        (k, t): (by_key[k][i - 1][1] if i else None)
        for k in by_key
        for i, (t, _) in enumerate(by_key[k])
    }
    assert {(r.k, r.t): r.previous for r in got} == expected


def test_hybrid_search_fills_the_limit_under_heavy_overlap(spark):
    rows = [("hot", i, i + 50, "json " * 20, [1.0, i / 1000]) for i in range(1, 61)]
    rows += [(f"f{k}", 1, 9, "json other words", [0.5, 1.0]) for k in range(4)]
    chunks = spark.createDataFrame(
        rows, "content_id string, start_line int, end_line int, content string, embedding array<double>"
    )
    scope = spark.createDataFrame(
        [(c, "r", "v1", f"{c}.txt") for c in ("hot", "f0", "f1", "f2", "f3")],
        "content_id string, repo string, ref string, path string",
    )
    for limit, want in ((3, 3), (5, 5), (200, 6)):
        got = search.hybrid_search(chunks, scope, ["json"], [1.0, 0.0], limit).collect()
        hot = [r for r in got if r.file_path == "hot.txt"]
        assert len(got) >= min(want, 5)
        assert all(a.end_line < b.start_line or b.end_line < a.start_line for a in hot for b in hot if a is not b)


def test_limits_have_no_ceiling():
    assert [search.clamp_limit(n) for n in (None, 0, 5, 5000)] == [20, 1, 5, 5000]


def test_a_hot_key_is_split_into_ranges(spark):
    """One key owns a third of all rows within one day; its rows go to many groups."""
    rows = [(0 if i % 3 == 0 else i, i, f"v{i}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, v string").repartition(3)
    number = jobs.range_number(df, ["k", "t"])
    sizes = df.groupBy("k", number.alias("b")).count().where("k = 0").collect()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) >= ranges // 3 and max(r["count"] for r in sizes) <= 2 * len(rows) / ranges
    got = {(r.k, r.t): r.previous for r in jobs.previous_value(df, ["k"], ["t"], "v").collect()}
    before = {}
    for k, t, v in rows:
        assert got[k, t] == before.get(k)
        before[k] = v


def test_word_scores_read_texts_once(spark):
    rows = [(1, "alpha beta alpha"), (2, "beta"), (3, "gamma"), (4, "")]
    chunks = spark.createDataFrame(rows, "id long, content string")
    got = search.word_scores(chunks, ["alpha", "beta"], ["id"])
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = search.bm25(search.with_words(chunks), ["alpha", "beta"]).select("id", "bm25")
    assert sorted(got.collect()) == sorted(want.collect())


def test_an_index_holds_words_in_its_blocks_only(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "x y x"), ("a", 2, "..."), ("b", 1, "y")], "word string, line int, content string")
    postings.write_index(chunks, ["word", "line"], str(tmp_path), buckets=4)
    assert {p.name for p in tmp_path.iterdir()} == {"about", "postings"}
    index = postings.read_index(spark, str(tmp_path))
    assert sorted((r.word, r.line, r.length) for r in index.lengths.collect()) == [("a", 1, 3), ("a", 2, 0), ("b", 1, 1)]
    assert sorted((r.word, r.n) for r in index.postings.groupBy("word").agg(F.sum("n").alias("n")).collect()) == [("x", 1), ("y", 2)]
    plan = postings.word_blocks(postings.numbered(chunks, ["word"], dealt=False))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_search_cuts_only_the_contents_it_found(spark):
    asked = []

    def texts(found):
        asked.extend(r.content_id for r in found.collect())
        return spark.createDataFrame([("a", 1, 3, "json text")], "content_id string, start_line int, end_line int, content string")

    keys = spark.createDataFrame(
        [("a", 1, 3, [1.0, 0.0]), ("b", 1, 3, None)],
        "content_id string, start_line int, end_line int, embedding array<float>",
    )
    scope = spark.createDataFrame([("a", "p", "r", "v"), ("b", "q", "r", "v")], "content_id string, path string, repo string, ref string")
    words = spark.createDataFrame([("a", 1, 3, 2.0)], "content_id string, start_line int, end_line int, bm25 double")
    got = search.hybrid_search(keys, scope, ["json"], [1.0, 0.0], 5, words=words, texts=texts).collect()
    assert asked == ["a"] and [(r.file_path, r.content) for r in got] == [("p", "json text")]
