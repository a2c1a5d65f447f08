"""Cells of line ranges, joins by them, and positions in a total order."""

import random

from pyspark.sql import functions as F

from folioscope.operators import lookup, ranges
from folioscope.operators.ranks import ranked
from test_plans import plan_of


def test_cells_cover_each_line_once(spark):
    rng = random.Random(1)
    spans = [(1, 1), (1, 8), (8, 16), (7, 72), (1, 5000), (3, 2), (64, 127)]
    spans += [tuple(sorted((rng.randint(1, 3000), rng.randint(1, 3000)))) for _ in range(60)]
    df = spark.createDataFrame(spans, "s int, e int")
    for row in df.select("s", "e", ranges.cover(F.col("s"), F.col("e")).alias("cells")).collect():
        lines = [n for level, cell in row.cells for n in range(cell << 3 * level, (cell + 1) << 3 * level)]
        assert sorted(lines) == list(range(row.s, row.e + 1))
        assert len(row.cells) <= 14 * 4


def test_within_equals_all_pairs(spark):
    rng = random.Random(2)

    def spans(count, most):
        starts = [rng.randint(1, 900) for _ in range(count)]
        return [(rng.choice("ab"), s, s + rng.randint(0, most)) for s in starts]

    outer, inner = spans(80, 300) + [("c", 1, 9), ("a", None, 4), ("a", 9, 2)], spans(200, 12) + [("a", 5, 1)]
    schema = "f string, start_line int, end_line int"
    got = ranges.within(spark.createDataFrame(outer, schema), spark.createDataFrame(inner, schema), ["f"])
    pairs = sorted(tuple(r) for r in got.where("inner_start is not null").distinct().collect())
    want = {(f, s, e, a, b) for f, s, e in outer if s for g, a, b in set(inner)
            if f == g and s <= a <= b <= e}
    assert pairs == sorted(want)
    assert got.select("f", "start_line", "end_line").distinct().count() == len(set(outer))


def test_one_huge_file_is_dealt_out(spark):
    """A file of 100,000 chunks under 3,000 symbols meets in equal tasks."""
    one = (F.col("id") % 1).cast("string").alias("content_id")
    chunks = spark.range(100_000).select(
        one, (F.col("id") * 3 + 1).cast("int").alias("start_line"),
        (F.col("id") * 3 + 3).cast("int").alias("end_line"), F.lit("x").alias("content"),
    )
    symbols = spark.range(3_000).select(
        one, F.col("id").cast("string").alias("name"),
        (F.col("id") * 100 + 1).cast("int").alias("start_line"), (F.col("id") * 100 + 100).cast("int").alias("end_line"),
    )
    key = ["content_id", "name"]
    sources = lookup.symbol_source_by_cells(symbols, chunks, key)
    plan = plan_of(sources)
    assert "hashpartitioning(content_id" in plan and "_at" in plan
    rows = sources.select(F.size(F.split("source", "\n")).alias("n")).groupBy("n").count().collect()
    # Lines 100k+1 .. 100k+100 hold 32 or 33 whole chunks.
    assert {r.n for r in rows} == {32, 33} and sum(r["count"] for r in rows) == 3_000
    at = F.expr("shiftright(cast(start_line as long), 3)")
    tasks = chunks.repartition(8, "content_id", at).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 2 * 100_000 / 8


def test_symbols_without_chunks_and_equal_chunks(spark):
    chunks = spark.createDataFrame(
        [("f", 1, 2, "a"), ("f", 1, 2, "b"), ("f", 3, 4, "c"), (None, 1, 1, "n")],
        "content_id string, start_line int, end_line int, content string",
    )
    symbols = spark.createDataFrame(
        [("f", "all", 1, 4), ("f", "all", 1, 4), ("f", "none", 2, 3), ("g", "other", 1, 9), (None, "null", 1, 1)],
        "content_id string, name string, start_line int, end_line int",
    )
    got = lookup.symbol_source_by_cells(symbols, chunks, ["content_id", "name"]).collect()
    assert {r.name: r.source for r in got} == {"all": "a\nb\nc", "none": "", "other": "", "null": ""}


def test_positions_in_a_total_order(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9), k) for k in range(997)]
    frame = spark.createDataFrame(rows, "score int, id int").repartition(7)
    got = ranked(frame, [F.desc("score"), "id"]).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.score, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 998))
    assert ranked(frame.where("false"), ["id"]).count() == 0
    assert "Window" not in plan_of(ranked(frame, ["id"]))
