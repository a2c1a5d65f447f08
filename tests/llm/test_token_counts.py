"""Signed deltas against counting anew, replays, and edge rows."""

import re

from folioscope.llm import rollup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, text string, tokenizer string"
ROWS = [
    (1, "a", "en", "one two, three", "clash"), (2, "a", "en", None, None), (3, "a", "de", "", None),
    (4, None, None, "x-y z", None), (4, None, None, "x-y z", None), (5, "b", "en", "w " * 20000, None),
]
PATTERNS = {"space-1": r"[^\x20\x09-\x0D]+", "plain-1": r"[a-zA-Z0-9\u0080-\U0010ffff]+"}


def counted(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("doc_id", "source", "lang", rollup.counts(F.col("text")).alias("tokens"))


def expected(rows):
    totals = {}
    for _, source, lang, text, _ in rows:
        for name, pattern in PATTERNS.items():
            n, t = totals.get((source, lang, name), (0, 0))
            totals[source, lang, name] = (n + 1, t + len(re.findall(pattern, text or "")))
    return totals


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def test_load_replay_remove_and_revise(spark, tmp_path):
    ledger = rollup.Ledger(spark, f"file://{tmp_path}/ledger")
    assert totals(ledger) == {}
    assert ledger.commit("load", rollup.signed(counted(spark, ROWS), 1))
    assert totals(ledger) == expected(ROWS)
    assert not ledger.commit("load", rollup.signed(counted(spark, ROWS), 1))
    assert totals(ledger) == expected(ROWS)
    assert ledger.commit("empty", rollup.signed(counted(spark, ROWS).where("false"), 1))
    assert ledger.commit("gone", rollup.signed(counted(spark, ROWS[:1]), -1))
    left = totals(ledger)
    assert left["a", "en", "space-1"] == (1, 0)
    both = counted(spark, ROWS[3:5]).withColumnRenamed("tokens", "before")
    both = both.withColumn("after", rollup.counts(F.lit("one")))
    assert ledger.commit("fix", rollup.revised(both, "before", "after"))
    assert totals(ledger)[None, None, "plain-1"] == (2, 2)


def test_data_without_a_record_does_not_count(spark, tmp_path):
    ledger = rollup.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.commit("one", rollup.signed(counted(spark, ROWS[:1]), 1))
    lost = rollup.signed(counted(spark, ROWS), 1).withColumns({"batch": F.lit("two"), "attempt": F.lit("x")})
    lost.write.mode("append").parquet(f"{ledger.folder}/deltas")
    assert totals(ledger) == expected(ROWS[:1])
