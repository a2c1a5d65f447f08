"""Shapes of physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry_module
from folioscope.operators import postings, search
from folioscope.queries import retrieval
from folioscope.sources import tables

STREAMS = ("q_stream_job_queue", "q_stream_progress_counters", "q_stream_latest_stage", "q_incremental_index")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(STREAMS)))
def test_no_cross_joins_or_row_at_a_time_python(spark, sf_dir, name):
    plan = plan_of(entry_module.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(entry_module.queries()["q_scan_filter"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "EqualTo(lang,fr)" in pushed and "GreaterThan(n_chars,500)" in pushed
    assert "text" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(entry_module.queries()["q_vector_topk"](spark, sf_dir))


def test_word_search_does_not_read_vectors(spark, sf_dir):
    chunks = tables.corpus_chunks(spark, sf_dir)
    scored = search.bm25(search.with_words(chunks), ["the"]).select(*retrieval.KEY, "bm25")
    assert "embedding:array" not in plan_of(scored)


def test_language_counts_are_combined_before_the_shuffle(spark, sf_dir):
    plan = plan_of(entry_module.queries()["q_language_stats"](spark, sf_dir))
    assert "partial_count" in plan


def test_indexed_search_reads_texts_of_the_result_only(spark, tmp_path):
    """Word and vector scores of a search from the index come from scans without text."""
    key = ["content_id", "start_line", "end_line"]
    chunks = tables.corpus_chunks(spark, "/root/testdata/sf0.001").select(*key, "content", "embedding")
    chunks.write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    postings.write_index(stored, key, str(tmp_path / "index"))
    words = postings.score_postings(postings.read_index(spark, str(tmp_path / "index")), ["the", "de  la"])
    scored = search.vector_score(stored.select(*key, "embedding"), [1.0] * 64)
    plan = plan_of(scored.join(words, key, "left"))
    assert "content:string" not in plan and "positions" in plan
    assert "PushedFilters: [In(word" in plan.replace("IsNotNull(word), ", "")
