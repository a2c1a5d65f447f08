"""The pipeline against brute force, and the queries' names and promises."""

import re

import corpus_pipeline
import __spark_entry__
from folioscope.llm import queries, toxicity
from test_decontaminate import brute as windows
from test_jaccard import brute as near
from test_pieces import sentencepiece, expected

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near copies", "benchmark decontamination", "piece encoding",
    ]


def test_run_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    accepted = corpus_pipeline.without_toxic(spark, docs, FOLDER)
    assert accepted.columns == docs.columns
    left = [(r.doc_id, r.text) for r in accepted.collect()]
    first = {i: c for i, _, c in near(left, 5, 80, 100)}
    left = [(i, t) for i, t in left if first[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in windows(left, items) if not hit}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = {i: expected(library, t)[0] for i, t in left if i in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_every_operator_has_one_query():
    names = list(__spark_entry__.queries())
    for number in range(1, 14):
        assert len([n for n in names if re.match(rf"op{number}_", n)]) == 1
    assert "pipeline" in names
    assert not set(__spark_entry__.oracle_sql()) - set(names)
