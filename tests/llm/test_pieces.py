"""Ids and decoded texts against the public library, on random texts and on edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import Row

from folioscope.llm import pieces, queries

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return ids, library.decode(ids)


def test_random_texts_match_the_library(path, library):
    coder = pieces.Codec(pieces.load_model(path))
    random.seed(7)
    letters = list("abcdeth   \n\t▁.,<>/s0x0A>中é😀\x00​’")
    for _ in range(4000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        ids, back = coder.text(text)
        assert ([int(i) for i in " ".join(ids).split()], back) == expected(library, text)


def test_small_memory_changes_nothing(path, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 3)
    coder = pieces.Codec(pieces.load_model(path))
    for text in ("some words and some other words", "und noch mehr Wörter, ja?"):
        assert [int(i) for i in " ".join(coder.text(text)[0]).split()] == expected(library, text)[0]
    assert len(coder.words) <= 3 and len(coder.pairs) <= 3


def test_edge_rows(spark, path, library):
    texts = [None, "", " ", "a" * 30000, "<s></s>", "中文 \x00", "same", "same"]
    rows = [Row(doc_id=i if i < 6 else 6, text=t, n_tokens="clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = pieces.code(docs, path, more=("decoded", "ids")).collect()
    assert len(out) == len(texts)
    for row in out:
        ids, back = expected(library, row.row.text)
        assert (row.ids, row.decoded, row.n_tokens) == (ids, back, len(ids))
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert row.row.n_tokens == "clash"
    assert pieces.code(docs.where("false"), path).count() == 0


def test_query_covers_the_table(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op6_pieces"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids, back = expected(library, doc.text)
        assert got[doc.doc_id].n_tokens == len(ids)
        assert got[doc.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc.doc_id].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
