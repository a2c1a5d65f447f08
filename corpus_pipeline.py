"""From documents to token ids: toxicity, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. `run`
writes every stage's rows to the folder that the cluster shares and reads them again, so a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import common, decontaminate, jaccard, pieces, queries, toxicity
from folioscope.session import ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels outside the held-out fold, accepts."""
    ship_package(spark)
    return toxicity.accepted(docs, common.table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard of 0.8 or more on five-word shingles."""
    ship_package(spark)
    return jaccard.distinct_documents(docs, n=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    ship_package(spark)
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with the end id, and digests of the ids and of the decoded text."""
    ship_package(spark)
    coded = pieces.code(docs, queries.tokenizer_path("piece_bpe_32k.model"), more=("ids",))
    kept = [F.col(f"row.{name}").alias(name) for name in ("doc_id", "lang", "source")]
    return coded.select(*kept, "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("piece encoding", encoded),
]

#: SQL cannot express the network or the merge encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs
