"""Parquet tables and the engine entities derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import text as text_fn
from folioscope.operators import chunking, ingest

REFS = 20
REPOS = 5
#: Session setting: deal texts out to this many tasks before heavy work. Unset, a scan's own
#: splits are used; set it where a table is one small file, so one split.
SPREAD = "folioscope.texts.partitions"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a unique key if the session asks for it."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), key) if parts else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def scan(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df if where is None else df.where(where)


def find_one(df: DataFrame, where: Column, order: str) -> DataFrame:
    """First match by an explicit order, so the answer never depends on the layout."""
    return df.where(where).orderBy(order).limit(1)


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of twenty refs: one slot of a path per language and number."""
    slot = F.expr(f"doc_id div {REFS}").cast("string")
    return documents(spark, folder).select(
        F.col("doc_id").alias("ordinal"),
        (F.col("doc_id") % REFS).alias("repo_ref_id"),
        F.concat(F.col("lang"), F.lit("/"), slot).alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        text_fn.content_hash(F.col("text")).alias("content_id"),
    )


def corpus_ref_files(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_files(spark, folder).drop("content", "ordinal")


def corpus_contents(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.distinct_contents(corpus_files(spark, folder))


def corpus_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per content with its text: that of the first file that has it."""
    files = corpus_files(spark, folder)
    return ingest.first_copies(files, ingest.distinct_contents(files))


def corpus_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Line windows of every content with the vector of its first document, if any."""
    texts = corpus_texts(spark, folder).select("ordinal", "content_id", "content")
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("ordinal"), "embedding"
    )
    return chunking.chunk_files(texts.join(vectors, "ordinal", "left"), keep=["embedding"])


def corpus_refs(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Refs of the corpus with their file counts, language shares and stage."""
    files = corpus_files(spark, folder) if files is None else files
    files = files.select("repo_ref_id", "language")
    counted = files.groupBy("repo_ref_id").agg(F.count("*").cast("int").alias("files_total"))
    stats = ingest.language_stats(files, ["repo_ref_id"])
    rid = F.col("repo_ref_id")
    stage = F.when(rid % 7 == 3, "error").when(rid % 7 == 5, "embedding").otherwise("ready")
    return counted.join(stats, "repo_ref_id").select(
        rid.alias("id"),
        (rid % REPOS).alias("repo_id"),
        F.concat(F.lit("v1."), F.expr(f"repo_ref_id div {REPOS}").cast("string"), F.lit(".0")).alias(
            "ref"
        ),
        F.concat(F.lit("c"), rid.cast("string")).alias("commit_sha"),
        stage.alias("stage"),
        "files_total",
        "language_stats",
    )


def corpus_repos(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "documents").select((F.col("doc_id") % REPOS).alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("repo"), F.col("id").cast("string")).alias("name"))


def scoped_files(
    spark: SparkSession, folder: str, files: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ref files, and refs under the names a search result shows; maybe from stored files."""
    refs = corpus_refs(spark, folder, files).select(
        F.col("id").alias("repo_ref_id"),
        "ref",
        "stage",
        F.concat(F.lit("repo"), F.col("repo_id").cast("string")).alias("repo"),
    )
    if files is None:
        return corpus_ref_files(spark, folder), refs
    return files.drop("ordinal"), refs


def snapshot_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of the documents: one in ten added, deleted and modified each."""
    docs = documents(spark, folder)
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    edited = F.when(
        F.col("doc_id") % 10 == 2, F.concat(F.col("text"), F.lit("\n// v2"))
    ).otherwise(F.col("text"))
    old = docs.where(F.col("doc_id") % 10 != 0).select(
        F.lit(1).cast("long").alias("repo_ref_id"), path.alias("path"), F.col("text").alias("content")
    )
    new = docs.where(F.col("doc_id") % 10 != 1).select(
        F.lit(2).cast("long").alias("repo_ref_id"), path.alias("path"), edited.alias("content")
    )
    return old.unionByName(new).withColumn("content_id", text_fn.content_hash(F.col("content")))
