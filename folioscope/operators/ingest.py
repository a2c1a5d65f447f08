"""Indexing operators: content identity, deduplication, statistics, vector reuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import text as text_fn
from folioscope.operators.shape import computed_once


def with_content_id(files: DataFrame, content: str = "content") -> DataFrame:
    """Strip NUL characters and address the text by its SHA-256."""
    cleaned = computed_once(files, "_clean", text_fn.strip_nul(F.col(content)))
    columns = [F.col("_clean").alias(c) if c == content else F.col(c) for c in files.columns]
    return cleaned.select(*columns, text_fn.content_hash(F.col("_clean")).alias("content_id"))


def split_skipped(files: DataFrame, content: str = "content", **caps: int | None) -> DataFrame:
    return files.withColumn("skip_reason", text_fn.skip_reason(F.col(content), **caps))


def share(count: Column, total: Column) -> Column:
    """Percentage rounded half up to one decimal."""
    return F.floor(count / total * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def language_shares(files: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of each language among all candidate files, skipped ones included.

    Counts are aggregated first; the window that adds the total sees at most one row
    per language of a group.
    """
    counts = files.groupBy(*group, "language").agg(F.count("*").alias("files"))
    total = F.sum("files").over(Window.partitionBy(*[F.col(g) for g in group]))
    return counts.withColumn("percent", share(F.col("files"), total))


def language_stats(files: DataFrame, group: Sequence[str]) -> DataFrame:
    """Map of language to percentage per group."""
    entries = F.map_from_entries(F.collect_list(F.struct("language", "percent")))
    return language_shares(files, group).groupBy(*group).agg(entries.alias("language_stats"))


def distinct_contents(files: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per content; the first file that has it names the language.

    Only hashes and one small struct are aggregated, so a content that a third of
    all files share collapses on the map side.
    """
    first = F.min(F.struct(F.col(ordinal).alias("ordinal"), F.col("language"))).alias("_first")
    return (
        files.groupBy("content_id")
        .agg(first, F.count("*").alias("copies"))
        .select(
            "content_id",
            F.col("_first.language").alias("language"),
            F.col("_first.ordinal").alias("first_ordinal"),
            "copies",
        )
    )


def new_contents(files: DataFrame, known: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Contents not indexed yet; their children are the only ones to be written."""
    return distinct_contents(files, ordinal).join(
        known.select("content_id").distinct(), "content_id", "left_anti"
    )


def first_copies(files: DataFrame, contents: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The full row of the first file of each content.

    The ordinal leads the join key and is unique or nearly so: copies cannot skew it.
    """
    heads = contents.select(
        F.col("first_ordinal").alias(ordinal), "content_id", F.col("language").alias("_language")
    )
    return (
        files.drop("language")
        .join(heads, [ordinal, "content_id"])
        .withColumnRenamed("_language", "language")
    )


def file_dedup(files: DataFrame, known: DataFrame) -> DataFrame:
    """Every distinct content with its first language and whether it is new."""
    marked = known.select("content_id").distinct().withColumn("_known", F.lit(True))
    return (
        distinct_contents(files)
        .join(marked, "content_id", "left")
        .withColumn("is_new", F.col("_known").isNull())
        .drop("_known")
    )


def dedup_summary(files: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters of one run: contents new and reused, chunks new and to repair."""
    contents = file_dedup(files, known)
    per_content = (
        chunks.groupBy("content_id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("bare"))
    )
    joined = contents.join(per_content, "content_id", "left")
    new = F.col("is_new")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return joined.agg(
        total(F.when(new, 1).otherwise(0)).alias("files_new"),
        total(F.when(new, 0).otherwise(1)).alias("files_reused"),
        total(F.when(new, F.coalesce("n", F.lit(0)))).alias("chunks_new"),
        total(F.when(~new, F.coalesce("bare", F.lit(0)))).alias("chunks_repair"),
    )


def unembedded(chunks: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Chunks an earlier run left without a vector."""
    missing = chunks.where(F.col("embedding").isNull())
    if contents is None:
        return missing
    return missing.join(contents.select("content_id").distinct(), "content_id", "left_semi")


def backfill_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn(
        "content_sha256",
        F.coalesce(F.col("content_sha256"), text_fn.content_hash(F.col("content"))),
    )


def cached_vectors(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """One stored vector per chunk hash: that of the smallest id that has one.

    The partial aggregate keeps one vector per hash and task, so a hot hash never
    ships its many equal vectors.
    """
    return (
        chunks.where(F.col("embedding").isNotNull() & F.col("content_sha256").isNotNull())
        .groupBy("content_sha256")
        .agg(F.min_by("embedding", order).alias("cached"))
    )


def reuse_vectors(new_chunks: DataFrame, stored: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Fill vectors of new chunks from equal stored chunks; misses stay null."""
    cache = cached_vectors(stored, order)
    joined = new_chunks.drop("embedding").join(cache, "content_sha256", "left")
    return joined.withColumnRenamed("cached", "embedding")


def cache_summary(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count_if(F.col("embedding").isNotNull()).alias("chunks_reused"),
        F.count_if(F.col("embedding").isNull()).alias("chunks_to_embed"),
    )


def link_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Attach the symbol a chunk was cut from.

    The symbol that starts on the chunk's first line wins; later windows of a long
    symbol start elsewhere and take the first symbol of that name.
    """
    exact = (
        symbols.groupBy("content_id", F.col("name").alias("symbol_name"), "start_line")
        .agg(F.max_by("symbol_id", "ordinal").alias("_exact"))
    )
    named = (
        symbols.groupBy("content_id", F.col("name").alias("symbol_name"))
        .agg(F.min_by("symbol_id", "ordinal").alias("_named"))
    )
    return (
        chunks.join(exact, ["content_id", "symbol_name", "start_line"], "left")
        .join(named, ["content_id", "symbol_name"], "left")
        .withColumn("symbol_id", F.coalesce("_exact", "_named"))
        .drop("_exact", "_named")
    )


def last_write_per_path(files: DataFrame, order: str = "ordinal") -> DataFrame:
    """Within one batch the last row of a path wins."""
    others = [c for c in files.columns if c not in ("repo_ref_id", "path")]
    return (
        files.groupBy("repo_ref_id", "path")
        .agg(F.max_by(F.struct(*others), order).alias("_row"))
        .select("repo_ref_id", "path", "_row.*")
    )
