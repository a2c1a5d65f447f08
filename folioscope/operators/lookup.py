"""Catalogue lookups: files, symbols, references and repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from folioscope.functions import labels, paths
from folioscope.operators.ranges import within


def file_tree(ref_files: DataFrame, repo_ref_id: int, prefix: str | None = None) -> DataFrame:
    return (
        ref_files.where((F.col("repo_ref_id") == repo_ref_id) & paths.has_prefix(F.col("path"), prefix))
        .select("path")
        .distinct()
        .orderBy("path")
    )


def find_files(
    ref_files: DataFrame,
    repo_ref_id: int,
    pattern: str,
    contents: DataFrame | None = None,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    hits = ref_files.where(
        (F.col("repo_ref_id") == repo_ref_id)
        & paths.contains_ignoring_case(F.col("path"), pattern)
    )
    if languages:
        wanted = contents.where(F.col("language").isin(list(languages)))
        hits = hits.join(wanted.select("content_id", "language"), "content_id")
    return hits


def symbols_in_ref(
    symbols: DataFrame,
    contents: DataFrame,
    ref_files: DataFrame,
    repo_ref_id: int,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Symbols of the files of one ref, once per path that has the content."""
    files = ref_files.where(F.col("repo_ref_id") == repo_ref_id).select("content_id", "path")
    kept = contents.select("content_id", "language")
    if languages:
        kept = kept.where(F.col("language").isin(list(languages)))
    return symbols.join(kept, "content_id").join(files, "content_id")


def find_symbols(
    symbols: DataFrame, contents: DataFrame, ref_files: DataFrame, repo_ref_id: int, pattern: str
) -> DataFrame:
    named = symbols.where(paths.contains_ignoring_case(F.col("name"), pattern))
    return symbols_in_ref(named, contents, ref_files, repo_ref_id)


def symbol_source(symbols: DataFrame, chunks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Text of each symbol: the chunks inside its line range, in line order.

    Chunks are joined on the content and filtered by range in the join itself. A
    symbol without contained chunks has an empty source.
    """
    parts = chunks.select(
        "content_id",
        F.col("start_line").alias("_start"),
        F.col("end_line").alias("_end"),
        F.col("content").alias("_text"),
    )
    inside = (
        (symbols["content_id"] == parts["content_id"])
        & (parts["_start"] >= symbols["start_line"])
        & (parts["_end"] <= symbols["end_line"])
    )
    joined = symbols.join(parts, inside, "left").drop(parts["content_id"])
    ordered = F.array_sort(
        F.collect_list(
            F.when(F.col("_start").isNotNull(), F.struct("_start", "_end", "_text"))
        )
    )
    return joined.groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda x: x["_text"]), "\n").alias("source")
    )


def symbol_source_by_cells(symbols: DataFrame, chunks: DataFrame, key: Sequence[str]) -> DataFrame:
    """`symbol_source` for tables in which one file may hold very many chunks and symbols.

    Ranges meet in cells of lines (`ranges.within`), texts join the pairs that are left. A
    symbol without contained chunks has an empty source.
    """
    wanted = symbols.select(*dict.fromkeys([*key, "content_id", "start_line", "end_line"])).distinct()
    pairs = within(wanted, chunks, ["content_id"])
    parts = chunks.select(
        "content_id",
        F.col("start_line").alias("inner_start"),
        F.col("end_line").alias("inner_end"),
        F.col("content").alias("_text"),
    )
    joined = pairs.join(parts, ["content_id", "inner_start", "inner_end"], "left")
    ordered = F.array_sort(
        F.collect_list(
            F.when(F.col("inner_start").isNotNull(), F.struct("inner_start", "inner_end", "_text"))
        )
    )
    return joined.groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda x: x["_text"]), "\n").alias("source")
    )


def get_symbol(
    symbols: DataFrame,
    contents: DataFrame,
    ref_files: DataFrame,
    chunks: DataFrame,
    repo_ref_id: int,
    name: str,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Symbols of one exact name in a ref, with path and source text."""
    named = symbols.where(F.col("name") == name)
    key = ["content_id", "name", "kind", "start_line", "end_line", "signature", "documentation"]
    sources = symbol_source(named.select(*key).distinct(), chunks, key)
    return symbols_in_ref(sources, contents, ref_files, repo_ref_id, languages).withColumnRenamed(
        "path", "file_path"
    )


def find_references(
    imports: DataFrame, contents: DataFrame, ref_files: DataFrame, repo_ref_id: int, name: str
) -> DataFrame:
    """Files of a ref that import a name, as a named or as the default import."""
    by_default = F.coalesce(F.col("default_name") == name, F.lit(False))
    hits = imports.where(F.array_contains(F.col("names"), name) | by_default)
    files = ref_files.where(F.col("repo_ref_id") == repo_ref_id).select("content_id", "path")
    return (
        hits.join(contents.select("content_id"), "content_id")
        .join(files, "content_id")
        .select(
            F.col("path").alias("file_path"),
            "source",
            F.lit(name).alias("imported_name"),
            by_default.alias("is_default"),
        )
    )


def file_text(chunks: DataFrame) -> DataFrame:
    """Text of every content rebuilt from its chunks in line order.

    Prefixes and overlaps of the chunks stay in, as the index stores them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "content")))
    return chunks.groupBy("content_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content")
    )


def get_file(ref_files: DataFrame, chunks: DataFrame, repo_ref_id: int, path: str) -> DataFrame:
    wanted = ref_files.where((F.col("repo_ref_id") == repo_ref_id) & (F.col("path") == path))
    return wanted.join(file_text(chunks.join(wanted, "content_id", "left_semi")), "content_id")


def list_repos(
    repos: DataFrame,
    refs: DataFrame,
    languages: Sequence[str] | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """Repositories with their refs, one row per ref; repositories without refs stay.

    With languages, a repository qualifies when any of its refs reaches the
    threshold (10 by default, 0 switches the filter off) and keeps all its refs.
    Rows stay flat because one repository may own most refs.
    """
    percent = 10.0 if threshold is None else float(threshold)
    kept = repos
    if languages and percent != 0:
        fits = labels.language_reaches(F.col("language_stats"), languages, percent)
        qualified = refs.where(fits).select(F.col("repo_id").alias("id")).distinct()
        kept = repos.join(qualified, "id", "left_semi")
    named = kept.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    return named.join(refs.withColumnRenamed("id", "repo_ref_id"), "repo_id", "left")


def ready_refs(repos: DataFrame, refs: DataFrame, scheme: str = "folio") -> DataFrame:
    """One resource per repository and ready ref, with its address."""
    named = repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
    address = F.concat(
        F.lit(f"{scheme}://"), F.col("repo"), F.lit("/"), F.col("ref"), F.lit("/tree")
    )
    return (
        refs.where(F.col("stage") == "ready")
        .join(named, "repo_id")
        .select("repo", "ref", address.alias("uri"))
    )


def active_progress(repos: DataFrame, refs: DataFrame) -> DataFrame:
    """Refs still being indexed; a repository that is gone shows as ``unknown``."""
    named = repos.select(F.col("id").alias("repo_id"), F.col("name").alias("_repo"))
    return (
        refs.where(~F.col("stage").isin("ready", "error"))
        .join(named, "repo_id", "left")
        .withColumn("repo", F.coalesce("_repo", F.lit("unknown")))
        .drop("_repo")
    )


def manifest_languages(ref_files: DataFrame) -> DataFrame:
    """Sorted languages each ref implies by the manifests at its root."""
    found = ref_files.select(
        "repo_ref_id", F.explode(paths.manifest_languages(F.col("path"))).alias("language")
    )
    return found.distinct().orderBy("repo_ref_id", "language")
