"""File trees on storage Spark can read: listing, text and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import paths
from folioscope.functions import text as text_fn


def binary_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Path, size and bytes of every file below a folder; unread columns cost nothing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root)


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(path, rf"^[a-z0-9+]*:?/*(?:[^/]+/)?\Q{base}\E/", "")


def text_files(files: DataFrame, root: str) -> DataFrame:
    """Files as path and UTF-8 text without NUL characters; bad bytes are replaced."""
    text = text_fn.strip_nul(F.col("content").cast("string"))
    return files.select(
        _relative(F.col("path"), root).alias("path"), F.make_valid_utf8(text).alias("content")
    )


def source_files(
    files: DataFrame,
    globs: list[str] | None = None,
    rules: list[paths.IgnoreRule] | None = None,
) -> DataFrame:
    """Keep files the globs admit, no rule ignores and whose language is known."""
    path = F.col("path")
    kept = files.where(paths.matches_globs(path, globs or []))
    kept = kept.where(~paths.is_ignored(path, rules if rules is not None else paths.ignore_rules()))
    return kept.withColumn("language", paths.classify_language(path)).where(
        F.col("language").isNotNull()
    )
