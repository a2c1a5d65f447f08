"""Table upkeep: upserts, deletes, updates, cascades and uniqueness checks.

Each operator returns the next version of a table as a DataFrame; the sink decides
where that version is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def upsert(
    current: DataFrame, changes: DataFrame, key: Sequence[str], order: str | None = None
) -> DataFrame:
    """Rows of both sides with the change winning; among changes the latest wins.

    A struct maximum per key replaces the usual ranked window, so equal keys fold
    on the map side however many changes one key receives.
    """
    columns = current.columns
    values = [c for c in columns if c not in key]
    version = F.col(order) if order else F.lit(0)
    old = current.select(*columns, F.struct(F.lit(0).alias("side"), F.lit(None).cast(
        changes.schema[order].dataType if order else "int").alias("at")).alias("_v"))
    new = changes.select(*columns, F.struct(F.lit(1).alias("side"), version.alias("at")).alias("_v"))
    return (
        old.unionByName(new)
        .groupBy(*key)
        .agg(F.max_by(F.struct(*values), "_v").alias("_row"))
        .select(*key, "_row.*")
        .select(*columns)
    )


def queue_refs(current: DataFrame, requested: DataFrame) -> DataFrame:
    """Put requested refs into the queue: insert them or reset their progress."""
    key = ["repo_id", "ref"]
    asked = requested.select(*key, F.lit(True).alias("_asked")).distinct()
    reset = {  # fixed values of a queued ref
        "stage": F.lit("queued"),
        "commit_sha": F.lit("pending"),
        "stage_message": F.lit("Waiting for worker…"),
        "indexing_started_at": F.lit(None).cast("timestamp_ntz"),
        "indexing_error": F.lit(None).cast("string"),
        "files_total": F.lit(0),
        "files_processed": F.lit(0),
        "chunks_total": F.lit(0),
        "chunks_embedded": F.lit(0),
    }
    joined = current.join(asked, key, "full_outer")
    touched = F.col("_asked").isNotNull()
    for name, value in reset.items():
        if name in current.columns:
            joined = joined.withColumn(name, F.when(touched, value).otherwise(F.col(name)))
    return joined.select(*current.columns)


def update_from(
    table: DataFrame, updates: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """UPDATE ... FROM: listed columns take the update's values, nulls included."""
    marked = updates.select(
        *key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit")
    )
    joined = table.join(marked, list(key), "left")
    picked = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns
        else F.col(c)
        for c in table.columns
    ]
    return joined.select(*picked)


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    picked = [
        F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in table.columns
    ]
    return table.select(*picked)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown keeps the row, as in SQL."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def orphans(contents: DataFrame, ref_files: DataFrame) -> DataFrame:
    """Contents no file points to any more.

    The referencing side is made distinct first: that folds hot contents before the
    shuffle and leaves unique keys on both sides of the join.
    """
    return contents.join(ref_files.select("content_id").distinct(), "content_id", "left_anti")


def sweep_orphans(
    contents: DataFrame, ref_files: DataFrame, children: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """All tables without orphaned contents and without the rows hanging on them."""
    gone = orphans(contents, ref_files).select("content_id")
    result = {"file_contents": delete_keys(contents, gone, ["content_id"])}
    for name, table in children.items():
        result[name] = delete_keys(table, gone, ["content_id"])
    return result


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths a ref still lists although the new commit no longer has them."""
    return stored.join(current.select("path").distinct(), "path", "left_anti")


def cascade_delete_repo(
    repo_id: int, repos: DataFrame, refs: DataFrame, ref_files: DataFrame
) -> dict[str, DataFrame]:
    """Delete a repository with its refs and their file rows."""
    doomed = refs.where(F.col("repo_id") == repo_id).select(F.col("id").alias("repo_ref_id"))
    return {
        "repos": delete_where(repos, F.col("id") == repo_id),
        "repo_refs": delete_where(refs, F.col("repo_id") == repo_id),
        "ref_files": delete_keys(ref_files, doomed, ["repo_ref_id"]),
    }


def duplicate_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when the uniqueness rule holds."""
    return (
        table.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    )


def missing_parents(child: DataFrame, parent: DataFrame, key: Sequence[str]) -> DataFrame:
    """Child rows whose parent is gone; empty when the reference rule holds."""
    return child.join(parent.select(*key).distinct(), list(key), "left_anti")
