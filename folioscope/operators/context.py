"""Diffs between refs and token-budgeted context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import text as text_fn

DEFAULT_BUDGET = 8192
SEARCH_LIMIT = 30
# The shortest header, ``\n---  L1-1 ---\n`` of an empty path, has 15 characters: five tokens.
LEAST_ROW_COST = 5


def ref_diff(ref_files: DataFrame, from_id: int, to_id: int) -> DataFrame:
    """Added, modified and deleted paths between two refs; deleted rows have no content."""
    old = ref_files.where(F.col("repo_ref_id") == from_id).select(
        "path", F.col("content_id").alias("_old")
    )
    new = ref_files.where(F.col("repo_ref_id") == to_id).select(
        "path", F.col("content_id").alias("_new")
    )
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("deleted"))
        .otherwise(F.lit("modified"))
    )
    return (
        old.join(new, "path", "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select("path", change.alias("change_type"), F.col("_new").alias("content_id"))
    )


def recent_changes(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of added and modified files, and one marker row per deleted file."""
    texts = chunks.select("content_id", "start_line", "end_line", "content")
    present = changes.where(F.col("content_id").isNotNull()).join(texts, "content_id")
    kept = present.select(
        F.col("path").alias("file_path"), "start_line", "end_line", "content",
        F.col("change_type").alias("annotation"),
    )
    gone = changes.where(F.col("change_type") == "deleted").select(
        F.col("path").alias("file_path"),
        F.lit(0).alias("start_line"),
        F.lit(0).alias("end_line"),
        F.lit("(file deleted)").alias("content"),
        F.lit("deleted").alias("annotation"),
    )
    return kept.unionByName(gone)


def header(path: Column, start: Column, end: Column) -> Column:
    return F.concat(
        F.lit("\n--- "), F.coalesce(path, F.lit("")), F.lit(" L"), start.cast("string"), F.lit("-"), end.cast("string"),
        F.lit(" ---\n"),
    )


def row_cost(path: str = "file_path") -> Column:
    top = header(F.col(path), F.col("start_line"), F.col("end_line"))
    return text_fn.token_estimate(top) + F.coalesce(
        text_fn.token_estimate(F.col("content")), F.lit(0)
    )


def trim_to_budget(
    rows: DataFrame, budget: int = DEFAULT_BUDGET, collation: str | None = None
) -> DataFrame:
    """Rows in path and line order up to the first that would exceed the budget.

    Every row costs at least its header, so no more than ``budget / 5`` rows can fit:
    taking one row more than that first is exact, and the running sum, which needs
    one ordered task, only ever sees that many rows.
    """
    place = F.col("file_path").collate(collation) if collation else F.col("file_path")
    ties = [c for c in ("end_line", "annotation", "content") if c in rows.columns]
    order = [place, F.col("start_line"), *[F.col(c) for c in ties]]
    first = rows.orderBy(*order).limit(budget // LEAST_ROW_COST + 1)
    seen = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    costed = first.withColumn("cost", row_cost())
    return (
        costed.withColumn("used", F.sum("cost").over(seen))
        .withColumn("position", F.row_number().over(Window.orderBy(*order)))
        .where(F.col("used") <= budget)
    )


def pack_summary(pack: DataFrame) -> DataFrame:
    """Chunk count and token total of a pack; headers do not count."""
    return pack.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.sum(text_fn.token_estimate(F.col("content"))), F.lit(0))
        .cast("long")
        .alias("total_tokens"),
    )


def pack_lines(pack: DataFrame) -> DataFrame:
    """Each row of a trimmed pack as text: the path shows where it changes."""
    previous = F.lag("file_path").over(Window.orderBy("position"))
    span = F.concat(
        F.lit("L"), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit(" ---"),
    )
    full = F.concat(F.lit("\n--- "), F.col("file_path"), F.lit(" "), span)
    short = F.concat(F.lit("\n--- "), span)
    top = F.when(F.col("_previous").eqNullSafe(F.col("file_path")), short).otherwise(full)
    note = F.lit(None).cast("string")
    if "annotation" in pack.columns:
        note = F.when(
            F.coalesce(F.col("annotation"), F.lit("")) != "",
            F.concat(F.lit("["), F.col("annotation"), F.lit("]")),
        )
    return pack.withColumn("_previous", previous).select(
        "position", F.concat_ws("\n", top, note, F.col("content")).alias("line")
    )


def format_pack(pack: DataFrame) -> DataFrame:
    """The whole pack as one trimmed text; its size is bounded by the budget."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    joined = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return pack_lines(pack).agg(
        F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text")
    )
