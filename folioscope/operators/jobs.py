"""Batch twins of the job queue and of progress tracking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.schemas import TERMINAL_STAGES


#: Places in the sample for each range of rows.
SAMPLE = 50


def range_number(rows: DataFrame, columns: Sequence[str]) -> Column:
    """Which of about as many even ranges as there are shuffle partitions a row lies in.

    Borders come from a bounded sample, chosen by a hash of the place; they move work
    between tasks, never results.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*columns)
    wanted = ranges * SAMPLE
    # About twice as many rows by a hash first, so that not every task sends that many.
    share = int(min(1.0, 2 * wanted / max(rows.count(), 1)) * (1 << 30))
    some = rows.select(place.alias("p")).where(F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < share)
    some = some.orderBy(F.xxhash64("p")).limit(wanted)
    places = [r.p for r in some.orderBy("p").collect()]
    cuts = [places[len(places) * i // ranges] for i in range(1, ranges)] if places else []
    kind = rows.select(place.alias("p")).schema["p"].dataType
    literals = [F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, cut))).cast(kind) for cut in cuts]
    if not literals:
        return F.lit(0)
    return F.size(F.filter(F.array(*literals), lambda cut: cut <= place))


def previous_value(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str,
    bucket: Column | None = None,
    out: str = "previous",
) -> DataFrame:
    """The value of the row before, per key, without one task holding a whole key.

    Rows are ranked within a key and bucket, where the bucket grows with the order; by
    default it is the row's range in the order of keys and places, so a key that owns a
    third of all rows spreads over a third of the ranges. Only the last value of each
    bucket crosses to the next one.
    """
    if bucket is None:
        bucket = range_number(rows, [*key, *order])
    held = rows.withColumn("_bucket", bucket)
    group = [*key, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    ends = held.groupBy(*group).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    carried = ends.select(
        *group, F.lag("_last").over(Window.partitionBy(*key).orderBy("_bucket")).alias("_carried")
    )
    return (
        held.withColumn("_inside", F.lag(boxed).over(inside))
        .join(carried, group)
        .withColumn(out, F.coalesce("_inside", "_carried")["v"])
        .drop("_bucket", "_inside", "_carried")
    )


def accepted_jobs(
    requests: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Requests that enter the queue: at most one unfinished job per key.

    ``kind`` is ``request`` or ``finish``. A request is taken when the row before it,
    among requests and finishes of its key, finished a job or does not exist: after a
    request, taken or refused, a job is always open.
    """
    with_previous = previous_value(requests, key, order, "kind", bucket)
    opened = F.coalesce(F.col("previous") == "request", F.lit(False))
    return with_previous.where((F.col("kind") == "request") & ~opened).drop("previous")


def latest_state(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of every key as a mergeable maximum, whatever the share of one key."""
    others = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
        .select(*key, "_row.*")
    )


def progress_per_repo(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One entry per repository: the last unfinished one, else the first."""
    others = F.struct(*[c for c in rows.columns if c != key])
    place = F.struct(*order)
    waiting = F.col("stage") != "ready"
    return (
        rows.groupBy(key)
        .agg(
            F.coalesce(
                F.max_by(F.when(waiting, others), F.when(waiting, place)), F.min_by(others, place)
            ).alias("_row")
        )
        .select(key, "_row.*")
    )


def just_finished(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Rows where a key moves from an unfinished stage to a final one."""
    done = list(TERMINAL_STAGES)
    moved = previous_value(rows, key, order, "stage", bucket)
    return moved.where(F.col("stage").isin(done) & ~F.col("previous").isin(done))


def progress_counters(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counters of every job from its progress events."""

    def kind(name: str) -> Column:
        return F.col("type") == name

    return events.groupBy(*key).agg(
        F.count_if(kind("file-done")).alias("files_processed"),
        F.count_if(kind("file-skipped")).alias("files_skipped"),
        F.count_if(kind("file-error")).alias("file_errors"),
        F.max(F.when(kind("embedding-start"), F.col("amount"))).alias("chunks_total"),
        F.coalesce(F.sum(F.when(kind("embedding-batch-done"), F.col("amount"))), F.lit(0)).alias(
            "chunks_embedded"
        ),
    )


def retry_delays(attempts: Column, first: int = 30, most: int = 3) -> Column:
    """Seconds before the next try, doubling each time; null when tries are used up."""
    return F.when(attempts < most, (F.lit(first) * F.pow(F.lit(2), attempts)).cast("long"))


def cancelled(jobs: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Queue without the unfinished jobs of the given keys."""
    marked = keys.select(*key, F.lit(True).alias("_hit")).distinct()
    open_job = ~F.col("state").isin("completed", "cancelled", "failed")
    return (
        jobs.join(marked, list(key), "left")
        .where(~(F.coalesce(F.col("_hit"), F.lit(False)) & open_job))
        .drop("_hit")
    )


def mirror_status(events: DataFrame, now: Column, kept_seconds: int = 60) -> DataFrame:
    """Status of every mirror: a final status fades to ``ready`` after its time.

    ``events`` has repo, status (cloning, ready or error), error and at.
    """
    last = latest_state(events, ["repo"], ["at", "status"])
    fresh = (F.col("status") == "cloning") | (
        F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp")) < kept_seconds
    )
    return last.select(
        "repo",
        F.when(fresh, F.col("status")).otherwise("ready").alias("status"),
        F.when(fresh, F.col("error")).alias("error"),
    )
