"""Streaming jobs: the deduplicated job queue, progress tables and file ingest.

State lives in versioned Parquet folders below the checkpoint, one version per
micro-batch. A batch that is replayed after a failure overwrites its own version,
so every effect happens once, and no executor holds state that could be lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscope.operators import jobs
from folioscope.plans.indexing import IndexState, index_ref


def _state_before(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """State of the batch before; only the first batch may start without one."""
    return spark.read.parquet(f"{folder}/state/batch={batch - 1}") if batch else None


class JobQueue:
    """At most one open job per key across micro-batches.

    ``rows`` carry the key, the order columns and ``kind`` (request or finish).
    """

    def __init__(
        self, folder: str, key: Sequence[str], order: Sequence[str],
        bucket: Callable[[], Column] = lambda: None,
    ):
        self.folder, self.key, self.order, self.bucket = folder, list(key), list(order), bucket

    def process(self, rows: DataFrame, batch: int) -> None:
        """Accept the requests of a batch, given the last row of every key before it."""
        columns = [*self.key, *self.order, "kind"]
        now = rows.select(*columns).withColumn("_now", F.lit(True))
        before = _state_before(rows.sparkSession, self.folder, batch)
        seen = now if before is None else now.unionByName(
            before.select(*columns).withColumn("_now", F.lit(False))
        )
        accepted = jobs.accepted_jobs(seen, self.key, self.order, self.bucket())
        accepted.where("_now").drop("_now", "kind").write.mode("overwrite").parquet(
            f"{self.folder}/accepted/batch={batch}"
        )
        jobs.latest_state(seen.drop("_now"), self.key, self.order).write.mode(
            "overwrite"
        ).parquet(f"{self.folder}/state/batch={batch}")

    def start(self, rows: DataFrame, checkpoint: str) -> DataStreamWriter:
        return rows.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/accepted").drop("batch")


def progress_stream(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Running counters of every job; emit in update or complete mode."""
    return jobs.progress_counters(events, key)


def stage_stream(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running latest stage of every job."""
    return jobs.latest_state(events, key, order)


def write_latest(df: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Write the complete running result of each batch as a new version."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return (
        df.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version; versions are folders, so finding it reads no data."""
    versions = spark.read.parquet(folder)
    newest = versions.agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/batch={newest}")


def with_retries(
    handler: Callable[[dict], None], job: dict, most: int = 3, wait: Callable[[int], None] | None = None
) -> str | None:
    """Run one job, again after a growing delay when it fails; the last error or None."""
    error = None
    for attempt in range(most + 1):
        try:
            handler(job)
            return None
        except Exception as failure:  # noqa: BLE001 - a job may fail in any way
            error = str(failure)
            if wait and attempt < most:
                wait(30 * 2**attempt)
    return error


def run_jobs(
    accepted: DataFrame,
    handler: Callable[[dict], None],
    cancelled: Callable[[dict], bool] = lambda job: False,
) -> Iterator[tuple[dict, str]]:
    """Hand accepted jobs to the handler one after another, skipping cancelled ones.

    A job is itself a Spark job, so the driver walks the queue row by row and never
    holds it whole.
    """
    for row in accepted.toLocalIterator():
        job = row.asDict()
        if cancelled(job):
            yield job, "cancelled"
            continue
        error = with_retries(handler, job)
        yield job, "error" if error else "completed"


class IncrementalIndex:
    """Index files as they arrive; contents seen before are not parsed again.

    A batch appends its own rows only: new contents with their children, and the paths
    it brought. A marker, written last, makes a batch visible; readers and the next batch
    stop with an error if one is missing. A replayed batch overwrites its own folders.
    """

    def __init__(self, folder: str, repo_ref_id: int, empty: IndexState):
        self.folder, self.repo_ref_id, self.empty = folder, repo_ref_id, empty
        self.names = ("file_contents", "ref_files", "symbols", "imports", "chunks")

    def last(self, spark: SparkSession) -> int:
        """The newest complete batch, or -1."""
        try:
            ready = spark.read.schema("batch int, done boolean").parquet(f"{self.folder}/ready")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1
        row = ready.agg(F.max("batch").alias("last"), F.countDistinct("batch").alias("all")).first()
        if row["all"] and row["all"] != row["last"] + 1:
            raise ValueError(f"batches are missing below {self.folder}")
        return -1 if row["last"] is None else row["last"]

    def state(self, spark: SparkSession, batch: int) -> IndexState:
        """Tables as of the end of a batch."""
        if batch < 0:
            return self.empty
        if self.last(spark) < batch:
            raise ValueError(f"batch {batch} is not complete below {self.folder}")
        read = {}
        for name in self.names:
            schema = getattr(self.empty, name).schema
            rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())]))
            read[name] = rows.parquet(f"{self.folder}/{name}").where(F.col("batch") <= batch)
        # Of a path the newest batch counts.
        newest = read["ref_files"].groupBy("repo_ref_id", "path").agg(
            F.max_by("content_id", "batch").alias("content_id")
        )
        return IndexState(**{n: df.drop("batch") for n, df in read.items()} | {"ref_files": newest})

    def process(self, files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        before = self.state(spark, batch - 1)
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        try:
            added = index_ref(files, self.repo_ref_id, before, hold=hold).added
            for name in self.names:
                getattr(added, name).write.mode("overwrite").parquet(
                    f"{self.folder}/{name}/batch={batch}"
                )
        finally:
            for df in held:
                df.unpersist()
        done = spark.range(1).select(F.lit(True).alias("done"))
        done.write.mode("overwrite").parquet(f"{self.folder}/ready/batch={batch}")

    def start(self, files: DataFrame, checkpoint: str) -> DataStreamWriter:
        return files.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True)
