"""Streaming and provider queries, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import text as text_fn
from folioscope.operators import jobs
from folioscope.plans.indexing import IndexState
from folioscope.queries import catalogue, parsing
from folioscope.schemas import CHUNKS, FILE_CONTENTS, IMPORTS, REF_FILES, SYMBOLS
from folioscope.sources import embedding as providers
from folioscope.sources import files, tables
from folioscope.sources.work import work_folder
from folioscope.streaming import jobs as streams


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = tables.table(spark, folder, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(folder)


def job_queue(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "queue")
    events = stream_table(spark, folder, "events").where(F.col("event_type") != "signup")
    ends = F.col("event_type").isin("purchase", "error")
    rows = events.withColumn("kind", F.when(ends, "finish").otherwise("request"))
    queue = streams.JobQueue(place, ["user_id"], ["ts", "event_id"])
    queue.start(rows, f"{place}/checkpoint").start().awaitTermination()
    return queue.accepted(spark).select("user_id", "event_id")


def progress_counters(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "progress")
    events = catalogue.as_progress(stream_table(spark, folder, "events"))
    running = streams.progress_stream(events, ["job"])
    writer = streams.write_latest(running, f"{place}/out", f"{place}/checkpoint")
    writer.start().awaitTermination()
    return streams.read_latest(spark, f"{place}/out")


def latest_stage(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "stage")
    events = stream_table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    running = streams.stage_stream(events, ["user_id"], ["ts", "event_id"])
    writer = streams.write_latest(running, f"{place}/out", f"{place}/checkpoint")
    writer.start().awaitTermination()
    return streams.read_latest(spark, f"{place}/out").select("user_id", "event_id", "event_type")


def empty_state(spark: SparkSession) -> IndexState:
    def table(schema):
        return spark.createDataFrame([], schema)

    return IndexState(
        table(FILE_CONTENTS), table(REF_FILES), table(SYMBOLS), table(IMPORTS), table(CHUNKS)
    )


def incremental_index(spark: SparkSession, folder: str) -> DataFrame:
    """Programs rendered from the document stream, indexed as they arrive."""
    place = work_folder(spark, "index")
    programs = parsing.render_programs(stream_table(spark, folder, "documents"))
    arriving = programs.select(F.col("content_id").alias("path"), "language", "content")
    index = streams.IncrementalIndex(place, 1, empty_state(spark))
    index.start(arriving, f"{place}/checkpoint").start().awaitTermination()
    state = index.state(spark, index.last(spark))
    return state.ref_files.join(state.symbols, "content_id").select(
        "path", "name", "kind", "start_line", "end_line"
    )


def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    chunks = docs.select(
        "doc_id",
        F.col("text").alias("content"),
        text_fn.content_hash(F.col("text")).alias("content_sha256"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("string").alias("embedding_error"),
    )
    done = providers.embed_chunks(chunks, providers.HashingEmbedder(64))
    return done.select(
        "doc_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        "embedding_error",
    )


def binaryfile_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every table file, from its metadata alone."""
    found = files.binary_files(spark, folder, "*.parquet")
    return found.select(F.substring_index("path", "/", -1).alias("file"), "length")


def mirror_status(spark: SparkSession, folder: str) -> DataFrame:
    """Users as mirrors: clicks start a clone, purchases end it, errors fail it."""
    events = tables.table(spark, folder, "events").where(
        F.col("event_type").isin("click", "purchase", "error")
    )
    status = F.when(F.col("event_type") == "click", "cloning").when(
        F.col("event_type") == "purchase", "ready"
    ).otherwise("error")
    rows = events.select(
        F.col("user_id").alias("repo"), status.alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), "event_id")).alias("error"),
        F.col("ts").alias("at"),
    )
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return jobs.mirror_status(rows, now, 6 * 3600)


QUERIES = {
    "q_stream_job_queue": job_queue,
    "q_stream_progress_counters": progress_counters,
    "q_stream_latest_stage": latest_stage,
    "q_incremental_index": incremental_index,
    "q_embed_chunks": embed_chunks,
    "q_binaryfile_scan": binaryfile_scan,
    "q_mirror_status": mirror_status,
}

ORACLES = {
    "q_stream_job_queue": catalogue.ORACLES["q_job_dedup"],
    "q_stream_progress_counters": catalogue.ORACLES["q_stream_progress"],
    "q_stream_latest_stage": """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "q_incremental_index": parsing.ORACLES["q_parse_symbols"].replace(
        "id AS content_id, language,", "id AS path,"
    ),
    "q_embed_chunks": """WITH w AS (
SELECT doc_id, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) AS h FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents)),
s AS (SELECT doc_id, (h // 2) % 64 AS i, CAST(sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS v
      FROM w GROUP BY ALL),
m AS (SELECT doc_id, map(list(i), list(v)) AS m, sqrt(sum(v * v)) AS length FROM s GROUP BY doc_id)
SELECT doc_id, list_transform(range(64), lambda i: CAST(CAST(CASE WHEN length > 0
  THEN coalesce(m[i], 0.0) / length ELSE 0.0 END AS FLOAT) AS DOUBLE)) AS embedding,
  CAST(NULL AS VARCHAR) AS embedding_error FROM m""",
    "q_mirror_status": """WITH s AS (
SELECT user_id AS repo, ts, event_id, CASE event_type WHEN 'click' THEN 'cloning'
  WHEN 'purchase' THEN 'ready' ELSE 'error' END AS status FROM events
WHERE event_type IN ('click', 'purchase', 'error')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, status DESC) = 1),
f AS (SELECT *, status = 'cloning' OR
  floor(epoch(TIMESTAMP '2024-01-30 12:00:00')) - floor(epoch(ts)) < 21600 AS fresh FROM s)
SELECT repo, CASE WHEN fresh THEN status ELSE 'ready' END AS status,
  CASE WHEN fresh AND status = 'error' THEN concat('failed ', event_id) END AS error FROM f""",
}
