import random

import pytest

from pyspark.sql import functions as F

from folioscope.queries.streams import empty_state
from folioscope.streaming import jobs


def test_queue_across_batches(spark, tmp_path):
    """Five micro-batches accept exactly what one pass over all rows accepts."""
    rng = random.Random(4)
    rows = [
        (i, rng.choice(["r1", "r1", "r2", "r3"]), "finish" if rng.random() < 0.3 else "request")
        for i in range(200)
    ]
    source = tmp_path / "in"
    for part in range(5):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "at long, job string, kind string").coalesce(
            1
        ).write.mode("append").parquet(str(source))
    schema = "at long, job string, kind string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    queue = jobs.JobQueue(
        str(tmp_path / "out"), ["job"], ["at"], lambda: (F.col("at") / 50).cast("int")
    )
    queue.start(stream, str(tmp_path / "check")).start().awaitTermination()
    open_jobs, expected = set(), set()
    for at, job, kind in rows:
        if kind == "finish":
            open_jobs.discard(job)
        elif job not in open_jobs:
            open_jobs.add(job)
            expected.add(at)
    assert {r.at for r in queue.accepted(spark).collect()} == expected
    # A replayed batch overwrites its own version.
    last = spark.createDataFrame(rows[160:], schema)
    queue.process(last, 4)
    assert {r.at for r in queue.accepted(spark).collect()} == expected


def test_running_counters(spark, tmp_path):
    rows = [("j", "file-done", 1)] * 3 + [("j", "embedding-start", 9), ("k", "file-error", 1)]
    schema = "job string, type string, amount long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.write_latest(jobs.progress_stream(stream, ["job"]), out, check).start().awaitTermination()
    got = {r.job: r for r in jobs.read_latest(spark, out).collect()}
    assert got["j"].files_processed == 3 and got["j"].chunks_total == 9
    assert got["k"].file_errors == 1 and got["k"].chunks_embedded == 0


def test_incremental_index(spark, tmp_path):
    """A second batch replaces one file, adds a copy and keeps the rest."""
    index = jobs.IncrementalIndex(str(tmp_path / "index"), 7, empty_state(spark))
    schema = "path string, language string, content string"
    first = [("a.py", "python", "def one():\n    pass\n"), ("b.py", "python", "def two():\n    pass\n")]
    second = [("a.py", "python", "def three():\n    pass\n"), ("c.py", "python", first[1][2])]
    index.process(spark.createDataFrame(first, schema), 0)
    index.process(spark.createDataFrame(second, schema), 1)
    state = index.state(spark, 1)
    names = state.ref_files.join(state.symbols, "content_id").select("path", "name").collect()
    assert {(r.path, r.name) for r in names} == {("a.py", "three"), ("b.py", "two"), ("c.py", "two")}
    assert state.file_contents.count() == 3


def test_retries_and_cancelling(spark):
    calls, waits = [], []

    def handler(job):
        calls.append(job["id"])
        if job["id"] == 1 or (job["id"] == 2 and calls.count(2) < 3):
            raise RuntimeError("down")

    assert jobs.with_retries(handler, {"id": 1}, wait=waits.append) == "down"
    assert waits == [30, 60, 120] and calls.count(1) == 4
    queue = spark.createDataFrame([(2,), (3,), (4,)], "id long").coalesce(1)
    done = list(jobs.run_jobs(queue, handler, cancelled=lambda job: job["id"] == 3))
    assert [(j["id"], s) for j, s in done] == [(2, "completed"), (3, "cancelled"), (4, "completed")]


def test_batches_write_their_own_rows_only(spark, tmp_path):
    """Many batches: bytes follow the batch, a repeated path and a lost batch are noticed."""
    index = jobs.IncrementalIndex(str(tmp_path / "index"), 7, empty_state(spark))
    schema = "path string, language string, content string"
    for batch in range(4):
        rows = [(f"f{batch}_{i}.py", "python", f"def f{batch}_{i}():\n    pass\n") for i in range(5)]
        rows += [("same.py", "python", f"def s{batch}():\n    pass\n")] * 2
        index.process(spark.createDataFrame(rows, schema), batch)
        written = spark.read.parquet(f"{tmp_path}/index/symbols/batch={batch}")
        assert written.count() == 6
    state = index.state(spark, 3)
    assert state.symbols.count() == 24 and state.ref_files.count() == 21
    same = state.ref_files.where("path = 'same.py'").join(state.symbols, "content_id")
    assert [r.name for r in same.collect()] == ["s3"]
    index.process(spark.createDataFrame(rows, schema), 3)  # a replay
    assert index.state(spark, 3).symbols.count() == 24
    with pytest.raises(ValueError):
        index.process(spark.createDataFrame(rows, schema), 6)
