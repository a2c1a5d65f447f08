"""Folders for data a job writes on its way."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint place the cluster names.

    On a local master without that setting, as in tests, a new local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"run-{name}-")
    stamp = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{shared.rstrip('/')}/{name}-{stamp}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write rows to a work folder and read them from there, so later steps do not make them again."""
    place = work_folder(frame.sparkSession, name)
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)
