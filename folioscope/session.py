"""Session settings used by the benchmark, the tests and the registered queries."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Runtime settings that hold at any size. Skewed join partitions are split by
# AQE even when that costs an extra shuffle, because one hash, source or user
# may own a third of all rows.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "folioscope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    text_partitions: int | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites of every column are costly to record for large expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if text_partitions:
        builder = builder.config("folioscope.texts.partitions", str(text_partitions))
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the shared folder the cluster names; the fallback is for tests only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(target)
    return target


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    Only stages that run Python need it: embedding and the git sources.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="run-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "folioscope"), "zip", os.path.dirname(package), "folioscope"
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
