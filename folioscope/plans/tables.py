"""Versioned Parquet tables: write a version, then announce it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def write_version(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Write all tables of a version; readers see it only once the marker exists."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    names = ",".join(sorted(tables))
    marker = spark.range(1).select(
        F.lit(version).cast("long").alias("version"), F.lit(names).alias("tables")
    )
    marker.write.mode("append").parquet(f"{folder}/_ready_versions")


def current_version(spark: SparkSession, folder: str, table: str) -> int | None:
    """Latest announced version of a table, or None before the first."""
    try:
        ready = spark.read.parquet(f"{folder}/_ready_versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    held = ready.where(F.array_contains(F.split("tables", ","), table))
    return held.agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    version = current_version(spark, folder, table)
    if version is None:
        return None
    return spark.read.parquet(f"{folder}/{table}/version={version}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
