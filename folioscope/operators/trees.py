"""Digests of folders, and diffs between refs that descend into changed folders only.

A folder's digest is a sum over all files below it of a hash of path and content, so it is the same
whatever the order, and an empty difference means an equal digest. Sums add up on the way to the
shuffle: a folder with most files of a ref is no heavy group. Digests are stored by depth, sorted by
ref and folder; a diff compares the entries of two refs one depth at a time, and goes on with those
of unequal folders. What it reads grows with the changed folders and their entries, not with the ref.

Two sums of 64-bit hashes make a digest; different folders share one with a chance of about 2**-128.

Defined results: a path's folders are its parts before a `/`; a null path is left out; a null
content counts as one of its own; of several rows of a ref and path the smallest content counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.sources.work import stored

#: Folders that a diff names to the scan; more meet it in a join.
NAMED_FOLDERS = 1000

SCHEMA = (
    "repo_ref_id long, parent string, name string, content_id string, is_file boolean, "
    "files long, one decimal(38,0), two decimal(38,0), batch int, depth int"
)


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "path", "content_id").cast("decimal(20,0)")


def entries(ref_files: DataFrame) -> DataFrame:
    """Every file and every folder of the refs as an entry of its parent: name, digest, files."""
    files = ref_files.where("path is not null").groupBy("repo_ref_id", "path").agg(F.min("content_id").alias("content_id"))
    parts = F.split("path", "/", -1)
    hashed = files.select(
        "repo_ref_id", "content_id", parts.alias("parts"), _hash(1).alias("one"), _hash(2).alias("two")
    )
    # One row for the file itself and one for each folder above it.
    depth = F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")
    each = hashed.select("*", depth).select(
        "repo_ref_id", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/").alias("parent"),
        F.element_at("parts", F.col("depth")).alias("name"), (F.col("depth") == F.size("parts")).alias("is_file"),
        "content_id", "one", "two",
    )
    key = ["repo_ref_id", "depth", "parent", "name", "is_file"]
    return each.groupBy(*key).agg(
        F.min(F.when(F.col("is_file"), F.col("content_id"))).alias("content_id"),
        F.count(F.lit(1)).alias("files"),
        F.sum("one").cast("decimal(38,0)").alias("one"), F.sum("two").cast("decimal(38,0)").alias("two"),
    )


def write_tree(ref_files: DataFrame, folder: str, batch: int) -> None:
    """Store the entries of some refs; a repeated batch overwrites itself."""
    order = ["depth", "repo_ref_id", "parent", "name"]
    rows = entries(ref_files).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").partitionBy("depth").parquet(f"{folder}/batch={batch}")


def _level(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder).where(F.col("depth") == depth)


def _deepest(spark: SparkSession, folder: str) -> int:
    """The number of levels: from the names of the partitions, no row is read."""
    try:
        row = spark.read.schema(SCHEMA).parquet(folder).agg(F.max("depth")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return row[0] or 0


def _path(depth: int) -> Column:
    return F.col("name") if depth == 1 else F.concat_ws("/", "parent", "name")


def _side(level: DataFrame, ref: int, parents: DataFrame | None) -> DataFrame:
    rows = level.where(F.col("repo_ref_id") == ref)
    if parents is not None:
        listed = [row.parent for row in parents.limit(NAMED_FOLDERS + 1).collect()]
        if len(listed) <= NAMED_FOLDERS:
            rows = rows.where(F.col("parent").isin(listed))
        else:
            rows = rows.join(parents, "parent", "left_semi")
    return rows.select("parent", "name", "is_file", "content_id", "one", "two")


def changed_entries(spark: SparkSession, folder: str, from_id: int, to_id: int) -> list[DataFrame]:
    """For each depth the entries that differ between two refs: path, digests and contents."""
    levels: list[DataFrame] = []
    parents: DataFrame | None = None
    for depth in range(1, _deepest(spark, folder) + 1):
        level = _level(spark, folder, depth)
        key = ["parent", "name", "is_file"]
        old, new = (
            _side(level, ref, parents).select(
                *key, F.col("content_id").alias(f"_{side}"), F.struct("one", "two").alias(f"_{side}_digest")
            )
            for ref, side in ((from_id, "old"), (to_id, "new"))
        )
        unequal = old.join(new, key, "full_outer").where(~F.col("_old_digest").eqNullSafe(F.col("_new_digest")))
        held = stored(unequal.withColumn("path", _path(depth)), "tree-diff")
        levels.append(held)
        parents = held.where("not is_file").select(F.col("path").alias("parent")).distinct()
        if parents.isEmpty():
            break
    return levels


def ref_diff(spark: SparkSession, folder: str, from_id: int, to_id: int) -> DataFrame:
    """Added, modified and deleted paths between two refs, as of `context.ref_diff`."""
    result = None
    for rows in changed_entries(spark, folder, from_id, to_id):
        files = rows.where("is_file")
        change = (
            F.when(F.col("_old_digest").isNull(), F.lit("added"))
            .when(F.col("_new_digest").isNull(), F.lit("deleted"))
            .otherwise(F.lit("modified"))
        )
        found = files.select("path", change.alias("change_type"), F.col("_new").alias("content_id"))
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "path string, change_type string, content_id string")
    return result
