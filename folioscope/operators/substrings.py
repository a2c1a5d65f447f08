"""A persisted index of short texts (paths, names) for patterns that may match anywhere.

Every text is stored once with the runs of three characters it holds, in lower case. A pattern's own
runs are looked up rarest first: texts that hold all of the chosen ones are candidates, and only those
are compared with the pattern. Postings lie in partitions by run and are sorted by it, so others are
not read. A pattern without three characters in a row is compared with all texts.

Batches are appended with numbers of their own, and a repeated one overwrites itself. Defined results:
patterns are as in ILIKE, ``%`` and ``_`` are wildcards and a backslash takes the next character as it
is; null texts match nothing; a text comes back once, however often it was added.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64
WIDTH = 3
#: Runs of a pattern that are looked up, rarest first; the comparison sees to the rest.
LOOKED_UP = 4


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards of a pattern."""
    parts, part, escaped = [], "", False
    for letter in pattern:
        if escaped or letter not in "\\%_":
            part, escaped = part + letter, False
        elif letter == "\\":
            escaped = True
        else:
            parts.append(part)
            part = ""
    return [p for p in [*parts, part] if p]


def _runs(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    lower = F.lower(text)
    starts = F.when(F.length(lower) >= WIDTH, F.sequence(F.lit(1), F.length(lower) - (WIDTH - 1)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(lower, at, F.lit(WIDTH))))


def _bucket(run: Column) -> Column:
    return F.pmod(F.crc32(F.encode(run, "UTF-8")), F.lit(BUCKETS)).cast("int")


class SubstringIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        return self._table("texts", "id long, text string, batch int")

    def add(self, texts: DataFrame, batch: int) -> None:
        """Index the texts (column text) that no other batch holds."""
        known = self.texts().where(F.col("batch") != batch).select("text")
        new = texts.select("text").where("text is not null").distinct().join(known, "text", "left_anti")
        place = f"{self.folder}/texts/batch={batch}"
        new.select(F.monotonically_increasing_id().alias("id"), "text").write.mode("overwrite").parquet(place)
        stored = self.spark.read.schema("id long, text string").parquet(place)
        posts = stored.select("id", F.explode(_runs(F.col("text"))).alias("run"))
        posts = posts.withColumn("bucket", _bucket(F.col("run"))).hint("rebalance", "bucket")
        posts.sortWithinPartitions("bucket", "run", "id").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.folder}/posts/batch={batch}"
        )
        written = self.spark.read.schema("run string").parquet(f"{self.folder}/posts/batch={batch}")
        written.groupBy("run").count().sort("run").write.mode("overwrite").parquet(f"{self.folder}/runs/batch={batch}")

    def rarest(self, pattern: str) -> list[str] | None:
        """The pattern's runs to look up; none at all if it has none, None if a run is in no text."""
        parts = literal_parts(pattern)
        row = self.spark.range(1).select(
            F.array_distinct(F.flatten(F.array(*[_runs(F.lit(p)) for p in parts]))).alias("runs")
        ).first() if parts else None
        runs = list(row.runs) if row else []
        counted = self._table("runs", "run string, count long").where(F.col("run").isin(runs))
        found = {r.run: r.n for r in counted.groupBy("run").agg(F.sum("count").alias("n")).collect()}
        if len(found) < len(runs):
            return None
        return sorted(runs, key=lambda run: (found[run], run))[:LOOKED_UP]

    def candidates(self, pattern: str) -> DataFrame:
        """Texts that hold the runs looked up."""
        runs = self.rarest(pattern)
        texts = self.texts()
        if runs is None:
            return texts.where("false")
        if not runs:
            return texts
        row = self.spark.range(1).select(F.array(*[_bucket(F.lit(r)) for r in runs]).alias("b")).first()
        posts = self._table("posts", "id long, run string, batch int, bucket int")
        posts = posts.where(F.col("bucket").isin(sorted(set(row.b))) & F.col("run").isin(runs))
        held = posts.groupBy("batch", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(runs))
        return texts.join(held, ["batch", "id"], "left_semi")

    def matching(self, pattern: str) -> DataFrame:
        """The texts that match ILIKE ``%pattern%``."""
        return self.candidates(pattern).where(F.col("text").ilike(f"%{pattern}%")).select("text").distinct()
