"""Token counts kept by signed deltas.

Totals by source, language and tokenizer version are sums, so a batch of changes only adds its
own sums: plus one for an inserted document, minus one for a deleted one, both for a revised
one. A batch is written to a folder of its own and counts from the moment its name is recorded;
recording a name twice changes nothing, so a batch can be replayed after any failure. A reader
sees only the attempts that were recorded.

Documents are counted with column expressions and summed before the shuffle, which moves a row
per task and group at most, however large one source is.

Defined results: null and empty texts count no tokens but one document; null sources and
languages are groups of their own; repeated rows count as often as they occur; an empty batch
is recorded and adds nothing; groups whose documents and tokens are all gone stay with zeros.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string, attempt string"

#: Words between white space, and runs of letters, digits and non-ASCII characters.
COUNTERS = {
    "space-1": r"[^\x20\x09-\x0D]+",
    "plain-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
}


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text for one of the built-in tokenizer versions."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[tokenizer])), F.lit(0)).cast("long")


def counts(text: Column, tokenizers: tuple[str, ...] = tuple(COUNTERS)) -> Column:
    """A map from tokenizer version to tokens."""
    return F.create_map(*(x for t in tokenizers for x in (F.lit(t), token_count(text, t))))


def signed(rows: DataFrame, sign: int, tokens: str = "tokens") -> DataFrame:
    """Documents with a map of counts as signed changes, a row for each tokenizer version."""
    each = rows.select("source", "lang", F.explode(tokens).alias("tokenizer", "n"))
    return each.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n") * sign).alias("n_tokens"))


def revised(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Documents whose counts were corrected: the old counts leave, the new ones enter."""
    changed = rows.where(F.map_entries(before) != F.map_entries(after))
    return signed(changed, -1, before).unionByName(signed(changed, 1, after))


class Ledger:
    """Batches of signed changes in a shared folder, and their totals."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the ledger, without rows as long as nothing was written."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def recorded(self) -> DataFrame:
        """Batches that count, each with the attempt that was recorded (the first by name)."""
        names = self._table("commits", "batch string, attempt string")
        return names.groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes unless its name is recorded; whether it was added."""
        if not self.recorded().where(F.col("batch") == batch).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums = sums.withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)})
        sums.write.mode("append").parquet(f"{self.folder}/deltas")
        one = self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string")
        one.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """Current totals by source, language and tokenizer version."""
        deltas = self._table("deltas", SCHEMA).join(self.recorded(), ["batch", "attempt"], "left_semi")
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
