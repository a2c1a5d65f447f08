"""URL filters by a sort-merge range join.

A rule for a host and its subdomains is an interval of canonical keys: host labels in reverse
order, each ended by a dot, so `example.com` becomes `com.example.` and its subdomains are the
keys that start so. Urls and rules are dealt to ranges of keys and sorted; one sweep over a
range keeps the rules whose interval is open on a stack, where each lies inside the one below.
A url takes the longest rule on the stack whose path starts its own.

Ranges come from a bounded sample of the keys, each with the row's number as a tie-breaker, so a
host with a third of all rows is dealt to many ranges. The sample moves borders, not results. A
rule goes to every range that its interval meets.

Defined results: a null url, or one without `://`, has an empty host and path and takes the
default verdict unless a rule has an empty host; of rules with the same host and path `block`
wins; rules with a null host or path are ignored; repeated rows each get their verdict; other
columns stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioscope.llm.common import ascii_lower

#: Keys in the sample for each range.
SAMPLE = 100


def parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = F.expr(f"coalesce(if(instr(`{url}`, '://') > 0, substr(`{url}`, instr(`{url}`, '://') + 3), ''), '')")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    """The host's labels in reverse order, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Rules:
    """The rules of one host: verdicts by path, looked up by the lengths that occur."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.paths:
            if len(path) not in self.lengths:
                self.lengths = sorted([*self.lengths, len(path)], reverse=True)
            self.paths[path] = (host, verdict)
        elif verdict == "block":
            self.paths[path] = (host, verdict)

    def longest(self, path: str) -> tuple[str, str, str] | None:
        for length in self.lengths:
            if length <= len(path) and path[:length] in self.paths:
                host, verdict = self.paths[path[:length]]
                return host, path[:length], verdict
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key and kind (rules first): urls leave with their rule."""
    stack: list[_Rules] = []
    current = None
    for batch in batches:
        names = ("range", "key", "kind", "host", "path", "verdict")
        columns = [batch.column(n).to_pylist() for n in names]
        kept, rules, verdicts = [], [], []
        for at, (number, key, kind, host, path, verdict) in enumerate(zip(*columns)):
            if number != current:
                stack, current = [], number
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Rules(key))
                stack[-1].add(host, path, verdict)
                continue
            best = None
            for level in stack:
                fit = level.longest(path)
                # Higher levels have longer hosts, so they win ties.
                if fit and (best is None or len(fit[0]) + len(fit[1]) >= len(best[0]) + len(best[1])):
                    best = fit
            kept.append(at)
            rules.append(best[0] + best[1] if best else None)
            verdicts.append(best[2] if best else None)
        some = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [some.column("row"), some.column("host"), some.column("path"),
             pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            ["row", "host", "path", "rule", "verdict"],
        )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row as struct `row` with host, path, rule and verdict.

    `rules` has host, path and verdict (allow or block).
    """
    spark = pages.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = parts("url")
    urls = pages.select(F.struct("*").alias("row"), F.col(url).alias("url")).select(
        "row", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("number")
    )
    urls = urls.select(
        host_key(F.col("host")).alias("key"), F.xxhash64("number").alias("tie"), F.lit(1).alias("kind"),
        "host", "path", F.lit(None).cast("string").alias("verdict"), "row",
    )
    # Bounded: SAMPLE keys for each range. A share of about twice as many rows is taken first, so
    # that not every task sends that many.
    wanted = ranges * SAMPLE
    share = int(min(1.0, 2 * wanted / max(pages.count(), 1)) * (1 << 30))
    some = urls.select("key", "tie").where(F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) < share)
    taken = some.orderBy(F.xxhash64("tie"), "key").limit(wanted).collect()
    keys = sorted((r.key, r.tie) for r in taken)
    borders = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, pair) for pair in zip(key, tie)], dtype="int32")

    lowest = F.lit(-(1 << 63)).cast("long")
    open_rules = rules.where("host is not null and path is not null").select(
        host_key(ascii_lower(F.col("host"))).alias("key"), ascii_lower(F.col("host")).alias("host"), "path", "verdict"
    )
    open_rules = open_rules.select("*", F.regexp_replace("key", r"\.$", "/").alias("end")).select(
        F.explode(F.sequence(range_of("key", lowest), range_of("end", lowest))).alias("range"),
        "key", lowest.alias("tie"), F.lit(0).alias("kind"), "host", "path", "verdict",
        F.lit(None).cast(pages_struct(pages)).alias("row"),
    )
    both = urls.select(range_of("key", "tie").alias("range"), *urls.columns).unionByName(open_rules)
    both = both.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "kind")
    shape = T.StructType(
        [T.StructField("row", pages.schema)] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    )
    swept = both.select("range", "key", "kind", "host", "path", "verdict", "row").mapInArrow(_sweep, shape)
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def pages_struct(pages: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in pages.schema.fields])
