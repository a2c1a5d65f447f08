"""Exact positions in a total order, found without one ordered task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.sources.work import stored

_LOCAL = (1 << 33) - 1


def ranked(frame: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Add every row's position, from 1, in the order of some columns.

    Rows are dealt out by ranges of the order and sorted within them; a row's position is the
    number of rows in the ranges before plus its place in its own. The driver sees one count per
    range, whose number is the session's shuffle partitions at most. The ranges are written before
    they are counted, so rows that tie keep the places they were counted with.
    """
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_place", 33)
    before, total = [], 0
    counts = dealt.groupBy(part.alias("part")).count().orderBy("part").collect()
    for row in counts:
        before.append((row["part"], total))
        total += row["count"]
    offsets = frame.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = dealt.withColumn("_part", part).join(offsets, "_part")
    rank = F.col("_before") + F.col("_place").bitwiseAND(_LOCAL) + 1
    return placed.withColumn(out, rank).select(*frame.columns, out)
