"""Joins of line ranges as plain joins on cells.

A range is cut into the fewest cells of a grid with levels: a cell of level n holds 8 ** n lines. A
line lies in one cell of each level, and in exactly one cell of every range around it. So "starts
inside" is an equality of (file, level, cell), which Spark shuffles by all three: the ranges of one
huge file are dealt out by cell, and no pair is looked at but those that meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.sources.work import stored

_BITS = 3
#: Levels that cover every line number of an int.
_LEVELS = 11

_CELLS = "array<struct<level:int,cell:long>>"


def _each(level: Column, first: Column, last: Column) -> Column:
    """Cells first .. last of a level, none if the order is wrong."""
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    return F.transform(numbers, lambda cell: F.struct(level.cast("int").alias("level"), cell.alias("cell")))


def cover(start: Column, end: Column) -> Column:
    """The cells that make up the lines start .. end."""
    state = F.struct(
        start.cast("long").alias("first"), end.cast("long").alias("last"), F.array().cast(_CELLS).alias("cells")
    )

    def step(held: Column, level: Column) -> Column:
        first, last = held["first"], held["last"]
        up = F.shiftright(first + ((1 << _BITS) - 1), _BITS)
        down = F.shiftright(last + 1, _BITS) - 1
        whole = _each(level, first, last)
        ends = F.concat(
            _each(level, first, F.shiftleft(up, _BITS) - 1), _each(level, F.shiftleft(down + 1, _BITS), last)
        )
        inside = up <= down
        return F.struct(
            F.when(inside, up).otherwise(1).alias("first"), F.when(inside, down).otherwise(0).alias("last"),
            F.concat(held["cells"], F.when(inside, ends).otherwise(whole)).cast(_CELLS).alias("cells"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), state, step, lambda held: held["cells"])


def within(
    outer: DataFrame, inner: DataFrame, key: Sequence[str], start: str = "start_line", end: str = "end_line"
) -> DataFrame:
    """Outer ranges with the inner ones inside them (columns inner_start and inner_end).

    ``key`` names what both must share. Equal inner ranges count once. An outer range without inner
    ones stays, with nulls; one whose ends are null or in the wrong order holds nothing.
    """
    cut = outer.select("*", F.explode_outer(cover(F.col(start), F.col(end))).alias("_cell"))
    cut = cut.select(*outer.columns, F.col("_cell.level").alias("_level"), F.col("_cell.cell").alias("_at"))
    cut = stored(cut, "ranges")  # the levels are asked for before the join reads it
    levels = sorted(row[0] for row in cut.select("_level").distinct().collect() if row[0] is not None)
    level = F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")).alias("_level")
    lines = inner.select(*key, F.col(start).alias("inner_start"), F.col(end).alias("inner_end")).distinct()
    lines = lines.where("inner_start <= inner_end").select("*", level)
    at = F.expr(f"shiftright(cast(inner_start as long), {_BITS} * _level)")
    met = cut.join(lines.withColumn("_at", at), [*key, "_level", "_at"], "left")
    # A range that starts inside may end outside.
    kept = F.col("inner_end") <= F.col(end)
    found = [F.when(kept, F.col(c)).alias(c) for c in ("inner_start", "inner_end")]
    return met.select(*outer.columns, *found)
