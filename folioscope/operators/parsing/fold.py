"""One walk over the lines of each file, for what depends on a stack of any depth."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from folioscope.session import ship_package

Columns = dict[str, list]

_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def fold_files(
    rows: DataFrame, reads: Sequence[str], added: str, fold: Callable[[Columns], Columns]
) -> DataFrame:
    """Rows (content_id, line, ...) with columns that ``fold`` computes file by file.

    ``fold`` gets the columns it reads of one file in line order. Lines carry numbers and
    marks, not text; a task holds the lines of one file and of one Arrow batch.
    """
    fields = StructType.fromDDL(added).fields
    kinds = {f.name: _ARROW[f.dataType.simpleString()] for f in fields}

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        codes = table.column("content_id").combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        read = {c: table.column(c).to_pylist() for c in reads}
        out: Columns = {n: [] for n in kinds}
        for a, b in zip(cuts[:-1], cuts[1:]):
            for name, values in fold({c: v[a:b] for c, v in read.items()}).items():
                out[name].extend(values)
        for name, kind in kinds.items():
            table = table.append_column(name, pa.array(out[name], kind))
        yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("content_id")[-1]
            ids = batch.column("content_id").dictionary_encode().indices.to_numpy()
            start = int(np.flatnonzero(ids != ids[-1]).max(initial=-1)) + 1
            same = held and held[-1].column("content_id")[-1] == last
            if start == 0 and (same or not held):
                held.append(batch)  # still the same file
                continue
            yield from whole(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = [batch.slice(start)]
        if held:
            yield from whole(pa.Table.from_batches(held))

    ship_package(rows.sparkSession)
    dealt = rows.repartition("content_id").sortWithinPartitions("content_id", "line")
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *fields]))


def next_at_most(values: list[int], marks: list[bool], limits: list[int]) -> list[int | None]:
    """For each place the nearest marked one, itself included, whose value is at most its limit."""
    found: list[int | None] = [None] * len(values)
    stack: list[int] = []  # marked places; values fall from the top, the nearest, downwards
    heights: list[int] = []
    for i in range(len(values) - 1, -1, -1):
        if marks[i]:
            while heights and heights[-1] >= values[i]:
                heights.pop()
                stack.pop()
            heights.append(values[i])
            stack.append(i)
        k = bisect_right(heights, limits[i]) - 1
        if k >= 0:
            found[i] = stack[k]
    return found


def nesting(c: Columns) -> Columns:
    """Owner, enclosing kinds and end of every line from depths and opening lines."""
    openers: dict[int, tuple] = {}
    owners, inside = [], []
    for depth, opens, tag, line, before, wanted in zip(
        c["depth"], c["opens"], c["tag"], c["line"], c["code_before"], c["wanted"]
    ):
        owners.append(openers.get(depth - 1, (None, None, None)) if depth > 0 else (None, None, None))
        above = None
        if wanted and depth > 1:
            kinds = {openers[k][0] if k in openers else None for k in range(depth - 1)}
            above = kinds.pop() if len(kinds) == 1 else "mixed"
        inside.append(above)
        if opens:
            openers[depth] = (tag, line, before)
    ends = next_at_most(c["after"], c["may_end"], c["depth"])
    groups = next_at_most(c["after"], c["may_end"], [0] * len(ends))
    lines, words = c["line"], c["last_word"]
    return {
        "owner_tag": [o[0] for o in owners],
        "owner_line": [o[1] for o in owners],
        "owner_before": [o[2] for o in owners],
        "inside": inside,
        "end_line": [None if e is None else lines[e] for e in ends],
        "end_word": [None if e is None else words[e] for e in ends],
        "group_end": [None if e is None else lines[e] for e in groups],
    }


NESTING = (
    "owner_tag string, owner_line int, owner_before int, inside string, end_line int, "
    "end_word string, group_end int"
)


def indentation(c: Columns) -> Columns:
    """The statement that encloses each statement, and the last line before the one that ends it."""
    stack: list[tuple[int, bool, int]] = []
    owners = []
    for indent, klass, line in zip(c["indent"], c["is_class"], c["line"]):
        while stack and stack[-1][0] >= indent:
            stack.pop()
        owners.append(stack[-1] if stack else (None, None, None))
        stack.append((indent, klass, line))
    # The next statement, itself not included, that is indented no deeper.
    indents, before = c["indent"], c["line_before"]
    ends, waiting = [None] * len(owners), []
    for i, indent in enumerate(indents):
        while waiting and indents[waiting[-1]] >= indent:
            ends[waiting.pop()] = before[i]
        waiting.append(i)
    return {
        "owner_indent": [o[0] for o in owners],
        "owner_is_class": [o[1] for o in owners],
        "end": ends,
    }


INDENTATION = "owner_indent int, owner_is_class boolean, end int"


def titles(c: Columns) -> Columns:
    """All lines of the paragraph above each line, trimmed and joined."""
    out, paragraph = [], []
    for starts, inside, text in zip(c["starts"], c["paragraph"], c["text"]):
        out.append("\n".join(paragraph) if paragraph else None)
        if starts:
            paragraph = []
        if inside:
            paragraph.append((text or "").strip(" "))
        else:
            paragraph = []
    return {"above_text": out}
