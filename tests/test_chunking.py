import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioscope.operators import chunking


def windows(lines, budget, ratio):
    """Line windows by a plain loop: (first, last) zero-based, last exclusive."""
    text = "\n".join(lines)
    if not text.strip():
        return []
    if math.ceil(len(text) / 3) <= budget:
        return [(0, len(lines))]
    height = max(math.floor(budget * 3 / (len(text) / len(lines))), 3)
    step = height - max(math.floor(height * ratio), 1)
    result, at = [], 0
    while True:
        end = min(at + height, len(lines))
        result.append((at, end))
        if end >= len(lines):
            return result
        at += step


def chunks_by_loop(text, symbols, prefix, budget, ratio):
    lines, result = text.split("\n"), []
    body = max(budget - math.ceil(len(prefix) / 3), budget * 0.5)
    cursor = 1
    ranges = []
    for start, end, name, doc in sorted(symbols):
        if start > cursor:
            ranges.append((cursor, start - 1, None, ""))
        cursor = max(cursor, end + 1)
        ranges.append((start, end, name, doc + "\n" if doc else ""))
    if cursor <= len(lines):
        ranges.append((cursor, len(lines), None, ""))
    for start, end, name, doc in ranges:
        part = lines[start - 1 : end]
        own = max(body - math.ceil(len(doc) / 3), budget * 0.3) if name else body
        for a, b in windows(part, own, ratio):
            result.append((start + a, start + b - 1, name, prefix + doc + "\n".join(part[a:b])))
    return sorted(result, key=repr)


@pytest.mark.parametrize("budget, ratio", [(20, 0.2), (64, 0.5), (512, 0.2), (8, 0.0)])
def test_chunks_equal_a_loop(spark, budget, ratio):
    rng = random.Random(budget)
    files, symbols, prefixes, expected = [], [], [], {}
    for i in range(40):
        text = "\n".join(
            "x" * rng.choice([0, 0, 3, 10, 40]) for _ in range(rng.randrange(1, 60))
        )
        count = len(text.split("\n"))
        prefix = "import a;\n\n" if i % 3 == 0 else ""
        own = []
        for j in range(rng.randrange(4)):
            start = rng.randrange(1, count + 1)
            own.append((start, rng.randrange(start, count + 1), f"s{j}", "doc" if j % 2 else ""))
        files.append((str(i), text))
        symbols += [(str(i), s, e, n, "function", n, d or None) for s, e, n, d in own]
        prefixes.append((str(i), prefix))
        expected[str(i)] = chunks_by_loop(text, own, prefix, budget, ratio)
    got = chunking.chunk_files(
        spark.createDataFrame(files, "content_id string, content string"),
        spark.createDataFrame(
            symbols,
            "content_id string, start_line int, end_line int, name string, kind string,"
            " signature string, documentation string",
        ),
        spark.createDataFrame(prefixes, "content_id string, import_prefix string"),
        budget,
        ratio,
    ).collect()
    found = {}
    for r in got:
        found.setdefault(r.content_id, []).append((r.start_line, r.end_line, r.symbol_name, r.content))
    for key, rows in expected.items():
        assert sorted(found.get(key, []), key=repr) == rows


def test_symbols_are_worked_out_once(spark, capsys):
    """Gaps come out of the symbols' own rows; a second branch would parse all files again."""
    files = spark.createDataFrame([("1", "a\nb\nc")], "content_id string, content string")
    symbols = spark.range(2, 3).selectExpr(
        "'1' AS content_id", "id AS start_line", "id AS end_line", "'f' AS name", "'function' AS kind",
        "'f' AS signature", "CAST(NULL AS string) AS documentation",
    )
    chunks = chunking.chunk_files(files, symbols)
    spans = sorted((r.start_line, r.end_line, r.symbol_name) for r in chunks.collect())
    assert spans == [(1, 1, None), (2, 2, "f"), (3, 3, None)]
    chunks.explain("extended")
    optimized = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("Range (") == 1


def test_overlap_must_leave_progress(spark):
    files = spark.createDataFrame([("a", "x")], "content_id string, content string")
    with pytest.raises(ValueError):
        chunking.chunk_files(files, overlap=1.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), min_size=1, max_size=60), st.integers(1, 60))
def test_loop_windows_cover_every_line(lines, budget):
    spans = windows(lines, budget, 0.2)
    if not "\n".join(lines).strip():
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(lines)
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_import_prefix(spark):
    rows = [
        ("p", 0, "python", "os", [], None, 0), ("p", 1, "python", "m", ["a", "b"], None, 0),
        ("t", 0, "typescript", "x", [], "ns", 1), ("t", 1, "typescript", "y", ["a"], "d", 0),
        ("t", 2, "javascript", "z", [], None, 0), ("c", 0, "c", "<stdio.h>", [], None, 0),
        ("c", 1, "cpp", "b.h", [], None, 0), ("g", 0, "go", "fmt", [], "f", 0),
        ("r", 0, "rust", "a::b", ["c"], None, 0), ("m", 0, "markdown", "u", ["t"], None, 0),
        ("j", 0, "java", "a.B", [], None, 0),
    ]
    df = spark.createDataFrame(
        rows,
        "content_id string, ordinal int, language string, source string, names array<string>,"
        " default_name string, is_namespace int",
    )
    got = {r.content_id: r.import_prefix for r in chunking.import_prefix(df).collect()}
    assert got == {
        "p": "import os\nfrom m import a, b\n\n",
        "t": 'import * as ns from "x";\nimport d, { a } from "y";\nimport "z";\n\n',
        "c": '#include <stdio.h>\n#include "b.h"\n\n',
        "g": 'import f "fmt"\n\n',
        "r": "use a::b::{c};\n\n",
        "m": "<!-- link: u -->\n\n",
        "j": "import a.B;\n\n",
    }
