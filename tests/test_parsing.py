import pytest
from pyspark.sql import functions as F

import samples
from folioscope.operators.parsing import lexer, markdown, symbols

EXPECTED = {
    "typescript": [
        ("interface", "LampConfig", 9, 12), ("enum", "Mode", 14, 17), ("class", "Lamp", 22, 39),
        ("method", "constructor", 25, 27), ("method", "turnOn", 30, 34), ("method", "make", 36, 38),
        ("type", "LampFactory", 41, 41), ("function", "createLamp", 43, 43),
        ("variable", "DEFAULTS", 45, 47), ("function", "run", 49, 51), ("variable", "default", 53, 53),
    ],
    "python": [
        ("module", "(module)", 1, 4), ("class", "Point", 14, 35), ("method", "shift", 20, 28),
        ("method", "wait", 34, 35), ("function", "count", 38, 42),
    ],
    "go": [
        ("struct", "Config", 12, 14), ("interface", "Switch", 16, 18), ("struct", "Alpha", 22, 27),
        ("type", "Beta", 22, 27), ("function", "New", 30, 32), ("method", "Flip", 34, 37),
    ],
    "java": [
        ("class", "Task", 8, 29), ("method", "Task", 13, 15), ("method", "run", 17, 22),
        ("enum", "Level", 24, 24), ("class", "Inner", 26, 28), ("method", "value", 27, 27),
        ("interface", "Shape", 31, 33), ("enum", "Color", 35, 35),
    ],
    "kotlin": [
        ("class", "User", 7, 17), ("method", "greet", 11, 11), ("method", "older", 14, 16),
        ("interface", "Repo", 19, 21), ("method", "find", 20, 20), ("object", "Checker", 23, 25),
        ("method", "check", 24, 24), ("function", "shout", 27, 29),
    ],
    "rust": [
        ("struct", "Config", 9, 11), ("enum", "Fault", 13, 15), ("trait", "Light", 17, 20),
        ("method", "on", 18, 18), ("method", "off", 19, 19), ("method", "new", 24, 27),
        ("function", "free", 30, 32),
    ],
    "c": [
        ("struct", "Lamp", 6, 8), ("type", "volts_t", 11, 11), ("function", "lamp_start", 14, 14),
        ("function", "lamp_name", 15, 15), ("function", "lamp_stop", 18, 24),
    ],
    "cpp": [
        ("namespace", "shine", 5, 31), ("class", "Lamp", 8, 19), ("method", "Lamp", 10, 10),
        ("method", "~Lamp", 11, 11), ("method", "turn", 13, 15), ("method", "name", 16, 16),
        ("class", "Registry", 21, 25), ("method", "add", 24, 24), ("function", "total", 27, 29),
    ],
    "markdown": [
        ("heading", "Guide to lamps", 1, 25), ("heading", "Install", 5, 12),
        ("heading", "Setup notes", 15, 20), ("heading", "Detail", 20, 20), ("heading", "Use", 22, 25),
    ],
}
IMPORTS = {
    "typescript": [
        ("node:fs", ["open", "close"], None, 0), ("node:path", [], "path", 0),
        ("node:os", [], "os", 1), ("./side-effect", [], None, 0), ("./helper", ["helper"], None, 0),
    ],
    "python": [("os", [], None, 0), ("typing", ["List", "Optional"], None, 0), (".local", ["thing"], None, 0)],
    "go": [("fmt", [], None, 0), ("strings", [], None, 0), ("os", [], None, 0)],
    "java": [("java.util.List", [], None, 0), ("java.util.Map.entry", [], None, 0), ("java.io", [], None, 0)],
    "kotlin": [("kotlin.math.max", [], None, 0), ("demo.util", [], None, 0)],
    "rust": [
        ("std::collections::HashMap", [], None, 0), ("std::io::{self, Read}", [], None, 0),
        ("crate::lamp::*", [], None, 0),
    ],
    "c": [("stdio.h", [], None, 0), ("util.h", [], None, 0)],
    "cpp": [("string", [], None, 0), ("base.hpp", [], None, 0)],
    "markdown": [("./other.md", ["link"], None, 0), ("https://example.com", ["https://example.com"], None, 0)],
}
DOCUMENTED = {
    ("typescript", "LampConfig"): "/** How a lamp is set up. */",
    ("typescript", "turnOn"): "/** Turn it on. */",
    ("python", "Point"): '"""A point."""',
    ("go", "Config"): "// Config holds settings.\n// It is small.",
    ("java", "Task"): "/** A task. */",
    ("rust", "Config"): "/// Settings of a lamp.\n/// Two lines.",
    ("c", "lamp_stop"): "/** Stop it. */",
    ("c", "lamp_start"): None,
    ("cpp", "turn"): "/** Turn it. */",
    ("kotlin", "older"): "/** Older. */",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, k, v) for k, v in samples.FILES.items()]
    rows += [("blank", "typescript", " \n"), ("unknown", "cobol", "MOVE A TO B.")]
    files = spark.createDataFrame(rows, "content_id string, language string, content string")
    found, used = symbols.parse_files(files)
    return (
        found.orderBy("content_id", "start_line", "ordinal").collect(),
        used.orderBy("content_id", "ordinal").collect(),
        markdown.code_blocks(files).collect(),
    )


@pytest.mark.parametrize("language", list(EXPECTED))
def test_symbols(parsed, language):
    got = [(r.kind, r.name, r.start_line, r.end_line) for r in parsed[0] if r.content_id == language]
    assert got == EXPECTED[language]


@pytest.mark.parametrize("language", list(IMPORTS))
def test_imports(parsed, language):
    got = [
        (r.source, r.names, r.default_name, r.is_namespace)
        for r in parsed[1]
        if r.content_id == language
    ]
    assert got == IMPORTS[language]


def test_documentation_and_signature(parsed):
    rows = {}
    for r in parsed[0]:
        rows.setdefault((r.content_id, r.name), r)
    for key, text in DOCUMENTED.items():
        assert rows[key].documentation == text
    assert rows[("typescript", "Lamp")].signature == "export class Lamp extends Base"
    assert rows[("markdown", "Install")].signature == "## Install"


def test_blank_and_unknown_files(parsed):
    assert {r.content_id for r in parsed[0]} == set(samples.FILES)


def test_code_blocks(parsed):
    assert [(b.code_language, b.code) for b in parsed[2]] == [
        ("sh", "# not a heading\n[no](link)")
    ]


def test_frontmatter_keeps_headings(spark):
    text = "---\ntitle: T\n---\n\n# Hello\n\nWorld\n"
    files = spark.createDataFrame([("a", "markdown", text)], "content_id string, language string, content string")
    names = [r.name for r in markdown.headings(files).orderBy("start_line").collect()]
    assert names == ["title: T", "Hello"]


def declared(spark, language, content):
    files = spark.createDataFrame([("f", language, content)], "content_id string, language string, content string")
    found, _ = symbols.parse_files(files)
    return sorted((r.start_line, r.end_line, r.kind, r.name) for r in found.collect())


def test_classes_nested_to_any_depth(spark):
    opened = [f"{'  ' * i}class C{i} {{" for i in range(40)]
    closed = [f"{'  ' * i}}}" for i in reversed(range(40))]
    got = declared(spark, "java", "\n".join(opened + closed))
    assert got == sorted((i + 1, 80 - i, "class", f"C{i}") for i in range(40))
    spaces = [f"namespace n{i} {{" for i in range(30)] + ["class Deep {", "  int at(int i) {", "  }", "};"] + ["}"] * 30
    got = declared(spark, "cpp", "\n".join(spaces))
    assert (31, 34, "class", "Deep") in got and (32, 33, "method", "at") in got and len(got) == 32


def test_methods_indented_to_any_depth(spark):
    deep = " " * 40
    lines = ["class A:", f"{deep}def one(self):", f"{deep}    return 1", f"{deep}def two(self):", f"{deep}    return 2", "x = 1"]
    got = declared(spark, "python", "\n".join(lines))
    assert got == [(1, 5, "class", "A"), (2, 3, "method", "one"), (4, 5, "method", "two")]


def test_underlined_titles_keep_all_lines(spark):
    text = "first\nsecond\n third\n===\n\nnext one\nand more\n---\n\nend"
    files = spark.createDataFrame([("f", "markdown", text)], "content_id string, language string, content string")
    got = [(r.name, r.depth, r.start_line) for r in markdown.headings(files).orderBy("start_line").collect()]
    assert got == [("first\nsecond\nthird", 1, 1), ("next one\nand more", 2, 6)]


def test_ranges_of_symbols_need_no_text_of_the_file(spark):
    from folioscope.operators.parsing import symbols

    files = spark.createDataFrame(
        [("a", "python", "def f(x):\n    return x\n"), ("b", "go", "package p\nfunc g() {\n}\n"), ("c", "en", "x")],
        "content_id string, language string, content string",
    )
    columns = ["content_id", "language", "name", "kind", "start_line", "end_line"]
    found = symbols.ranges(files)
    whole, _ = symbols.parse_files(files)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, whole.select(*columns).collect())) and len(rows) >= 2
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Join")
    assert count(found) == 0 < count(whole)


def test_comments_of_one_line_are_blanked_whole(spark, capsys):
    """One blank for each character, without a pattern's replacement for each of them."""
    text = 'a(); // é 𝄞 {\u2028} "x"\n/* {\n𝄞\r} */ b(); /* 𝄞 */\nc();//'
    want = 'a(); ' + " " * len('// é 𝄞 {\u2028} "x"') + "\n    \n" + " " * len("𝄞\r} */") + " b(); " + " " * 7 + "\nc();  "
    files = spark.createDataFrame([(text, "java")], "content string, language string")
    masked = files.select(lexer.masked(F.col("content"), F.col("language"), ("java",)).alias("code"))
    assert masked.first().code == want
    masked.explain("extended")
    assert "repeat( , length" in capsys.readouterr().out
