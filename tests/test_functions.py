import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import labels, paths, text, vectors, versions

TAGS = ["v1.0.0", "v1.1.0", "v1.2.3", "v2.0.0", "v2.1.0", "v1.0.0-beta.1"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def best(spark, tags, constraint):
    df = spark.createDataFrame([(t,) for t in tags], "ref string")
    keyed = df.withColumn("k", versions.version_key(versions.clean_version(F.col("ref"))))
    hits = keyed.where(versions.satisfies(F.col("k"), constraint))
    return hits.agg(F.max_by("ref", "k")).first()[0]


@pytest.mark.parametrize(
    "constraint, expected",
    [
        ("1.2.3", "v1.2.3"), ("^1.2.0", "v1.2.3"), ("~1.0.0", "v1.0.0"), ("1.x", "v1.2.3"),
        ("^3.0.0", None), ("main", None), ("1.0.0-beta.1", "v1.0.0-beta.1"),
        ("^1.0.0-beta.0", "v1.2.3"), (">=2.0.0", "v2.1.0"), ("", "v2.1.0"), ("*", "v2.1.0"),
        ("1.0.0 - 1.1", "v1.1.0"), ("<1.1.0 || >2.0", "v2.1.0"), ("< 2", "v1.2.3"),
        (">1.1 <2.1.0", "v2.0.0"), ("<=1.1", "v1.1.0"), ("~1", "v1.2.3"), ("^0.0.1", None),
    ],
)
def test_ranges(spark, constraint, expected):
    assert best(spark, TAGS, constraint) == expected


def test_lone_prerelease(spark):
    assert best(spark, ["v1.0.0-beta.1"], "^1.0.0-beta.0") == "v1.0.0-beta.1"
    assert best(spark, ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-2", "1.0.0-11"], ">=1.0.0-0") == (
        "1.0.0-alpha.1"
    )


@pytest.mark.parametrize(
    "ref, clean",
    [
        ("v1.2.3", "1.2.3"), ("1.0.0", "1.0.0"), ("v2.0.0-beta.1", "2.0.0-beta.1"), ("main", None),
        ("release/2025-03", None), ("", None), (" =v1.2.3+x ", "1.2.3"), ("1.02.3", None),
    ],
)
def test_clean(spark, ref, clean):
    assert one(spark, versions.clean_version(F.lit(ref))) == clean


def test_rewrite_query():
    quoted = text.rewrite_query('"error handling" in module')
    assert quoted.full_text == '"error handling" in module'
    assert quoted.embedding_text == "error handling in module"
    assert text.rewrite_query(" \n\t") is None


def test_skip_rules(spark):
    def reason(content, **caps):
        return one(spark, text.skip_reason(F.lit(content), **caps))

    assert reason("é" * 6, max_bytes=11) == "too-large"
    assert reason("é" * 5, max_bytes=11) is None
    assert reason("x" * 2000) is None
    assert reason("x" * 2000 + "\ny") == "minified-or-generated"
    assert reason("") is None


def test_code_words(spark):
    words = one(spark, text.code_words(F.lit("parseJSONFile snake_case2Foo — é!")))
    assert words == ["parse", "json", "file", "snake", "case2", "foo", "é"]
    assert one(spark, text.code_words(F.lit(" .. "))) == []
    padded = text.padded_words(F.lit("a a b aa"))
    assert one(spark, text.padded_term_count(padded, "a")) == 2
    assert one(spark, text.padded_count(padded)) == 4


def test_truncation_against_a_loop(spark):
    rng = random.Random(5)
    texts = [
        "\n".join("ab😀"[rng.randrange(3)] * rng.randrange(12) for _ in range(rng.randrange(1, 9)))
        for _ in range(60)
    ]

    def size(t):
        return len(t.encode("utf-16-be")) // 2

    def expected(t, budget):
        if -(-size(t) // 3) <= budget:
            return t
        lines = t.split("\n")
        kept = [i for i in range(1, len(lines) + 1) if -(-size("\n".join(lines[:i])) // 3) <= budget]
        return "\n".join(lines[: kept[-1]]) if kept else t[: int(budget * 1.5)]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for budget in (2, 4, 7):
        got = df.select("t", text.truncate_for_embedding(F.col("t"), budget).alias("c")).collect()
        assert [r.c for r in got] == [expected(r.t, budget) for r in got]


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, vectors.cosine_similarity(a, b)) == pytest.approx(0.70710678)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine_similarity(a, zero)) is None
    assert one(spark, vectors.cosine_to(zero, [1.0, 2.0])) is None


def kept(spark, names, condition):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    return [r.p for r in df.where(condition).collect()]


def test_ignore_rules(spark):
    names = [
        "src/index.ts", "debug.log", "coverage/lcov.info", ".env", ".env.local", "a/keep.log",
        "node_modules/x/keep.log", "sub/a.tmp", "a.tmp", "sub/x", "sub/y/x", "yarn.lock", "x/build",
    ]
    # Nested lines get their folder and a slash in front, so a rooted "/x" names nothing.
    rules = paths.ignore_rules(
        ["*.log", "coverage/", ".env*", "!keep.log"], {"sub": ["*.tmp", "# note", "/x"]}
    )
    assert kept(spark, names, ~paths.is_ignored(F.col("p"), rules)) == [
        "src/index.ts", "a/keep.log", "a.tmp", "sub/x", "sub/y/x",
    ]


def test_globs(spark):
    names = ["a.ts", "src/a.ts", "src/deep/b.js", "src/.hidden.ts", "docs/x.md"]

    def hits(*globs):
        return kept(spark, names, paths.matches_globs(F.col("p"), globs))

    assert hits() == names
    assert hits("**/*.ts") == ["a.ts", "src/a.ts"]
    assert hits("src/**") == ["src/a.ts", "src/deep/b.js"]
    assert hits("src/**", "!**/*.js") == ["src/a.ts"]
    assert hits("{src,docs}/*.{ts,md}") == ["src/a.ts", "docs/x.md"]
    assert hits("src/[a-c]?ts") == ["src/a.ts"]


def test_languages(spark):
    cases = {
        "server.go": "go", "build.gradle.kts": "kotlin", "a/X.HPP": "cpp", "s.h": "c",
        "docs/guide.mdx": "markdown", "logo.png": None, "Makefile": None, ".ts": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.l for r in df.select("p", paths.classify_language(F.col("p")).alias("l")).collect()}
    assert got == cases


def test_labels(spark):
    assert one(spark, labels.redact(F.lit("secret-1234"))) == "****1234"
    assert one(spark, labels.redact(F.lit("abc"))) == "****"
    assert one(spark, labels.host_env_suffix(F.lit("https://git-lab.example.com/a.git"))) == (
        "GIT_LAB_EXAMPLE_COM"
    )
    assert one(spark, labels.repo_name_from_url(F.lit("https://h.example.com/a/b.git"))) == "b"
    stats = F.create_map(F.lit("go"), F.lit(9.9))
    assert one(spark, labels.language_reaches(stats, ["go", "c"], 9.9)) is True
    assert one(spark, labels.language_reaches(F.lit(None).cast("map<string,double>"), ["go"], 0)) is False


def test_one_invalid_alternative_makes_no_range(spark):
    assert versions.parse_range("1.x || main") is None
    assert best(spark, ["v1.2.0"], "1.x || main") is None


def test_prerelease_numbers_of_any_size(spark):
    nine, ten = "9" * 45, "1" + "0" * 45
    tags = [f"1.0.0-{n}" for n in (ten, nine, "2", "a")][:3]
    keys = spark.createDataFrame([(t,) for t in tags], "t string").orderBy(versions.version_key(F.col("t")))
    assert [r.t for r in keys.collect()] == [f"1.0.0-{n}" for n in ("2", nine, ten)]
