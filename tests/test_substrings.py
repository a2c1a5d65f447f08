"""The substring index against ILIKE over all texts."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import substrings
from folioscope.operators.substrings import SubstringIndex
from test_plans import plan_of

PATTERNS = ["src", "SRC/L", "a_c", "lamp%ts", "ab", "", "%", "_", "Ünï", "zzz", "x\\_y", "50\\%", "lamp.ts", "o/b/c", "\\\\"]


def made(seed, count):
    rng = random.Random(seed)
    names = ["src", "lib", "Lamp", "abc", "axc", "x_y", "xzy", "50%", "ünïcode", "a\\b", "o"]
    return ["/".join(rng.choices(names, k=rng.randint(1, 4))) + rng.choice([".ts", ".py", ""]) for _ in range(count)]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.fixture
def index(spark, tmp_path):
    return SubstringIndex(spark, str(tmp_path / "names"))


def test_equals_a_scan_over_batches(spark, index):
    first, second = made(1, 150), made(2, 150) + [None, "", "ab"]
    index.add(frame(spark, first), 0)
    for _ in range(2):  # a repeated batch overwrites itself
        index.add(frame(spark, second), 1)
    every = frame(spark, first + second).distinct()
    for pattern in PATTERNS:
        want = sorted(r.text for r in every.where(F.col("text").ilike(f"%{pattern}%")).collect())
        assert sorted(r.text for r in index.matching(pattern).collect()) == want, pattern
    assert index.texts().count() == len({t for t in first + second if t is not None})


def test_only_the_runs_of_the_pattern_are_read(spark, index):
    index.add(frame(spark, made(3, 100) + ["needle/in/hay"]), 0)
    assert index.candidates("needle").count() == 1
    plan = plan_of(index.candidates("needle"))
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") or "bucket" in plan
    assert "In(run" in plan
    assert len(index.rarest("needle/in")) == substrings.LOOKED_UP
    assert index.rarest("unheard of") is None and index.rarest("ab") == []


def test_empty(spark, index):
    assert index.matching("abc").count() == 0 and index.matching("").count() == 0
    index.add(frame(spark, []), 0)
    assert index.matching("abc").count() == 0 and index.matching("").count() == 0


def test_literal_parts():
    assert substrings.literal_parts("a%bc_d") == ["a", "bc", "d"]
    assert substrings.literal_parts("a\\%b\\\\c") == ["a%b\\c"]
    assert substrings.literal_parts("%_") == []
