"""Diffs by folder digests against the full join, and how much of a ref they look at."""

import random

from pyspark.sql import functions as F

from folioscope.operators import context, trees


def refs(spark, rows):
    return spark.createDataFrame(rows, "repo_ref_id long, path string, content_id string")


def made(seed, count):
    """Two refs that differ in a few places of a deep tree."""
    rng = random.Random(seed)
    old = {f"{rng.randrange(3)}/{rng.randrange(4)}/{k % 7}/f{k}": f"c{rng.randrange(9)}" for k in range(count)}
    old |= {"top": "c1", "/slash": "c2", "a//b": "c3", "0": "file and folder"}
    new = dict(old)
    for path in rng.sample(sorted(new), 5):
        del new[path]
    for path in rng.sample(sorted(new), 5):
        new[path] += "x"
    new |= {"new/deep/er/file": "n", "0/0/fresh": "n"}
    return [(1, p, c) for p, c in old.items()] + [(2, p, c) for p, c in new.items()]


def test_equals_the_full_join(spark, tmp_path, monkeypatch):
    for seed, named in ((1, 1000), (2, 2)):
        monkeypatch.setattr(trees, "NAMED_FOLDERS", named)
        rows = refs(spark, made(seed, 150))
        place = str(tmp_path / str(seed))
        trees.write_tree(rows.where("repo_ref_id = 1"), place, 0)
        for _ in range(2):  # a repeated batch overwrites itself
            trees.write_tree(rows.where("repo_ref_id = 2"), place, 1)
        for one, other in ((1, 2), (2, 1)):
            got = sorted(map(tuple, trees.ref_diff(spark, place, one, other).collect()), key=str)
            assert got == sorted(map(tuple, context.ref_diff(rows, one, other).collect()), key=str)
            assert len(got) > 8
        assert trees.ref_diff(spark, place, 1, 1).count() == 0


def test_what_is_compared_grows_with_the_change(spark, tmp_path, monkeypatch):
    files = [(f"{a}/{b}/{c}", "x") for a in range(12) for b in range(12) for c in range(12)]
    changed = [(p, "y" if p == "3/4/5" else c) for p, c in files]
    place = str(tmp_path)
    trees.write_tree(refs(spark, [(1, *f) for f in files] + [(2, *f) for f in changed]), place, 0)
    looked, side = [], trees._side

    def counted(level, ref, parents):
        rows = side(level, ref, parents)
        looked.append(rows.count())
        return rows

    monkeypatch.setattr(trees, "_side", counted)
    assert [tuple(r) for r in trees.ref_diff(spark, place, 1, 2).collect()] == [("3/4/5", "modified", "y")]
    assert sum(looked) == 2 * (12 + 12 + 12)  # of 2 * 1,728 files


def test_named_folders_reach_the_scan(spark, tmp_path):
    trees.write_tree(refs(spark, made(3, 40)), str(tmp_path), 0)
    level = trees._level(spark, str(tmp_path), 2)
    parents = spark.createDataFrame([("1",)], "parent string")
    plan = trees._side(level, 1, parents)._jdf.queryExecution().executedPlan().toString()
    assert "depth" in plan.split("PartitionFilters")[1][:80]
    assert "EqualTo(repo_ref_id,1)" in plan and ("In(parent" in plan or "EqualTo(parent,1)" in plan)


def test_edge_rows(spark, tmp_path):
    rows = refs(spark, [(1, None, "a"), (1, "p", None), (2, "p", "b"), (1, "q", "z"), (1, "q", "y"), (2, "q", "y")])
    trees.write_tree(rows, str(tmp_path / "t"), 0)
    got = [tuple(r) for r in trees.ref_diff(spark, str(tmp_path / "t"), 1, 2).collect()]
    assert got == [("p", "modified", "b")]
    assert trees.ref_diff(spark, str(tmp_path / "none"), 1, 2).count() == 0
    trees.write_tree(rows.where(F.lit(False)), str(tmp_path / "empty"), 0)
    assert trees.ref_diff(spark, str(tmp_path / "empty"), 1, 2).count() == 0
