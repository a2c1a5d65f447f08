"""Stored writes: what they add, how often they embed, plans that do not grow, dead writes."""

import pytest
from pyspark.sql import functions as F

from folioscope.plans.store import IndexStore, StoredEngine
from folioscope.schemas import REPOS
from folioscope.sources.embedding import HashingEmbedder
from test_plans import plan_of

FILES = "path string, language string, content string"
ONE = "def one():\n    pass\n"


def counting_embedder(folder):
    """An embedder that notes every text it is asked for, in a folder all tasks see."""

    class Counting(HashingEmbedder):  # defined here, so tasks get the class by value
        def embed(self, texts):
            import uuid

            for text in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as out:
                    out.write(text)
            return HashingEmbedder.embed(self, texts)

    return Counting(8)


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    kinds = {f.name: f.dataType for f in REPOS.fields}
    repos = spark.createDataFrame([(1, "lamps"), (2, "other")], "id long, name string").select(
        *[(F.col(c) if c in ("id", "name") else F.array() if c == "glob_patterns" else F.lit(None)).cast(kinds[c]).alias(c)
          for c in kinds]
    )
    return StoredEngine.create(repos, str(tmp_path / "index"), counting_embedder(tmp_path / "asked"))


def files(spark, **texts):
    rows = [(f"{name}.py", "python", text) for name, text in texts.items()]
    return spark.createDataFrame(rows, FILES)


def asked(tmp_path):
    return sorted(p.read_text(encoding="utf-8") for p in (tmp_path / "asked").iterdir())


def test_versions_share_contents_and_leave(spark, engine, tmp_path):
    two, three = "def two():\n    pass\n", "def three():\n    pass\n"
    first = engine.sync_ref("lamps", "v1.0.0", "c1", files(spark, a=ONE, b=two))
    calls = asked(tmp_path)
    assert len(calls) == len(set(calls)) == 2
    second = first.sync_ref("lamps", "v2.0.0", "c2", files(spark, a=ONE, c=three))
    for _ in range(2):  # lookups and counters do not embed again
        row = second.repo_refs.where("ref = 'v2.0.0'").first()
    assert (row.stage, row.files_total, row.chunks_total, row.chunks_embedded) == ("ready", 2, 2, 2)
    assert row.language_stats == {"python": 100.0} and row.semver == "2.0.0" and row.indexed_at is not None
    assert len(asked(tmp_path)) == 3
    assert second.state.file_contents.count() == 3 and second.state.ref_files.count() == 4
    found = second.search_code("three", "lamps", "v2.0.0").collect()
    assert found[0].file_path == "c.py"
    # A version goes with the contents that only it had; they may come back.
    gone = second.delete_version("lamps", "v1.0.0")
    assert {r.name for r in gone.state.symbols.collect()} == {"one", "three"}
    assert gone.resolve("lamps").ref == "v2.0.0"
    back = gone.sync_ref("lamps", "v3.0.0", "c3", files(spark, b=two))
    assert sorted(r.name for r in back.state.symbols.collect()) == ["one", "three", "two"]
    assert back.state.chunks.groupBy("content_id").count().where("count > 1").isEmpty()
    # A ref that is synced again is replaced.
    again = back.sync_ref("lamps", "v2.0.0", "c4", files(spark, a=ONE))
    assert sorted(r.path for r in again.file_tree("lamps", "v2.0.0").collect()) == ["a.py"]
    assert sorted(r.name for r in again.state.symbols.collect()) == ["one", "two"]
    assert again.repo_refs.count() == 2
    compact = again.compact()
    for name in ("file_contents", "ref_files", "symbols", "imports", "chunks"):
        one, other = (getattr(e.state, name) for e in (again, compact))
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert len(compact.store.wrote) == 1
    # The engine from before sees what it saw.
    assert second.state.ref_files.count() == 4
    empty = compact.delete_repo("lamps")
    assert empty.state.chunks.isEmpty() and empty.repo_refs.isEmpty() and empty.repos.count() == 1


def test_plans_do_not_grow(spark, engine):
    lengths = []
    for number in range(3):
        engine = engine.sync_ref("lamps", f"v{number}.0.0", "c", files(spark, a=ONE, b=f"x = {number}\n"))
        lengths.append(len(plan_of(engine.state.chunks).splitlines()))
    assert lengths[0] == lengths[1] == lengths[2] < 40


def test_a_write_that_died_is_not_seen(spark, engine, monkeypatch):
    engine = engine.sync_ref("lamps", "v1.0.0", "c1", files(spark, a=ONE))
    monkeypatch.setattr(IndexStore, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        engine.sync_ref("lamps", "v1.0.0", "c2", files(spark, b="def other():\n    pass\n"))
    monkeypatch.undo()
    again = StoredEngine(spark, engine.store.folder, engine.embedder)
    assert [r.name for r in again.state.symbols.collect()] == ["one"]
    # The next write of that number does not pick up what was left.
    queued = again.refresh("lamps", "new")
    assert [r.name for r in queued.state.symbols.collect()] == ["one"]
    assert queued.state.ref_files.count() == 1
    assert {r.ref: r.stage for r in queued.repo_refs.collect()} == {"v1.0.0": "ready", "new": "queued"}


def test_small_tables_and_messages(spark, engine):
    renamed = engine.update_repo("lamps", remote_url="x")
    assert renamed.repos.where("name = 'lamps'").first().remote_url == "x"
    assert renamed.sync_ref("no", "v1", "c", files(spark, a=ONE)) == 'Repository "no" not found.'
    assert renamed.delete_version("lamps", "v9") == 'Ref "v9" not found for "lamps".'
    assert renamed.delete_repo("no") == 'Repository "no" not found.'
    empty = renamed.sync_ref("lamps", "v1.0.0", "c1", spark.createDataFrame([], FILES))
    row = empty.repo_refs.first()
    assert (row.files_total, row.chunks_total, row.language_stats) == (0, 0, None)
