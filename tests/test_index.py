"""Several versions of a tree through the index and the engine."""

import pytest
from pyspark.sql import functions as F

import samples
from folioscope.operators import context, maintain
from folioscope.plans import tables as versioned
from folioscope.plans.engine import Engine, with_defaults
from folioscope.plans.indexing import index_ref, without_orphans
from folioscope.queries.streams import empty_state
from folioscope.schemas import REPO_REFS, REPOS
from folioscope.sources import files as file_source
from folioscope.sources.embedding import HashingEmbedder

EXTENSION = {
    "typescript": "ts", "python": "py", "go": "go", "java": "java", "kotlin": "kt", "rust": "rs",
    "c": "h", "cpp": "hpp", "markdown": "md",
}
V1 = {f"src/lamp.{e}": samples.FILES[k] for k, e in EXTENSION.items()}
V1 |= {"package.json": "{}", "node_modules/a.ts": "const a = 1;", "copy/lamp.ts": samples.TYPESCRIPT}
V2 = dict(V1)
V2["src/lamp.ts"] = samples.TYPESCRIPT + "// v2\n"
del V2["src/lamp.py"]
V2["src/new.ts"] = 'export const NEW = "x";\n'


def tree(spark, content):
    listed = spark.createDataFrame(list(content.items()), "path string, content string")
    return file_source.source_files(listed)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Both versions, written as table versions and read back."""
    folder = str(tmp_path_factory.mktemp("index"))
    state = empty_state(spark)
    results = []
    for number, content in ((1, V1), (2, V2)):
        result = index_ref(tree(spark, content), number, state, HashingEmbedder(32))
        names = vars(result.state)
        versioned.write_version(names, folder, number)
        new = sorted(r.language for r in result.new_contents.collect())
        results.append((new, result.language_stats.first()["language_stats"]))
        state = type(state)(**{n: versioned.read_current(spark, folder, n) for n in names})
    return state, results


@pytest.fixture(scope="module")
def engine(spark, indexed):
    repos = spark.createDataFrame(
        [(1, "lamps", None, None, [], None), (2, "empty", None, None, [], None)],
        "id long, name string, local_path string, remote_url string, glob_patterns array<string>,"
        " created_at timestamp_ntz",
    )
    assert [f.name for f in repos.schema] == [f.name for f in REPOS]
    rows = [
        (1, 1, "v1.0.0", "c1", "ready", {"typescript": 60.0}),
        (2, 1, "v2.0.0", "c2", "ready", {"typescript": 70.0}),
        (3, 1, "main", "c3", "embedding", None),
    ]
    refs = spark.createDataFrame(
        rows, "id long, repo_id long, ref string, commit_sha string, stage string,"
        " language_stats map<string,double>",
    )
    assert {f.name for f in refs.schema} <= {f.name for f in REPO_REFS}
    return Engine(spark, repos, refs, indexed[0], HashingEmbedder(32))


def test_only_new_contents_are_indexed(indexed):
    state, results = indexed
    assert results[0][0] == sorted(EXTENSION)
    assert results[1][0] == ["typescript", "typescript"]
    assert results[0][1]["typescript"] == 20.0
    files = {r.repo_ref_id: r.n for r in state.ref_files.groupBy("repo_ref_id").agg(
        F.count("*").alias("n")).collect()}
    assert files == {1: 10, 2: 10}
    assert maintain.duplicate_keys(state.file_contents, ["content_id"]).isEmpty()
    assert maintain.duplicate_keys(state.ref_files, ["repo_ref_id", "path"]).isEmpty()
    assert maintain.missing_parents(state.chunks, state.file_contents, ["content_id"]).isEmpty()


def test_every_chunk_has_a_vector(indexed):
    chunks = indexed[0].chunks
    assert chunks.count() > 40
    assert chunks.where("embedding is null or embedding_error is not null").isEmpty()


def test_diff(indexed):
    changes = context.ref_diff(indexed[0].ref_files, 1, 2)
    assert {(r.path, r.change_type) for r in changes.collect()} == {
        ("src/lamp.ts", "modified"), ("src/lamp.py", "deleted"), ("src/new.ts", "added"),
    }


def test_orphans_go_with_their_children(indexed):
    state = indexed[0]
    state = type(state)(**{**vars(state), "ref_files": state.ref_files.where("repo_ref_id = 2")})
    swept = without_orphans(state)
    # The Python file is gone; the first TypeScript text lives on in its copy.
    languages = [r.language for r in swept.file_contents.collect()]
    assert sorted(languages) == sorted(
        [*(k for k in EXTENSION if k != "python"), "typescript", "typescript"]
    )
    assert maintain.missing_parents(swept.symbols, swept.file_contents, ["content_id"]).isEmpty()


def test_search(engine):
    rows = engine.search_code("turnOn lamp mode", "lamps", "^1.0.0", limit=5).collect()
    assert 0 < len(rows) <= 5
    assert {r.ref for r in rows} == {"v1.0.0"}
    assert any("turnOn" in r.content for r in rows)
    assert all(r.start_line >= 1 and r.end_line >= r.start_line and r.score > 0 for r in rows)
    for a in rows:
        for b in rows:
            if a is not b and a.file_path == b.file_path:
                assert a.end_line < b.start_line or b.end_line < a.start_line
    assert engine.search_code("lamp", "nowhere").isEmpty()
    assert engine.search_code("  ") == "No results found."
    python = engine.search_code("shift point", "lamps", "v1.0.0", languages=["python"])
    assert {r.file_path for r in python.collect()} == {"src/lamp.py"}
    only = engine.search_code("lamp", "lamps", "v2.0.0", paths=["src/new.ts"])
    assert {r.file_path for r in only.collect()} <= {"src/new.ts"}


def test_words_alone_are_found_with_zero_vectors(spark, engine):
    state = engine.state
    zero = state.chunks.withColumn("embedding", F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
    blind = Engine(spark, engine.repos, engine.repo_refs, type(state)(**{**vars(state), "chunks": zero}),
                   engine.embedder)
    rows = blind.search_code("HashMap", "lamps", "v1.0.0").collect()
    assert rows and all(r.score > 0 for r in rows)
    assert rows[0].file_path == "src/lamp.rs"


def test_resolution_messages(engine):
    assert engine.resolve("nowhere") == 'Repository "nowhere" not found.'
    assert engine.resolve("empty") == 'No indexed refs found for "empty".'
    assert engine.resolve("lamps", "9.x") == 'Ref "9.x" not found for "lamps".'
    assert engine.resolve("lamps").ref == "v2.0.0"
    assert engine.resolve("lamps", "main").id == 3
    assert engine.resolve("lamps", "1.0.0").ref == "v1.0.0"


def test_lookups(engine):
    text = engine.get_file("lamps", "src/new.ts", include_symbols=True)
    assert 'export const NEW = "x";' in text["content"]
    assert [r.name for r in text["symbols"].collect()] == ["NEW"]
    assert engine.get_file("lamps", "gone.ts") == 'File "gone.ts" not found in lamps@v2.0.0.'
    found = engine.get_symbol("lamps", "Lamp", "v1.0.0", ["typescript"], include_imports=True)
    assert {r.file_path for r in found["symbols"].collect()} == {"src/lamp.ts", "copy/lamp.ts"}
    assert "turnOn" in found["symbols"].first()["source"]
    assert engine.get_symbol("lamps", "Nope").startswith('Symbol "Nope" not found')
    users = engine.find_references("lamps", "path", "v1.0.0").collect()
    assert {(r.file_path, r.source, r.is_default) for r in users} == {
        ("src/lamp.ts", "node:path", True), ("copy/lamp.ts", "node:path", True),
    }
    assert {r.path for r in engine.find("lamps", "LAMP.T").collect()} == {"src/lamp.ts", "copy/lamp.ts"}
    assert "turnOn" in {r.name for r in engine.find("lamps", "turn", "symbol").collect()}
    assert [r.path for r in engine.file_tree("lamps", prefix="src/n").collect()] == ["src/new.ts"]
    assert engine.ready_refs().count() == 2
    assert {r.repo for r in engine.list_repos(["typescript"], 65).collect()} == {"lamps"}
    assert engine.list_repos(["typescript"], 0).select("repo").distinct().count() == 2
    assert [r.ref for r in engine.indexing_status("lamps").collect()] == ["main"]


def test_context_packs(engine):
    pack = engine.build_context_pack("lamps", "recent-changes", ref="2.0.0", from_ref="1.0.0")
    rows = pack.orderBy("position").collect()
    assert {r.annotation for r in rows} == {"modified", "added", "deleted"}
    assert [r.file_path for r in rows] == sorted(r.file_path for r in rows)
    assert engine.build_context_pack("lamps", "recent-changes", ref="2.0.0").isEmpty()
    small = engine.build_context_pack("lamps", "explain", "lamp", max_tokens=200)
    assert small.agg(F.sum("cost")).first()[0] <= 200
    text = engine.prompt("explain-library", "lamps", "lamp", "v1.0.0")
    assert text.startswith("Explain the architecture and key concepts of lamp.\n")
    with pytest.raises(ValueError):
        engine.build_context_pack("lamps", "guess")


def test_argument_defaults():
    assert with_defaults("find", {}, ["go"], 5) == {"languages": ["go"], "threshold": 5}
    assert with_defaults("find", {"languages": ["c"], "threshold": 0}, ["go"], 5) == {
        "languages": ["c"], "threshold": 5,
    }
    assert with_defaults("get_file", {}, ["go"], 5) == {}


def test_the_last_row_of_a_path_wins(spark):
    rows = [(1, "p.py", "python", "def old():\n    pass\n"), (2, "p.py", "python", "def new():\n    pass\n")]
    files = spark.createDataFrame(rows, "ordinal long, path string, language string, content string")
    state = index_ref(files, 1, empty_state(spark)).state
    assert [r.name for r in state.symbols.collect()] == ["new"]
    assert state.ref_files.count() == 1 and state.file_contents.count() == 1


def test_long_lines_are_indexed_unless_a_limit_is_given(spark):
    text = "def wide():\n    return '" + "x" * 4000 + "'\n"
    files = spark.createDataFrame([("w.py", "python", text)], "path string, language string, content string")
    assert index_ref(files, 1, empty_state(spark)).state.symbols.count() == 1
    limited = index_ref(files, 1, empty_state(spark), max_average_line=500)
    assert limited.state.symbols.count() == 0
    assert [tuple(r) for r in limited.skipped.collect()] == [("w.py", "minified-or-generated")]


def test_writes_of_the_engine(spark, engine):
    lines = [("a.py", "python", "def fresh():\n    pass\n"), ("b.md", "markdown", "# Title\n")]
    files = spark.createDataFrame(lines, "path string, language string, content string")
    kinds = {f.name: f.dataType for f in REPO_REFS.fields}
    base = Engine(
        spark, engine.repos,
        engine.repo_refs.select(*[
            F.col(c) if c in engine.repo_refs.columns
            else (F.lit(0) if c.startswith(("files", "chunks")) else F.lit(None)).cast(kinds[c]).alias(c)
            for c in kinds
        ]),
        engine.state, engine.embedder,
    )
    synced = base.sync_ref("lamps", "v3.1.0", "c9", files)
    row = synced.repo_refs.where("ref = 'v3.1.0'").first()
    assert (row.stage, row.commit_sha, row.semver, row.files_total, row.files_processed) == ("ready", "c9", "3.1.0", 2, 2)
    assert row.chunks_total == row.chunks_embedded > 0 and row.indexed_at is not None
    assert row.language_stats == {"python": 50.0, "markdown": 50.0}
    assert synced.resolve("lamps", "^3.0.0").ref == "v3.1.0"
    assert [r.name for r in synced.get_symbol("lamps", "fresh", "v3.1.0")["symbols"].collect()] == ["fresh"]
    gone = synced.delete_version("lamps", "v3.1.0")
    assert gone.repo_refs.where("ref = 'v3.1.0'").isEmpty()
    assert gone.state.symbols.where("name = 'fresh'").isEmpty()
    assert gone.state.file_contents.count() == base.state.file_contents.count()
    empty = synced.delete_repo("lamps")
    assert empty.state.ref_files.isEmpty() and empty.state.chunks.isEmpty()
    assert [r.name for r in empty.repos.collect()] == ["empty"]
    queued = base.refresh("lamps", "new").repo_refs.where("ref = 'new'").first()
    assert queued.stage == "queued" and queued.id is not None
    renamed = base.update_repo("lamps", remote_url="x").repos.where("name = 'lamps'").first()
    assert renamed.remote_url == "x"
    for missing in (base.refresh("no", "x"), base.delete_repo("no"), base.delete_version("no", "x"), base.update_repo("no")):
        assert missing == 'Repository "no" not found.'


def test_paths_are_decided_without_texts(spark):
    import re

    from folioscope.plans.indexing import index_ref
    from folioscope.queries.streams import empty_state

    rows = [("a", "en", "one"), ("a", "en", "one"), ("b", "en", "one"), ("c", "de", "two"), ("c", "de", "two")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    added = index_ref(files, 1, empty_state(spark)).added
    plan = added.ref_files._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"max_by\(struct\([^)]*\bcontent\b", plan)
    assert sorted(r.path for r in added.ref_files.collect()) == ["a", "b", "c"]
    assert sorted((r.content, r.start_line) for r in added.chunks.collect()) == [("one", 1), ("two", 1)]
