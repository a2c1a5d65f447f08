import subprocess

import pytest
from pyspark.sql import functions as F

from folioscope.functions import paths
from folioscope.sources import embedding, files, git


def run(folder, *arguments):
    subprocess.run(["git", "-C", str(folder), *arguments], check=True, capture_output=True)


@pytest.fixture(scope="module")
def mirror(tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    run(work, "init", "-q", "-b", "main")
    run(work, "config", "user.email", "dev@example.com")
    run(work, "config", "user.name", "Dev")
    (work / "src").mkdir()
    (work / "src" / "a b.ts").write_text("export const a = 1;\n")
    (work / "é.md").write_text("# Title\n")
    run(work, "add", "-A")
    run(work, "commit", "-q", "-m", "one")
    run(work, "tag", "v1.0.0")
    (work / "src" / "c.py").write_text("x = 1\n")
    run(work, "add", "-A")
    run(work, "commit", "-q", "-m", "two")
    run(work, "branch", "next")
    return git.sync_mirror(str(work), str(tmp_path_factory.mktemp("mirrors")), "demo")


def test_tree_and_refs(spark, mirror):
    first, last = git.resolve_commit(mirror, "v1.0.0"), git.resolve_commit(mirror, "main")
    listed = git.tree(spark, mirror, first, content=False, shares=3)
    assert sorted(r.path for r in listed.collect()) == ["src/a b.ts", "é.md"]
    content = files.text_files(git.tree(spark, mirror, last), "/nowhere")
    assert {r.path: r.content for r in content.collect()} == {
        "src/a b.ts": "export const a = 1;\n", "é.md": "# Title\n", "src/c.py": "x = 1\n",
    }
    names = [(r.kind, r.ref) for r in git.refs(spark, mirror).collect()]
    assert names == [("branch", "main"), ("branch", "next"), ("tag", "v1.0.0")]
    assert git.refs(spark, mirror + "-gone").isEmpty()
    assert git.read_file(mirror, last, "src/c.py") == "x = 1\n"
    assert git.read_file(mirror, first, "src/c.py") is None
    assert git.sync_mirror("unused", mirror.rsplit("/", 1)[0], "demo") == mirror
    assert git.token_variable("git-lab.example.com") == "GIT_TOKEN_GIT_LAB_EXAMPLE_COM"


def test_text_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_bytes(b"let a\x00 = 1;")
    (tmp_path / "src" / "b.png").write_bytes(b"\xff\xfe")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "c.ts").write_text("no")
    found = files.text_files(files.binary_files(spark, str(tmp_path)), str(tmp_path))
    kept = files.source_files(found, ["**"], paths.ignore_rules()).collect()
    assert [(r.path, r.language, r.content) for r in kept] == [("src/a.ts", "typescript", "let a = 1;")]


def flaky():
    """A provider that fails on some texts; local, so that workers get it by value."""

    class Flaky:
        max_input_tokens = 100

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no bad words")
            return [[float(len(t)), 1.0] for t in texts]

    return Flaky()


def test_failed_batches_are_tried_text_by_text(spark):
    rows = [(i, "bad" if i == 3 else "x" * (i % 5), None) for i in range(20)]
    chunks = spark.createDataFrame(rows, "id long, content string, embedding array<float>")
    chunks = chunks.withColumn("content_sha256", F.sha2("content", 256)).withColumn(
        "embedding_error", F.lit(None).cast("string")
    )
    done = {r.id: r for r in embedding.embed_chunks(chunks, flaky(), batch=4).collect()}
    assert len(done) == 20
    assert done[3].embedding is None and done[3].embedding_error == "no bad words"
    assert all(done[i].embedding == [float(i % 5), 1.0] for i in done if i != 3)


def test_request_shapes():
    local = embedding.HttpEmbedder("http://host:1/", "m").request(["a"])
    assert local.full_url == "http://host:1/api/embed" and b'"truncate": true' in local.data
    hosted = embedding.HttpEmbedder("http://host/v1", "m", "key", 768).request(["a"])
    assert hosted.full_url == "http://host/v1/embeddings"
    assert hosted.headers["Authorization"] == "Bearer key" and b'"dimensions": 768' in hosted.data
    answer = {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert embedding.HttpEmbedder.vectors(answer) == [[1.0], [2.0]]
    assert embedding.check_dimension(embedding.HashingEmbedder(8), 8) is None
    assert "8 dimensions" in embedding.check_dimension(embedding.HashingEmbedder(8), 9)
    assert embedding.check_dimension(flaky(), 2) is None


def test_long_texts_go_in_windows_and_are_pooled(spark):
    """No character is lost between windows, and the pooled vector has length one."""
    text = "\n".join("y" * n for n in (10, 200, 7, 299, 301, 900))
    parts = embedding.windows(text, 100)
    assert "".join(parts) == text and all(len(p) <= 300 for p in parts) and len(parts) > 4
    assert embedding.windows(text, None) == [text]
    chunks = spark.createDataFrame([(1, text, None)], "id long, content string, embedding array<float>")
    chunks = chunks.withColumn("content_sha256", F.sha2("content", 256)).withColumn(
        "embedding_error", F.lit(None).cast("string")
    )
    vector = embedding.embed_chunks(chunks, flaky(), batch=2).first()["embedding"]
    sums = (float(len(text)), float(len(parts)))
    length = (sums[0] ** 2 + sums[1] ** 2) ** 0.5
    assert all(abs(v - s / length) < 1e-6 for v, s in zip(vector, sums))


def test_hashes_of_words_are_remembered_within_bounds(monkeypatch):
    import hashlib
    import math

    monkeypatch.setattr(embedding._Places, "MEMORY", 3)
    monkeypatch.setattr(embedding, "_places", {})
    text = "Aa bb_1 aa é " + "x" * 100 + " cc dd aa"
    sums = [0.0] * 4
    for word in text.lower().split():
        digest = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        sums[(digest >> 1) % 4] += 1.0 if digest & 1 else -1.0
    length = math.sqrt(sum(v * v for v in sums))
    embedder = embedding.HashingEmbedder(4)
    assert embedder.embed([text, " .."]) == [[v / length for v in sums], [0.0] * 4]
    assert len(embedding._places[4]) <= 3 and "x" * 100 not in embedding._places[4]


def test_the_embedder_takes_arrow_batches(spark):
    rows = spark.createDataFrame([("h", "a b", None)], "content_sha256 string, content string, embedding array<float>")
    plan = embedding.embed_chunks(rows, embedding.HashingEmbedder(4))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
