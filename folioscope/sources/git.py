"""Git trees and refs as Spark data sources, and the few commands around them.

The mirror folder must be visible to the executors. Every task lists the tree by
itself and reads the share of blobs whose hash falls to it, so neither names nor
contents pass through the driver and a crowded folder spreads over all tasks.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.session import ship_package

TREE_SCHEMA = "path string, blob string, content binary"
REFS_SCHEMA = "kind string, ref string, commit_sha string"


def _git(mirror: str, *arguments: str) -> bytes:
    command = ["git", "-C", mirror, "-c", "safe.directory=*", *arguments]
    return subprocess.run(command, check=True, capture_output=True).stdout


class Share(InputPartition):
    def __init__(self, number: int, of: int):
        super().__init__(number)
        self.number, self.of = number, of


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.mirror = options["mirror"]
        self.commit = options["commit"]
        self.with_content = options.get("content", "true") == "true"
        self.shares = int(options.get("shares", "8"))

    def partitions(self):
        return [Share(i, self.shares) for i in range(self.shares)]

    def read(self, share: Share) -> Iterator[tuple]:
        listing = _git(self.mirror, "ls-tree", "-r", "-z", self.commit).split(b"\0")
        mine = []
        for entry in filter(None, listing):
            meta, path = entry.split(b"\t", 1)
            _mode, kind, blob = meta.decode().split()
            if kind == "blob" and int(blob[:8], 16) % share.of == share.number:
                mine.append((path.decode("utf-8", "replace"), blob))
        if not self.with_content:
            yield from ((path, blob, None) for path, blob in mine)
            return
        process = subprocess.Popen(
            ["git", "-C", self.mirror, "-c", "safe.directory=*", "cat-file", "--batch"],
            stdin=subprocess.PIPE, stdout=subprocess.PIPE,
        )
        try:
            for path, blob in mine:
                process.stdin.write(blob.encode() + b"\n")
                process.stdin.flush()
                size = int(process.stdout.readline().split()[2])
                content = process.stdout.read(size)
                process.stdout.read(1)
                yield path, blob, content
        finally:
            process.stdin.close()
            process.wait()


class RefsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.mirror = options["mirror"]

    def read(self, partition) -> Iterator[tuple]:
        if not os.path.isdir(self.mirror):
            return
        listed = _git(
            self.mirror, "for-each-ref", "--format=%(refname) %(objectname)",
            "refs/heads/", "refs/tags/",
        )
        for line in listed.decode().splitlines():
            name, commit = line.rsplit(" ", 1)
            kind = "branch" if name.startswith("refs/heads/") else "tag"
            yield kind, name.split("/", 2)[2], commit


class GitTree(DataSource):
    @classmethod
    def name(cls):
        return "git_tree"

    def schema(self):
        return TREE_SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


class GitRefs(DataSource):
    @classmethod
    def name(cls):
        return "git_refs"

    def schema(self):
        return REFS_SCHEMA

    def reader(self, schema):
        return RefsReader(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(GitTree)
    spark.dataSource.register(GitRefs)


def tree(spark: SparkSession, mirror: str, commit: str, content: bool = True, shares: int = 8) -> DataFrame:
    """Files of a commit; without content only names and blob hashes are read."""
    register(spark)
    reader = spark.read.format("git_tree").option("mirror", mirror).option("commit", commit)
    reader = reader.option("content", str(content).lower()).option("shares", str(shares))
    return reader.load()


def refs(spark: SparkSession, mirror: str) -> DataFrame:
    """Branches and tags by name; a mirror that does not exist has none."""
    register(spark)
    return spark.read.format("git_refs").option("mirror", mirror).load().orderBy("kind", "ref")


def resolve_commit(mirror: str, ref: str) -> str:
    return _git(mirror, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def read_file(mirror: str, commit: str, path: str) -> str | None:
    """One file at a commit, or None when anything about it is missing."""
    try:
        return _git(mirror, "show", f"{commit}:{path}").decode("utf-8", "replace")
    except (subprocess.CalledProcessError, OSError):
        return None


def token_variable(host: str) -> str:
    return "GIT_TOKEN_" + re.sub(r"[.-]", "_", host).upper()


def sync_mirror(source: str, folder: str, name: str) -> str:
    """Fetch a bare mirror, cloning it first; remote clones leave out blobs."""
    mirror = os.path.join(folder, f"{name}.git")
    if os.path.isdir(mirror):
        _git(mirror, "fetch", "--prune", "origin")
        return mirror
    os.makedirs(folder, exist_ok=True)
    remote = re.match(r"^https?://", source) or "@" in source
    extra = ["--filter=blob:none"] if remote else []
    subprocess.run(
        ["git", "-c", "safe.directory=*", "clone", "--bare", *extra, source, mirror],
        check=True, capture_output=True, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"},
    )
    _git(mirror, "config", "remote.origin.fetch", "+refs/*:refs/*")
    return mirror
