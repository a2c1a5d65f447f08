"""An engine whose writes are stored, so each one is made once and costs what it adds.

A write is a generation. It appends what is new: rows of new contents and of their children, the
paths of the ref it brought, and the contents that no ref uses any more. A marker, written last, says
which tables the generation wrote; until then no reader sees it, and the next write of that number
overwrites what it left. Paths of a ref are those of the generation that brought them last (`heads`),
so a ref is replaced without touching the rows of others. The small tables of repositories and refs
are written whole.

Every call after a write reads plain tables: its plan does not grow with the number of writes, and
parser and embedder do not run again. `compact` rewrites the live rows as one generation. One writer
at a time; an engine opened before a write keeps its generation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscope.functions import versions
from folioscope.operators import maintain
from folioscope.plans.engine import Engine
from folioscope.plans.indexing import IndexState, index_ref
from folioscope.schemas import CHUNKS, FILE_CONTENTS, IMPORTS, REF_FILES, REPO_REFS, REPOS, SYMBOLS
from folioscope.sources import embedding as providers

_CONTENTS = {"file_contents": FILE_CONTENTS, "symbols": SYMBOLS, "imports": IMPORTS, "chunks": CHUNKS}
_HEADS = "repo_ref_id long, written int"


def _with_generation(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("gen", IntegerType())])


class IndexStore:
    """The tables of a folder as of a generation."""

    def __init__(self, spark: SparkSession, folder: str, generation: int | None = None):
        self.spark, self.folder = spark, folder
        self.wrote = self._markers(generation)
        self.generation = max(self.wrote, default=0)

    def _markers(self, last: int | None) -> dict[int, set[str]]:
        """The tables that each generation since the last compaction wrote."""
        reader = self.spark.read.schema("tables string, base boolean, gen int")
        try:
            rows = reader.parquet(f"{self.folder}/ready").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        rows = [row for row in rows if last is None or row.gen <= last]
        base = max((row.gen for row in rows if row.base), default=0)
        return {row.gen: set(row.tables.split(",")) for row in rows if row.gen >= base}

    def _read(self, name: str, schema: StructType | str, last: bool = False) -> DataFrame:
        """Rows of all generations that wrote a table, or of the last of them."""
        gens = [gen for gen, tables in self.wrote.items() if name in tables]
        if not gens:
            return self.spark.createDataFrame([], schema).withColumn("gen", F.lit(0))
        if isinstance(schema, str):
            schema = self.spark.createDataFrame([], schema).schema
        rows = self.spark.read.schema(_with_generation(schema)).parquet(f"{self.folder}/{name}")
        return rows.where(F.col("gen").isin([max(gens)] if last else gens))

    def whole(self, name: str, schema: StructType | str) -> DataFrame:
        """A small table that is written whole."""
        return self._read(name, schema, last=True).drop("gen")

    def state(self) -> IndexState:
        tables = {name: self._read(name, schema) for name, schema in _CONTENTS.items()}
        if any("gone" in written for written in self.wrote.values()):
            # A content that went may come back later.
            gone = self._read("gone", "content_id string").groupBy("content_id").agg(F.max("gen").alias("_gone"))
            for name, rows in tables.items():
                left = rows.join(gone, "content_id", "left").where("_gone is null or gen > _gone")
                tables[name] = left.drop("_gone")
        heads = self.whole("heads", _HEADS).withColumnRenamed("written", "gen")
        files = self._read("ref_files", REF_FILES).join(heads, ["repo_ref_id", "gen"], "left_semi")
        rows = {name: rows.select(*_CONTENTS[name].names) for name, rows in tables.items()}
        return IndexState(ref_files=files.select(*REF_FILES.names), **rows)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of the next generation; its rows as stored."""
        place = f"{self.folder}/{name}/gen={self.generation + 1}"
        rows.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def commit(self, names: set[str], base: bool = False) -> IndexStore:
        """Make the next generation visible."""
        row = self.spark.createDataFrame([(",".join(sorted(names)), base)], "tables string, base boolean")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ready/gen={self.generation + 1}")
        return IndexStore(self.spark, self.folder)


class StoredEngine(Engine):
    """The engine over an `IndexStore`; a write returns the engine of the next generation."""

    def __init__(
        self, spark: SparkSession, folder: str, embedder: providers.Embedder | None = None,
        mirrors: str | None = None, generation: int | None = None,
    ):
        self.store = IndexStore(spark, folder, generation)
        repos, refs = self.store.whole("repos", REPOS), self.store.whole("repo_refs", REPO_REFS)
        super().__init__(spark, repos, refs, self.store.state(), embedder, mirrors)

    @classmethod
    def create(cls, repos: DataFrame, folder: str, embedder: providers.Embedder | None = None) -> StoredEngine:
        """A new index without refs of some repositories."""
        spark = repos.sparkSession
        store = IndexStore(spark, folder)
        store.write("repos", repos.select(*REPOS.names))
        store.commit({"repos"})
        return cls(spark, folder, embedder)

    def _next(self, tables: dict[str, DataFrame], written: set[str], base: bool = False) -> StoredEngine:
        """Write what is not written yet and the marker."""
        for name, rows in tables.items():
            self.store.write(name, rows)
        self.store.commit(set(tables) | written, base)
        return StoredEngine(self.spark, self.store.folder, self.embedder, self.mirrors)

    def _with(self, **tables: DataFrame) -> StoredEngine:
        """Updates of the small tables, as the plain engine makes them (`refresh`, `update_repo`)."""
        small = {name: tables[name] for name in ("repos", "repo_refs") if name in tables}
        return self._next(small, set())

    def _unused(self, before: DataFrame, files: DataFrame) -> DataFrame:
        """Contents of some paths that no path uses any more."""
        used = files.select("content_id").distinct()
        return before.select("content_id").distinct().join(used, "content_id", "left_anti")

    def _heads(self) -> DataFrame:
        return self.store.whole("heads", _HEADS)

    def sync_ref(
        self, repo: str, ref: str, commit_sha: str, files: DataFrame, **limits: int | None
    ) -> StoredEngine | str:
        """Index the files (path, language, content) of a ref, store them and make it searchable."""
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        queued, number = self._queued(row["id"], ref)
        held: list[DataFrame] = []

        def hold(frame: DataFrame) -> DataFrame:
            held.append(frame.persist())
            return held[-1]

        try:
            result = index_ref(files, number, self.state, hold=hold, **limits)
            added = vars(result.added)
            # Only chunks of new contents go to the embedder, and only in this write.
            added["chunks"] = providers.embed_chunks(added["chunks"], self.embedder).select(*CHUNKS.names)
            stored = {name: self.store.write(name, rows) for name, rows in added.items()}
            stats = result.language_stats.select("language_stats").first()
        finally:
            for frame in held:
                frame.unpersist()
        own = stored["ref_files"]
        before = self.state.ref_files
        others = before.where(F.col("repo_ref_id") != number)
        gone = self._unused(before.where(F.col("repo_ref_id") == number), others.unionByName(own))
        heads = maintain.delete_where(self._heads(), F.col("repo_ref_id") == number)
        now = self.spark.createDataFrame([(number, self.store.generation + 1)], _HEADS)
        chunks = self.state.chunks.select("content_id", "embedding").unionByName(
            stored["chunks"].select("content_id", "embedding")
        )
        pieces = chunks.join(own.select("content_id").distinct(), "content_id", "left_semi").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.count("embedding").cast("int").alias("embedded")
        ).first()
        values = self._ready(ref, commit_sha, own.count(), pieces.n, pieces.embedded, stats and stats[0])
        mine = (F.col("repo_id") == row["id"]) & (F.col("ref") == ref)
        tables = {
            "gone": gone, "heads": heads.unionByName(now),
            "repo_refs": maintain.update_where(queued, mine, values).select(*REPO_REFS.names),
        }
        return self._next(tables, set(stored))

    def _queued(self, repo_id: int, ref: str) -> tuple[DataFrame, int]:
        """The refs with one in the queue, and its number."""
        asked = self.spark.createDataFrame([(repo_id, ref)], "repo_id long, ref string")
        highest = self.repo_refs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        queued = maintain.queue_refs(self.repo_refs, asked)
        queued = queued.withColumn("id", F.coalesce("id", F.lit(highest + 1).cast("long")))
        own = (F.col("repo_id") == repo_id) & (F.col("ref") == ref)
        return queued, queued.where(own).first()["id"]

    @staticmethod
    def _ready(ref: str, commit: str, files: int, chunks: int, embedded: int, stats: dict | None) -> dict:
        shares = F.lit(None)
        if stats:
            shares = F.create_map(*[F.lit(x) for pair in sorted(stats.items(), key=str) for x in pair])
        return {
            "commit_sha": F.lit(commit),
            "stage": F.lit("ready"),
            "stage_message": F.lit(None).cast("string"),
            "semver": versions.clean_version(F.lit(ref)),
            "indexed_at": F.localtimestamp(),
            "language_stats": shares.cast("map<string,double>"),
            "files_total": F.lit(files),
            "files_processed": F.lit(files),
            "chunks_total": F.lit(chunks),
            "chunks_embedded": F.lit(embedded),
        }

    def delete_version(self, repo: str, ref: str) -> StoredEngine | str:
        """Remove a ref, its paths, and contents that no other ref uses."""
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        own = (F.col("repo_id") == row["id"]) & (F.col("ref") == ref)
        if self.repo_refs.where(own).isEmpty():
            return f'Ref "{ref}" not found for "{repo}".'
        return self._without(self.repo_refs.where(own), {})

    def delete_repo(self, repo: str) -> StoredEngine | str:
        """Remove a repository with its refs, their paths and contents nobody else uses."""
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        left = maintain.delete_where(self.repos, F.col("id") == row["id"])
        return self._without(self.repo_refs.where(F.col("repo_id") == row["id"]), {"repos": left})

    def _without(self, refs: DataFrame, tables: dict[str, DataFrame]) -> StoredEngine:
        doomed = refs.select(F.col("id").alias("repo_ref_id"))
        files = self.state.ref_files
        left = maintain.delete_keys(files, doomed, ["repo_ref_id"])
        tables |= {
            "gone": self._unused(files.join(doomed, "repo_ref_id", "left_semi"), left),
            "heads": maintain.delete_keys(self._heads(), doomed, ["repo_ref_id"]),
            "repo_refs": maintain.delete_keys(self.repo_refs, refs, ["id"]),
        }
        return self._next(tables, set())

    def compact(self) -> StoredEngine:
        """Rewrite the live rows as one generation; older ones are no longer read."""
        number = self.store.generation + 1
        heads = self._heads().select("repo_ref_id", F.lit(number).alias("written"))
        tables = {**vars(self.state), "heads": heads, "repos": self.repos, "repo_refs": self.repo_refs}
        return self._next(tables, set(), base=True)
