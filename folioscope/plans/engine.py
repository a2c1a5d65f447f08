"""The engine's interface: every tool as a method that returns a DataFrame.

Things that are not found come back as a message, not as an exception.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import text as text_fn
from folioscope.functions import versions
from folioscope.operators import context, lookup, maintain, postings, refs, search
from folioscope.plans.indexing import IndexState, index_ref, without_orphans
from folioscope.schemas import CONTEXT_STRATEGIES
from folioscope.sources import embedding as providers
from folioscope.sources import git

LANGUAGE_TOOLS = ("search_code", "get_symbol", "find", "list_repos")

# The opening lines of the three prompts.
PROMPTS = {
    "explain-library": (
        "Explain the architecture and key concepts of {topic}.",
        "Use the following indexed code context:",
    ),
    "implement-feature": (
        "I want to implement: {topic}",
        "Follow the existing patterns in the codebase. Here is the relevant context:",
    ),
    "debug-issue": (
        "I'm debugging this issue: {topic}",
        "Here is the relevant code context:",
    ),
}
NO_CONTEXT = "(no context available)"


@dataclass(frozen=True)
class ResolvedRef:
    repo_id: int
    repo: str
    id: int
    ref: str
    commit_sha: str


def with_defaults(
    tool: str, arguments: dict, languages: Sequence[str] | None, threshold: float | None
) -> dict:
    """Add detected languages where a tool takes them and the caller gave none.

    A threshold of 0 counts as not given.
    """
    result = dict(arguments)
    if tool in LANGUAGE_TOOLS:
        if languages and not result.get("languages"):
            result["languages"] = list(languages)
        if threshold is not None and not result.get("threshold"):
            result["threshold"] = threshold
    return result


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        repos: DataFrame,
        repo_refs: DataFrame,
        state: IndexState,
        embedder: providers.Embedder | None = None,
        mirrors: str | None = None,
        words: postings.WordIndex | None = None,
    ):
        """``words`` is the persisted word index of the chunks; without it a search reads texts."""
        self.words = words
        self.spark, self.repos, self.repo_refs, self.state = spark, repos, repo_refs, state
        self.embedder = embedder or providers.HashingEmbedder()
        self.mirrors = mirrors

    # --- resolution: one row each, so it may run on the driver --------------------

    def find_repo(self, name: str):
        return self.repos.where(F.col("name") == name).orderBy("id").first()

    def resolve(self, repo: str, ref: str | None = None) -> ResolvedRef | str:
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        own = self.repo_refs.where(F.col("repo_id") == row["id"])
        found = (refs.resolve_ref(own, ref) if ref else refs.latest_ready(own)).first()
        if found is None:
            if ref:
                return f'Ref "{ref}" not found for "{repo}".'
            return f'No indexed refs found for "{repo}".'
        return ResolvedRef(row["id"], repo, found["id"], found["ref"], found["commit_sha"])

    def _files(self) -> DataFrame:
        languages = self.state.file_contents.select("content_id", "language")
        return self.state.ref_files.join(languages, "content_id")

    def _named_refs(self) -> DataFrame:
        names = self.repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
        return self.repo_refs.join(names, "repo_id").select(
            F.col("id").alias("repo_ref_id"), "repo", "ref", "stage"
        )

    # --- writes: each returns an engine on the new tables, without a word index ------

    def index_words(self, folder: str) -> Engine:
        """Write the word index of all chunks; searches of the new engine read it."""
        key = ["content_id", "start_line", "end_line"]
        postings.write_index(self.state.chunks.select(*key, "content"), key, folder)
        return Engine(
            self.spark, self.repos, self.repo_refs, self.state, self.embedder, self.mirrors,
            postings.read_index(self.spark, folder),
        )

    def _with(self, **tables: DataFrame) -> Engine:
        state = {n: tables.pop(n, t) for n, t in vars(self.state).items()}
        return Engine(
            self.spark, tables.pop("repos", self.repos), tables.pop("repo_refs", self.repo_refs),
            IndexState(**state), self.embedder, self.mirrors,
        )

    def refresh(self, repo: str, ref: str) -> Engine | str:
        """Put a ref into the queue: a new row, or its progress reset."""
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        asked = self.spark.createDataFrame([(row["id"], ref)], "repo_id long, ref string")
        queued = maintain.queue_refs(self.repo_refs, asked)
        highest = self.repo_refs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # One ref is asked for, so at most one row is new.
        return self._with(repo_refs=queued.withColumn("id", F.coalesce("id", F.lit(highest + 1))))

    def sync_ref(
        self, repo: str, ref: str, commit_sha: str, files: DataFrame, **limits: int | None
    ) -> Engine | str:
        """Index the files (path, language, content) of a ref and make it searchable.

        The row of the ref gets its commit, counters, language shares, version and time and
        turns ready; contents that no ref uses any more leave with their children.
        """
        queued = self.refresh(repo, ref)
        if isinstance(queued, str):
            return queued
        row = self.find_repo(repo)
        own = (F.col("repo_id") == row["id"]) & (F.col("ref") == ref)
        number = queued.repo_refs.where(own).first()["id"]
        result = index_ref(files, number, self.state, self.embedder, **limits)
        state = without_orphans(result.state)
        paths = state.ref_files.where(F.col("repo_ref_id") == number)
        pieces = state.chunks.join(paths.select("content_id").distinct(), "content_id", "left_semi")
        total = paths.agg(F.count("*").cast("int").alias("n")).select("n").scalar()
        counted = pieces.agg(
            F.struct(
                F.count("*").cast("int").alias("all"),
                F.count_if(F.col("embedding").isNotNull()).cast("int").alias("embedded"),
            ).alias("n")
        ).select("n").scalar()
        stats = result.language_stats.select("language_stats").scalar()
        values = {
            "commit_sha": F.lit(commit_sha),
            "stage": F.lit("ready"),
            "stage_message": F.lit(None).cast("string"),
            "semver": versions.clean_version(F.lit(ref)),
            "indexed_at": F.localtimestamp(),
            "language_stats": stats,
            "files_total": total,
            "files_processed": total,
            "chunks_total": counted["all"],
            "chunks_embedded": counted["embedded"],
        }
        known = {c: v for c, v in values.items() if c in queued.repo_refs.columns}
        done = maintain.update_where(queued.repo_refs, own, known)
        return self._with(repo_refs=done, **vars(state))

    def delete_version(self, repo: str, ref: str) -> Engine | str:
        """Remove a ref, its paths, and contents that no other ref uses."""
        row = self.find_repo(repo)
        own = None if row is None else (F.col("repo_id") == row["id"]) & (F.col("ref") == ref)
        found = None if own is None else self.repo_refs.where(own).first()
        if found is None:
            return f'Ref "{ref}" not found for "{repo}".' if row else f'Repository "{repo}" not found.'
        s = self.state
        left = maintain.delete_where(s.ref_files, F.col("repo_ref_id") == found["id"])
        swept = without_orphans(IndexState(**vars(s) | {"ref_files": left}))
        return self._with(repo_refs=maintain.delete_where(self.repo_refs, own), **vars(swept))

    def delete_repo(self, repo: str) -> Engine | str:
        """Remove a repository with its refs, their paths and contents nobody else uses."""
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        s = self.state
        left = maintain.cascade_delete_repo(row["id"], self.repos, self.repo_refs, s.ref_files)
        swept = without_orphans(IndexState(**vars(s) | {"ref_files": left["ref_files"]}))
        return self._with(repos=left["repos"], repo_refs=left["repo_refs"], **vars(swept))

    def update_repo(self, repo: str, **values: object) -> Engine | str:
        """Set columns of a repository, such as remote_url or glob_patterns."""
        if self.find_repo(repo) is None:
            return f'Repository "{repo}" not found.'
        kinds = {f.name: f.dataType for f in self.repos.schema.fields}
        columns = {c: F.lit(v).cast(kinds[c]) for c, v in values.items()}
        return self._with(repos=maintain.update_where(self.repos, F.col("name") == repo, columns))

    # --- search -------------------------------------------------------------------

    def search_code(
        self,
        query: str,
        repo: str | None = None,
        ref: str | None = None,
        limit: int | None = None,
        languages: Sequence[str] | None = None,
        paths: Sequence[str] | None = None,
    ) -> DataFrame | str:
        """Hybrid search. A ref is resolved when its repository is known, else taken as is."""
        words = text_fn.rewrite_query(query)
        if words is None:
            return "No results found."
        if repo and ref:
            resolved = self.resolve(repo, ref)
            ref = ref if isinstance(resolved, str) else resolved.ref
        count = search.clamp_limit(limit)
        scope = search.in_scope(self._files(), self._named_refs(), repo, ref, languages, paths)
        vector = self.embedder.embed([words.embedding_text])[0]
        terms = search.query_terms(self.spark, words.full_text)
        found = None
        if self.words is not None:
            found = postings.score_postings(self.words.within(scope), terms)
        return search.hybrid_search(self.state.chunks, scope, terms, vector, count, words=found)

    # --- lookups ------------------------------------------------------------------

    def get_file(
        self, repo: str, path: str, ref: str | None = None, include_symbols: bool = False
    ) -> dict | str:
        """Text of a file from the mirror when there is one, else from its chunks."""
        at = self.resolve(repo, ref)
        if isinstance(at, str):
            return at
        content = None
        if self.mirrors:
            content = git.read_file(f"{self.mirrors}/{at.repo}.git", at.commit_sha, path)
        if content is None:
            row = lookup.get_file(self.state.ref_files, self.state.chunks, at.id, path).first()
            if row is None:
                return f'File "{path}" not found in {at.repo}@{at.ref}.'
            content = row["content"]
        result = {"repo": at.repo, "ref": at.ref, "path": path, "content": content}
        if include_symbols:
            owner = self.state.ref_files.where(
                (F.col("repo_ref_id") == at.id) & (F.col("path") == path)
            )
            result["symbols"] = self.state.symbols.join(
                owner.select("content_id"), "content_id", "left_semi"
            ).orderBy("start_line")
        return result

    def get_symbol(
        self,
        repo: str,
        name: str,
        ref: str | None = None,
        languages: Sequence[str] | None = None,
        include_imports: bool = False,
    ) -> dict | str:
        at = self.resolve(repo, ref)
        if isinstance(at, str):
            return at
        s = self.state
        found = lookup.get_symbol(
            s.symbols, s.file_contents, s.ref_files, s.chunks, at.id, name, languages
        )
        if found.isEmpty():
            return f'Symbol "{name}" not found in {at.repo}@{at.ref}.'
        result = {"symbols": found}
        if include_imports:
            result["imports"] = self.find_references(repo, name, at.ref)
        return result

    def find(
        self,
        repo: str,
        pattern: str,
        kind: str = "file",
        ref: str | None = None,
        languages: Sequence[str] | None = None,
    ) -> DataFrame | str:
        at = self.resolve(repo, ref)
        if isinstance(at, str):
            return at
        s = self.state
        if kind == "file":
            return lookup.find_files(s.ref_files, at.id, pattern, s.file_contents, languages)
        found = lookup.find_symbols(s.symbols, s.file_contents, s.ref_files, at.id, pattern)
        return found.where(F.col("language").isin(list(languages))) if languages else found

    def find_references(self, repo: str, name: str, ref: str | None = None) -> DataFrame | str:
        at = self.resolve(repo, ref)
        if isinstance(at, str):
            return at
        s = self.state
        return lookup.find_references(s.imports, s.file_contents, s.ref_files, at.id, name)

    def file_tree(self, repo: str, ref: str | None = None, prefix: str | None = None) -> DataFrame | str:
        at = self.resolve(repo, ref)
        return at if isinstance(at, str) else lookup.file_tree(self.state.ref_files, at.id, prefix)

    def list_repos(
        self, languages: Sequence[str] | None = None, threshold: float | None = None
    ) -> DataFrame:
        return lookup.list_repos(self.repos, self.repo_refs, languages, threshold)

    def ready_refs(self) -> DataFrame:
        return lookup.ready_refs(self.repos, self.repo_refs)

    def indexing_status(self, repo: str | None = None) -> DataFrame:
        active = lookup.active_progress(self.repos, self.repo_refs)
        return active if repo is None else active.where(F.col("repo") == repo)

    # --- context ------------------------------------------------------------------

    def build_context_pack(
        self,
        repo: str,
        strategy: str,
        query: str | None = None,
        ref: str | None = None,
        from_ref: str | None = None,
        paths: Sequence[str] | None = None,
        max_tokens: int = context.DEFAULT_BUDGET,
        hits: int = context.SEARCH_LIMIT,
    ) -> DataFrame | str:
        if strategy not in CONTEXT_STRATEGIES:
            raise ValueError(f"unknown strategy {strategy}")
        row = self.find_repo(repo)
        if row is None:
            return f'Repository "{repo}" not found.'
        if strategy == "recent-changes":
            rows = self._recent_changes(repo, from_ref, ref)
        else:
            found = self.search_code(
                query or repo, repo, ref, hits, paths=paths
            )
            rows = None if isinstance(found, str) else found.select(
                "file_path", "start_line", "end_line", "content",
                F.lit(None).cast("string").alias("annotation"),
            )
        if rows is None:
            rows = self.spark.createDataFrame(
                [], "file_path string, start_line int, end_line int, content string, annotation string"
            )
        return context.trim_to_budget(rows, max_tokens)

    def _recent_changes(self, repo: str, from_ref: str | None, to_ref: str | None):
        ends = [self.resolve(repo, r) if r else "" for r in (from_ref, to_ref)]
        if any(isinstance(e, str) for e in ends):
            return None
        changes = context.ref_diff(self.state.ref_files, ends[0].id, ends[1].id)
        return context.recent_changes(changes, self.state.chunks)

    def format_pack(self, pack: DataFrame) -> str:
        return context.format_pack(pack).first()["text"]

    def prompt(self, name: str, repo: str, query: str | None = None, ref: str | None = None) -> str:
        """Prompt text around a context pack."""
        pack = self.build_context_pack(repo, name.split("-")[0], query, ref)
        if isinstance(pack, str):
            return pack
        first, second = PROMPTS[name]
        text = self.format_pack(pack) or NO_CONTEXT
        return "\n".join([first.format(topic=query or repo), second, "", text])
