"""Index one version of a file tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from folioscope.functions import text as text_fn
from folioscope.operators import chunking, ingest, maintain
from folioscope.operators.parsing import symbols as parsing
from folioscope.sources import embedding as providers


@dataclass
class IndexState:
    """Tables of everything indexed so far."""

    file_contents: DataFrame
    ref_files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    chunks: DataFrame


@dataclass
class IndexResult:
    state: IndexState
    skipped: DataFrame
    language_stats: DataFrame
    new_contents: DataFrame
    added: IndexState  # the rows of this run alone


def index_ref(
    files: DataFrame,
    repo_ref_id: int,
    state: IndexState,
    embedder: providers.Embedder | None = None,
    max_tokens: int = chunking.MAX_TOKENS,
    overlap: float = chunking.OVERLAP,
    hold: Callable[[DataFrame], DataFrame] = lambda df: df,
    max_bytes: int | None = None,
    max_average_line: int | None = None,
) -> IndexResult:
    """Add the files (path, language, content) of a ref to the index.

    Every file is indexed unless a limit is given; ``skipped`` lists what a limit left
    out. Of a path that occurs twice the last row wins, by ``ordinal`` if the files have
    that column, else by content.

    Known contents are left out by an anti join before any file is parsed, and
    chunks whose text was embedded before take that vector. Several tables share
    the new texts and symbols; ``hold`` may persist or checkpoint those.
    """
    named = hold(ingest.with_content_id(files))
    order = "ordinal" if "ordinal" in files.columns else "content_id"
    # Texts are hashed and measured once; what decides about paths travels without them.
    measured = ingest.split_skipped(named, max_bytes=max_bytes, max_average_line=max_average_line)
    slim = measured.select("path", "language", "content_id", "skip_reason", F.col(order).alias("_order"))
    once = ingest.last_write_per_path(slim.withColumn("repo_ref_id", F.lit(repo_ref_id).cast("long")), "_order")
    marked = hold(once.drop("_order").withColumn("ordinal", F.col("path")))
    stats = ingest.language_stats(marked, ["repo_ref_id"])
    skipped = marked.where(F.col("skip_reason").isNotNull()).select("path", "skip_reason")
    kept = marked.where(F.col("skip_reason").isNull()).drop("skip_reason", "repo_ref_id")

    contents = ingest.new_contents(kept, state.file_contents)
    texts = named.select(F.col("path").alias("ordinal"), "language", "content_id", "content")
    # A path may bring the same text twice; the join has sorted the rows by its key.
    fresh = hold(
        ingest.first_copies(texts, contents).dropDuplicates(["ordinal", "content_id"])
        .select("content_id", "language", "content")
    )
    found, used = (hold(df) for df in parsing.parse_files(fresh))
    pieces = chunking.chunk_files(
        fresh, found, chunking.import_prefix(used), max_tokens, overlap
    ).withColumn("content_sha256", text_fn.content_hash(F.col("content")))
    # The embedder reads the texts, and its vectors join them.
    cached = hold(ingest.reuse_vectors(
        pieces.withColumn("embedding", F.lit(None).cast("array<float>")),
        state.chunks.withColumn("chunk_id", F.struct("content_id", "start_line", "end_line")),
    ).withColumn("embedding_error", F.lit(None).cast("string")))

    columns = state.chunks.columns
    chunks = maintain.delete_keys(state.chunks, contents, ["content_id"]).unionByName(
        cached.select(*columns)
    )
    if embedder is not None:
        chunks = providers.embed_chunks(chunks, embedder)

    own = kept.select(
        F.lit(repo_ref_id).cast("long").alias("repo_ref_id"), "path", "content_id"
    )
    others = state.ref_files.where(F.col("repo_ref_id") != repo_ref_id)
    fresh_chunks = cached.select(*columns)
    if embedder is not None:
        fresh_chunks = chunks.join(contents.select("content_id"), "content_id", "left_semi")
    added = IndexState(
        contents.select("content_id", "language"), own, found.select(*state.symbols.columns),
        used.select(*state.imports.columns), fresh_chunks.select(*columns),
    )
    return IndexResult(
        IndexState(
            state.file_contents.unionByName(contents.select("content_id", "language")),
            others.unionByName(own),
            state.symbols.unionByName(found.select(*state.symbols.columns)),
            state.imports.unionByName(used.select(*state.imports.columns)),
            chunks,
        ),
        skipped,
        stats,
        contents,
        added,
    )


def without_orphans(state: IndexState) -> IndexState:
    """The index without contents no file uses, and without their children."""
    swept = maintain.sweep_orphans(
        state.file_contents,
        state.ref_files,
        {"symbols": state.symbols, "imports": state.imports, "chunks": state.chunks},
    )
    return IndexState(
        swept["file_contents"], state.ref_files, swept["symbols"], swept["imports"],
        swept["chunks"],
    )
