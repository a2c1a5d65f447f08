"""Table schemas. Content is addressed by its SHA-256, so the hash is the key."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS = T.TimestampNTZType()

REPOS = _struct(
    ("id", _L, False),
    ("name", _S, False),
    ("local_path", _S, True),
    ("remote_url", _S, True),
    ("glob_patterns", T.ArrayType(_S), False),
    ("created_at", _TS, False),
)

REPO_REFS = _struct(
    ("id", _L, False),
    ("repo_id", _L, False),
    ("ref", _S, False),
    ("commit_sha", _S, False),
    ("stage", _S, False),
    ("stage_message", _S, True),
    ("semver", _S, True),
    ("indexed_at", _TS, True),
    ("indexing_started_at", _TS, True),
    ("language_stats", T.MapType(_S, _D), True),
    ("files_total", _I, False),
    ("files_processed", _I, False),
    ("chunks_total", _I, False),
    ("chunks_embedded", _I, False),
    ("indexing_error", _S, True),
)

FILE_CONTENTS = _struct(("content_id", _S, False), ("language", _S, True))

REF_FILES = _struct(("repo_ref_id", _L, False), ("path", _S, False), ("content_id", _S, False))

SYMBOLS = _struct(
    ("content_id", _S, False),
    ("name", _S, False),
    ("kind", _S, False),
    ("signature", _S, False),
    ("start_line", _I, False),
    ("end_line", _I, False),
    ("documentation", _S, True),
)

CHUNKS = _struct(
    ("content_id", _S, False),
    ("symbol_name", _S, True),
    ("content", _S, False),
    ("content_sha256", _S, True),
    ("start_line", _I, False),
    ("end_line", _I, False),
    ("embedding", T.ArrayType(T.FloatType()), True),
    ("embedding_error", _S, True),
)

IMPORTS = _struct(
    ("content_id", _S, False),
    ("source", _S, False),
    ("names", T.ArrayType(_S), False),
    ("default_name", _S, True),
    ("is_namespace", _I, False),
)

INDEX_JOB = _struct(("repo", _S, False), ("ref", _S, False), ("commit_sha", _S, True))

# Fixed values of the data model.
LANGUAGES = (
    "typescript", "javascript", "python", "go", "java", "kotlin", "rust", "c", "cpp", "markdown",
)
SYMBOL_KINDS = (
    "function", "class", "method", "interface", "type", "enum", "variable", "struct", "trait",
    "object", "namespace", "module", "heading",
)
STAGES = (
    "queued", "syncing", "resolving", "checking-out", "diffing", "processing-files", "embedding",
    "finalizing", "ready", "error",
)
TERMINAL_STAGES = ("ready", "error")
CONTEXT_STRATEGIES = ("explain", "implement", "debug", "recent-changes")
CHANGE_TYPES = ("added", "modified", "deleted")
