"""Small value expressions: stage labels, error texts, redaction, list parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def parse_list(text: Column, allowed: Sequence[str] | None = None) -> Column:
    """Comma list to array. With ``allowed`` the items are lower-cased and checked."""
    items = F.transform(F.split(text, ",", -1), lambda x: F.trim(x))
    if allowed is None:
        return F.filter(items, lambda x: x != "")
    return F.filter(F.transform(items, F.lower), lambda x: x.isin(list(allowed)))


def redact(text: Column, shown: int = 4) -> Column:
    return F.when(F.length(text) <= shown, F.lit("****")).otherwise(
        F.concat(F.lit("****"), F.right(text, F.lit(shown)))
    )


def valid_repo_name(name: Column) -> Column:
    bad = name.rlike(r"[/\\\x00-\x1f]") | name.isin(".", "..")
    return F.length(name).between(1, 255) & ~bad


def host_env_suffix(url: Column) -> Column:
    """Host of a remote as an environment variable suffix."""
    host = F.parse_url(url, F.lit("HOST"))
    return F.upper(F.translate(host, ".-", "__"))


def repo_name_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/:]+?)(?:\.git)?/?$", 1)


# The text shown for each stage of an index job.
STAGE_LABELS = {
    "syncing": "Cloning…",
    "resolving": "Resolving…",
    "checking-out": "Checking out…",
    "diffing": "Computing diff…",
    "processing-files": "Processing files…",
    "embedding": "Embedding…",
    "finalizing": "Finalizing…",
}
OTHER_STAGE_LABEL = "Indexing…"


def stage_label(
    stage: Column,
    files_done: Column,
    files_total: Column,
    chunks_done: Column,
    chunks_total: Column,
) -> Column:
    """Text for a stage; the two counting stages show their counters once known."""
    pairs = [F.lit(x) for item in STAGE_LABELS.items() for x in item]
    plain = F.coalesce(F.try_element_at(F.create_map(*pairs), stage), F.lit(OTHER_STAGE_LABEL))
    files = F.format_string("Processing %d/%d files…", files_done, files_total)
    chunks = F.format_string("Embedding %d/%d chunks…", chunks_done, chunks_total)
    return (
        F.when((stage == "processing-files") & (files_total > 0), files)
        .when((stage == "embedding") & (chunks_total > 0), chunks)
        .otherwise(plain)
    )


def remote_error_kind(message: Column) -> Column:
    """Class of a failed clone or fetch, by the text git prints."""
    return (
        F.when(
            message.contains("Write access to repository not granted")
            | message.contains("The requested URL returned error: 403"),
            F.lit("access-denied"),
        )
        .when(
            message.contains("terminal prompts disabled")
            | message.contains("could not read Username"),
            F.lit("credentials-missing"),
        )
        .when(
            message.contains("not found") | message.contains("does not exist"),
            F.lit("repository-missing"),
        )
        .otherwise(F.lit("other"))
    )


def language_reaches(stats: Column, languages: Sequence[str], percent: float) -> Column:
    """Does any of the languages hold at least this share? Missing stats do not."""
    if not languages:
        return F.lit(False)
    shares = [F.coalesce(F.try_element_at(stats, F.lit(x)), F.lit(0.0)) for x in languages]
    best = F.greatest(*shares) if len(shares) > 1 else shares[0]
    return F.coalesce(stats.isNotNull() & (best >= percent), F.lit(False))


def languages_by_share(stats: Column) -> Column:
    """Map entries from the largest share down, names breaking ties."""
    return F.transform(
        F.array_sort(
            F.transform(
                F.map_entries(stats),
                lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("language")),
            )
        ),
        lambda e: F.struct(e["language"].alias("language"), (-e["neg"]).alias("percent")),
    )
