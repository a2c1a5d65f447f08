"""Which version is meant: range and name resolution over the table of refs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import versions
from folioscope.operators.shape import computed_once


def with_version(refs: DataFrame) -> DataFrame:
    """Add the clean version text and its sortable key; both null for branches."""
    # The stored text follows from the ref, as here.
    bare = refs.drop("semver", "version_key")
    clean = computed_once(bare, "semver", versions.clean_version(F.col("ref")))
    return computed_once(clean, "version_key", versions.version_key(F.col("semver")))


def _best_of_each(
    refs: DataFrame, wanted: Sequence[str], picked: Column, rank: Callable[[str], Column]
) -> DataFrame:
    """For every text the highest-ranked row of each repository: one scan for all texts.

    A rank is null where the text does not fit; then the row does not count.
    """
    best = [F.max_by(picked, rank(text)).alias(f"best{i}") for i, text in enumerate(wanted)]
    # Every rank is one struct, so each text costs an aggregate, not a pass.
    each = [
        F.struct(F.lit(text).alias("wanted"), F.col(f"best{i}").alias("best"))
        for i, text in enumerate(wanted)
    ]
    found = with_version(refs).groupBy("repo_id").agg(*best)
    found = found.select("repo_id", F.explode(F.array(*each)).alias("e")).where("e.best is not null")
    return found.select("repo_id", "e.best.*", "e.wanted")


def resolve_semvers(refs: DataFrame, constraints: Sequence[str]) -> DataFrame:
    """Highest matching tag of every repository and constraint (`wanted`), if there is one."""

    def rank(text: str) -> Column:
        fits = versions.satisfies(F.col("version_key"), text)
        return F.when(fits, F.struct(F.col("version_key"), (-F.col("id")).alias("neg_id")))

    return _best_of_each(refs, constraints, F.struct("id", "ref"), rank)


def resolve_semver(refs: DataFrame, constraint: str) -> DataFrame:
    """Highest matching tag of every repository; repositories without one are absent."""
    return resolve_semvers(refs, [constraint]).drop("wanted")


def resolve_refs(refs: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Version range first, exact name second, for every repository and text (`wanted`)."""

    def rank(text: str) -> Column:
        in_range = versions.satisfies(F.col("version_key"), text)
        place = F.struct(
            F.when(in_range, 1).otherwise(0).alias("by_range"),
            F.when(in_range, F.col("version_key")).alias("version_key"),
            (-F.col("id")).alias("neg_id"),
        )
        return F.when(in_range | (F.col("ref") == text), place)

    return _best_of_each(refs, texts, F.struct("id", "ref", "commit_sha"), rank)


def resolve_ref(refs: DataFrame, text: str) -> DataFrame:
    """Version range first, exact name second; one row per repository that has either."""
    return resolve_refs(refs, [text]).drop("wanted")


def latest_ready(refs: DataFrame) -> DataFrame:
    """The most recently added ref of each repository that is ready to be searched."""
    return (
        refs.where(F.col("stage") == "ready")
        .groupBy("repo_id")
        .agg(F.max_by(F.struct("id", "ref", "commit_sha"), "id").alias("best"))
        .select("repo_id", "best.*")
    )
