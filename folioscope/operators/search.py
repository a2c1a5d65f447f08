"""Hybrid retrieval: BM25, cosine, rank fusion, overlap removal and scope."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import text as text_fn
from folioscope.functions import vectors
from folioscope.operators.ranks import ranked
from folioscope.operators.shape import computed_once
from folioscope.sources.work import stored

K1 = 1.2
B = 0.75
RRF_K = 60
SCORE_DIGITS = 9
DEFAULT_LIMIT = 20


def clamp_limit(limit: int | None) -> int:
    """At least one row; there is no ceiling."""
    return max(DEFAULT_LIMIT if limit is None else limit, 1)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Search units of a query: quoted phrases stay together, other words stand alone.

    The words go through the same column expression as the corpus, evaluated on
    one constant row that the optimizer folds away. A phrase is written the way it
    looks inside a padded word stream.
    """
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]*"?', " ", query)
    row = spark.range(1).select(
        *[text_fn.code_words(F.lit(p)).alias(f"p{i}") for i, p in enumerate([*phrases, rest])]
    ).first()
    units = ["  ".join(words) for words in row[:-1] if words] + list(row[-1])
    return list(dict.fromkeys(units))


def with_words(chunks: DataFrame, content: str = "content") -> DataFrame:
    return computed_once(chunks, "words", text_fn.padded_words(F.col(content)))


def corpus_stats(chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row: chunk count, word count and, per search unit, chunks that hold it."""
    held = [
        F.count_if(text_fn.padded_term_count(F.col("words"), t) > 0).alias(f"df{i}")
        for i, t in enumerate(terms)
    ]
    return chunks.agg(
        F.count("*").alias("n"), F.sum(text_fn.padded_count(F.col("words"))).alias("total"), *held
    )


def idf(n: Column, held: Column) -> Column:
    return F.log(F.lit(1.0) + (n - held + F.lit(0.5)) / (held + F.lit(0.5)))


def term_weight(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    damp = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / average)
    return tf * F.lit(k1 + 1.0) / (tf + damp)


def bm25(
    chunks: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B, out: str = "bm25"
) -> DataFrame:
    """Add the BM25 score of every chunk; null where no search unit occurs.

    Corpus statistics are one row and enter as an uncorrelated scalar subquery, so
    scoring is a plain projection over the scan: no explode, shuffle or join.
    """
    if not terms:
        return chunks.withColumn(out, F.lit(None).cast("double"))
    words = F.col("words")
    counts = [text_fn.padded_term_count(words, t) for t in terms]
    return _scored(chunks, corpus_stats(chunks, terms), text_fn.padded_count(words), counts, k1, b, out)


def word_scores(
    chunks: DataFrame, terms: Sequence[str], keep: Sequence[str], k1: float = K1, b: float = B, out: str = "bm25"
) -> DataFrame:
    """The columns to keep and the BM25 score of every chunk (with `content`).

    Cutting and reading texts costs more than all else and would run for the statistics and again
    for the scores, so lengths and counts are stored in between.
    """
    if not terms:
        return chunks.select(*keep, F.lit(None).cast("double").alias(out))
    words = F.col("words")
    named = [f"_tf{i}" for i in range(len(terms))]
    counted = stored(
        with_words(chunks).select(
            *keep, text_fn.padded_count(words).alias("_length"),
            *[text_fn.padded_term_count(words, t).alias(name) for t, name in zip(terms, named)],
        ),
        "counts",
    )
    held = [F.count_if(F.col(name) > 0).alias(f"df{i}") for i, name in enumerate(named)]
    stats = counted.agg(F.count("*").alias("n"), F.sum("_length").alias("total"), *held)
    counts = [F.col(name) for name in named]
    return _scored(counted, stats, F.col("_length"), counts, k1, b, out).select(*keep, out)


def _scored(
    chunks: DataFrame, stats: DataFrame, length: Column, counts: Sequence[Column], k1: float, b: float, out: str
) -> DataFrame:
    fields = [F.col(c) for c in stats.columns]
    scored = chunks.withColumn("_stats", stats.select(F.struct(*fields)).scalar())
    s = F.col("_stats")
    average = s["total"] / s["n"]
    parts = [
        idf(s["n"], s[f"df{i}"]) * term_weight(tf, length, average, k1, b)
        for i, tf in enumerate(counts)
    ]
    found = sum(counts[1:], counts[0]) > 0
    score = F.round(sum(parts[1:], parts[0]), SCORE_DIGITS)
    return scored.withColumn(out, F.when(found, score)).drop("_stats")


def vector_score(
    chunks: DataFrame, query: Sequence[float], out: str = "vector", embedding: str = "embedding"
) -> DataFrame:
    """Add the cosine to the query; null for missing and zero vectors."""
    score = F.round(vectors.cosine_to(F.col(embedding), query), SCORE_DIGITS)
    return computed_once(chunks, out, score)


def top_k(scored: DataFrame, score: str, key: Sequence[str], limit: int) -> DataFrame:
    """Best rows by one score, ties by key; rows without a score never appear."""
    return (
        scored.where(F.col(score).isNotNull())
        .orderBy(F.desc(score), *[F.asc(k) for k in key])
        .limit(limit)
    )


def ranked_legs(scored: DataFrame, key: Sequence[str], legs: Sequence[str]) -> DataFrame:
    """Every scored row's place in every leg's *complete* list: _key, leg, value and rank.

    Ties go to the smaller key. Stored, as a search may ask for deeper heads of the lists.
    """
    ident = F.struct(*[F.col(c) for c in key])
    # Scores cost a pass over the text; the ranges below only need keys and scores.
    slim = stored(scored.select(ident.alias("_key"), *legs), "scores")
    ranks = None
    for leg in legs:
        own = slim.where(F.col(leg).isNotNull()).select("_key", F.lit(leg).alias("leg"), F.col(leg).alias("value"))
        own = ranked(own, [F.desc("value"), F.asc("_key")])
        ranks = own if ranks is None else ranks.unionByName(own)
    return stored(ranks, "legs")


def fused_top(
    ranks: DataFrame, legs: Sequence[str], limit: int, k: int = RRF_K, out: str = "score"
) -> DataFrame:
    """The best rows by Reciprocal Rank Fusion of complete ranked lists (`ranked_legs`).

    A row outside the first ``depth`` places of every leg scores at most
    ``m / (k + depth + 1)``, while the ``limit`` best rows of the longest leg score
    at least ``1 / (k + limit)`` each. With the depth below no such row can enter
    the result, so only the union of the leg heads competes, with its exact ranks.
    """
    depth = len(legs) * (k + limit) - k
    heads = ranks.where(F.col("rank") <= depth).select("_key").distinct()
    held = ranks.join(heads, "_key", "left_semi")
    result = held.groupBy("_key").agg(
        *[F.max(F.when(F.col("leg") == leg, F.col("value"))).alias(leg) for leg in legs],
        *[F.max(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"{leg}_rank") for leg in legs],
    )
    parts = [
        F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(f"{leg}_rank")), F.lit(0.0))
        for leg in legs
    ]
    fused = result.withColumn(out, F.round(sum(parts[1:], parts[0]), 12))
    best = fused.orderBy(F.desc(out), "_key").limit(limit)
    return best.select("_key.*", *legs, *[f"{leg}_rank" for leg in legs], out)


def rrf_top(
    scored: DataFrame,
    key: Sequence[str],
    legs: Sequence[str],
    limit: int,
    k: int = RRF_K,
    out: str = "score",
) -> DataFrame:
    """The best rows by Reciprocal Rank Fusion over the complete ranked lists of all legs."""
    return fused_top(ranked_legs(scored, key, legs), legs, limit, k, out).orderBy(F.desc(out), *key)


def drop_overlaps(
    rows: DataFrame,
    file_key: Sequence[str],
    tie: Sequence[str] = (),
    score: str = "score",
    start: str = "start_line",
    end: str = "end_line",
) -> DataFrame:
    """Keep the better of two rows whose line ranges meet in the same file.

    Rows are visited from the best down; a row stays when it meets none of the rows
    kept so far, so a dropped row never blocks a later one. A group is one file,
    whose size the index bounds; only keys, ranges and scores travel.
    """
    others = [c for c in rows.columns if c not in file_key]
    entry = F.struct(
        (-F.col(score)).alias("_neg"),
        F.col(start).alias("_s"),
        F.col(end).alias("_e"),
        *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)],
        F.struct(*[F.col(c) for c in others]).alias("_row"),
    )
    grouped = rows.groupBy(*file_key).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    none = F.filter(F.col("_all"), lambda x: F.lit(False))

    def visit(kept: Column, x: Column) -> Column:
        meets = F.exists(kept, lambda y: (y["_s"] <= x["_e"]) & (y["_e"] >= x["_s"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(x)))

    kept = grouped.select(
        *file_key, F.explode(F.aggregate(F.col("_all"), none, visit)).alias("_k")
    )
    return kept.select(*file_key, "_k._row.*").select(*rows.columns)


def in_scope(
    ref_files: DataFrame,
    refs: DataFrame,
    repo: str | None = None,
    ref: str | None = None,
    languages: Sequence[str] | None = None,
    paths: Sequence[str] | None = None,
    ready_only: bool = True,
) -> DataFrame:
    """Files a search may return: one row per repository, ref and path."""
    chosen = refs
    if ready_only:
        chosen = chosen.where(F.col("stage") == "ready")
    if repo is not None:
        chosen = chosen.where(F.col("repo") == repo)
    if ref is not None:
        chosen = chosen.where(F.col("ref") == ref)
    files = ref_files
    if paths:
        files = files.where(F.col("path").isin(list(paths)))
    if languages:
        files = files.where(F.col("language").isin(list(languages)))
    names = chosen.select("repo_ref_id", "repo", "ref")
    return files.join(names, "repo_ref_id")


def hybrid_search(
    chunks: DataFrame,
    scope: DataFrame,
    terms: Sequence[str],
    query_vector: Sequence[float],
    limit: int = DEFAULT_LIMIT,
    k: int = RRF_K,
    words: DataFrame | None = None,
    texts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Hybrid search over the chunks of the files in scope.

    ``chunks`` has content_id, start_line, end_line, content, embedding and maybe
    symbol_name. Ranking and overlap removal work on contents; the files that share
    a content only join the few surviving chunks, and each yields its own row.

    Candidates enter from the best down. A candidate outside the pool is worse than all
    inside, so it drops none of them: the result is exact once ``limit`` rows survive,
    or once the pool holds every scored chunk. Until then the pool grows.

    ``words`` may bring the word scores of the chunks in scope from a persisted index
    (``postings.score_postings``); then no text is read but that of the result. ``texts`` may
    cut the chunks of the result's contents (content_id); ``chunks`` then needs no content.
    """
    wanted = scope.select("content_id").distinct()
    inside = chunks.join(wanted, "content_id", "left_semi")
    key = ["content_id", "start_line", "end_line"]
    if words is None:
        compared = vector_score(inside.select(*key, "content", "embedding"), query_vector)
        scored = word_scores(compared, terms, [*key, "vector"])
    else:
        scored = vector_score(inside.select(*key, "embedding"), query_vector)
        scored = scored.join(words.select(*key, "bm25"), key, "left")
    legs = ["bm25", "vector"]
    ranks = ranked_legs(scored, key, legs)
    every = ranks.select("_key").distinct().count()
    owners = scope.select("content_id", "repo", "ref", "path")
    place = ["repo", "ref", "path", "start_line"]
    extra = [c for c in ("symbol_name",) if c in chunks.columns]
    pool = 4 * limit
    while True:
        best = fused_top(ranks, legs, pool, k).select(*key, "score")
        survivors = drop_overlaps(best, ["content_id"])
        top = survivors.join(owners, "content_id").orderBy(F.desc("score"), *place).limit(limit)
        top = stored(top, "hits")
        if top.count() >= limit or pool >= every:
            break
        pool *= 4
    held = chunks if texts is None else texts(top.select("content_id").distinct())
    found = top.join(held.select(*key, "content", *extra), key).select(
        F.col("path").alias("file_path"), "repo", "ref", "content", "start_line", "end_line",
        "score", *extra,
    )
    return found.orderBy(F.desc("score"), "repo", "ref", "file_path", "start_line")
