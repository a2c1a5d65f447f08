"""Search: words, vectors, fusion, overlap removal, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import chunking, context, ingest, postings, search
from folioscope.operators.segments import SegmentedIndex
from folioscope.operators.vector_index import VectorIndex
from folioscope.queries import sql
from folioscope.sources import tables
from folioscope.sources.work import stored, work_folder

QUERY = '"de la" theUnd'
PHRASE, WORDS = ("de", "la"), ["the", "und"]
KEY = ["content_id", "start_line", "end_line"]
LIMIT = 20


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    vectors = tables.table(spark, folder, "embeddings")
    return list(vectors.where(F.col("vec_id") == 0).select("embedding").first()[0])


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    chunks = tables.corpus_chunks(spark, folder).select(*KEY, "content")
    scored = search.word_scores(chunks, search.query_terms(spark, QUERY), KEY)
    return search.top_k(scored, "bm25", KEY, 50)


def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Build the inverted index of all chunks, then score two words from it."""
    place = work_folder(spark, "postings")
    chunks = tables.corpus_chunks(spark, folder).select(*KEY, "content")
    postings.write_index(chunks, KEY, place)
    return postings.score_postings(postings.read_index(spark, place), WORDS)


def code_words(spark: SparkSession, folder: str) -> DataFrame:
    from folioscope.functions import text as text_fn

    pages = tables.spread(tables.table(spark, folder, "pages"), "page_id")
    words = F.explode(text_fn.code_words(F.concat_ws(" ", "url", "html")))
    return pages.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("uses"))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    query = _query_vector(spark, folder)
    scored = search.vector_score(tables.table(spark, folder, "embeddings"), query)
    return search.top_k(scored, "vector", ["vec_id"], 30).select("vec_id", "label", "vector")


def _vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    """All vectors in two batches under centres of the first."""
    rows = tables.table(spark, folder, "embeddings")
    late = F.col("vec_id") % 4 == 3
    index = VectorIndex.build(rows.where(~late), ["vec_id", "label"], work_folder(spark, "vectors"))
    index.add(rows.where(late), 1)
    return index


def ann_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty nearest vectors from the best lists of a persisted index."""
    return _vector_index(spark, folder).nearest(_query_vector(spark, folder), 30)


def ann_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The same from every list that may hold one of them."""
    found = _vector_index(spark, folder).exact(_query_vector(spark, folder), 30)
    return found.withColumnRenamed("score", "vector")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    chunks = tables.corpus_chunks(spark, folder).select(*KEY, "content", "embedding")
    compared = search.vector_score(chunks, _query_vector(spark, folder))
    return search.word_scores(compared, search.query_terms(spark, QUERY), [*KEY, "vector"])


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return search.rrf_top(_scored(spark, folder), KEY, ["bm25", "vector"], 50)


def dedup_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Best disjoint chunks of every file for a word search, over all matching chunks."""
    chunks = tables.corpus_chunks(spark, folder).select(*KEY, "content")
    scored = search.word_scores(chunks, search.query_terms(spark, QUERY), KEY, out="score")
    rows = scored.where(F.col("score").isNotNull()).select(*KEY, "score")
    return search.drop_overlaps(rows, ["content_id"])


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    files, refs = tables.scoped_files(spark, folder)
    scope = search.in_scope(files, refs, repo="repo1")
    return search.hybrid_search(
        tables.corpus_chunks(spark, folder).drop("symbol_name"),
        scope,
        search.query_terms(spark, QUERY),
        _query_vector(spark, folder),
        LIMIT,
    )


# Scope of the narrow search: one ref, two languages and the files of some folders.
SCOPE_LANGUAGES = ["en", "de"]
SCOPE_PATHS = [f"{language}/{slot}" for language in ("en", "de", "fr") for slot in range(0, 400, 2)]


def scoped_search(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid search within one ref, some languages and a list of paths."""
    files, refs = tables.scoped_files(spark, folder)
    scope = search.in_scope(files, refs, "repo1", "v1.0.0", SCOPE_LANGUAGES, SCOPE_PATHS)
    chunks = tables.corpus_chunks(spark, folder).drop("symbol_name")
    terms = search.query_terms(spark, QUERY)
    return search.hybrid_search(chunks, scope, terms, _query_vector(spark, folder), LIMIT)


def search_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The context pack of a hybrid search, with the text it becomes."""
    files, refs = tables.scoped_files(spark, folder)
    hits = search.hybrid_search(
        tables.corpus_chunks(spark, folder).drop("symbol_name"), search.in_scope(files, refs, repo="repo1"),
        search.query_terms(spark, QUERY), _query_vector(spark, folder), context.SEARCH_LIMIT,
    )
    pack = context.trim_to_budget(hits.select("file_path", "start_line", "end_line", "content"))
    lines = context.pack_lines(pack).select("position", F.sha2("line", 256).alias("line_sha"))
    return pack.select("position", "file_path", "start_line", "end_line", "cost", "used").join(lines, "position")


def indexed_search(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid search with word scores from a persisted index, phrase included.

    Texts are shuffled once, for the index; files are hashed once, and the index names the chunks.
    """
    listed = stored(tables.corpus_files(spark, folder).drop("content"), "files")
    files, refs = tables.scoped_files(spark, folder, listed)
    scope = search.in_scope(files, refs, repo="repo1")
    contents = ingest.distinct_contents(listed)
    place = work_folder(spark, "words")

    def cut(some: DataFrame) -> DataFrame:
        texts = ingest.first_copies(tables.corpus_files(spark, folder), some)
        return chunking.chunk_files(texts).select(*KEY, "content")

    postings.write_index(cut(contents), KEY, place)
    index = postings.read_index(spark, place).within(scope)
    vectors = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("first_ordinal"), "embedding")
    vectors = contents.join(vectors, "first_ordinal").select("content_id", "embedding")
    chunks = index.lengths.select(*KEY).join(vectors, "content_id", "left")
    terms = search.query_terms(spark, QUERY)
    return search.hybrid_search(
        chunks, scope, terms, _query_vector(spark, folder), LIMIT,
        words=postings.score_postings(index, terms),
        texts=lambda found: cut(stored(contents.join(found, "content_id", "left_semi"), "found")),
    )


def index_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The best chunks after three additions, a replacement, a removal and a merge."""
    texts = tables.corpus_texts(spark, folder).select("ordinal", "content_id", "content")
    chunks = chunking.chunk_files(texts, keep=["ordinal"]).select("ordinal", *KEY, "content")
    index = SegmentedIndex(spark, work_folder(spark, "segments"), KEY)
    for part in range(3):
        index.add(chunks.where(F.col("ordinal") % 3 == part))
    edited = F.concat("content", F.lit("\nundUnd de la"))
    index.replace(chunks.where(F.col("ordinal") % 10 == 1).withColumn("content", edited))
    index.delete(chunks.where(F.col("ordinal") % 10 == 0))
    index.merge(fanout=3)
    return index.top(search.query_terms(spark, QUERY), 50)


def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    rows = _search_rows(spark, folder)
    pack = context.trim_to_budget(rows)
    return pack.select("position", "file_path", "start_line", "end_line", "cost", "used")


def _search_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best word matches under the path of their first file."""
    best = stored(bm25_topk(spark, folder).orderBy(F.desc("bm25"), *KEY).limit(context.SEARCH_LIMIT), "best")
    # Only the files of the matches are cut again.
    files = tables.corpus_files(spark, folder).join(best.select("content_id").distinct(), "content_id", "left_semi")
    texts = stored(ingest.first_copies(files, ingest.distinct_contents(files)), "texts")
    return (
        best.join(chunking.chunk_files(texts).select(*KEY, "content"), KEY)
        .join(texts.select("content_id", "path"), "content_id")
        .select(F.col("path").alias("file_path"), "start_line", "end_line", "content")
    )


def format_pack(spark: SparkSession, folder: str) -> DataFrame:
    return context.format_pack(context.trim_to_budget(_search_rows(spark, folder)))


def pack_summary(spark: SparkSession, folder: str) -> DataFrame:
    return context.pack_summary(context.trim_to_budget(_search_rows(spark, folder)))


_CHUNKS = f"WITH RECURSIVE {sql.FILES},{sql.CONTENTS},{sql.windows('contents')}"
_KEY = "content_id, start_line, end_line"
_BM25 = f"{_CHUNKS},{sql.words('pieces', _KEY)},{sql.bm25(_KEY, PHRASE, WORDS)}"
_VECTOR = """
qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
vector_scores AS (
  SELECT vec_id, label,
         round(list_dot_product(CAST(embedding AS DOUBLE[]), q)
               / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
                  * sqrt(list_dot_product(q, q))), 9) AS vector
  FROM embeddings, qv)"""


def _fused(limit: int | None = None) -> str:
    cut = "" if limit is None else f"ORDER BY score DESC, {_KEY} LIMIT {limit}"
    return f"""
both_legs AS (
  SELECT b.content_id, b.start_line, b.end_line, b.bm25, v.vector
  FROM bm25_scores b JOIN contents c USING (content_id)
  LEFT JOIN vector_scores v ON v.vec_id = c.first_ordinal),
br AS (SELECT {_KEY}, row_number() OVER (ORDER BY bm25 DESC, {_KEY}) AS bm25_rank
       FROM both_legs WHERE bm25 IS NOT NULL),
vr AS (SELECT {_KEY}, row_number() OVER (ORDER BY vector DESC, {_KEY}) AS vector_rank
       FROM both_legs WHERE vector IS NOT NULL),
fused AS (
  SELECT {_KEY}, bm25, vector, bm25_rank, vector_rank,
         round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0), 12)
         AS score
  FROM both_legs LEFT JOIN br USING ({_KEY}) LEFT JOIN vr USING ({_KEY})
  WHERE bm25_rank IS NOT NULL OR vector_rank IS NOT NULL
  {cut})"""


def _greedy(source: str) -> str:
    """Visit the rows of each content from the best down and keep disjoint ranges."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content_id
                               ORDER BY score DESC, start_line, end_line) AS rn FROM {source}),
visit AS (
  SELECT content_id, rn, start_line, end_line, score, TRUE AS kept,
         [{{'s': start_line, 'e': end_line}}] AS taken
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.content_id, r.rn, r.start_line, r.end_line, r.score,
         len(list_filter(v.taken, lambda t: t.s <= r.end_line AND t.e >= r.start_line)) = 0,
         CASE WHEN len(list_filter(v.taken, lambda t: t.s <= r.end_line AND t.e >= r.start_line)) = 0
              THEN list_append(v.taken, {{'s': r.start_line, 'e': r.end_line}})
              ELSE v.taken END
  FROM visit v JOIN ranked r ON r.content_id = v.content_id AND r.rn = v.rn + 1),
survivors AS (SELECT {_KEY}, score FROM visit WHERE kept)"""


_REFS = """
search_refs AS (
  SELECT r AS repo_ref_id, concat('repo', CAST(r % 5 AS VARCHAR)) AS repo,
         concat('v1.', CAST(r // 5 AS VARCHAR), '.0') AS ref,
         CASE WHEN r % 7 = 3 THEN 'error' WHEN r % 7 = 5 THEN 'embedding' ELSE 'ready' END AS stage
  FROM (SELECT DISTINCT doc_id % 20 AS r FROM documents))"""

def _scoped(where: str) -> str:
    """Word scores of the chunks of the files in scope."""
    return (
        _CHUNKS
        + f""",{_REFS},
scope AS (
  SELECT f.content_id, f.path, s.repo, s.ref
  FROM files f JOIN search_refs s USING (repo_ref_id) WHERE s.stage = 'ready' AND s.repo = 'repo1'{where}),
in_scope AS (SELECT * FROM pieces WHERE content_id IN (SELECT content_id FROM scope)),"""
        + sql.words("in_scope", _KEY).lstrip()
        + ","
        + sql.bm25(_KEY, PHRASE, WORDS)
    )


_SCOPED = _scoped("")
_NARROW = _scoped(
    f""" AND s.ref = 'v1.0.0' AND f.language IN ({', '.join(repr(x) for x in SCOPE_LANGUAGES)})
    AND f.path IN ({', '.join(repr(x) for x in SCOPE_PATHS)})"""
)


def _hits(scoped: str, limit: int) -> str:
    return f"""{scoped},{_VECTOR},{_fused()},{_greedy('fused')},
hits AS (
  SELECT s.path AS file_path, s.repo, s.ref, p.content, v.start_line, v.end_line, v.score
  FROM survivors v JOIN scope s USING (content_id) JOIN pieces p USING ({_KEY})
  ORDER BY v.score DESC, s.repo, s.ref, s.path, v.start_line LIMIT {limit})"""


_COSTED = """
costed AS (
  SELECT *, CAST(ceil(length(concat(chr(10), '--- ', file_path, ' L', start_line, '-', end_line,
                                    ' ---', chr(10))) / 3.0) + ceil(length(content) / 3.0)
                 AS BIGINT) AS cost
  FROM pack_rows),
summed AS (
  SELECT *, CAST(sum(cost) OVER o AS BIGINT) AS used, row_number() OVER o AS position
  FROM costed WINDOW o AS (ORDER BY file_path, start_line, end_line, content)),
pack AS (SELECT * FROM summed WHERE used <= 8192)"""

_PACK_ROWS = f"""
top30 AS (
  SELECT * FROM bm25_scores WHERE bm25 IS NOT NULL ORDER BY bm25 DESC, {_KEY} LIMIT 30),
pack_rows AS (
  SELECT f.path AS file_path, t.start_line, t.end_line, p.content
  FROM top30 t JOIN pieces p USING ({_KEY}) JOIN contents c USING (content_id)
  JOIN files f ON f.ordinal = c.first_ordinal),{_COSTED}"""

QUERIES = {
    "q_bm25_topk": bm25_topk,
    "q_bm25_postings": bm25_postings,
    "q_code_words": code_words,
    "q_vector_topk": vector_topk,
    "q_ann_topk": ann_topk,
    "q_ann_exact": ann_exact,
    "q_rrf_fusion": rrf_fusion,
    "q_dedup_overlap": dedup_overlap,
    "q_hybrid_search": hybrid_search,
    "q_indexed_search": indexed_search,
    "q_scoped_search": scoped_search,
    "q_search_pack": search_pack,
    "q_index_segments": index_segments,
    "q_context_pack": context_pack,
    "q_format_pack": format_pack,
    "q_pack_summary": pack_summary,
}

ORACLES = {
    "q_bm25_topk": f"""{_BM25}
SELECT {_KEY}, bm25 FROM bm25_scores WHERE bm25 IS NOT NULL
ORDER BY bm25 DESC, {_KEY} LIMIT 50""",
    "q_bm25_postings": f"""{_CHUNKS},{sql.words('pieces', _KEY)},
counted AS (
  SELECT {_KEY}, len(ws) AS dl, len(list_filter(ws, lambda x: x = 'the')) AS a,
         len(list_filter(ws, lambda x: x = 'und')) AS b FROM tokens),
totals AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) AS total, count(*) FILTER (WHERE a > 0)
           AS da, count(*) FILTER (WHERE b > 0) AS db FROM counted)
SELECT {_KEY}, round(
  ln(1.0 + (n - da + 0.5) / (da + 0.5)) * (a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / (total / n))))
  + ln(1.0 + (n - db + 0.5) / (db + 0.5)) * (b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / (total / n)))),
  9) AS bm25
FROM counted, totals WHERE a + b > 0""",
    "q_scoped_search": f"{_hits(_NARROW, LIMIT)} SELECT * FROM hits",
    "q_search_pack": f"""{_hits(_SCOPED, 30)},
pack_rows AS (SELECT file_path, start_line, end_line, content FROM hits),{_COSTED},
headed AS (SELECT *, lag(file_path) OVER (ORDER BY position) AS prev FROM pack)
SELECT position, file_path, start_line, end_line, cost, used, sha256(
  concat(chr(10), CASE WHEN prev = file_path THEN '--- L' ELSE concat('--- ', file_path, ' L') END,
         start_line, '-', end_line, ' ---', chr(10), content)) AS line_sha
FROM headed""",
    "q_index_segments": f"""{_CHUNKS},
edited AS (
  SELECT {', '.join('p.' + c for c in KEY)}, CASE WHEN c.first_ordinal % 10 = 1
         THEN concat(p.content, chr(10), 'undUnd de la') ELSE p.content END AS content
  FROM pieces p JOIN contents c USING (content_id) WHERE c.first_ordinal % 10 <> 0),
{sql.words('edited', _KEY)},{sql.bm25(_KEY, PHRASE, WORDS)}
SELECT {_KEY}, bm25 FROM bm25_scores WHERE bm25 IS NOT NULL
ORDER BY bm25 DESC, {_KEY} LIMIT 50""",
    "q_code_words": f"""WITH page_text AS (
  SELECT page_id, concat(url, ' ', html) AS content FROM pages),
{sql.words('page_text', 'page_id')}
SELECT word, count(*) AS uses FROM (SELECT unnest(ws) AS word FROM tokens) GROUP BY word""",
    "q_vector_topk": f"""WITH {_VECTOR}
SELECT vec_id, label, vector FROM vector_scores ORDER BY vector DESC, vec_id LIMIT 30""",
    "q_rrf_fusion": f"""{_BM25},{_VECTOR},{_fused(50)} SELECT * FROM fused""",
    "q_dedup_overlap": f"""{_BM25},
matches AS (SELECT {_KEY}, bm25 AS score FROM bm25_scores WHERE bm25 IS NOT NULL),
{_greedy('matches')} SELECT * FROM survivors""",
    "q_hybrid_search": f"""{_SCOPED},{_VECTOR},{_fused()},{_greedy('fused')}
SELECT s.path AS file_path, s.repo, s.ref, p.content, v.start_line, v.end_line, v.score
FROM survivors v JOIN scope s USING (content_id) JOIN pieces p USING ({_KEY})
ORDER BY v.score DESC, s.repo, s.ref, s.path, v.start_line LIMIT {LIMIT}""",
    "q_context_pack": f"""{_BM25},{_PACK_ROWS}
SELECT position, file_path, start_line, end_line, cost, used FROM pack""",
    "q_format_pack": f"""{_BM25},{_PACK_ROWS},
headed AS (
  SELECT *, lag(file_path) OVER (ORDER BY position) AS prev FROM pack)
SELECT trim(string_agg(
  concat(chr(10), CASE WHEN prev = file_path THEN '--- L' ELSE concat('--- ', file_path, ' L') END,
         start_line, '-', end_line, ' ---', chr(10), content), chr(10) ORDER BY position),
  concat(' ', chr(9), chr(10), chr(13))) AS text
FROM headed""",
    "q_pack_summary": f"""{_BM25},{_PACK_ROWS}
SELECT count(*) AS chunks, CAST(coalesce(sum(ceil(length(content) / 3.0)), 0) AS BIGINT)
       AS total_tokens FROM pack""",
}
# The index changes how words are found, not what is found.
ORACLES["q_indexed_search"] = ORACLES["q_hybrid_search"]
ORACLES["q_ann_exact"] = ORACLES["q_vector_topk"]
