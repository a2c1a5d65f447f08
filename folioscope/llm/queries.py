"""The queries of this subpackage and the SQL that the comparable ones are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import (
    attention, collide, common, decontaminate, jaccard, licenses, oddsketch, pieces, rangejoin,
    rollup, runs, styletree, toxicity, whiten,
)
from folioscope.session import ship_package



def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; they are installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(run: Query) -> Query:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    found = decontaminate.find_matches(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"),
        keep=("doc_id",),
    )
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op10_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, len(k) AS m, list_aggregate(k, 'string_agg', ' ') AS t FROM (
        SELECT item_id, w[i:i + least(10, len(w)) - 1] AS k FROM (
            SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0))
), dw AS (
    SELECT doc_id, i, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS t FROM (
        SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hits AS (
    SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.m = bw.m
), n AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), l AS (
    SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@_query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with the end id, and the text that they decode to, as digests."""
    coded = pieces.code(
        common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"),
        keep=("doc_id",),
    )
    return coded.select(
        F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256"
    )


@_query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of documents whose sets of 3-word shingles have a Jaccard of 0.9 or more."""
    return jaccard.near_links(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100)


#: Components by all pairs; further columns of a document come in front of FROM and at the end.
_COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, hash(g) AS g FROM (
        SELECT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0))
), n AS (
    SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y
    WHERE 100 * c >= 90 * (i.k + j.k - c)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT doc_id, doc_id AS t FROM d
    UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.t = e.x
)
SELECT d.doc_id, coalesce(k, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(t) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

ORACLES["op2_ngram_jaccard"] = _COMPONENTS_SQL.replace(
    "c.component_id\nFROM", "c.component_id, coalesce(o.n_links, 0) AS n_links\nFROM"
) + "LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x) o USING (doc_id)"


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    scored = toxicity.score(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"),
        keep=("doc_id",),
    )
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), common.held_out(doc_id, 0).alias("held_out"), "score",
        toxicity.predicted().alias("predicted"),
    )


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, a revision (titles removed), a removal (low quality) and replays."""
    title = F.regexp_extract("text", "^[^\n]*\n", 0)
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang",
        rollup.counts(F.col("text")).alias("before"), rollup.counts(title).alias("title"),
    )
    # No token holds a line's end, so a text without its title has the other tokens.
    after = F.transform_values("before", lambda k, n: n - F.element_at("title", k))
    docs = docs.select("doc_id", "source", "lang", "before", after.alias("after"))
    counted = common.stored(docs)  # a slim row per document; texts are read once
    poor = common.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    batches = {
        "load": rollup.signed(counted, 1, "before"),
        "revise": rollup.revised(counted, "before", "after"),
        "remove": rollup.signed(counted.join(poor, "doc_id", "left_semi"), -1, "after"),
    }
    ledger = rollup.Ledger(spark, common.shared_folder(spark))
    for name in ("load", "revise", "revise", "remove", "load"):
        ledger.commit(name, batches[name])
    return ledger.totals()


ORACLES["op1_token_counts"] = r"""
WITH d AS (
    SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '^[^\n]*\n', '') AS t FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)
), c AS (
    SELECT source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
    UNION ALL
    SELECT source, lang, 'plain-1', len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM d
), k AS (
    SELECT DISTINCT source, lang, tokenizer FROM documents, (VALUES ('space-1'), ('plain-1')) v(tokenizer)
)
SELECT k.source, k.lang, k.tokenizer, count(c.n) AS n_docs, coalesce(sum(c.n), 0) AS n_tokens
FROM k LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.lang IS NOT DISTINCT FROM c.lang
    AND k.tokenizer = c.tokenizer GROUP BY 1, 2, 3
"""

#: The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@_query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by the longest rule that fits it."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    judged = rangejoin.judge(pages, rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


ORACLES["op8_url_filters"] = r"""
WITH r(h, p, v) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule,
    coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""


@_query
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    # Only the id goes on behind the scan of the text.
    scanned = licenses.scan(docs)
    return scanned.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        "base_labels", "labels", "score",
    )


def _license_oracle() -> str:
    """The base phrases by windows of words, the templates by sets of words of each line."""
    values = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', '{t}')" for k, (label, t) in enumerate(licenses.TEMPLATES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents
), w AS (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS w FROM d
), p AS (
    SELECT len(string_split(p, ' ')) AS m, p, label FROM (VALUES {values}) v(p, label)
), b AS (
    SELECT doc_id, i - 1 AS pos, label FROM (
        SELECT doc_id, w, m, p, label, unnest(range(1, len(w) - m + 2)) AS i FROM w, p WHERE len(w) >= m
    ) WHERE array_to_string(w[i:i + m - 1], ' ') = p
), base AS (
    SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id
), l AS (
    SELECT doc_id, row_number() OVER () AS k, list_distinct(regexp_extract_all(line, '{pattern}')) AS s
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
), t AS (
    SELECT k, label, list_distinct(string_split(t, ' ')) AS s FROM (VALUES {templates}) v(k, label, t)
), h AS (
    SELECT doc_id, label, len(list_intersect(l.s, t.s)) * 1.0 / len(t.s) AS c FROM l, t
    WHERE len(list_intersect(l.s, t.s)) >= ceil(len(t.s) * {licenses.THRESHOLD} - 0.0001)
), found AS (
    SELECT doc_id, max(c) AS c FROM h GROUP BY doc_id
), every AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM b) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN every USING (doc_id)
"""


ORACLES["op4_license_scans"] = _license_oracle()


@_query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    read = styletree.extract(common.table(spark, sf_dir, "pages"))
    return read.select(
        F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
        F.length("text").cast("long").alias("n_chars"),
    )


@_query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector by cosine."""
    return collide.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@_query
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's and the unigram base's log10 probability of every document."""
    docs = common.table(spark, sf_dir, "documents")
    scored = attention.score(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id",))
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"), common.held_out(doc_id, attention.HELD_OUT).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in the words of every document, a tenth of them rearranged."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.collapse(docs, key="doc_id", places=runs.planted, keep=("doc_id",))
    milli = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_runs", "start", "length", "period",
        milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@_query
def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 5-word shingles have a Jaccard of 0.85 or more."""
    return oddsketch.near_duplicates(common.table(spark, sf_dir, "documents"), n=5, num=85, den=100)


def _near_oracle() -> str:
    """The oracle of the n-gram join at other parameters, with the first of each group marked."""
    text = _COMPONENTS_SQL
    for old, new in (("w[i:i + 2]", "w[i:i + 4]"), ("len(w) - 2, 1", "len(w) - 4, 1"), (">= 90 *", ">= 85 *")):
        assert text.count(old) == 1
        text = text.replace(old, new)
    return f"SELECT *, doc_id = component_id AS kept FROM ({text})"


ORACLES["op12_odd_sketches"] = _near_oracle()


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 32 whitened components."""
    table = common.table(spark, sf_dir, "embeddings")
    rows, fit = whiten.whiten(table, "embedding", components=32, keep=("vec_id",))
    shares = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values]).cast("array<double>")
    each = rows.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        shares[F.col("at")].alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )
