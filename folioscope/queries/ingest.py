"""Indexing queries: identity, deduplication, statistics, chunking, vector reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import labels, paths
from folioscope.functions import text as text_fn
from folioscope.operators import chunking, ingest, maintain
from folioscope.plans.store import StoredEngine
from folioscope.queries import sql
from folioscope.schemas import REPOS
from folioscope.sources import tables
from folioscope.sources.embedding import HashingEmbedder
from folioscope.sources.work import work_folder

# File name endings cycled over the documents to exercise the path rules.
ENDINGS = (
    ".ts", ".TSX", ".mjs", ".py", ".go", ".java", ".kts", ".rs", ".h", ".cc", ".md", ".png",
    "", ".lock", ".test.js",
)
FOLDERS = ("src", "docs/api", "node_modules/pkg", "build", "lib/.hidden", "src/build", "logs")
# Ignore rules of a made-up root and nested ignore file.
ROOT_RULES = ("*.h", "logs/", "!logs/keep", "/docs")
NESTED_RULES = {"src": ("*.go", "# note", "/skip*")}


def document_paths(spark: SparkSession, folder: str) -> DataFrame:
    """A varied path per document, derived from its number and language."""
    docs = tables.table(spark, folder, "documents")

    def pick(values: tuple[str, ...], number: F.Column) -> F.Column:
        return F.element_at(
            F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int")
        )

    path = F.concat(
        pick(FOLDERS, F.expr("doc_id div 15")), F.lit("/"), F.col("lang"),
        F.col("doc_id").cast("string"), pick(ENDINGS, F.col("doc_id")),
    )
    return docs.select("doc_id", "lang", path.alias("path"))


def sha256(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    return ingest.with_content_id(docs, "text").select(
        "doc_id", "content_id", text_fn.token_estimate(F.col("text")).alias("tokens")
    )


def skip_file(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    marked = ingest.split_skipped(docs, "text", max_bytes=8192)
    return marked.select("doc_id", "skip_reason")


def classify_language(spark: SparkSession, folder: str) -> DataFrame:
    files = document_paths(spark, folder)
    return files.select(
        "path", paths.extension(F.col("path")).alias("extension"),
        paths.classify_language(F.col("path")).alias("language"),
    )


def glob_filter(spark: SparkSession, folder: str) -> DataFrame:
    files = document_paths(spark, folder)
    globs = ["{src,docs}/**", "!**/*.{md,png}"]
    return files.where(paths.matches_globs(F.col("path"), globs)).select("path")


def gitignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    files = document_paths(spark, folder)
    rules = paths.ignore_rules(ROOT_RULES, NESTED_RULES)
    return files.where(~paths.is_ignored(F.col("path"), rules)).select("path")


def manifest_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of refs whose file names are manifests, by document number."""
    from folioscope.operators import lookup

    names = [F.lit(n) for n in [*paths.MANIFESTS, "README.md"]]
    docs = tables.table(spark, folder, "documents")
    picked = F.element_at(F.array(*names), (F.expr("(doc_id * 7) div 13") % len(names) + 1).cast("int"))
    files = docs.select((F.col("doc_id") % 150).alias("repo_ref_id"), picked.alias("path"))
    return lookup.manifest_languages(files)


def parse_list(spark: SparkSession, folder: str) -> DataFrame:
    """Comma lists made of the words of each document."""
    docs = tables.documents(spark, folder)
    head = F.replace("text", F.lit(" "), F.lit(" , "))
    return docs.select(
        "doc_id",
        labels.parse_list(head, ["le", "la", "the", "und", "de"]).alias("kept"),
        F.size(labels.parse_list(head)).alias("items"),
    )


def redact(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents")
    words = F.transform(F.split("text", " "), lambda w: labels.redact(w))
    return docs.select("doc_id", F.sha2(F.array_join(words, " "), 256).alias("redacted"))


def remote_hosts(spark: SparkSession, folder: str) -> DataFrame:
    pages = tables.table(spark, folder, "pages")
    url = F.substring_index("url", "?", 1)
    return pages.select(
        "page_id",
        labels.host_env_suffix(url).alias("env_suffix"),
        labels.repo_name_from_url(url).alias("repo_name"),
        labels.valid_repo_name(labels.repo_name_from_url(url)).alias("valid_name"),
    )


def language_shares(spark: SparkSession, folder: str) -> DataFrame:
    files = tables.corpus_files(spark, folder).select("repo_ref_id", "language")
    return ingest.language_shares(files, ["repo_ref_id"])


def language_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of each ref from the largest share down."""
    refs = tables.corpus_refs(spark, folder)
    entries = F.posexplode(labels.languages_by_share(F.col("language_stats")))
    listed = refs.select("id", entries.alias("position", "entry"))
    return listed.select("id", "position", "entry.language", "entry.percent")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """Contents a previous run indexed: those of the first half of the refs."""
    files = tables.corpus_files(spark, folder)
    return files.where(F.col("repo_ref_id") < 10).select("content_id").distinct()


def _new_files(spark: SparkSession, folder: str) -> DataFrame:
    files = tables.corpus_files(spark, folder)
    return files.where(F.col("repo_ref_id") >= 8)


def file_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.file_dedup(_new_files(spark, folder), _known(spark, folder))


def dedup_summary(spark: SparkSession, folder: str) -> DataFrame:
    chunks = tables.corpus_chunks(spark, folder).select("content_id", "embedding")
    return ingest.dedup_summary(_new_files(spark, folder), _known(spark, folder), chunks)


def last_write(spark: SparkSession, folder: str) -> DataFrame:
    """Last document per language and slot when slots are shared by ten documents."""
    docs = tables.table(spark, folder, "documents").select(
        F.lit(1).cast("long").alias("repo_ref_id"),
        F.concat(F.col("lang"), F.lit("/"), F.expr("doc_id div 10").cast("string")).alias("path"),
        text_fn.content_hash(F.col("text")).alias("content_id"),
        F.col("doc_id").alias("ordinal"),
    )
    return ingest.last_write_per_path(docs).select("path", "content_id", "ordinal")


def _stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as whole-file chunks; a vector exists where the tables hold one."""
    docs = tables.documents(spark, folder)
    vectors = tables.table(spark, folder, "embeddings")
    hashed = docs.select(
        F.col("doc_id").alias("chunk_id"), "source", text_fn.content_hash(F.col("text")).alias("content_sha256")
    )
    return hashed.join(
        vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left"
    )


def distinct_on(spark: SparkSession, folder: str) -> DataFrame:
    cached = ingest.cached_vectors(_stored_chunks(spark, folder))
    return cached.select(
        "content_sha256", F.col("cached").cast("array<double>").alias("embedding")
    )


def embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    stored = _stored_chunks(spark, folder)
    fresh = stored.select("chunk_id", "content_sha256")
    reused = ingest.reuse_vectors(fresh, stored)
    return reused.select(
        "chunk_id",
        F.col("embedding").isNotNull().alias("reused"),
        F.transform("embedding", lambda v: F.round(v.cast("double"), 6)).alias("vector"),
    )


def cache_summary(spark: SparkSession, folder: str) -> DataFrame:
    stored = _stored_chunks(spark, folder)
    fresh = stored.select("chunk_id", "content_sha256")
    return ingest.cache_summary(ingest.reuse_vectors(fresh, stored))


def repair_unembedded(spark: SparkSession, folder: str) -> DataFrame:
    chunks = tables.corpus_chunks(spark, folder)
    return ingest.unembedded(chunks, _known(spark, folder)).select(
        "content_id", "start_line", "end_line"
    )


def backfill_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    hashed = docs.select(
        "doc_id",
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).alias("content_sha256"),
    )
    return ingest.backfill_hashes(hashed).select("doc_id", "content_sha256")


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    chunks = tables.corpus_chunks(spark, folder)
    return chunks.select(
        "content_id", "start_line", "end_line", F.sha2("content", 256).alias("chunk_sha")
    )


def document_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Nested line ranges of every content: one per seven lines and inner ones."""
    texts = tables.corpus_texts(spark, folder).select(
        "content_id", "language", text_fn.line_count(F.col("content")).cast("int").alias("lines")
    )
    starts = texts.where(F.col("lines") > 3).select(
        "*", F.explode(F.sequence(F.lit(2), F.col("lines"), F.lit(7))).alias("start_line")
    )
    outer = starts.select(
        "content_id", "start_line", F.least(F.col("start_line") + 4, F.col("lines")).alias("end_line"),
        F.concat(F.lit("s"), F.col("start_line").cast("string")).alias("name"),
    )
    inner = outer.where(F.col("end_line") - F.col("start_line") >= 3).select(
        "content_id", (F.col("start_line") + 1).alias("start_line"),
        (F.col("start_line") + 2).alias("end_line"), F.concat(F.lit("m"), F.col("name")).alias("name"),
    )
    return outer.unionByName(inner).select(
        "content_id", "name", F.lit("function").alias("kind"), F.col("name").alias("signature"),
        "start_line", "end_line",
        F.when(F.col("start_line") % 3 == 0, F.concat(F.lit("doc of "), F.col("name"))).alias(
            "documentation"
        ),
    )


def gap_ranges(spark: SparkSession, folder: str) -> DataFrame:
    texts = tables.corpus_texts(spark, folder)
    sizes = texts.select("content_id", text_fn.line_count(F.col("content")).alias("lines"))
    return chunking.gap_ranges(document_symbols(spark, folder), sizes)


def page_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of pages as imports: the target is the source, the text the name."""
    languages = [F.lit(x) for x in (
        "typescript", "python", "go", "rust", "java", "c", "markdown", "javascript", "kotlin", "cpp"
    )]
    pages = tables.table(spark, folder, "pages")
    anchors = F.regexp_extract_all("html", F.lit(r'<a href="([^"<>]*)">[^<]*</a>'), 0)
    listed = pages.select("page_id", F.posexplode(anchors).alias("ordinal", "anchor"))
    source = F.regexp_extract("anchor", r'<a href="([^"<>]*)">', 1)
    name = F.regexp_extract("anchor", r">([^<]*)</a>", 1)
    n = F.col("page_id") + F.col("ordinal")
    return listed.select(
        F.col("page_id").cast("string").alias("content_id"),
        "ordinal",
        F.element_at(F.array(*languages), (F.col("page_id") % 10 + 1).cast("int")).alias("language"),
        source.alias("source"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name)).alias("names"),
        F.when(n % 4 == 1, name).alias("default_name"),
        F.when(n % 5 == 0, 1).otherwise(0).alias("is_namespace"),
    )


def html_links(spark: SparkSession, folder: str) -> DataFrame:
    return page_imports(spark, folder).select(
        "content_id", "ordinal", "source", "default_name", "is_namespace"
    )


def import_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.import_prefix(page_imports(spark, folder))


def chunk_file(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of contents with symbols, documentation and an import prefix."""
    texts = tables.corpus_texts(spark, folder)
    prefixes = texts.select(
        "content_id",
        F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("import "), F.col("path"), F.lit("\n\n")))
        .otherwise("")
        .alias("import_prefix"),
    )
    chunks = chunking.chunk_files(
        texts, document_symbols(spark, folder), prefixes, max_tokens=200
    )
    return chunks.select(
        "content_id", "start_line", "end_line", "symbol_name",
        F.sha2("content", 256).alias("chunk_sha"),
    )


def chunk_symbol_link(spark: SparkSession, folder: str) -> DataFrame:
    symbols = document_symbols(spark, folder).select(
        "content_id", "name", "start_line",
        F.concat_ws(":", "content_id", "name").alias("symbol_id"),
        F.col("start_line").alias("ordinal"),
    )
    texts = tables.corpus_texts(spark, folder)
    chunks = chunking.chunk_files(texts, document_symbols(spark, folder), max_tokens=60)
    linked = ingest.link_symbols(
        chunks.select("content_id", "start_line", "end_line", "symbol_name"), symbols
    )
    return linked.groupBy("symbol_id").agg(F.count("*").alias("chunks"))


def truncate(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.documents(spark, folder)
    cut = text_fn.truncate_for_embedding(F.col("text"), 100)
    return docs.select("doc_id", F.length(cut).alias("kept"), F.sha2(cut, 256).alias("cut_sha"))


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    pair = tables.snapshot_pair(spark, folder).drop("content")
    old = pair.where(F.col("repo_ref_id") == 1).drop("repo_ref_id")
    new = pair.where(F.col("repo_ref_id") == 2).drop("repo_ref_id")
    return maintain.upsert(old, new, ["path"])


_PICK_ENDING = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + f"][doc_id % {len(ENDINGS)} + 1]"
_PICK_FOLDER = "[" + ", ".join(f"'{e}'" for e in FOLDERS) + f"][(doc_id // 15) % {len(FOLDERS)} + 1]"
_PATHS = f"""WITH paths AS (
  SELECT doc_id, concat({_PICK_FOLDER}, '/', lang, doc_id, {_PICK_ENDING}) AS path
  FROM documents)"""
_LANG_CASE = "CASE " + " ".join(
    "WHEN extension IN (" + ", ".join(f"'{e}'" for e in exts) + f") THEN '{lang}'"
    for lang, exts in paths.EXTENSIONS.items()
) + " END"
_MANIFEST_ROWS = ", ".join(
    f"('{name}', '{lang}')" for name, langs in paths.MANIFESTS.items() for lang in langs
)
_MANIFEST_NAMES = "[" + ", ".join(f"'{n}'" for n in [*paths.MANIFESTS, "README.md"]) + "]"
_BASE = f"WITH {sql.FILES},{sql.CONTENTS}"
_WINDOWS = f"{_BASE},{sql.windows('contents')}"
_KNOWN = "known AS (SELECT DISTINCT content_id FROM files WHERE repo_ref_id < 10)"
_STORED = """WITH stored AS (
  SELECT doc_id AS chunk_id, sha256(text) AS content_sha256, embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
cached AS (
  SELECT content_sha256, arg_min(embedding, chunk_id) AS cached
  FROM stored WHERE embedding IS NOT NULL GROUP BY content_sha256)"""
_SYMBOLS = """
sized AS (SELECT content_id, content, len(string_split(content, chr(10))) AS lines FROM contents),
outer_symbols AS (
  SELECT content_id, s AS start_line, least(s + 4, lines) AS end_line, concat('s', s) AS name
  FROM (SELECT content_id, lines, unnest(range(2, lines + 1, 7)) AS s FROM sized WHERE lines > 3)),
all_symbols AS (
  SELECT *, CASE WHEN start_line % 3 = 0 THEN concat('doc of ', name) END AS doc FROM (
    SELECT * FROM outer_symbols
    UNION ALL
    SELECT content_id, start_line + 1, start_line + 2, concat('m', name)
    FROM outer_symbols WHERE end_line - start_line >= 3)),
covered AS (
  SELECT content_id, unnest(range(start_line, end_line + 1)) AS line FROM all_symbols),
uncovered AS (
  SELECT content_id, line, line - row_number() OVER (PARTITION BY content_id ORDER BY line) AS grp
  FROM (SELECT content_id, unnest(range(1, lines + 1)) AS line FROM sized) l
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.content_id = l.content_id AND c.line = l.line)),
gaps AS (
  SELECT content_id, min(line) AS start_line, max(line) AS end_line
  FROM uncovered GROUP BY content_id, grp)"""


def _range_windows(max_tokens: int, with_prefix: bool) -> str:
    """CTE ``pieces`` that cuts symbol and gap ranges with prefixes and budgets."""
    prefix = (
        "CASE WHEN first_ordinal % 2 = 0 THEN concat('import ', f.path, chr(10), chr(10)) ELSE '' END"
        if with_prefix
        else "''"
    )
    return f"""{_SYMBOLS},
owner AS (
  SELECT c.content_id, string_split(c.content, chr(10)) AS ls, {prefix} AS prefix
  FROM contents c JOIN files f ON f.ordinal = c.first_ordinal),
parts AS (
  SELECT content_id, start_line, end_line, name AS symbol_name,
         CASE WHEN doc IS NULL THEN '' ELSE concat(doc, chr(10)) END AS doc FROM all_symbols
  UNION ALL SELECT content_id, start_line, end_line, NULL, '' FROM gaps),
budgeted AS (
  SELECT p.*, o.prefix, o.ls[p.start_line : p.end_line] AS part,
         greatest({max_tokens} - ceil(length(o.prefix) / 3.0), {max_tokens} * 0.5) AS body
  FROM parts p JOIN owner o USING (content_id)),
w0 AS (
  SELECT *, array_to_string(part, chr(10)) AS txt, len(part) AS n,
         CASE WHEN symbol_name IS NULL THEN body
              ELSE greatest(body - ceil(length(doc) / 3.0), {max_tokens} * 0.3) END AS budget
  FROM budgeted),
w1 AS (
  SELECT *, ceil(length(txt) / 3.0) <= budget AS fits,
         CAST(greatest(floor(CAST(budget AS DOUBLE) * 3.0 / nullif(length(txt) / n, 0)), 3)
              AS BIGINT) AS h0
  FROM w0 WHERE regexp_matches(txt, '\\S')),
w2 AS (
  SELECT *, CASE WHEN fits THEN n ELSE h0 END AS height,
         CASE WHEN fits THEN n ELSE h0 - CAST(greatest(floor(h0 * 0.2), 1) AS BIGINT) END AS step
  FROM w1),
w3 AS (
  SELECT *, unnest(CASE WHEN n <= height THEN [CAST(0 AS BIGINT)]
                        ELSE range(0, CAST(ceil((n - height) / step) AS BIGINT) * step + 1, step)
                   END) AS i
  FROM w2),
pieces AS (
  SELECT content_id, CAST(start_line + i AS INTEGER) AS start_line,
         CAST(start_line + least(i + height, n) - 1 AS INTEGER) AS end_line, symbol_name,
         concat(prefix, doc, array_to_string(part[i + 1 : least(i + height, n)], chr(10))) AS content
  FROM w3)"""


_ANCHORS = """WITH anchors AS (
  SELECT page_id, i - 1 AS ordinal, a[i] AS anchor FROM (
    SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (
      SELECT page_id, regexp_extract_all(html, '<a href="[^"<>]*">[^<]*</a>') AS a FROM pages))),
imports0 AS (
  SELECT page_id, ordinal, page_id + ordinal AS n,
         regexp_extract(anchor, '<a href="([^"<>]*)">', 1) AS source,
         regexp_extract(anchor, '>([^<]*)</a>', 1) AS name FROM anchors),
imports AS (
  SELECT CAST(page_id AS VARCHAR) AS content_id, CAST(ordinal AS INTEGER) AS ordinal,
         ['typescript', 'python', 'go', 'rust', 'java', 'c', 'markdown', 'javascript', 'kotlin',
          'cpp'][page_id % 10 + 1] AS language,
         source, n % 3 <> 0 AS named, name, CASE WHEN n % 4 = 1 THEN name END AS default_name,
         CAST(CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_namespace FROM imports0)"""

def _synced(spark: SparkSession, folder: str) -> StoredEngine:
    """Both versions of the documents as refs of one repository, each stored by its own sync."""
    kinds = {f.name: f.dataType for f in REPOS.fields}
    values = {"id": F.lit(1), "name": F.lit("corpus"), "glob_patterns": F.array()}
    repos = spark.range(1).select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kinds])
    engine = StoredEngine.create(repos, work_folder(spark, "engine"), HashingEmbedder(8))
    versions = tables.snapshot_pair(spark, folder).withColumn("language", F.substring_index("path", "/", 1))
    for number in (1, 2):
        files = versions.where(F.col("repo_ref_id") == number).select("path", "language", "content")
        engine = engine.sync_ref("corpus", f"v{number}.0.0", f"c{number}", files)
    return engine


def sync_ref(spark: SparkSession, folder: str) -> DataFrame:
    """What two syncs leave in the rows of their refs."""
    return _synced(spark, folder).repo_refs.select(
        "ref", "commit_sha", "stage", "semver", "files_total", "files_processed", "chunks_total",
        "chunks_embedded", F.size("language_stats").alias("languages"),
    )


def delete_version(spark: SparkSession, folder: str) -> DataFrame:
    """Contents and chunks that are left, by language, when the first version goes."""
    state = _synced(spark, folder).delete_version("corpus", "v1.0.0").state
    sizes = state.chunks.groupBy("content_id").agg(F.count(F.lit(1)).alias("chunks"))
    held = state.file_contents.join(sizes, "content_id", "left")
    return held.groupBy("language").agg(
        F.count(F.lit(1)).alias("contents"), F.sum("chunks").alias("chunks"),
    )


QUERIES = {
    "q_sync_ref": sync_ref,
    "q_delete_version": delete_version,
    "q_sha256": sha256,
    "q_skip_file": skip_file,
    "q_classify_language": classify_language,
    "q_glob_filter": glob_filter,
    "q_gitignore_filter": gitignore_filter,
    "q_manifest_languages": manifest_languages,
    "q_parse_list": parse_list,
    "q_redact": redact,
    "q_remote_hosts": remote_hosts,
    "q_language_stats": language_shares,
    "q_language_ranking": language_ranking,
    "q_file_dedup": file_dedup,
    "q_dedup_summary": dedup_summary,
    "q_last_write": last_write,
    "q_distinct_on": distinct_on,
    "q_embedding_cache": embedding_cache,
    "q_cache_summary": cache_summary,
    "q_repair_unembedded": repair_unembedded,
    "q_backfill_hash": backfill_hash,
    "q_chunk_windows": chunk_windows,
    "q_gap_ranges": gap_ranges,
    "q_html_links": html_links,
    "q_import_prefix": import_prefix,
    "q_chunk_file": chunk_file,
    "q_chunk_symbol_link": chunk_symbol_link,
    "q_truncate": truncate,
    "q_upsert_latest": upsert_latest,
}

_VERSIONS = f"""WITH versions AS (
  SELECT 1 AS v, lang, text AS content, sha256(text) AS content_id, doc_id FROM documents
  WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT 2, lang, t, sha256(t), doc_id FROM (
    SELECT lang, doc_id, CASE WHEN doc_id % 10 = 2 THEN concat(text, chr(10), '// v2') ELSE text END AS t
    FROM documents WHERE doc_id % 10 <> 1)),
texts AS (SELECT DISTINCT content_id, content FROM versions),{sql.windows('texts')},
sizes AS (SELECT content_id, count(*) AS n FROM pieces GROUP BY content_id)"""

ORACLES = {
    "q_sync_ref": f"""{_VERSIONS},
held AS (
  SELECT v, CAST(sum(n) AS INTEGER) AS n FROM (SELECT DISTINCT v, content_id FROM versions)
  JOIN sizes USING (content_id) GROUP BY v)
SELECT concat('v', v, '.0.0') AS ref, concat('c', v) AS commit_sha, 'ready' AS stage,
  concat(v, '.0.0') AS semver, CAST(count(*) AS INTEGER) AS files_total,
  CAST(count(*) AS INTEGER) AS files_processed, any_value(n) AS chunks_total,
  any_value(n) AS chunks_embedded, CAST(count(DISTINCT lang) AS INTEGER) AS languages
FROM versions JOIN held USING (v) GROUP BY v""",
    "q_delete_version": f"""{_VERSIONS},
-- A content's language is that of the first path of the version that brought it.
brought AS (
  SELECT content_id, arg_min(lang, concat(v, lang, '/', doc_id)) AS language
  FROM versions GROUP BY content_id)
SELECT language, count(*) AS contents, CAST(sum(n) AS BIGINT) AS chunks
FROM brought LEFT JOIN sizes USING (content_id)
WHERE content_id IN (SELECT content_id FROM versions WHERE v = 2) GROUP BY language""",
    "q_sha256": """SELECT doc_id, sha256(text) AS content_id,
  CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens FROM documents""",
    "q_skip_file": """SELECT doc_id,
  CASE WHEN strlen(text) > 8192 THEN 'too-large'
       WHEN len(string_split(text, chr(10))) > 1
            AND length(text) / len(string_split(text, chr(10))) > 500
       THEN 'minified-or-generated' END AS skip_reason FROM documents""",
    "q_classify_language": f"""{_PATHS}, ext AS (
  SELECT path, lower(regexp_extract(path, '[^/]+(\\.[^./]*)$', 1)) AS extension FROM paths)
SELECT path, extension, {_LANG_CASE} AS language FROM ext""",
    "q_glob_filter": f"""{_PATHS} SELECT path FROM paths
WHERE (starts_with(path, 'src/') OR starts_with(path, 'docs/')) AND NOT contains(path, '/.')
  AND NOT (path LIKE '%.md' OR path LIKE '%.png')""",
    "q_gitignore_filter": f"""{_PATHS} SELECT path FROM paths
WHERE NOT (path LIKE 'node_modules/%' OR path LIKE '%build/%' OR path LIKE '%.lock'
           OR path LIKE '%.h' OR path LIKE 'logs/%' OR path LIKE 'docs/%'
           OR path LIKE 'src/%.go')""",
    "q_manifest_languages": f"""WITH m(path, language) AS (VALUES {_MANIFEST_ROWS}),
f AS (SELECT doc_id % 150 AS repo_ref_id, {_MANIFEST_NAMES}[((doc_id * 7) // 13) % 21 + 1] AS path
      FROM documents)
SELECT DISTINCT repo_ref_id, language FROM f JOIN m USING (path)""",
    "q_parse_list": """WITH l AS (
  SELECT doc_id, list_transform(string_split(replace(text, ' ', ' , '), ','),
                                lambda x: trim(x, ' ')) AS items FROM documents)
SELECT doc_id,
  list_filter(list_transform(items, lambda x: lower(x)),
              lambda x: x IN ('le', 'la', 'the', 'und', 'de')) AS kept,
  CAST(len(list_filter(items, lambda x: x <> '')) AS INTEGER) AS items FROM l""",
    "q_redact": """SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, ' '),
  lambda w: CASE WHEN length(w) <= 4 THEN '****' ELSE concat('****', right(w, 4)) END), ' '))
  AS redacted FROM documents""",
    "q_remote_hosts": """WITH u AS (
  SELECT page_id, split_part(url, '?', 1) AS url FROM pages),
v AS (SELECT page_id, upper(translate(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), '.-', '__'))
        AS env_suffix, regexp_extract(url, '([^/:]+?)(?:\\.git)?/?$', 1) AS repo_name FROM u)
SELECT page_id, env_suffix, repo_name,
  length(repo_name) BETWEEN 1 AND 255 AND repo_name NOT IN ('.', '..')
  AND NOT contains(repo_name, '/') AND NOT contains(repo_name, chr(92)) AS valid_name FROM v""",
    "q_language_stats": f"""WITH {sql.FILES}
SELECT repo_ref_id, language, count(*) AS files,
  floor(count(*) / sum(count(*)) OVER (PARTITION BY repo_ref_id) * 1000 + 0.5) / 10 AS percent
FROM files GROUP BY repo_ref_id, language""",
    "q_language_ranking": f"""WITH {sql.FILES}, s AS (
SELECT repo_ref_id AS id, language,
  floor(count(*) / sum(count(*)) OVER (PARTITION BY repo_ref_id) * 1000 + 0.5) / 10 AS percent
FROM files GROUP BY repo_ref_id, language)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY percent DESC, language) - 1 AS INTEGER)
  AS position, language, percent FROM s""",
    "q_file_dedup": f"""WITH {sql.FILES}, {_KNOWN}
SELECT content_id, arg_min(language, ordinal) AS language, min(ordinal) AS first_ordinal,
  count(*) AS copies, content_id NOT IN (SELECT content_id FROM known) AS is_new
FROM files WHERE repo_ref_id >= 8 GROUP BY content_id""",
    "q_dedup_summary": f"""{_WINDOWS}, {_KNOWN},
run AS (SELECT content_id, content_id NOT IN (SELECT content_id FROM known) AS is_new
        FROM files WHERE repo_ref_id >= 8 GROUP BY content_id),
per AS (SELECT p.content_id, count(*) AS n, count(*) FILTER (WHERE e.vec_id IS NULL) AS bare
        FROM pieces p JOIN contents c USING (content_id)
        LEFT JOIN embeddings e ON e.vec_id = c.first_ordinal GROUP BY p.content_id)
SELECT CAST(count(*) FILTER (WHERE is_new) AS BIGINT) AS files_new,
  CAST(count(*) FILTER (WHERE NOT is_new) AS BIGINT) AS files_reused,
  CAST(coalesce(sum(n) FILTER (WHERE is_new), 0) AS BIGINT) AS chunks_new,
  CAST(coalesce(sum(bare) FILTER (WHERE NOT is_new), 0) AS BIGINT) AS chunks_repair
FROM run LEFT JOIN per USING (content_id)""",
    "q_last_write": """SELECT concat(lang, '/', doc_id // 10) AS path,
  arg_max(sha256(text), doc_id) AS content_id, max(doc_id) AS ordinal
FROM documents GROUP BY lang, doc_id // 10""",
    "q_distinct_on": f"""{_STORED}
SELECT content_sha256, CAST(cached AS DOUBLE[]) AS embedding FROM cached""",
    "q_embedding_cache": f"""{_STORED}
SELECT chunk_id, cached IS NOT NULL AS reused, list_transform(cached, lambda v: round(CAST(v AS DOUBLE), 6)) AS vector
FROM stored LEFT JOIN cached USING (content_sha256)""",
    "q_cache_summary": f"""{_STORED}
SELECT count(cached) AS chunks_reused, count(*) - count(cached) AS chunks_to_embed
FROM stored LEFT JOIN cached USING (content_sha256)""",
    "q_repair_unembedded": f"""{_WINDOWS}, {_KNOWN}
SELECT content_id, start_line, end_line FROM pieces JOIN contents USING (content_id)
WHERE content_id IN (SELECT content_id FROM known)
  AND first_ordinal NOT IN (SELECT vec_id FROM embeddings)""",
    "q_backfill_hash": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents",
    "q_chunk_windows": f"""{_WINDOWS}
SELECT content_id, start_line, end_line, sha256(content) AS chunk_sha FROM pieces""",
    "q_gap_ranges": f"""{_BASE},{_SYMBOLS}
SELECT content_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line
FROM gaps""",
    "q_html_links": f"""{_ANCHORS}
SELECT content_id, ordinal, source, default_name, is_namespace FROM imports""",
    "q_import_prefix": f"""{_ANCHORS}, rendered AS (
SELECT content_id, ordinal, CASE
  WHEN language = 'python' THEN CASE WHEN named THEN concat('from ', source, ' import ', name)
    WHEN is_namespace = 1 AND coalesce(default_name, '') <> ''
      THEN concat('import ', source, ' as ', default_name)
    ELSE concat('import ', source) END
  WHEN language = 'go' THEN CASE WHEN coalesce(default_name, '') <> ''
    THEN concat('import ', default_name, ' "', source, '"')
    ELSE concat('import "', source, '"') END
  WHEN language = 'rust' THEN CASE WHEN named THEN concat('use ', source, '::{{', name, '}};')
    WHEN coalesce(default_name, '') <> '' AND default_name <> source
      THEN concat('use ', source, ' as ', default_name, ';')
    ELSE concat('use ', source, ';') END
  WHEN language IN ('java', 'kotlin') THEN concat('import ', source, ';')
  WHEN language IN ('c', 'cpp') THEN concat('#include "', source, '"')
  WHEN language = 'markdown' THEN concat('<!-- link: ', source, ' -->')
  WHEN is_namespace = 1 AND coalesce(default_name, '') <> ''
    THEN concat('import * as ', default_name, ' from "', source, '";')
  WHEN coalesce(default_name, '') <> '' AND named
    THEN concat('import ', default_name, ', {{ ', name, ' }} from "', source, '";')
  WHEN coalesce(default_name, '') <> ''
    THEN concat('import ', default_name, ' from "', source, '";')
  WHEN named THEN concat('import {{ ', name, ' }} from "', source, '";')
  ELSE concat('import "', source, '";') END AS line FROM imports)
SELECT content_id, concat(string_agg(line, chr(10) ORDER BY ordinal), chr(10), chr(10))
  AS import_prefix FROM rendered GROUP BY content_id""",
    "q_chunk_file": f"""{_BASE},{_range_windows(200, True)}
SELECT content_id, start_line, end_line, symbol_name, sha256(content) AS chunk_sha FROM pieces""",
    "q_chunk_symbol_link": f"""{_BASE},{_range_windows(60, False)}
SELECT CASE WHEN symbol_name IS NULL THEN NULL ELSE concat(content_id, ':', symbol_name) END
  AS symbol_id, count(*) AS chunks FROM pieces GROUP BY 1""",
    "q_truncate": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
k AS (
  SELECT doc_id, text, ls, len(list_filter(range(1, len(ls) + 1), lambda i:
    ceil(length(array_to_string(ls[1:i], chr(10))) / 3.0) <= 100)) AS kept FROM l),
c AS (
  SELECT doc_id, CASE WHEN ceil(length(text) / 3.0) <= 100 THEN text
    WHEN kept > 0 THEN array_to_string(ls[1:kept], chr(10)) ELSE left(text, 150) END AS cut FROM k)
SELECT doc_id, CAST(length(cut) AS INTEGER) AS kept, sha256(cut) AS cut_sha FROM c""",
    "q_upsert_latest": """WITH f AS (
  SELECT concat(lang, '/', doc_id) AS path, doc_id, text FROM documents)
SELECT path, sha256(CASE WHEN doc_id % 10 = 2 THEN concat(text, chr(10), '// v2') ELSE text END)
  AS content_id FROM f""",
}
