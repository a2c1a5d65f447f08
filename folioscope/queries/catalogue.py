"""Lookups, versions, diffs, upkeep and job queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import labels, versions
from folioscope.functions import text as text_fn
from folioscope.operators import context, ingest, jobs, lookup, maintain, refs, trees
from folioscope.operators.substrings import SubstringIndex
from folioscope.queries import ingest as ingest_queries
from folioscope.queries import sql
from folioscope.sources import tables
from folioscope.sources.work import work_folder

# --- scans and lookups -----------------------------------------------------------


def scan_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents")
    return tables.scan(docs, (F.col("lang") == "fr") & (F.col("n_chars") > 500)).select(
        "doc_id", "source", "n_chars"
    )


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents")
    found = tables.find_one(docs, (F.col("source") == "src3") & (F.col("lang") == "de"), "doc_id")
    return found.select("doc_id", "source", "lang")


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.file_tree(tables.corpus_ref_files(spark, folder), 2, "en/")


def find_files(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.find_files(tables.corpus_ref_files(spark, folder), 3, "N/1_").select(
        "path", "content_id"
    )


def find_files_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same files by an index of all paths, added in two batches."""
    files = tables.corpus_ref_files(spark, folder)
    index = SubstringIndex(spark, work_folder(spark, "paths"))
    paths = files.select(F.col("path").alias("text"), (F.col("repo_ref_id") % 2).alias("part"))
    for part in (0, 1):
        index.add(paths.where(F.col("part") == part), part)
    found = index.matching("N/1_").withColumnRenamed("text", "path")
    return files.where(F.col("repo_ref_id") == 3).join(found, "path", "left_semi").select("path", "content_id")


def find_files_lang(spark: SparkSession, folder: str) -> DataFrame:
    files = tables.corpus_ref_files(spark, folder).drop("language")
    contents = tables.corpus_contents(spark, folder)
    return lookup.find_files(files, 3, "1", contents, ["fr", "de"]).select(
        "path", "content_id", "language"
    )


def _symbol_tables(spark: SparkSession, folder: str):
    symbols = ingest_queries.document_symbols(spark, folder)
    contents = tables.corpus_contents(spark, folder)
    files = tables.corpus_ref_files(spark, folder).drop("language")
    return symbols, contents, files


def find_symbols(spark: SparkSession, folder: str) -> DataFrame:
    found = lookup.find_symbols(*_symbol_tables(spark, folder), 1, "S1")
    return found.select("path", "name", "start_line", "end_line")


def _small_chunks(spark: SparkSession, folder: str) -> DataFrame:
    from folioscope.operators import chunking

    return chunking.chunk_files(
        tables.corpus_texts(spark, folder),
        ingest_queries.document_symbols(spark, folder),
        max_tokens=60,
    )


def get_symbol(spark: SparkSession, folder: str) -> DataFrame:
    symbols, contents, files = _symbol_tables(spark, folder)
    found = lookup.get_symbol(
        symbols, contents, files, _small_chunks(spark, folder), 1, "s9", ["en", "fr"]
    )
    return found.select("file_path", "name", "start_line", "end_line", F.sha2("source", 256).alias("source_sha"))


def symbol_source(spark: SparkSession, folder: str) -> DataFrame:
    symbols = ingest_queries.document_symbols(spark, folder)
    key = ["content_id", "name", "start_line", "end_line"]
    sources = lookup.symbol_source(symbols, _small_chunks(spark, folder), key)
    return sources.select(*key, F.sha2("source", 256).alias("source_sha"))


def document_imports(spark: SparkSession, folder: str) -> DataFrame:
    """The words of every content but the first as the names it imports."""
    texts = tables.corpus_texts(spark, folder)
    words = F.split("content", " ")
    return texts.select(
        "content_id",
        F.col("path").alias("source"),
        F.slice(words, F.lit(2), F.size(words)).alias("names"),
        F.try_element_at(words, F.lit(2)).alias("default_name"),
        F.lit(0).alias("is_namespace"),
    )


def find_references(spark: SparkSession, folder: str) -> DataFrame:
    files = tables.corpus_ref_files(spark, folder).drop("language")
    contents = tables.corpus_contents(spark, folder)
    return lookup.find_references(document_imports(spark, folder), contents, files, 1, "de")


def get_file(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of one ref rebuilt from its chunks."""
    files = tables.corpus_ref_files(spark, folder).where(F.col("repo_ref_id") == 4)
    chunks = tables.corpus_chunks(spark, folder)
    texts = lookup.file_text(chunks.join(files, "content_id", "left_semi"))
    return files.join(texts, "content_id").select("path", F.sha2("content", 256).alias("text_sha"))


def list_repos(spark: SparkSession, folder: str) -> DataFrame:
    listed = lookup.list_repos(tables.corpus_repos(spark, folder), tables.corpus_refs(spark, folder))
    return listed.select("repo", "repo_ref_id", "ref", "stage", "files_total")


def list_repos_lang(spark: SparkSession, folder: str) -> DataFrame:
    refs_table = tables.corpus_refs(spark, folder)
    listed = lookup.list_repos(tables.corpus_repos(spark, folder), refs_table, ["fr", "es"], 20)
    return listed.select("repo", "repo_ref_id", "ref")


def ready_refs(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.ready_refs(tables.corpus_repos(spark, folder), tables.corpus_refs(spark, folder))


def active_progress(spark: SparkSession, folder: str) -> DataFrame:
    repos = tables.corpus_repos(spark, folder).where(F.col("id") != 2)
    active = lookup.active_progress(repos, tables.corpus_refs(spark, folder))
    return active.select("repo", "ref", "stage", "files_total")


def latest_ready_ref(spark: SparkSession, folder: str) -> DataFrame:
    return refs.latest_ready(tables.corpus_refs(spark, folder))


# --- versions --------------------------------------------------------------------


def version_refs(spark: SparkSession, folder: str) -> DataFrame:
    """One tag or branch name per document; the source is the repository."""
    docs = tables.table(spark, folder, "documents")
    n = F.expr("doc_id div 20")
    core = F.concat_ws(".", (n % 4).cast("string"), (n % 7).cast("string"), (n % 11).cast("string"))
    kind = n % 8
    ref = (
        F.when(kind <= 2, F.concat(F.lit("v"), core))
        .when(kind == 3, F.concat(F.lit(" ="), core, F.lit(" ")))
        .when(kind == 4, F.concat(F.lit("v"), core, F.lit("-beta."), (n % 13).cast("string")))
        .when(kind == 5, F.concat(core, F.lit("+build.7")))
        .when(kind == 6, F.concat(F.lit("v0"), core, F.lit(".x")))
        .otherwise(F.concat(F.lit("feature/"), core))
    )
    return docs.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 20).alias("repo_id"),
        ref.alias("ref"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("commit_sha"),
    )


def parse_semver(spark: SparkSession, folder: str) -> DataFrame:
    return refs.with_version(version_refs(spark, folder)).select("id", "ref", "semver")


CONSTRAINTS = ("^1.2.0", "~2.3", ">=1.2.3-beta.0 <2.0.0 || 0.x", "1.1.0 - 2.4", "main", "", "1.x || main")


def semver_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return refs.resolve_semvers(version_refs(spark, folder), CONSTRAINTS)



NAMES = ("feature/1.1.1", "2.x", "v01.1.5.x")


def resolve_ref(spark: SparkSession, folder: str) -> DataFrame:
    return refs.resolve_refs(version_refs(spark, folder), NAMES)


# --- diffs -----------------------------------------------------------------------


def _diff(spark: SparkSession, folder: str) -> DataFrame:
    return context.ref_diff(tables.snapshot_pair(spark, folder), 1, 2)


def ref_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder)


def tree_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The same files in folders of ten, ten by ten; the diff goes by digests of folders."""
    number = F.substring_index("path", "/", -1)
    deep = F.concat_ws(
        "/", F.substring_index("path", "/", 1), F.expr("cast(substring_index(path, '/', -1) as long) div 100"),
        F.expr("cast(substring_index(path, '/', -1) as long) div 10"), number,
    )
    pair = tables.snapshot_pair(spark, folder).select("repo_ref_id", deep.alias("path"), "content_id")
    place = work_folder(spark, "trees")
    for ref in (1, 2):
        trees.write_tree(pair.where(F.col("repo_ref_id") == ref), place, ref)
    return trees.ref_diff(spark, place, 1, 2)


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    from folioscope.operators import chunking

    pair = tables.snapshot_pair(spark, folder)
    new = pair.where(F.col("repo_ref_id") == 2).select("path", "content_id", "content")
    contents = new.groupBy("content_id").agg(F.min_by("content", "path").alias("content"))
    return context.recent_changes(_diff(spark, folder), chunking.chunk_files(contents))


def recent_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select(
        "file_path", "start_line", "end_line", "annotation", F.sha2("content", 256).alias("content_sha")
    )


def recent_pack(spark: SparkSession, folder: str) -> DataFrame:
    return context.trim_to_budget(_changes(spark, folder), 4000).select(
        "position", "file_path", "start_line", "end_line", "annotation", "used"
    )


def union_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """Paths in exactly one of the two snapshots, by set operations."""
    pair = tables.snapshot_pair(spark, folder)
    old = pair.where(F.col("repo_ref_id") == 1).select("path")
    new = pair.where(F.col("repo_ref_id") == 2).select("path")
    gone = old.subtract(new).withColumn("side", F.lit("deleted"))
    return gone.unionByName(new.subtract(old).withColumn("side", F.lit("added")))


# --- upkeep ----------------------------------------------------------------------


def stale_files(spark: SparkSession, folder: str) -> DataFrame:
    pair = tables.snapshot_pair(spark, folder).drop("content")
    old, new = pair.where(F.col("repo_ref_id") == 1), pair.where(F.col("repo_ref_id") == 2)
    return maintain.stale_files(old, new).select("path", "content_id")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    pair = tables.snapshot_pair(spark, folder).drop("content")
    contents = pair.select("content_id").distinct()
    return maintain.orphans(contents, pair.where(F.col("repo_ref_id") == 2))


def sweep_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks left once contents only the first ten refs use are swept away."""
    files = tables.corpus_ref_files(spark, folder)
    left = files.where(F.col("repo_ref_id") >= 10)
    swept = maintain.sweep_orphans(
        tables.corpus_contents(spark, folder), left, {"chunks": tables.corpus_chunks(spark, folder)}
    )
    return swept["chunks"].groupBy("content_id").agg(F.count("*").alias("chunks"))


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    left = maintain.cascade_delete_repo(
        2,
        tables.corpus_repos(spark, folder),
        tables.corpus_refs(spark, folder),
        tables.corpus_ref_files(spark, folder),
    )
    return left["ref_files"].groupBy("repo_ref_id").agg(F.count("*").alias("files"))


def update_from_values(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors for even documents and an error for every third one."""
    chunks = tables.table(spark, folder, "documents").select(
        "doc_id", F.lit(0).alias("label"), F.lit(None).cast("string").alias("embedding_error")
    )
    failed = F.col("vec_id") % 3 == 0
    updates = tables.table(spark, folder, "embeddings").where(F.col("vec_id") % 2 == 0).select(
        F.col("vec_id").alias("doc_id"),
        F.when(~failed, F.col("label")).alias("label"),
        F.when(failed, F.lit("provider failed")).alias("embedding_error"),
    )
    return maintain.update_from(chunks, updates, ["doc_id"], ["label", "embedding_error"])


def move_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """UPDATE ... FROM of whole vectors: each even one becomes that of its odd neighbour."""
    rows = tables.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>"))
    odd = rows.where(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    return maintain.update_from(rows, odd, ["vec_id"], ["embedding"])


def delete_keys(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select("doc_id", "lang")
    toxic = tables.table(spark, folder, "labels").where(F.col("toxic") == 1)
    return maintain.delete_keys(docs, toxic, ["doc_id"])


def update_delete_where(spark: SparkSession, folder: str) -> DataFrame:
    users = tables.table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    moved = maintain.update_where(
        users, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("IN DEBT")}
    )
    return maintain.delete_where(moved, F.col("c_mktsegment") == "MACHINERY")


def queue_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Requests for every third ref and for one new ref per repository."""
    current = tables.corpus_refs(spark, folder).select(
        "id", "repo_id", "ref", "commit_sha", "stage", "files_total"
    )
    again = current.where(F.col("id") % 3 == 0).select("repo_id", "ref")
    fresh = tables.corpus_repos(spark, folder).select(
        F.col("id").alias("repo_id"), F.lit("v9.0.0").alias("ref")
    )
    return maintain.queue_refs(current, again.unionByName(fresh)).drop("id")


def unique_check(spark: SparkSession, folder: str) -> DataFrame:
    return maintain.duplicate_keys(tables.corpus_ref_files(spark, folder), ["content_id"])


def missing_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose document is not in the English part."""
    docs = tables.table(spark, folder, "documents").where(F.col("lang") == "en")
    return maintain.missing_parents(tables.table(spark, folder, "labels"), docs, ["doc_id"])


# --- jobs and progress -----------------------------------------------------------

STAGE_OF = {
    "view": "syncing", "click": "processing-files", "signup": "embedding",
    "purchase": "ready", "error": "error",
}


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.table(spark, folder, "events")
    pairs = [F.lit(x) for item in STAGE_OF.items() for x in item]
    stage = F.element_at(F.create_map(*pairs), F.col("event_type"))
    return events.select("user_id", "ts", "event_id", stage.alias("stage"), "value")


ORDER = ["ts", "event_id"]


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.latest_state(_stages(spark, folder), ["user_id"], ORDER).select(
        "user_id", "event_id", "stage", "value"
    )


def progress_per_repo(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.progress_per_repo(_stages(spark, folder), "user_id", ORDER).select(
        "user_id", "event_id", "stage"
    )


def stage_transitions(spark: SparkSession, folder: str) -> DataFrame:
    moved = jobs.just_finished(_stages(spark, folder), ["user_id"], ORDER)
    return moved.select("user_id", "event_id", "previous", "stage")


def job_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and views ask for an index job; purchases and errors end it."""
    stages = _stages(spark, folder).where(F.col("stage") != "embedding")
    kind = F.when(F.col("stage").isin("ready", "error"), "finish").otherwise("request")
    requests = stages.withColumn("kind", kind)
    return jobs.accepted_jobs(requests, ["user_id"], ORDER).select("user_id", "event_id")


def job_cancel(spark: SparkSession, folder: str) -> DataFrame:
    """Queue after the jobs of every user with an order error were cancelled."""
    events = tables.table(spark, folder, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "error", "failed"
    ).otherwise("active")
    queue = events.select("event_id", "user_id", state.alias("state"))
    keys = events.where((F.col("event_type") == "error") & (F.col("value") > 30)).select("user_id")
    return jobs.cancelled(queue, keys, ["user_id"])


def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.progress_counters(progress_events(spark, folder), ["job"])


EVENT_KINDS = {
    "view": "file-done", "click": "file-skipped", "error": "file-error",
    "signup": "embedding-start", "purchase": "embedding-batch-done",
}


def progress_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_progress(tables.table(spark, folder, "events"))


def as_progress(events: DataFrame) -> DataFrame:
    """Events as progress reports of the job of their user."""
    pairs = [F.lit(x) for item in EVENT_KINDS.items() for x in item]
    return events.select(
        F.col("user_id").alias("job"),
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("amount"),
    )


def stage_labels(spark: SparkSession, folder: str) -> DataFrame:
    events = _stages(spark, folder)
    k = (F.col("event_id") % 40).cast("int")
    return events.select(
        "event_id", labels.stage_label(F.col("stage"), k, F.lit(40), k, k % 3).alias("label")
    )


def remote_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of every kind, with the text of the event mixed in."""
    events = tables.table(spark, folder, "events")
    message = (
        F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit(": The requested URL returned error: 403")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("fatal: could not read Username for "), "event_type"))
        .when(F.col("event_id") % 4 == 2, F.concat("event_type", F.lit(" does not exist")))
        .otherwise(F.col("event_type"))
    )
    kinds = events.select(labels.remote_error_kind(message).alias("kind"), "event_type")
    return kinds.groupBy("kind", "event_type").agg(F.count("*").alias("messages"))


def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    """Delay after each failure of a user, counting the failures of the day."""
    events = tables.table(spark, folder, "events").where(F.col("event_type") == "error")
    failures = events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.count("*").alias("failures")
    )
    return failures.withColumn("delay", jobs.retry_delays(F.col("failures")))


_BASE = f"WITH {sql.FILES},{sql.CONTENTS}"
_REFS = """
refs AS (
  SELECT r AS id, r % 5 AS repo_id, concat('v1.', CAST(r // 5 AS VARCHAR), '.0') AS ref,
         concat('c', r) AS commit_sha,
         CASE WHEN r % 7 = 3 THEN 'error' WHEN r % 7 = 5 THEN 'embedding' ELSE 'ready' END AS stage,
         CAST(n AS INTEGER) AS files_total
  FROM (SELECT doc_id % 20 AS r, count(*) AS n FROM documents GROUP BY 1))"""
_SNAP = """
snap AS (
  SELECT 1 AS v, concat(lang, '/', doc_id) AS path, text AS content FROM documents
  WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT 2, concat(lang, '/', doc_id),
         CASE WHEN doc_id % 10 = 2 THEN concat(text, chr(10), '// v2') ELSE text END
  FROM documents WHERE doc_id % 10 <> 1),
diff AS (
  SELECT coalesce(n.path, o.path) AS path,
         CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
              ELSE 'modified' END AS change_type,
         sha256(n.content) AS content_id
  FROM (SELECT * FROM snap WHERE v = 1) o
  FULL OUTER JOIN (SELECT * FROM snap WHERE v = 2) n ON o.path = n.path
  WHERE o.path IS NULL OR n.path IS NULL OR o.content <> n.content)"""
_CHANGES = f"""{_SNAP},
new_contents AS (
  SELECT sha256(content) AS content_id, min(content) AS content FROM snap WHERE v = 2 GROUP BY 1),
{sql.windows('new_contents').lstrip()},
changes AS (
  SELECT path AS file_path, start_line, end_line, content, change_type AS annotation
  FROM diff JOIN pieces USING (content_id)
  UNION ALL
  SELECT path, 0, 0, '(file deleted)', 'deleted' FROM diff WHERE change_type = 'deleted')"""
_SMALL = f"{_BASE},{ingest_queries._range_windows(60, False)}"
_SOURCES = """
sources AS (
  SELECT s.content_id, s.name, s.start_line, s.end_line,
         coalesce(string_agg(p.content, chr(10)
                  ORDER BY p.start_line, p.end_line, p.content), '') AS source
  FROM all_symbols s LEFT JOIN pieces p
    ON p.content_id = s.content_id AND p.start_line >= s.start_line AND p.end_line <= s.end_line
  GROUP BY ALL)"""
_VERSIONS = """
vrefs AS (
  SELECT doc_id AS id, doc_id % 20 AS repo_id, concat('c', doc_id) AS commit_sha,
         CASE WHEN k <= 2 THEN concat('v', core) WHEN k = 3 THEN concat(' =', core, ' ')
              WHEN k = 4 THEN concat('v', core, '-beta.', n % 13)
              WHEN k = 5 THEN concat(core, '+build.7') WHEN k = 6 THEN concat('v0', core, '.x')
              ELSE concat('feature/', core) END AS ref,
         CASE WHEN k = 4 THEN concat(core, '-beta.', n % 13) WHEN k <= 5 THEN core END AS semver,
         CASE WHEN k <= 5 THEN n % 4 END AS ma, CASE WHEN k <= 5 THEN n % 7 END AS mi,
         CASE WHEN k <= 5 THEN n % 11 END AS pa, CASE WHEN k = 4 THEN n % 13 END AS pre
  FROM (SELECT doc_id, doc_id // 20 AS n, (doc_id // 20) % 8 AS k,
               concat((doc_id // 20) % 4, '.', (doc_id // 20) % 7, '.', (doc_id // 20) % 11) AS core
        FROM documents))"""
_PICK = """
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ma DESC, mi DESC, pa DESC,
                             pre IS NULL DESC, pre DESC, id) = 1"""


def _resolve_sql(wanted: str, condition: str) -> str:
    return (
        f"(SELECT repo_id, id, ref, '{wanted}' AS wanted FROM vrefs"
        f" WHERE semver IS NOT NULL AND ({condition}){_PICK})"
    )


_STAGES = "stages AS (SELECT *, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()
) + " END AS stage FROM events)"
_KINDS = "kinds AS (SELECT *, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_KINDS.items()
) + " END AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS amount FROM events)"
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.STAGE_LABELS.items())

QUERIES = {
    "q_scan_filter": scan_filter,
    "q_point_lookup": point_lookup,
    "q_file_tree": file_tree,
    "q_find_files": find_files,
    "q_find_files_indexed": find_files_indexed,
    "q_find_files_lang": find_files_lang,
    "q_find_symbols": find_symbols,
    "q_get_symbol": get_symbol,
    "q_symbol_source": symbol_source,
    "q_find_references": find_references,
    "q_get_file": get_file,
    "q_list_repos": list_repos,
    "q_list_repos_lang": list_repos_lang,
    "q_ready_refs": ready_refs,
    "q_active_progress": active_progress,
    "q_latest_ready_ref": latest_ready_ref,
    "q_parse_semver": parse_semver,
    "q_semver_resolve": semver_resolve,
    "q_resolve_ref": resolve_ref,
    "q_ref_diff": ref_diff,
    "q_tree_diff": tree_diff,
    "q_recent_changes": recent_changes,
    "q_recent_pack": recent_pack,
    "q_union_deleted": union_deleted,
    "q_stale_files": stale_files,
    "q_orphans": orphans,
    "q_sweep_orphans": sweep_orphans,
    "q_cascade_delete": cascade_delete,
    "q_update_from_values": update_from_values,
    "q_move_vectors": move_vectors,
    "q_delete_keys": delete_keys,
    "q_update_delete_where": update_delete_where,
    "q_queue_refs": queue_refs,
    "q_unique_check": unique_check,
    "q_missing_parents": missing_parents,
    "q_latest_state": latest_state,
    "q_progress_per_repo": progress_per_repo,
    "q_stage_transitions": stage_transitions,
    "q_job_dedup": job_dedup,
    "q_job_cancel": job_cancel,
    "q_stream_progress": stream_progress,
    "q_stage_labels": stage_labels,
    "q_remote_errors": remote_errors,
    "q_retry_delays": retry_delays,
}

ORACLES = {
    "q_scan_filter": """SELECT doc_id, source, n_chars FROM documents
WHERE lang = 'fr' AND n_chars > 500""",
    "q_point_lookup": """SELECT doc_id, source, lang FROM documents
WHERE source = 'src3' AND lang = 'de' ORDER BY doc_id LIMIT 1""",
    "q_file_tree": f"""WITH {sql.FILES} SELECT DISTINCT path FROM files
WHERE repo_ref_id = 2 AND path LIKE 'en/%'""",
    "q_find_files": f"""WITH {sql.FILES} SELECT path, content_id FROM files
WHERE repo_ref_id = 3 AND path ILIKE '%N/1_%'""",
    "q_find_files_lang": f"""{_BASE} SELECT f.path, f.content_id, c.language
FROM files f JOIN contents c USING (content_id)
WHERE f.repo_ref_id = 3 AND f.path ILIKE '%1%' AND c.language IN ('fr', 'de')""",
    "q_find_symbols": f"""{_BASE},{ingest_queries._SYMBOLS}
SELECT f.path, s.name, CAST(s.start_line AS INTEGER) AS start_line,
  CAST(s.end_line AS INTEGER) AS end_line
FROM all_symbols s JOIN files f USING (content_id)
WHERE f.repo_ref_id = 1 AND s.name ILIKE '%S1%'""",
    "q_get_symbol": f"""{_SMALL},{_SOURCES}
SELECT f.path AS file_path, s.name, CAST(s.start_line AS INTEGER) AS start_line,
  CAST(s.end_line AS INTEGER) AS end_line, sha256(s.source) AS source_sha
FROM sources s JOIN contents c USING (content_id) JOIN files f USING (content_id)
WHERE f.repo_ref_id = 1 AND s.name = 's9' AND c.language IN ('en', 'fr')""",
    "q_symbol_source": f"""{_SMALL},{_SOURCES}
SELECT content_id, name, CAST(start_line AS INTEGER) AS start_line,
  CAST(end_line AS INTEGER) AS end_line, sha256(source) AS source_sha FROM sources""",
    "q_find_references": f"""{_BASE},
imported AS (
  SELECT c.content_id, f.path AS source, string_split(c.content, ' ') AS ws
  FROM contents c JOIN files f ON f.ordinal = c.first_ordinal)
SELECT f.path AS file_path, i.source, 'de' AS imported_name,
  coalesce(i.ws[2] = 'de', FALSE) AS is_default
FROM imported i JOIN files f USING (content_id)
WHERE f.repo_ref_id = 1 AND list_contains(i.ws[2:], 'de')""",
    "q_get_file": f"""{_BASE},{sql.windows('contents').lstrip()},
texts AS (SELECT content_id, string_agg(content, chr(10) ORDER BY start_line) AS content
          FROM pieces GROUP BY content_id)
SELECT f.path, sha256(t.content) AS text_sha FROM files f JOIN texts t USING (content_id)
WHERE f.repo_ref_id = 4""",
    "q_list_repos": f"""WITH {_REFS}
SELECT concat('repo', repo_id) AS repo, id AS repo_ref_id, ref, stage, files_total FROM refs""",
    "q_list_repos_lang": f"""WITH {_REFS},{sql.FILES},
shares AS (SELECT repo_ref_id, language,
  floor(count(*) / sum(count(*)) OVER (PARTITION BY repo_ref_id) * 1000 + 0.5) / 10 AS percent
  FROM files GROUP BY 1, 2)
SELECT concat('repo', repo_id) AS repo, id AS repo_ref_id, ref FROM refs
WHERE repo_id IN (SELECT r.repo_id FROM refs r JOIN shares s ON s.repo_ref_id = r.id
                  WHERE s.language IN ('fr', 'es') AND s.percent >= 20)""",
    "q_ready_refs": f"""WITH {_REFS}
SELECT concat('repo', repo_id) AS repo, ref,
  concat('folio://repo', repo_id, '/', ref, '/tree') AS uri FROM refs WHERE stage = 'ready'""",
    "q_active_progress": f"""WITH {_REFS}
SELECT CASE WHEN repo_id = 2 THEN 'unknown' ELSE concat('repo', repo_id) END AS repo, ref, stage,
  files_total FROM refs WHERE stage NOT IN ('ready', 'error')""",
    "q_latest_ready_ref": f"""WITH {_REFS}
SELECT repo_id, id, ref, commit_sha FROM refs WHERE stage = 'ready'
QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id DESC) = 1""",
    "q_parse_semver": f"WITH {_VERSIONS} SELECT id, ref, semver FROM vrefs",
    "q_semver_resolve": f"WITH {_VERSIONS} "
    + " UNION ALL ".join(
        _resolve_sql(*pair)
        for pair in (
            ("^1.2.0", "pre IS NULL AND ma = 1 AND mi >= 2"),
            ("~2.3", "pre IS NULL AND ma = 2 AND mi = 3"),
            (
                ">=1.2.3-beta.0 <2.0.0 || 0.x",
                "(ma = 1 AND (mi > 2 OR (mi = 2 AND pa >= 3)) AND (pre IS NULL OR (mi = 2 AND pa = 3)))"
                " OR (ma = 0 AND pre IS NULL)",
            ),
            ("1.1.0 - 2.4", "pre IS NULL AND ((ma = 1 AND mi >= 1) OR (ma = 2 AND mi < 5))"),
            ("", "pre IS NULL"),
        )
    ),
    "q_resolve_ref": f"""WITH {_VERSIONS}
(SELECT repo_id, id, ref, commit_sha, 'feature/1.1.1' AS wanted FROM vrefs
 WHERE ref = 'feature/1.1.1' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id) = 1)
UNION ALL
(SELECT repo_id, id, ref, commit_sha, '2.x' AS wanted FROM vrefs
 WHERE semver IS NOT NULL AND pre IS NULL AND ma = 2 {_PICK})
UNION ALL
(SELECT repo_id, id, ref, commit_sha, 'v01.1.5.x' AS wanted FROM vrefs
 WHERE ref = 'v01.1.5.x' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id) = 1)""",
    "q_ref_diff": f"WITH {_SNAP} SELECT * FROM diff",
    "q_tree_diff": f"""WITH {_SNAP} SELECT concat_ws('/', string_split(path, '/')[1],
  CAST(string_split(path, '/')[2] AS BIGINT) // 100, CAST(string_split(path, '/')[2] AS BIGINT) // 10,
  string_split(path, '/')[2]) AS path, change_type, content_id FROM diff""",
    "q_recent_changes": f"""WITH {_CHANGES}
SELECT file_path, start_line, end_line, annotation, sha256(content) AS content_sha FROM changes""",
    "q_recent_pack": f"""WITH {_CHANGES},
costed AS (
  SELECT *, ceil(length(concat(chr(10), '--- ', file_path, ' L', start_line, '-', end_line,
                               ' ---', chr(10))) / 3.0) + ceil(length(content) / 3.0) AS cost
  FROM changes),
summed AS (
  SELECT *, CAST(sum(cost) OVER o AS BIGINT) AS used, row_number() OVER o AS position
  FROM costed WINDOW o AS (ORDER BY file_path, start_line, end_line, annotation, content))
SELECT position, file_path, start_line, end_line, annotation, used FROM summed
WHERE used <= 4000""",
    "q_union_deleted": f"""WITH {_SNAP}
SELECT path, change_type AS side FROM diff WHERE change_type <> 'modified'""",
    "q_stale_files": """SELECT concat(lang, '/', doc_id) AS path, sha256(text) AS content_id
FROM documents WHERE doc_id % 10 = 1""",
    "q_orphans": f"""WITH {_SNAP}
SELECT DISTINCT sha256(content) AS content_id FROM snap WHERE v = 1
  AND sha256(content) NOT IN (SELECT sha256(content) FROM snap WHERE v = 2)""",
    "q_sweep_orphans": f"""{_BASE},{sql.windows('contents').lstrip()}
SELECT content_id, count(*) AS chunks FROM pieces
WHERE content_id IN (SELECT content_id FROM files WHERE repo_ref_id >= 10) GROUP BY content_id""",
    "q_cascade_delete": f"""WITH {sql.FILES}
SELECT repo_ref_id, count(*) AS files FROM files WHERE repo_ref_id % 5 <> 2 GROUP BY 1""",
    "q_update_from_values": """SELECT doc_id,
  CASE WHEN vec_id IS NULL THEN 0 WHEN vec_id % 3 = 0 THEN NULL ELSE label END AS label,
  CASE WHEN vec_id % 3 = 0 THEN 'provider failed' END AS embedding_error
FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) ON vec_id = doc_id""",
    "q_move_vectors": """SELECT e.vec_id, CAST(coalesce(o.embedding, e.embedding) AS DOUBLE[]) AS embedding
FROM embeddings e LEFT JOIN embeddings o ON e.vec_id % 2 = 0 AND o.vec_id = e.vec_id + 1""",
    "q_delete_keys": """SELECT doc_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "q_update_delete_where": """SELECT c_custkey, c_acctbal,
  CASE WHEN c_acctbal < 0 THEN 'IN DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer
WHERE c_acctbal < 0 OR c_mktsegment <> 'MACHINERY'""",
    "q_queue_refs": f"""WITH {_REFS}
SELECT repo_id, ref, CASE WHEN id % 3 = 0 THEN 'pending' ELSE commit_sha END AS commit_sha,
  CASE WHEN id % 3 = 0 THEN 'queued' ELSE stage END AS stage,
  CASE WHEN id % 3 = 0 THEN 0 ELSE files_total END AS files_total FROM refs
UNION ALL
SELECT DISTINCT repo_id, 'v9.0.0', 'pending', 'queued', 0 FROM refs""",
    "q_unique_check": f"""WITH {sql.FILES}
SELECT content_id, count(*) AS copies FROM files GROUP BY 1 HAVING count(*) > 1""",
    "q_missing_parents": """SELECT * FROM labels
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
    "q_latest_state": f"""WITH {_STAGES}
SELECT user_id, event_id, stage, value FROM stages
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "q_progress_per_repo": f"""WITH {_STAGES}
SELECT user_id, event_id, stage FROM stages
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stage = 'ready',
  CASE WHEN stage = 'ready' THEN -epoch_us(ts) ELSE epoch_us(ts) END DESC,
  CASE WHEN stage = 'ready' THEN -event_id ELSE event_id END DESC) = 1""",
    "q_stage_transitions": f"""WITH {_STAGES}, moved AS (
SELECT user_id, event_id, stage,
  lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM stages)
SELECT user_id, event_id, previous, stage FROM moved
WHERE stage IN ('ready', 'error') AND previous NOT IN ('ready', 'error')""",
    "q_job_dedup": f"""WITH {_STAGES}, r AS (
SELECT user_id, event_id, stage IN ('ready', 'error') AS ends,
  lag(stage IN ('ready', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
FROM stages WHERE stage <> 'embedding')
SELECT user_id, event_id FROM r WHERE NOT ends AND coalesce(before, TRUE)""",
    "q_job_cancel": """WITH q AS (
SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'completed'
  WHEN 'error' THEN 'failed' ELSE 'active' END AS state FROM events)
SELECT event_id, user_id, state FROM q WHERE state <> 'active' OR user_id NOT IN
  (SELECT user_id FROM events WHERE event_type = 'error' AND value > 30)""",
    "q_stream_progress": f"""WITH {_KINDS}
SELECT user_id AS job, count(*) FILTER (WHERE type = 'file-done') AS files_processed,
  count(*) FILTER (WHERE type = 'file-skipped') AS files_skipped,
  count(*) FILTER (WHERE type = 'file-error') AS file_errors,
  max(amount) FILTER (WHERE type = 'embedding-start') AS chunks_total,
  CAST(coalesce(sum(amount) FILTER (WHERE type = 'embedding-batch-done'), 0) AS BIGINT)
    AS chunks_embedded
FROM kinds GROUP BY user_id""",
    "q_stage_labels": f"""WITH {_STAGES}
SELECT event_id, CASE WHEN stage = 'processing-files'
    THEN concat('Processing ', event_id % 40, '/40 files…')
  WHEN stage = 'embedding' AND (event_id % 40) % 3 > 0
    THEN concat('Embedding ', event_id % 40, '/', (event_id % 40) % 3, ' chunks…')
  ELSE CASE stage {_LABELS} ELSE 'Indexing…' END END AS label FROM stages""",
    "q_remote_errors": """SELECT CASE event_id % 4 WHEN 0 THEN 'access-denied'
  WHEN 1 THEN 'credentials-missing' WHEN 2 THEN 'repository-missing' ELSE 'other' END AS kind,
  event_type, count(*) AS messages FROM events GROUP BY ALL""",
    "q_retry_delays": """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  count(*) AS failures, CASE WHEN count(*) < 3 THEN CAST(30 * pow(2, count(*)) AS BIGINT) END
  AS delay FROM events WHERE event_type = 'error' GROUP BY ALL""",
}
# The index changes how paths are found, not which.
ORACLES["q_find_files_indexed"] = ORACLES["q_find_files"]
