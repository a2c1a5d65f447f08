"""Shared pieces of the comparison SQL (DuckDB dialect)."""

FILES = """
files AS (
  SELECT doc_id AS ordinal, doc_id % 20 AS repo_ref_id,
         concat(lang, '/', CAST(doc_id // 20 AS VARCHAR)) AS path,
         lang AS language, text AS content, sha256(text) AS content_id
  FROM documents)"""

CONTENTS = """
contents AS (
  SELECT content_id, arg_min(language, ordinal) AS language, min(ordinal) AS first_ordinal,
         count(*) AS copies, min(content) AS content
  FROM files GROUP BY content_id)"""


def windows(source: str, budget: int = 512, overlap: float = 0.2) -> str:
    """CTEs that cut ``source`` (content_id, content) into line windows ``pieces``."""
    return f"""
w0 AS (
  SELECT content_id, string_split(content, chr(10)) AS ls, length(content) AS chars
  FROM {source} WHERE regexp_matches(content, '\\S')),
w1 AS (
  SELECT content_id, ls, len(ls) AS n,
         CASE WHEN ceil(chars / 3.0) <= {budget} THEN len(ls)
              ELSE greatest(floor({budget} * 3.0 / (chars / len(ls))), 3) END AS height0,
         ceil(chars / 3.0) <= {budget} AS fits
  FROM w0),
w2 AS (
  SELECT content_id, ls, n, CAST(height0 AS BIGINT) AS height,
         CASE WHEN fits THEN n
              ELSE CAST(height0 AS BIGINT)
                   - CAST(greatest(floor(height0 * {overlap}), 1) AS BIGINT) END AS step
  FROM w1),
w3 AS (
  SELECT content_id, ls, n, height,
         unnest(CASE WHEN n <= height THEN [CAST(0 AS BIGINT)]
                     ELSE range(0, CAST(ceil((n - height) / step) AS BIGINT) * step + 1, step)
                END) AS i
  FROM w2),
pieces AS (
  SELECT content_id, array_to_string(ls[i + 1 : least(i + height, n)], chr(10)) AS content,
         CAST(i + 1 AS INTEGER) AS start_line,
         CAST(least(i + height, n) AS INTEGER) AS end_line
  FROM w3)"""


def words(source: str, columns: str) -> str:
    """CTE ``tokens``: the listed columns and the code words ``ws`` of ``content``."""
    return f"""
squeezed AS (
  SELECT {columns},
         trim(regexp_replace(lower(regexp_replace(regexp_replace(content,
              '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'),
              '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')),
              '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS sq
  FROM {source}),
tokens AS (
  SELECT {columns}, CASE WHEN sq = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(sq, ' ') END
         AS ws
  FROM squeezed)"""


def bm25(columns: str, phrase: tuple[str, str], terms: list[str]) -> str:
    """CTE ``bm25_scores`` over ``tokens`` for one two-word phrase and some words."""
    a, b = phrase
    counts = [
        f"len(list_filter(range(1, len(ws)), lambda i: ws[i] = '{a}' AND ws[i + 1] = '{b}')) AS tf0"
    ] + [f"len(list_filter(ws, lambda x: x = '{t}')) AS tf{i + 1}" for i, t in enumerate(terms)]
    n = len(counts)
    held = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(n))
    score = " + ".join(
        f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5))"
        f" * (tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / (total / n))))"
        for i in range(n)
    )
    some = " + ".join(f"tf{i}" for i in range(n))
    return f"""
counted AS (SELECT {columns}, len(ws) AS dl, {', '.join(counts)} FROM tokens),
totals AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) AS total, {held} FROM counted),
bm25_scores AS (
  SELECT {columns}, CASE WHEN {some} > 0 THEN round({score}, 9) END AS bm25
  FROM counted, totals)"""
