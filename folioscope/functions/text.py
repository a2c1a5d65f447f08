"""Measures, cleaning and tokens of text columns, all inside the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

CHARS_PER_TOKEN = 3
MAX_FILE_BYTES = 3 * 1024 * 1024
MAX_AVERAGE_LINE = 500


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 units, which is how the token estimate counts characters."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def strip_nul(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def skip_reason(
    text: Column,
    max_bytes: int | None = MAX_FILE_BYTES,
    max_average_line: int | None = MAX_AVERAGE_LINE,
) -> Column:
    """Why a file is left out of the index, or null when it is kept; None is no limit."""
    lines = line_count(text)
    reason = F.when(F.lit(False), F.lit(""))
    if max_bytes is not None:
        reason = reason.when(F.octet_length(text) > max_bytes, F.lit("too-large"))
    if max_average_line is not None:
        long = (lines > 1) & (utf16_length(text) / lines > max_average_line)
        reason = reason.when(long, F.lit("minified-or-generated"))
    return reason


WORD_BREAK = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def padded_words(text: Column) -> Column:
    """Lower-case code words, each wrapped in its own pair of spaces: ``" parse  json "``.

    Words break at anything that is not a letter or digit, between a lower-case
    letter or digit and a capital, and before the last capital of an acronym. With
    the fixed wrapping a term count is a length difference, so scoring never has to
    explode or shuffle words.
    """
    spaced = F.lower(F.regexp_replace(text, WORD_BREAK, " "))
    wrapped = F.regexp_replace(
        spaced, r"[^\p{L}\p{N}]*([\p{L}\p{N}]+)[^\p{L}\p{N}]*", " $1 "
    )
    return F.regexp_replace(wrapped, r"^[^\p{L}\p{N}]+$", "")


def code_words(text: Column) -> Column:
    """Array of code words; text without any word gives an empty array."""
    return F.filter(F.split(padded_words(text), " ", -1), lambda w: w != "")


def padded_count(padded: Column) -> Column:
    """How many words a padded stream holds."""
    spaces = F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))
    return (spaces / F.lit(2)).cast("long")


def padded_term_count(padded: Column, term: str) -> Column:
    """How often a word or phrase occurs in a padded stream; phrases may overlap themselves."""
    needle = f" {term} "
    if len(set(term.split())) < len(term.split()):
        return F.regexp_count(padded, F.lit(f"(?={re.escape(needle)})")).cast("long")
    removed = F.length(padded) - F.length(F.replace(padded, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("long")


def truncate_for_embedding(text: Column, max_tokens: int) -> Column:
    """The most whole lines within the budget; a too long first line is cut hard.

    The longest prefix ending before a newline is found on the text itself: take
    one character more than the budget holds and cut at its last newline.
    """
    limit = max_tokens * CHARS_PER_TOKEN
    window = F.substring(text, 1, limit + 1)
    newline_at = F.locate("\n", F.reverse(window))
    whole_lines = F.substring(window, F.lit(1), F.length(window) - newline_at)
    first_line = F.substring_index(text, "\n", 1)
    hard_cut = F.substring(text, 1, int(max_tokens * 1.5))
    return (
        F.when(token_estimate(text) <= max_tokens, text)
        .when(token_estimate(first_line) > max_tokens, hard_cut)
        .when(utf16_length(window) > F.length(window), _whole_lines_by_sum(text, limit))
        .otherwise(whole_lines)
    )


def _whole_lines_by_sum(text: Column, limit: int) -> Column:
    """Longest line prefix when some characters take two UTF-16 units."""
    lines = split_lines(text)
    start = F.struct(F.lit(-1.0).alias("used"), F.lit(0).alias("kept"))

    def step(state: Column, line: Column) -> Column:
        used = state["used"] + utf16_length(line) + F.lit(1.0)
        kept = F.when(used <= limit, state["kept"] + 1).otherwise(state["kept"])
        return F.struct(used.alias("used"), kept.alias("kept"))

    kept = F.aggregate(lines, start, step, lambda state: state["kept"])
    return F.array_join(F.slice(lines, F.lit(1), kept), "\n")


@dataclass(frozen=True)
class SearchText:
    full_text: str
    embedding_text: str


def rewrite_query(query: str) -> SearchText | None:
    """Quotes stay for the word search and go for the embedding; blank gives None."""
    if not query.strip():
        return None
    return SearchText(query, query.replace('"', ""))
