"""Blank out comments and strings so that brackets and words mean code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_COMMENT = r"/\*(?s:.*?)\*/"
LINE_COMMENT = r"//[^\n]*"
HASH_COMMENT = r"#[^\n]*"
DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
CHARACTER = r"'(?:\\[^\n']{1,10}|[^'\\\n])'"
TEMPLATE = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
RAW_BACKTICK = r"`[^`]*`"
TRIPLE = r'"""(?s:.*?)"""'
TRIPLE_SINGLE = r"'''(?s:.*?)'''"
RUST_RAW = r'r#"(?s:.*?)"#'
CPP_RAW = r'R"\((?s:.*?)\)"'

# Which tokens hide code in each language, in the order they are tried.
DIALECTS: dict[tuple[str, ...], tuple[str, ...]] = {
    ("typescript", "javascript"): (BLOCK_COMMENT, LINE_COMMENT, DOUBLE, SINGLE, TEMPLATE),
    ("python",): (TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE, HASH_COMMENT),
    ("go",): (BLOCK_COMMENT, LINE_COMMENT, DOUBLE, CHARACTER, RAW_BACKTICK),
    ("java", "kotlin"): (BLOCK_COMMENT, LINE_COMMENT, TRIPLE, DOUBLE, CHARACTER),
    ("rust",): (BLOCK_COMMENT, LINE_COMMENT, RUST_RAW, DOUBLE, CHARACTER),
    ("c",): (BLOCK_COMMENT, LINE_COMMENT, DOUBLE, CHARACTER),
    ("cpp",): (BLOCK_COMMENT, LINE_COMMENT, CPP_RAW, DOUBLE, CHARACTER),
}
MARKDOWN_FENCE = r"(?m)^ {0,3}(`{3,}|~{3,})[^\n]*\n(?s:.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\z)"


def _tokens(text: Column, hidden: tuple[str, ...]) -> Column:
    openers = "/\"'`" + ("#" if HASH_COMMENT in hidden else "")
    openers += "r" if RUST_RAW in hidden else "R" if CPP_RAW in hidden else ""
    plain = f"[^{openers}]++"
    pattern = "|".join([*hidden, plain, "(?s:.)"])
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _is_comment(token: Column, hidden: tuple[str, ...]) -> Column:
    starts = []
    if BLOCK_COMMENT in hidden:
        starts.append(r"/[/*]")
    if HASH_COMMENT in hidden:
        starts.append("#")
    return token.rlike("^(?:" + "|".join(starts) + ")")


def _is_string(token: Column) -> Column:
    return token.rlike(r"(?s)^(?:[\"'`]|r#\"|R\"\().+") & (F.length(token) > 1)


def _blank(token: Column) -> Column:
    # A pattern costs a replacement for every character; most comments are one line.
    lined = F.regexp_replace(token, r"[^\n]", " ")
    return F.when(token.contains("\n"), lined).otherwise(F.repeat(F.lit(" "), F.length(token)))


def _hollow(token: Column, keep_last: bool) -> Column:
    """Keep the delimiters of a string and blank what lies between them."""
    inner = F.regexp_replace(token, r"(?s)(?<=.)[^\n]", " ")
    quoted = F.concat(F.lit('"'), F.substring(inner, F.lit(2), F.length(token)))
    if not keep_last:
        return quoted
    return F.concat(F.substring(quoted, F.lit(1), F.length(token) - 1), F.lit('"'))


def masked(
    text: Column,
    language: Column,
    languages: tuple[str, ...],
    keep_strings: bool = False,
) -> Column:
    """Text of the same shape with comments blanked and strings hollowed out.

    ``languages`` names those that can occur here, so that no other dialect enters
    the plan. With ``keep_strings`` one-line strings stay readable, for import sources.
    """
    result = F.when(F.lit(False), text)
    if "markdown" in languages:
        result = result.when(language == "markdown", _mask_fences(text))
    for dialect, hidden in DIALECTS.items():
        if not set(dialect) & set(languages):
            continue
        visible = _visible(hidden, keep_strings, keep_last="python" not in dialect)
        joined = F.array_join(F.transform(_tokens(text, hidden), visible), "")
        result = result.when(language.isin(*dialect), joined)
    return result


def _visible(
    hidden: tuple[str, ...], keep_strings: bool, keep_last: bool
) -> Callable[[Column], Column]:
    def visible(token: Column) -> Column:
        string = _is_string(token)
        if keep_strings:
            string = string & token.contains("\n")
        return (
            F.when(_is_comment(token, hidden), _blank(token))
            .when(string, _hollow(token, keep_last))
            .otherwise(token)
        )

    return visible


def _mask_fences(text: Column) -> Column:
    """Blank fenced blocks but leave their first line visible as a bar."""
    fences = F.regexp_extract_all(text, F.lit(rf"{MARKDOWN_FENCE}|\n|[^\n]++"), 0)

    def visible(token: Column) -> Column:
        fence = token.rlike(r"^ {0,3}(?:`{3,}|~{3,})[^\n]*(?:\n|\z)") & token.contains("\n")
        bar = F.concat(F.lit("|"), F.substring(_blank(token), F.lit(2), F.length(token)))
        return F.when(fence, bar).otherwise(token)

    return F.array_join(F.transform(fences, visible), "")


def code_lines(
    files: DataFrame, languages: tuple[str, ...], extra: tuple[str, ...] = ()
) -> DataFrame:
    """One row per line: number, source text and masked text. Feed only to projections."""
    code = masked(F.col("content"), F.col("language"), languages)
    both = F.arrays_zip(
        F.split(F.col("content"), "\n", -1).alias("text"),
        F.split(code, "\n", -1).alias("code"),
    )
    rows = files.select("content_id", "language", *extra, F.posexplode(both).alias("pos", "l"))
    return rows.select(
        "content_id", "language", *extra, (F.col("pos") + 1).alias("line"),
        F.col("l.text").alias("text"), F.rtrim(F.col("l.code")).alias("code"),
    )
