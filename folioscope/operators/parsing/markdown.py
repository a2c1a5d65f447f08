"""Headings, links and code blocks of Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.operators.parsing import fold, lexer

ATX = r"^ {0,3}(#{1,6})(?:[ \t]|$)"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*$"
NOT_PARAGRAPH = r"^(?: {4}|\t| {0,3}(?:>|[-+*][ \t]|\d{1,9}[.)][ \t]|(?:[-_*][ \t]*){3,}$|\|))"


def plain_title(text: Column) -> Column:
    """Heading text without markers and inline marks."""
    bare = F.regexp_replace(text, r"^ {0,3}#{1,6}(?:[ \t]+|$)|[ \t]+#+[ \t]*$", "")
    linked = F.regexp_replace(bare, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(linked, r"\*\*|__|`|(?<![\w])[*_](?=\S)|(?<=\S)[*_](?![\w])", ""))


def heading_ends(headings: DataFrame, key: str = "content_id") -> DataFrame:
    """End line of each heading: before the next one of its own or a higher level.

    ``solid_before`` is the last line with text before a heading, so trailing blank
    lines fall away. ``lines`` is the length of the file.
    """
    below = Window.partitionBy(key).orderBy(F.desc("start_line")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    following = [
        F.last(F.when(F.col("depth") <= d, F.col("solid_before")), ignorenulls=True).over(below)
        for d in range(1, 7)
    ]
    end = F.try_element_at(F.array(*following), F.col("depth"))
    return headings.withColumn(
        "end_line",
        F.when(end.isNull(), F.col("lines"))
        .otherwise(F.greatest(end, F.col("start_line")))
        .cast("int"),
    )


def headings(files: DataFrame) -> DataFrame:
    """ATX and underlined headings with level, text and line range."""
    md = files.where(F.col("language") == "markdown")
    code = F.col("code")
    sized = md.withColumn("lines", F.size(F.split("content", "\n", -1)))
    rows = lexer.code_lines(sized, ("markdown",), ("lines",)).where(F.col("text").rlike(r"\S"))
    marks = F.length(F.regexp_extract(code, ATX, 1))
    underline = F.regexp_extract(code, UNDERLINE, 1)
    paragraph = code.rlike(r"\S") & (marks == 0) & ~code.rlike(NOT_PARAGRAPH)
    slim = rows.select(
        "content_id", "language", "lines", "line", marks.alias("marks"),
        F.substring(underline, 1, 1).alias("underline"),
        (paragraph & (underline == "")).alias("paragraph"),
        F.when((marks > 0) | paragraph, F.col("text")).alias("text"),
    )
    down = Window.partitionBy("content_id").orderBy("line")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        slim.withColumn("solid_before", F.coalesce(F.lag("line").over(down), F.lit(0)))
        .withColumn("joined", F.col("paragraph") & F.coalesce(
            F.lag("paragraph").over(down) & (F.lag("line").over(down) == F.col("line") - 1),
            F.lit(False)))
    )
    seen = seen.withColumn("starts", F.col("paragraph") & ~F.col("joined"))
    seen = fold.fold_files(seen, ("starts", "paragraph", "text"), "above_text string", fold.titles)
    # A paragraph starts where its line is not joined to the one before.
    starts = F.struct(F.col("line").alias("at"), F.col("solid_before").alias("solid"), F.col("text"))
    lined = (
        seen.withColumn("block", F.last(
            F.when(F.col("paragraph") & ~F.col("joined"), starts), ignorenulls=True).over(before))
        .withColumn("above", F.lag(F.struct("line", "paragraph", "text")).over(down))
    )
    set_heading = (
        (F.col("underline") != "") & F.col("above.paragraph")
        & (F.col("above.line") == F.col("line") - 1)
    )
    depth = F.when(F.col("marks") > 0, F.col("marks")).when(
        set_heading, F.when(F.col("underline") == "=", 1).otherwise(2)
    )
    one_line = F.col("block.at") == F.col("above.line")
    title = F.when(F.col("marks") > 0, F.col("text")).otherwise(
        F.when(one_line, F.col("above.text")).otherwise(F.col("above_text"))
    )
    found = lined.withColumn("depth", depth).where(F.col("depth").isNotNull()).select(
        "content_id", "language", "lines", F.col("depth").cast("int").alias("depth"),
        plain_title(title).alias("name"),
        F.when(F.col("marks") > 0, F.col("line")).otherwise(F.col("block.at")).cast("int").alias(
            "start_line"
        ),
        F.when(F.col("marks") > 0, F.col("solid_before")).otherwise(F.col("block.solid")).cast(
            "int"
        ).alias("solid_before"),
    )
    return heading_ends(found)


def declarations(files: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return headings(files).select(
        "content_id", "language", "name", F.lit("heading").alias("kind"), "start_line", "end_line",
        none.alias("doc_from"), none.alias("doc_to"), "depth",
    )


def links(text: Column) -> Column:
    """Inline links and autolinks outside code as (source, names) structs."""
    code = r"`+[^`]*`+"
    link = r"(?<!!)\[(?:[^\[\]]|\[[^\]]*\])*\]\((?:<[^>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+[\"'(][^\n]*?[\"')])?\)"
    auto = r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>"
    found = F.filter(
        F.regexp_extract_all(lexer.masked(text, F.lit("markdown"), ("markdown",)), F.lit(f"{code}|{link}|{auto}"), 0),
        lambda t: ~t.startswith("`"),
    )
    empty = F.lit(None).cast("string")

    def parse(t: Column) -> Column:
        label = F.regexp_extract(t, r"(?s)^\[(.*)\]\(", 1)
        url = F.regexp_extract(t, r"(?s)\]\(<?([^)>\s]*(?:\([^()\s]*\)[^()\s]*)*)", 1)
        bare = F.regexp_extract(t, r"^<(.*)>$", 1)
        auto_link = t.startswith("<")
        return F.struct(
            F.when(auto_link, bare).otherwise(url).alias("source"),
            F.array(F.when(auto_link, bare).otherwise(plain_title(label))).alias("names"),
            empty.alias("default_name"),
            F.lit(0).alias("is_namespace"),
        )

    return F.transform(found, parse)


def code_blocks(files: DataFrame) -> DataFrame:
    """Fenced code blocks with language and content, one row each."""
    md = files.where(F.col("language") == "markdown")
    blocks = F.filter(
        F.regexp_extract_all("content", F.lit(rf"{lexer.MARKDOWN_FENCE}|\n|[^\n]++"), 0),
        lambda t: t.rlike(r"^ {0,3}(?:`{3,}|~{3,})[^\n]*\n"),
    )
    rows = md.select("content_id", F.posexplode(blocks).alias("ordinal", "block"))
    tag = F.regexp_extract("block", r"^ {0,3}[`~]{3,}[ \t]*([^\s`]*)", 1)
    body = F.regexp_replace(
        F.regexp_replace("block", r"^[^\n]*\n", ""), r"(?:^|\n) {0,3}[`~]{3,}[ \t]*\z", ""
    )
    return rows.select(
        "content_id", "ordinal", F.when(tag != "", tag).alias("code_language"), body.alias("code")
    )
