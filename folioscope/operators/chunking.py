"""Cut files into chunks: symbols first, then the gaps between them.

Ranges are small rows and are worked out with windows; the text joins them once
and is cut inside its own row, so no line of text is ever shuffled on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import text as text_fn

MAX_TOKENS = 512
OVERLAP = 0.2
MIN_WINDOW_LINES = 3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times in a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- imports as context --------------------------------------------------------


def render_import(
    language: Column, source: Column, names: Column, default_name: Column, is_namespace: Column
) -> Column:
    """One import written in the syntax of its language."""
    has_names = F.size(names) > 0
    listed = F.array_join(names, ", ")
    default = F.coalesce(default_name, F.lit(""))
    has_default = default != ""
    namespace = F.coalesce(is_namespace, F.lit(0)).cast("int") == 1
    ready = source.startswith("<") | source.startswith('"')

    def text(template: str, *values: Column) -> Column:
        return F.format_string(template, *values)

    python = (
        F.when(has_names, text("from %s import %s", source, listed))
        .when(namespace & has_default, text("import %s as %s", source, default))
        .otherwise(text("import %s", source))
    )
    go = F.when(has_default, text('import %s "%s"', default, source)).otherwise(
        text('import "%s"', source)
    )
    rust = (
        F.when(has_names, text("use %s::{%s};", source, listed))
        .when(has_default & (default != source), text("use %s as %s;", source, default))
        .otherwise(text("use %s;", source))
    )
    c_family = F.when(ready, text("#include %s", source)).otherwise(
        text('#include "%s"', source)
    )
    script = (
        F.when(namespace & has_default, text('import * as %s from "%s";', default, source))
        .when(has_default & has_names, text('import %s, { %s } from "%s";', default, listed, source))
        .when(has_default, text('import %s from "%s";', default, source))
        .when(has_names, text('import { %s } from "%s";', listed, source))
        .otherwise(text('import "%s";', source))
    )
    return (
        F.when(language == "python", python)
        .when(language == "go", go)
        .when(language == "rust", rust)
        .when(language.isin("java", "kotlin"), text("import %s;", source))
        .when(language.isin("c", "cpp"), c_family)
        .when(language == "markdown", text("<!-- link: %s -->", source))
        .otherwise(script)
    )


def import_prefix(imports: DataFrame) -> DataFrame:
    """Import block of every content, one line per import, then an empty line."""
    line = render_import(
        F.col("language"), F.col("source"), F.col("names"), F.col("default_name"),
        F.col("is_namespace"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ordinal"), line.alias("line"))))
    block = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return imports.groupBy("content_id").agg(
        F.concat(block, F.lit("\n\n")).alias("import_prefix")
    )


# --- ranges --------------------------------------------------------------------


def _cursor() -> Column:
    """First line behind all symbols of the file that come before this one."""
    order = Window.partitionBy("content_id").orderBy("start_line", "end_line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.coalesce(F.max("end_line").over(before), F.lit(0)), F.lit(0)) + 1


def gaps_between(symbols: DataFrame) -> DataFrame:
    """Line ranges before and between symbols, plus the line after the last one.

    The cursor is the running maximum of end_line + 1, so nested symbols leave no
    false gap. ``tail_from`` rows carry the first line no symbol reaches.
    """
    return (
        symbols.select("content_id", "start_line", "end_line")
        .withColumn("gap_start", _cursor())
        .where(F.col("start_line") > F.col("gap_start"))
        .select(
            "content_id",
            F.col("gap_start").cast("int").alias("start_line"),
            (F.col("start_line") - 1).cast("int").alias("end_line"),
        )
    )


def gap_ranges(symbols: DataFrame, sizes: DataFrame) -> DataFrame:
    """All uncovered ranges, given the line count (``lines``) of every content."""
    last = symbols.groupBy("content_id").agg(F.max("end_line").alias("last"))
    tail = (
        sizes.join(last, "content_id", "left")
        .withColumn("start_line", (F.coalesce("last", F.lit(0)) + 1).cast("int"))
        .where(F.col("start_line") <= F.col("lines"))
        .select("content_id", "start_line", F.col("lines").cast("int").alias("end_line"))
    )
    return gaps_between(symbols).unionByName(tail)


# --- windows -------------------------------------------------------------------


def window_plan(length: Column, lines: Column, budget: Column, overlap: float) -> Column:
    """Window height and step for a range of text that may exceed its budget."""
    fits = F.ceil(length / F.lit(3)) <= budget
    average = length / lines
    height = F.greatest(
        F.floor(budget * F.lit(3.0) / F.nullif(average, F.lit(0.0))), F.lit(MIN_WINDOW_LINES)
    ).cast("int")
    shared = F.greatest(F.floor(height * F.lit(overlap)), F.lit(1)).cast("int")
    return F.struct(
        F.when(fits, lines).otherwise(height).cast("int").alias("height"),
        F.when(fits, lines).otherwise(height - shared).cast("int").alias("step"),
    )


def window_starts(lines: Column, plan: Column) -> Column:
    """Zero-based first lines of the windows that cover a range."""
    rest = F.ceil((lines - plan["height"]) / plan["step"]).cast("int") * plan["step"]
    return F.when(lines <= plan["height"], F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), rest, plan["step"])
    )


def _cut(lines: Column, part: Column, overlap: float) -> Column:
    """Chunks of one range of a file as an array of structs."""
    span = part["end_line"] - part["start_line"] + 1
    own = F.slice(lines, part["start_line"], span)

    def windows(own_lines: Column) -> Column:
        return bind(F.array_join(own_lines, "\n"), lambda body: emit(own_lines, body))

    def emit(own_lines: Column, body: Column) -> Column:
        count = F.size(own_lines)
        plan = window_plan(text_fn.utf16_length(body), count, part["budget"], overlap)
        nothing = F.array().cast("array<int>")

        def cut(p: Column) -> Column:
            starts = F.when(text_fn.is_blank(body), nothing).otherwise(window_starts(count, p))
            return F.transform(starts, lambda i: piece(own_lines, count, p["height"], i))

        return bind(plan, cut)

    def piece(own_lines: Column, count: Column, height: Column, i: Column) -> Column:
        last = F.least(i + height, count)
        body = F.array_join(F.slice(own_lines, i + 1, last - i), "\n")
        return F.struct(
            F.concat(part["prefix"], body).alias("content"),
            (part["start_line"] + i).cast("int").alias("start_line"),
            (part["start_line"] + last - 1).cast("int").alias("end_line"),
            part["name"].alias("symbol_name"),
            part["kind"].alias("symbol_kind"),
            part["signature"].alias("symbol_signature"),
        )

    return bind(own, windows)


def chunk_files(
    files: DataFrame,
    symbols: DataFrame | None = None,
    prefixes: DataFrame | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: float = OVERLAP,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Chunks of every file: content_id, content, line range and symbol.

    ``files`` needs content_id and content; columns to ``keep`` are repeated on every
    chunk. Symbol and gap ranges are collected per
    content without any text; a group is one file, whose size the index bounds.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    rows = files.select("content_id", "content", *keep)
    range_type = (
        "array<struct<start_line:int,end_line:int,name:string,kind:string,"
        "signature:string,doc:string>>"
    )
    if symbols is not None:
        wanted = symbols.select(
            "content_id", "start_line", "end_line", "name", "kind", "signature",
            F.when(
                F.coalesce(F.col("documentation"), F.lit("")) != "",
                F.concat(F.col("documentation"), F.lit("\n")),
            ).otherwise("").alias("doc"),
        )
        none = F.lit(None).cast("string")
        gap = F.struct(
            F.col("gap_start").cast("int").alias("start_line"),
            (F.col("start_line") - 1).cast("int").alias("end_line"),
            none.alias("name"), none.alias("kind"), none.alias("signature"), F.lit("").alias("doc"),
        )
        own = F.struct(
            F.col("start_line").cast("int").alias("start_line"),
            F.col("end_line").cast("int").alias("end_line"), "name", "kind", "signature", "doc",
        )
        # A symbol and the gap before it come out of one row, so the symbols are worked out once.
        both = F.when(F.col("start_line") > F.col("gap_start"), F.array(own, gap)).otherwise(F.array(own))
        ranges = (
            wanted.withColumn("gap_start", _cursor())
            .select("content_id", F.explode(both).alias("r"))
            .groupBy("content_id").agg(
                F.array_sort(F.collect_list("r")).cast(range_type).alias("ranges"),
                F.max(F.when(F.col("r.name").isNotNull(), F.col("r.end_line"))).alias("last_line"),
            )
        )
        rows = rows.join(ranges, "content_id", "left")
    else:
        rows = rows.withColumn("ranges", F.lit(None).cast(range_type)).withColumn(
            "last_line", F.lit(None).cast("int")
        )
    if prefixes is not None:
        rows = rows.join(prefixes.select("content_id", "import_prefix"), "content_id", "left")
    else:
        rows = rows.withColumn("import_prefix", F.lit(""))

    prefix = F.coalesce(F.col("import_prefix"), F.lit(""))
    body_budget = F.greatest(
        F.lit(float(max_tokens)) - text_fn.token_estimate(prefix), F.lit(max_tokens * 0.5)
    )

    def all_ranges(lines: Column) -> Column:
        tail_start = (F.coalesce(F.col("last_line"), F.lit(0)) + 1).cast("int")
        tail = F.struct(
            tail_start.alias("start_line"),
            F.size(lines).cast("int").alias("end_line"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("string").alias("signature"),
            F.lit("").alias("doc"),
        )
        tails = F.filter(F.array(tail), lambda t: t["start_line"] <= t["end_line"])
        known = F.coalesce(F.col("ranges"), F.array().cast(range_type))
        return F.concat(known, tails.cast(range_type))

    def with_budget(r: Column) -> Column:
        return F.struct(
            r["start_line"].alias("start_line"),
            r["end_line"].alias("end_line"),
            r["name"].alias("name"),
            r["kind"].alias("kind"),
            r["signature"].alias("signature"),
            F.concat(prefix, r["doc"]).alias("prefix"),
            F.when(
                r["name"].isNotNull(),
                F.greatest(
                    body_budget - text_fn.token_estimate(r["doc"]), F.lit(max_tokens * 0.3)
                ),
            ).otherwise(body_budget).alias("budget"),
        )

    pieces = bind(
        text_fn.split_lines(F.col("content")),
        lambda lines: F.flatten(
            F.transform(
                F.transform(all_ranges(lines), with_budget),
                lambda part: _cut(lines, part, overlap),
            )
        ),
    )
    cut = rows.select("content_id", *keep, F.explode(pieces).alias("c"))
    return cut.select("content_id", "c.*", *keep)
