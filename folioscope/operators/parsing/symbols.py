"""Symbols of files of any language, with signature and documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.operators.chunking import bind
from folioscope.operators.parsing import braces, imports, markdown, python_code

BLOCK_DOC = ("typescript", "javascript", "java", "kotlin", "c", "cpp")
_STRING = r"""(?s)^\s*([rRuUbBfF]{0,2}(?:\"{3}.*?\"{3}|'{3}.*?'{3}|"[^"\n]*"|'[^'\n]*'))"""


def _lines(lines: Column, first: Column, last: Column) -> Column:
    size = F.greatest(last - first + 1, F.lit(0))
    return F.slice(lines, F.greatest(first, F.lit(1)), size)


def _signature(lines: Column, s: Column) -> Column:
    first = F.trim(F.element_at(lines, s["start_line"]))
    code = F.regexp_replace(F.rtrim(first), r"\s*\{$", "")
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce(s["depth"], F.lit(1))), F.lit(" "), s["name"])
    return F.when(s["kind"] == "heading", heading).otherwise(code)


def _block_doc(text: Column) -> Column:
    """The last comment when it is a documentation block."""

    def found(trimmed: Column) -> Column:
        return bind(F.substring_index(trimmed, "/**", -1), lambda last: checked(trimmed, last))

    def checked(trimmed: Column, last: Column) -> Column:
        whole = (
            trimmed.contains("/**") & last.rlike(r"(?s)^[^*/].*\*/$|^\s") & trimmed.endswith("*/")
            & (F.length(last) - F.length(F.replace(last, F.lit("*/"), F.lit(""))) == 2)
        )
        return F.when(whole, F.concat(F.lit("/**"), last))

    return bind(F.regexp_replace(text, r"^\s+|\s+$", ""), found)


def _line_doc(lines: Column, mark: str, skip: str | None = None) -> Column:
    """The comment lines right above, from the last one that is none of them."""
    bare = F.filter(F.transform(lines, F.trim), lambda x: x != "")
    if skip:
        bare = F.filter(bare, lambda x: ~x.startswith(skip))
    start = F.aggregate(
        bare,
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x.startswith(mark), F.concat(kept, F.array(x))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return F.when(F.size(start) > 0, F.array_join(start, "\n"))


def _documentation(lines: Column, language: Column, s: Column) -> Column:
    above = _lines(lines, s["doc_from"], s["doc_to"])
    joined = F.array_join(above, "\n")
    string = F.regexp_extract(joined, _STRING, 1)
    undocumented = (language == "c") & ~(
        (s["kind"] == "function") & s["has_body"]
    )
    return (
        F.when(s["doc_from"].isNull() | undocumented, F.lit(None).cast("string"))
        .when(language.isin(*BLOCK_DOC), _block_doc(joined))
        .when(language == "go", _line_doc(above, "//"))
        .when(language == "rust", _line_doc(above, "///", skip="#["))
        .when(language == "python", F.when(string != "", string))
    )


def with_text(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Add signature and documentation by cutting them out of the file.

    The declarations of a file are one small array, so its text joins them once.
    """
    fields = ["start_line", "end_line", "name", "kind", "doc_from", "doc_to", "depth"]
    grouped = declared.groupBy("content_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_found")
    )
    joined = files.select("content_id", "content", "language").join(grouped, "content_id")
    language = F.col("language")

    def describe(lines: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            body = _lines(lines, s["start_line"], s["end_line"])
            # A C prototype ends without a body and carries no documentation; only C asks.
            has_body = F.when(language == "c", F.exists(body, lambda x: x.contains("{")))
            full = F.struct(*[s[f].alias(f) for f in fields], has_body.alias("has_body"))
            return F.struct(
                s["name"].alias("name"),
                s["kind"].alias("kind"),
                F.when(
                    s["kind"] == "module",
                    F.element_at(F.split(_documentation(lines, language, full), "\n"), 1),
                ).otherwise(_signature(lines, s)).alias("signature"),
                s["start_line"].alias("start_line"),
                s["end_line"].alias("end_line"),
                _documentation(lines, language, full).alias("documentation"),
                i.alias("ordinal"),
            )

        return F.transform(F.col("_found"), one)

    described = F.element_at(F.transform(F.array(F.split("content", "\n", -1)), describe), 1)
    return joined.select("content_id", "language", F.explode(described).alias("s")).select(
        "content_id", "language", "s.*"
    )


def declarations(files: DataFrame) -> DataFrame:
    """Declared ranges of all languages; blank and unknown files yield nothing."""
    usable = files.select("content_id", "language", "content").where(
        F.col("content").rlike(r"\S")
    )
    code = usable.where(~F.col("language").isin("python", "markdown"))
    none = F.lit(None).cast("int").alias("depth")
    return (
        braces.declarations(code).withColumn("depth", none)
        .unionByName(python_code.declarations(usable.where(F.col("language") == "python"))
                     .withColumn("depth", none))
        .unionByName(markdown.declarations(usable))
    )


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and imports of files (content_id, language, content)."""
    plain = files.where(F.col("language") != "cpp")
    return with_text(_visible(declarations(files)), files), imports.imports(plain).unionByName(
        _includes(files)
    )


def ranges(files: DataFrame) -> DataFrame:
    """Symbols of files without signature and documentation, so texts stay where they are read."""
    return _visible(declarations(files)).select(
        "content_id", "language", "name", "kind", "start_line", "end_line"
    )


def _visible(declared: DataFrame) -> DataFrame:
    return declared.where(F.col("kind") != "include")


def _includes(files: DataFrame) -> DataFrame:
    """C++ includes outside conditional blocks; that depth only the declarations know."""
    found = braces.declarations(files.where(F.col("language") == "cpp"))
    return found.where(F.col("kind") == "include").select(
        "content_id", "language", F.col("start_line").alias("ordinal"),
        F.regexp_replace("name", r'^[<"]|[>"]$', "").alias("source"),
        F.array().cast("array<string>").alias("names"),
        F.lit(None).cast("string").alias("default_name"),
        F.lit(0).alias("is_namespace"),
    )
