"""Declarations of Python files, found by indentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioscope.operators.parsing import fold, lexer


def declarations(files: DataFrame) -> DataFrame:
    """Module docstring, functions, classes and plain methods with their ranges."""
    code, text = F.col("code"), F.col("text")
    kept = text.rlike(r"\S") & (code.rlike(r"\S") | ~text.rlike(r"^\s*#"))
    lines = lexer.code_lines(files, ("python",)).where((F.col("language") == "python") & kept)
    expanded = F.replace(code, F.lit("\t"), F.lit("        "))
    opened = F.length(code) - F.length(F.translate(code, "{([", ""))
    closed = F.length(code) - F.length(F.translate(code, "})]", ""))
    slim = lines.select(
        "content_id",
        "language",
        "line",
        code.rlike(r"\S").alias("visible"),
        code.rlike(r"\\$").alias("unfinished"),
        (F.length(expanded) - F.length(F.ltrim(expanded))).alias("indent"),
        (opened - closed).alias("net"),
        F.regexp_extract(code, r"^\s*(?:async\s+)?def\s+(\w+)", 1).alias("function"),
        F.regexp_extract(code, r"^\s*class\s+(\w+)", 1).alias("klass"),
        code.rlike(r"^\s*@").alias("decorator"),
        code.rlike(r'^\s*[rRuUbBfF]{0,2}"').alias("string"),
    )
    per_file = Window.partitionBy("content_id")
    down = per_file.orderBy("line")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slim.withColumn("depth", F.coalesce(F.sum("net").over(before), F.lit(0)))
        .withColumn("line_before", F.lag("line").over(down))
        .withColumn("goes_on", F.coalesce(F.lag("unfinished").over(down), F.lit(False)))
        .withColumn("last_line", F.max("line").over(per_file))
        .where(F.col("visible") & (F.col("depth") == 0) & ~F.col("goes_on"))
    )
    # From here on every row starts a statement.
    is_class = F.col("klass") != ""
    marked = placed.withColumn("is_class", is_class)
    reads = ("indent", "is_class", "line", "line_before")
    placed = fold.fold_files(marked, reads, fold.INDENTATION, fold.indentation)
    group = F.coalesce(F.sum(F.when(~F.col("decorator"), 1).otherwise(0)).over(before), F.lit(0))
    stacked = Window.partitionBy("content_id", "_group")
    statements = (
        placed.withColumn("next", F.lead(F.struct("line", "indent", "string", "line_before")).over(down))
        .withColumn("after_next", F.lead("line_before", 2).over(down))
        .withColumn("first_line", F.min("line").over(per_file))
        .withColumn("_group", group)
        .withColumn("start_line", F.min("line").over(stacked))
    )
    top = F.col("indent") == 0
    decorated = F.col("start_line") < F.col("line")
    function = F.col("function") != ""
    in_class = (F.col("owner_indent") == 0) & F.col("owner_is_class")
    kind = (
        F.when(top & is_class, "class")
        .when(top & function, "function")
        .when(function & in_class & ~decorated, "method")
        .when(top & F.col("string") & (F.col("line") == F.col("first_line")), "module")
    )
    documented = (
        F.col("next.string") & (F.col("next.indent") > F.col("indent")) & (F.col("kind") != "module")
    )
    name = F.when(F.col("kind") == "module", F.lit("(module)")).otherwise(
        F.when(is_class, F.col("klass")).otherwise(F.col("function"))
    )
    end = F.when(
        F.col("kind") == "module", F.coalesce("next.line_before", "last_line")
    ).otherwise(F.coalesce("end", "last_line"))
    doc_from = F.when(F.col("kind") == "module", F.col("line")).when(documented, F.col("next.line"))
    doc_to = F.when(F.col("kind") == "module", end).when(
        documented, F.coalesce("after_next", "last_line")
    )
    return (
        statements.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "content_id", "language", name.alias("name"), "kind",
            F.col("start_line").cast("int"), end.cast("int").alias("end_line"),
            doc_from.cast("int").alias("doc_from"), doc_to.cast("int").alias("doc_to"),
        )
    )
