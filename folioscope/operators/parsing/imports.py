"""Import statements of every language, found inside one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.operators.parsing import lexer, markdown

_QUOTED = r"""["']([^"']*)["']"""
SCRIPT = (
    r"""(?m)^(?:import\s+(?:[\w$*{}\s,]+?\s*from\s*)?["'][^"'\n]+["']"""
    r"""|export\s*(?:\*(?:\s*as\s+\w+)?|(?:type\s*)?\{[^}]*\})\s*from\s*["'][^"'\n]+["'])"""
)
PYTHON = (
    r"(?m)^(?:import[ \t]+[^\n#;]+"
    r"|from[ \t]+(?!__future__\b)\S+[ \t]+import[ \t]*(?:\([^)]*\)|[^\n#;(]+))"
)
GO = r"""(?m)^import\s*(?:\([^)]*\)|[\w.]*\s*["`][^"`\n]+["`])"""
GO_SPEC = r"""["`]([^"`\n]+)["`]"""
JAVA = r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?[\w.]+\.[\w*]+[ \t]*;"
KOTLIN = r"(?m)^[ \t]*import[ \t]+[\w.]+"
RUST = r"(?m)^(?:pub(?:\([^)]*\))?[ \t]+)?use\s+[^;]+;"
INCLUDE = r"""(?m)^[ \t]*#[ \t]*include[ \t]*[<"][^>"\n]+[>"]"""
EMPTY = "array<string>"


def _entry(source: Column, names: Column, default: Column | None = None, namespace: Column | None = None) -> Column:
    return F.struct(
        source.alias("source"),
        names.cast(EMPTY).alias("names"),
        (default if default is not None else F.lit(None).cast("string")).alias("default_name"),
        (namespace if namespace is not None else F.lit(0)).alias("is_namespace"),
    )


def _listed(text: Column) -> Column:
    """Names of a comma list; a renamed one keeps its original name."""
    items = F.transform(
        F.split(text, ","),
        lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^type | as .*$", ""),
    )
    return F.filter(items, lambda x: x != "")


def _script(statement: Column) -> Column:
    names = _listed(F.regexp_extract(statement, r"\{([^}]*)\}", 1))
    alias = F.regexp_extract(statement, r"^import\b[^{]*\*\s*as\s+([\w$]+)", 1)
    default = F.regexp_extract(statement, r"^import\s+(?:type\s+)?(?!type\s*\{)([\w$]+)\s*(?:,|from)", 1)
    spaced = F.when(alias != "", alias).when(default != "", default)
    return _entry(
        F.regexp_extract(statement, _QUOTED, 1), names, spaced, F.when(alias != "", 1).otherwise(0)
    )


def _python(statement: Column) -> Column:
    source = F.regexp_extract(statement, r"^from[ \t]+(\S+)", 1)
    wanted = F.regexp_extract(statement, r"(?s)^from[ \t]+\S+[ \t]+import[ \t]*\(?([^)]*)", 1)
    names = F.filter(_listed(wanted), lambda x: x != "*")
    modules = F.filter(
        F.transform(F.split(F.regexp_extract(statement, r"^import[ \t]+(.*)$", 1), ","), F.trim),
        lambda x: (x != "") & ~x.rlike(r"\sas\s"),
    )
    plain = statement.startswith("import")
    return _entry(
        F.when(plain, F.try_element_at(modules, F.lit(1))).otherwise(source),
        F.when(plain, F.slice(modules, F.lit(2), F.greatest(F.size(modules), F.lit(1)))).otherwise(names),
    )


def _plain(pattern: str):
    def parse(statement: Column) -> Column:
        return _entry(F.regexp_extract(statement, pattern, 1), F.array())

    return parse


def file_imports(content: Column, language: Column) -> Column:
    """Array of (source, names, default_name, is_namespace) in file order."""

    def statements(pattern: str, *languages: str) -> Column:
        visible = lexer.masked(content, language, languages, keep_strings=True)
        return F.regexp_extract_all(visible, F.lit(pattern), 0)

    go = F.flatten(
        F.transform(statements(GO, "go"), lambda s: F.regexp_extract_all(s, F.lit(GO_SPEC), 1))
    )
    rust = F.filter(
        F.transform(
            statements(RUST, "rust"), lambda s: F.trim(F.regexp_extract(s, r"(?s)use\s+([^;]+);", 1))
        ),
        lambda s: ~s.rlike(r"^\{") & ~s.rlike(r"^[^{]*\sas\s"),
    )
    python = F.filter(
        F.transform(statements(PYTHON, "python"), _python), lambda x: x["source"].isNotNull()
    )
    return (
        F.when(language.isin("typescript", "javascript"), F.transform(statements(SCRIPT, "typescript", "javascript"), _script))
        .when(language == "python", python)
        .when(language == "go", F.transform(go, lambda s: _entry(s, F.array())))
        .when(language == "java", F.transform(
            statements(JAVA, "java"), _plain(r"import[ \t]+(?:static[ \t]+)?([\w.]+?)(?:\.\*)?[ \t]*;")))
        .when(language == "kotlin", F.transform(
            statements(KOTLIN, "kotlin"), _plain(r"import[ \t]+([\w.]*\w)")))
        .when(language == "rust", F.transform(rust, lambda s: _entry(s, F.array())))
        .when(language == "c", F.transform(
            statements(INCLUDE, "c"), _plain(r"""include[ \t]*[<"]([^>"]+)""")))
        .when(language == "markdown", markdown.links(content))
    )


def imports(files: DataFrame) -> DataFrame:
    """One row per import. C++ includes need the line depth and come from the symbols."""
    found = files.select(
        "content_id", "language",
        F.posexplode(file_imports(F.col("content"), F.col("language"))).alias("ordinal", "i"),
    )
    return found.select("content_id", "language", "ordinal", "i.*")
