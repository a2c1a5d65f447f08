"""Declarations of the bracket languages: scripts, Go, Java, Kotlin, Rust, C and C++."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.operators.parsing import fold, lexer

SCRIPTS = ("typescript", "javascript")
LANGUAGES = (*SCRIPTS, "go", "java", "kotlin", "rust", "c", "cpp")

_EXPORT = r"^\s*(?:export\s+(?:default\s+)?)?"
_JAVA = r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*"
_JAVA_METHOD = (
    r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
    r"(?:<[^>]*>\s*)?(?:[\w.$]+(?:<[^()]*>)?(?:\[\])*\s+)?([A-Za-z_$][\w$]*)\s*\("
)
_KOTLIN = (
    r"^\s*(?:(?:public|private|protected|internal|open|abstract|sealed|data|inner|enum|annotation|"
    r"value|inline|override|suspend|operator|infix|tailrec|external|const|final|companion|expect|"
    r"actual)\s+)*"
)
_RUST = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
_RUST_FN = _RUST + r"(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"
_NOT_CALL = r"(?!\s*(?:if|for|while|switch|catch|return|else|do|new|throw|typedef|using|namespace|class|struct|enum|template|case|delete|sizeof|static_assert|await|yield|function)\b)"
_C_FUNCTION = (
    r"^" + _NOT_CALL + r"\s*(?:[A-Za-z_][\w:<>,]*(?:\s*[*&]+\s*|\s+))+?[*&\s]*((?:[\w]+::)*~?\w+)\s*\("
)
_CPP_METHOD = (
    r"^" + _NOT_CALL + r"\s*(?:(?:virtual|explicit|static|inline|constexpr|friend)\s+)*"
    r"(?:[A-Za-z_][\w:<>,]*(?:\s*[*&]+\s*|\s+))*?[*&\s]*(~?\w+|operator\s*[^\s(]+)\s*\("
)


@dataclass(frozen=True)
class Rule:
    """One kind of declaration: its languages, pattern and the owners it may have."""

    languages: tuple[str, ...]
    kind: str
    pattern: str
    owners: tuple[str, ...] = ("file",)
    fixed_name: str | None = None


# The first rule that matches a line names it. Owners say what encloses the line.
RULES = (
    Rule(SCRIPTS, "function", _EXPORT + r"(?:async\s+)?function\s+([\w$]+)"),
    Rule(SCRIPTS, "class", _EXPORT + r"class\s+([\w$]+)"),
    Rule(SCRIPTS, "interface", _EXPORT + r"interface\s+([\w$]+)"),
    Rule(SCRIPTS, "type", _EXPORT + r"type\s+([\w$]+)\s*(?:<|=)"),
    Rule(SCRIPTS, "enum", _EXPORT + r"(?:const\s+)?enum\s+([\w$]+)"),
    Rule(
        SCRIPTS,
        "function",
        _EXPORT + r"(?:const|let)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?"
        r"(?:function\b|[\w$]+\s*=>|(?:<[^>]*>\s*)?\([^)]*\)\s*(?::[^=]+)?=>|\([^)]*$)",
    ),
    Rule(SCRIPTS, "variable", _EXPORT + r"(?:const|let)\s+([\w$]+|\{[^}]*\}|\[[^\]]*\])"),
    Rule(SCRIPTS, "variable", r"^(export\s+default)\s+[\w$]+\s*;?$", fixed_name="default"),
    Rule(SCRIPTS, "variable", r"^(module\.exports)\s*=", fixed_name="module.exports"),
    Rule(
        SCRIPTS,
        "method",
        r"^" + _NOT_CALL + r"\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*"
        r"\*?\s*(#?[\w$]+|\[[^\]]*\])\s*(?:<[^>]*>)?\((?!.*;\s*$)",
        ("class",),
    ),
    Rule(("go",), "function", r"^func\s+(\w+)\s*[\[(]"),
    Rule(("go",), "method", r"^func\s*\([^)]*\)\s*(\w+)\s*\("),
    Rule(("go",), "struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"),
    Rule(("go",), "interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
    Rule(("go",), "group", r"^(type)\s*\("),
    Rule(("go",), "type", r"^type\s+(\w+)\s+[^=\s]"),
    Rule(("go",), "struct", r"^\s+(\w+)\s+struct\b", ("group",)),
    Rule(("go",), "interface", r"^\s+(\w+)\s+interface\b", ("group",)),
    Rule(("go",), "type", r"^\s+(\w+)\s+[^=\s]", ("group",)),
    Rule(("java",), "class", _JAVA + r"class\s+(\w+)", ("file", "class")),
    Rule(("java",), "interface", _JAVA + r"interface\s+(\w+)"),
    Rule(("java",), "enum", _JAVA + r"enum\s+(\w+)", ("file", "class")),
    Rule(("java",), "method", r"^" + _NOT_CALL + _JAVA_METHOD[1:], ("class",)),
    Rule(("kotlin",), "interface", r"^\s*interface\s+(\w+)"),
    Rule(("kotlin",), "class", _KOTLIN + r"(?:class|interface)\s+(\w+)"),
    Rule(("kotlin",), "object", _KOTLIN + r"object\s+(\w+)"),
    Rule(
        ("kotlin",), "function",
        _KOTLIN + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(\w+)\s*\(",
    ),
    Rule(
        ("kotlin",), "method",
        _KOTLIN + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(\w+)\s*\(", ("class", "object", "interface"),
    ),
    Rule(("rust",), "function", _RUST_FN),
    Rule(("rust",), "struct", _RUST + r"struct\s+(\w+)"),
    Rule(("rust",), "enum", _RUST + r"enum\s+(\w+)"),
    Rule(("rust",), "trait", _RUST + r"(?:unsafe\s+)?trait\s+(\w+)"),
    Rule(("rust",), "impl", r"^\s*(?:unsafe\s+)?(impl)\b"),
    Rule(("rust",), "method", _RUST_FN, ("trait", "impl")),
    Rule(("c",), "struct", r"^\s*typedef\s+(struct)\b", fixed_name=""),
    Rule(("c",), "type", r"^\s*(typedef)\b", fixed_name=""),
    Rule(("c",), "function", _C_FUNCTION),
    Rule(("cpp",), "include", r"^\s*#\s*include\s+([<\"][^>\"]*[>\"])"),
    Rule(("cpp",), "namespace", r"^\s*(?:inline\s+)?namespace\s+([\w:]+)", ("file", "namespace")),
    Rule(("cpp",), "class", r"^\s*(?:template\s*<.*>\s*)?class\s+(\w+)(?!.*;\s*$)", ("file", "namespace")),
    Rule(
        ("cpp",), "function",
        r"^(?:\s*template\s*<.*>\s*)?" + _C_FUNCTION[1:] + r"(?!.*\)[^{}]*;\s*$)",
        ("file", "namespace"),
    ),
    Rule(("cpp",), "method", _CPP_METHOD, ("class",)),
)
HIDDEN_KINDS = ("impl", "group")
# What a nested owner may itself be nested in.
NESTS = {"java": ("class",), "cpp": ("namespace",)}
SEMICOLON_LANGUAGES = ("java", "rust", "c", "cpp")

_GOES_ON = r"(?:[=,(\[{+\-*/&|:<.]|=>|->|\b(?:extends|implements|by|in|is|as))$"
_CARRIES_ON = r"^\s*(?:[|&?:.,=+*/<{]|->|(?:extends|implements|where|by)\b)"
_ANNOTATION = r"^\s*@[A-Za-z]"
_ACCESS = r"^\s*(?:public|private|protected|signals|slots)\s*:"


def _count(code: Column, characters: str) -> Column:
    return F.length(code) - F.length(F.translate(code, characters, ""))


# Columns that hold the first fitting rule for each family of owners.
FAMILIES = {
    "file_match": ("file",),
    "space_match": ("namespace",),
    "body_match": ("class", "object", "interface", "trait", "impl", "group"),
}


def _first_match(code: Column, text: Column, language: Column, owners: tuple[str, ...]) -> Column:
    """First rule that fits below one of the owners, and the name it takes; or null.

    Include paths are strings, which the masked line hides, so they come from the
    source line.
    """

    def found(i: int, rule: Rule) -> Column:
        line = text if rule.kind == "include" else code
        name = F.regexp_extract(line, rule.pattern, 1) if rule.fixed_name is None else F.lit(rule.fixed_name)
        return F.struct(F.lit(i).alias("rule"), name.alias("name"))

    result = F.when(F.lit(False), found(0, RULES[0]))
    for i, rule in enumerate(RULES):
        if set(rule.owners) & set(owners):
            hit = language.isin(*rule.languages) & code.rlike(rule.pattern)
            result = result.when(hit, found(i, rule))
    return result


def _pick(index: Column, values: list[Column]) -> Column:
    return F.try_element_at(F.array(*values), index + 1)


def declarations(files: DataFrame) -> DataFrame:
    """Declarations with their line ranges; text comes later, from the file itself."""
    code, language = F.col("code"), F.col("language")
    attribute = (language == "rust") & code.rlike(r"^\s*#!?\[")
    access = (language == "cpp") & code.rlike(_ACCESS)
    lines = lexer.code_lines(files, LANGUAGES).where(code.rlike(r"\S") & ~attribute & ~access)
    guard = (
        F.when((language == "cpp") & code.rlike(r"^\s*#\s*if"), 1)
        .when((language == "cpp") & code.rlike(r"^\s*#\s*endif"), -1)
        .otherwise(0)
    )
    directive = language.isin("c", "cpp") & code.rlike(r"^\s*#")
    net = F.when(directive, guard).otherwise(_count(code, "{([") - _count(code, "})]"))
    slim = lines.select(
        "content_id",
        "language",
        "line",
        net.cast("int").alias("net"),
        directive.alias("directive"),
        *[
            _first_match(code, F.col("text"), language, owners).alias(f)
            for f, owners in FAMILIES.items()
        ],
        F.when(
            (language == "c") & code.rlike(r"^\s*(?:typedef\b|\})"),
            F.regexp_extract(code, r"(\w+)\s*(?:\[[^\]]*\])?\s*;$", 1),
        ).alias("last_word"),
        code.rlike(r"^\s*\{").alias("opens_alone"),
        (code.rlike(r"\{") & ~code.rlike(r"^\s*\{")).alias("opens"),
        F.when(language.isin(*SEMICOLON_LANGUAGES), code.rlike(r"[;}]$"))
        .otherwise(~code.rlike(_GOES_ON))
        .alias("may_end"),
        (~language.isin(*SEMICOLON_LANGUAGES) & code.rlike(_CARRIES_ON)).alias("carries_on"),
        (language.isin("java", "kotlin", *SCRIPTS) & code.rlike(_ANNOTATION)).alias("annotation"),
        ((language == "cpp") & code.rlike(r"^\s*template\s*<[^;{]*>$")).alias("template"),
    )
    return _ranges(slim)


def _ranges(lines: DataFrame) -> DataFrame:
    per_file = Window.partitionBy("content_id")
    down = per_file.orderBy("line")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    deep = (
        lines.withColumn("depth", F.coalesce(F.sum("net").over(before), F.lit(0)).cast("int"))
        .withColumn("after", F.col("depth") + F.col("net"))
        .withColumn("code_before", F.coalesce(F.max("line").over(before), F.lit(0)))
        .withColumn("may_end", F.col("may_end") & ~F.coalesce(
            F.lead("carries_on").over(down), F.lit(False)))
    )
    kinds = [F.lit(r.kind) for r in RULES]
    rule = F.when(F.col("depth") == 0, F.col("file_match.rule")).otherwise(
        F.coalesce("space_match.rule", "body_match.rule")
    )
    deep = deep.withColumn("tag", F.coalesce(_pick(rule, kinds), F.lit("code")))
    opens = (F.col("tag") != "code") | (F.col("opens") | (F.col("after") > F.col("depth"))) & ~F.col(
        "opens_alone"
    )
    marked = (
        deep.withColumn("opens", F.coalesce(opens, F.lit(False)))
        .withColumn("may_end", F.coalesce("may_end", F.lit(False)))
        .withColumn("wanted", F.coalesce("file_match", "space_match", "body_match").isNotNull())
        .withColumn("last_line", F.max("line").over(per_file))
    )
    # What encloses a line, and where its statement ends, at any depth.
    reads = ("line", "depth", "after", "opens", "may_end", "tag", "code_before", "last_word", "wanted")
    wide = fold.fold_files(marked, reads, fold.NESTING, fold.nesting)
    # Annotations and template heads belong to the declaration they stand on.
    head = F.col("annotation") | F.col("template")
    level = Window.partitionBy("content_id", "depth").orderBy("line")
    group = F.coalesce(
        F.sum(F.when(~head, 1).otherwise(0)).over(level.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    stacked = Window.partitionBy("content_id", "depth", "_group")
    wide = (
        wide.withColumn("_group", group)
        .withColumn("start_line", F.min("line").over(stacked))
        .withColumn("head_before", F.min("code_before").over(stacked))
    )
    return _valid(wide)


def _valid(rows: DataFrame) -> DataFrame:
    """Keep declarations whose whole chain of owners may hold them."""
    depth, language = F.col("depth"), F.col("language")
    owner_tag = F.when(depth == 0, F.lit("file")).otherwise(F.col("owner_tag"))

    match = (
        F.when(owner_tag == "file", F.col("file_match"))
        .when(owner_tag == "namespace", F.col("space_match"))
        .otherwise(F.col("body_match"))
    )
    rule = match["rule"]
    allowed = F.array_contains(
        F.coalesce(
            _pick(rule, [F.array(*[F.lit(o) for o in r.owners]) for r in RULES]),
            F.array().cast("array<string>"),
        ),
        owner_tag,
    )
    # Owners above the direct one must be of the kinds that nest in this language.
    inside = F.when(depth <= 1, F.lit(True))
    nests = F.when(language == "java", inside.otherwise(F.col("inside") == "class")).when(
        language == "cpp", inside.otherwise(F.col("inside") == "namespace")
    ).otherwise(depth <= 1)
    picked = (
        rows.withColumn("rule", rule)
        .withColumn("name", match["name"])
        .withColumn("in_group", F.coalesce(owner_tag == "group", F.lit(False)))
        .where(F.col("rule").isNotNull() & allowed & F.coalesce(nests, F.lit(False)))
    )
    name, in_group = F.col("name"), F.col("in_group")
    typedef = (language == "c") & (name == "")
    start = F.when(in_group, F.col("owner_line")).otherwise(F.col("start_line"))
    end = F.when(in_group, F.col("group_end")).otherwise(F.col("end_line"))
    return (
        picked.withColumn("kind", _pick(F.col("rule"), [F.lit(r.kind) for r in RULES]))
        .where(~F.col("kind").isin(*HIDDEN_KINDS))
        .select(
            "content_id",
            "language",
            F.when(typedef, F.coalesce(F.col("end_word"), F.lit(""))).otherwise(name).alias("name"),
            "kind",
            start.cast("int").alias("start_line"),
            F.coalesce(end, F.col("last_line")).cast("int").alias("end_line"),
            (F.when(in_group, F.col("owner_before")).otherwise(F.col("head_before")) + 1)
            .cast("int").alias("doc_from"),
            (start - 1).cast("int").alias("doc_to"),
        )
        .where(F.col("name") != "")
    )
