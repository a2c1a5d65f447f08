"""Path expressions: languages by extension, globs, ignore rules, manifests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Extensions and the language each stands for.
EXTENSIONS = {
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi"),
    "go": (".go",),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "markdown": (".md", ".mdx"),
}

# Names that are ignored in every tree.
ALWAYS_IGNORED = (
    "node_modules", ".git", "dist", "build", ".next", ".nuxt", "__pycache__", ".DS_Store", "*.lock",
)

# Manifest files and the languages they imply.
MANIFESTS = {
    "tsconfig.json": ("typescript", "javascript"),
    "package.json": ("typescript", "javascript"),
    "deno.json": ("typescript", "javascript"),
    "deno.jsonc": ("typescript", "javascript"),
    "bun.lockb": ("typescript", "javascript"),
    "pyproject.toml": ("python",),
    "setup.py": ("python",),
    "setup.cfg": ("python",),
    "requirements.txt": ("python",),
    "Pipfile": ("python",),
    "go.mod": ("go",),
    "pom.xml": ("java", "kotlin"),
    "build.gradle": ("java", "kotlin"),
    "build.gradle.kts": ("java", "kotlin"),
    "settings.gradle": ("java", "kotlin"),
    "settings.gradle.kts": ("java", "kotlin"),
    "Cargo.toml": ("rust",),
    "CMakeLists.txt": ("c", "cpp"),
    "Makefile": ("c", "cpp"),
    "meson.build": ("c", "cpp"),
}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def classify_language(path: Column) -> Column:
    pairs = [F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def manifest_languages(path: Column) -> Column:
    """Languages implied by a manifest at the root of a tree; empty otherwise."""
    pairs = []
    for name, langs in MANIFESTS.items():
        pairs += [F.lit(name), F.array(*[F.lit(x) for x in langs])]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), path), F.array().cast("array<string>")
    )


# --- globs -----------------------------------------------------------------


def expand_braces(pattern: str) -> list[str]:
    """``a.{b,c}`` as ``a.b`` and ``a.c``; nested groups and no group both work."""
    depth, start = 0, -1
    for i, ch in enumerate(pattern):
        if ch == "{":
            if depth == 0:
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                options = _split_top_level(pattern[start + 1 : i])
                if len(options) < 2:
                    continue
                tails = expand_braces(pattern[i + 1 :])
                return [
                    pattern[:start] + head + tail
                    for option in options
                    for head in expand_braces(option)
                    for tail in tails
                ]
    return [pattern]


def _split_top_level(body: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in body:
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
            continue
        depth += (ch == "{") - (ch == "}")
        current += ch
    return [*parts, current]


def _segment_regex(segment: str, hide_dotfiles: bool) -> str:
    out, i = "", 0
    if hide_dotfiles and segment[:1] in ("*", "?", "["):
        out = r"(?!\.)"
    while i < len(segment):
        ch = segment[i]
        if ch == "*":
            while i + 1 < len(segment) and segment[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in segment[i + 2 :]:
            close = segment.index("]", i + 2)
            body = segment[i + 1 : close]
            negate = body[0] in "!^"
            body = body[1:] if negate else body
            out += "[" + ("^/" if negate else "") + body.replace("\\", r"\\") + "]"
            i = close
        elif ch == "\\" and i + 1 < len(segment):
            i += 1
            out += re.escape(segment[i])
        else:
            out += re.escape(ch)
        i += 1
    if segment and not segment.strip("*") and hide_dotfiles:
        out = r"(?!\.)[^/]+"
    return out


def _glob_body(pattern: str, hide_dotfiles: bool = True) -> str:
    segments = pattern.split("/")
    out = ""
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            step = r"(?!\.)[^/]+" if hide_dotfiles else "[^/]+"
            out += rf"{step}(?:/{step})*" if last else rf"(?:{step}/)*"
        else:
            out += _segment_regex(segment, hide_dotfiles) + ("" if last else "/")
    return out


def glob_regex(pattern: str) -> tuple[str, bool]:
    """Anchored regular expression of a glob and whether the glob is negated."""
    negated = False
    while pattern.startswith("!"):
        negated, pattern = not negated, pattern[1:]
    options = [_glob_body(p) for p in expand_braces(pattern)]
    return "^(?:" + "|".join(options) + ")$", negated


def matches_globs(path: Column, patterns: Sequence[str]) -> Column:
    """True when a path satisfies every glob; no globs let everything through."""
    result = F.lit(True)
    for pattern in patterns:
        if pattern.startswith("#"):
            result = result & F.lit(False)
            continue
        regex, negated = glob_regex(pattern)
        hit = path.rlike(regex)
        result = result & (~hit if negated else hit)
    return result


# --- ignore rules ------------------------------------------------------------


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negated: bool


def ignore_rule(line: str, base: str = "") -> IgnoreRule | None:
    """One line of an ignore file as a regular expression.

    It is tested on one entry of a path at a time; folders end in a slash.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    if body.startswith(("\\#", "\\!")):
        body = body[1:]
    only_folder = body.endswith("/")
    body = body.rstrip("/")
    if base:
        body = f"{base.strip('/')}/{body.lstrip('/')}"
    if not body:
        return None
    rooted = "/" in body
    core = _glob_body(body.lstrip("/"), hide_dotfiles=False)
    start = "(?i)^" if rooted else "(?i)^(?:.*/)?"
    return IgnoreRule(start + core + ("/$" if only_folder else "/?$"), negated)


def ignore_rules(
    root_lines: Iterable[str] = (), nested: dict[str, Iterable[str]] | None = None
) -> list[IgnoreRule]:
    rules = [ignore_rule(name) for name in ALWAYS_IGNORED]
    rules += [ignore_rule(line) for line in root_lines]
    for folder, lines in (nested or {}).items():
        kept = [x for x in lines if x.strip() and not x.startswith("#")]
        rules += [ignore_rule(f"{folder.strip('/')}/{x}") for x in kept]
    return [r for r in rules if r]


def path_entries(path: Column) -> Column:
    """``a/b/c`` as ``[a/, a/b/, a/b/c]``: every folder above the file, then the file."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), depth),
        lambda n: F.concat(
            F.array_join(F.slice(parts, F.lit(1), n), "/"),
            F.when(n < depth, F.lit("/")).otherwise(F.lit("")),
        ),
    )


def is_ignored(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """The last rule that matches an entry decides on it.

    A file below an ignored folder is ignored whatever later rules say of the file.
    """

    def decide(entry: Column) -> Column:
        decision = F.lit(False)
        for rule in rules:
            decision = F.when(entry.rlike(rule.regex), F.lit(not rule.negated)).otherwise(decision)
        return decision

    return F.exists(path_entries(path), decide)


def contains_ignoring_case(text: Column, part: str) -> Column:
    """ILIKE over ``%part%``; ``%`` and ``_`` inside the part stay wildcards."""
    return text.ilike(f"%{part}%")


def has_prefix(path: Column, prefix: str | None) -> Column:
    """LIKE over ``prefix%``; wildcards inside the prefix stay wildcards."""
    return path.like(f"{prefix}%") if prefix else F.lit(True)
