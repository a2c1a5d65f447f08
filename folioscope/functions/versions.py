"""Semantic versions as struct columns and version ranges as predicates.

A range is compiled once on the driver into plain comparisons, so the check on
tags stays a Catalyst predicate and the best tag is an ordinary aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_ID = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
# The public grammar's rule of safe integers: a larger core number makes a tag no version.
_NUM = r"(?:0|[1-9][0-9]{0,15})"
VERSION_PATTERN = (
    rf"^[=v]*\s*({_NUM})\.({_NUM})\.({_NUM})"
    rf"(?:-({_ID}(?:\.{_ID})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
)

Version = tuple[int, int, int, tuple[str, ...]]


def clean_version(ref: Column) -> Column:
    """``" =v1.2.3 "`` as ``1.2.3``; null for refs that are no version."""
    text = F.trim(ref)
    pre = F.regexp_extract(text, VERSION_PATTERN, 4)
    core = F.concat_ws(".", *[F.regexp_extract(text, VERSION_PATTERN, i) for i in (1, 2, 3)])
    return F.when(
        text.rlike(VERSION_PATTERN),
        F.when(pre == "", core).otherwise(F.concat(core, F.lit("-"), pre)),
    )


def _identifier_key(identifier: Column) -> Column:
    """Numbers sort before words, numbers by value and words by text.

    Numbers have no leading zeros, so length and then text order them whatever their size.
    """
    numeric = identifier.rlike("^[0-9]+$")
    return F.struct(
        F.when(numeric, F.lit(0)).otherwise(F.lit(1)).alias("is_word"),
        F.when(numeric, F.length(identifier)).otherwise(F.lit(0)).alias("digits"),
        identifier.alias("word"),
    )


def version_key(version: Column) -> Column:
    """Sortable struct of a cleaned version: larger structs are later versions."""
    pre = F.regexp_extract(version, VERSION_PATTERN, 4)
    numbers = [
        F.regexp_extract(version, VERSION_PATTERN, i).try_cast("long").alias(name)
        for i, name in ((1, "major"), (2, "minor"), (3, "patch"))
    ]
    identifiers = F.filter(F.split(pre, r"\.", -1), lambda x: x != "")
    return F.when(
        version.isNotNull(),
        F.struct(
            *numbers,
            F.when(pre == "", F.lit(1)).otherwise(F.lit(0)).alias("is_release"),
            F.transform(identifiers, _identifier_key).alias("pre"),
        ),
    )


# --- ranges ------------------------------------------------------------------


@dataclass(frozen=True)
class Bound:
    op: str
    version: Version


_PART = r"(?:0|[1-9][0-9]*|[xX*])"
_PARTIAL = re.compile(
    rf"^[v=\s]*({_PART})(?:\.({_PART})(?:\.({_PART})"
    rf"(?:-({_ID}(?:\.{_ID})*))?(?:\+[0-9A-Za-z.-]+)?)?)?$"
)
_NOTHING = (Bound("<", (0, 0, 0, ("0",))),)


def _partial(text: str) -> tuple[list[int], tuple[str, ...]] | None:
    """Known leading numbers of a possibly partial version and its pre-release."""
    if text in ("", "v", "="):
        return [], ()
    match = _PARTIAL.match(text)
    if not match:
        return None
    numbers: list[int] = []
    for part in match.groups()[:3]:
        if part is None or part in "xX*":
            break
        numbers.append(int(part))
    pre = tuple(match.group(4).split(".")) if match.group(4) and len(numbers) == 3 else ()
    return numbers, pre


def _full(numbers: list[int], pre: tuple[str, ...] = ()) -> Version:
    filled = (numbers + [0, 0, 0])[:3]
    return filled[0], filled[1], filled[2], pre


def _next(numbers: list[int], position: int) -> Version:
    """First version after every version that shares the numbers up to a position."""
    raised = numbers[:position] + [numbers[position] + 1]
    return _full(raised, ("0",))


def _span(numbers: list[int], pre: tuple[str, ...]) -> tuple[Bound, ...]:
    if not numbers:
        return (Bound(">=", _full([])),)
    if len(numbers) == 3:
        return (Bound("=", _full(numbers, pre)),)
    return Bound(">=", _full(numbers)), Bound("<", _next(numbers, len(numbers) - 1))


def _caret(numbers: list[int], pre: tuple[str, ...]) -> tuple[Bound, ...]:
    if not numbers:
        return _span(numbers, pre)
    fixed = next((i for i, n in enumerate(numbers) if n), len(numbers) - 1)
    return Bound(">=", _full(numbers, pre)), Bound("<", _next(numbers, fixed))


def _tilde(numbers: list[int], pre: tuple[str, ...]) -> tuple[Bound, ...]:
    if not numbers:
        return _span(numbers, pre)
    return Bound(">=", _full(numbers, pre)), Bound("<", _next(numbers, min(1, len(numbers) - 1)))


def _compare(op: str, numbers: list[int], pre: tuple[str, ...]) -> tuple[Bound, ...]:
    if len(numbers) == 3:
        return (Bound(op, _full(numbers, pre)),)
    if not numbers:
        return _NOTHING if op in "<>" else (Bound(">=", _full([])),)
    last = len(numbers) - 1
    if op == ">":
        raised = _next(numbers, last)
        return (Bound(">=", (*raised[:3], ())),)
    if op == "<=":
        return (Bound("<", _next(numbers, last)),)
    if op == "<":
        return (Bound("<", _full(numbers, ("0",))),)
    return (Bound(op, _full(numbers)),)


def _conjunction(text: str) -> tuple[Bound, ...] | None:
    text = text.strip()
    hyphen = re.match(r"^(\S+)\s+-\s+(\S+)$", text)
    if hyphen:
        low, high = _partial(hyphen.group(1)), _partial(hyphen.group(2))
        if low is None or high is None:
            return None
        bounds = (Bound(">=", _full(*low)),)
        if not high[0]:
            return bounds
        if len(high[0]) == 3:
            return (*bounds, Bound("<=", _full(*high)))
        return (*bounds, Bound("<", _next(high[0], len(high[0]) - 1)))
    text = re.sub(r"(<=|>=|<|>|=|~>?|\^)\s+", r"\1", text)
    if not text:
        return (Bound(">=", _full([])),)
    bounds: tuple[Bound, ...] = ()
    for word in text.split():
        op, rest = re.match(r"^(<=|>=|<|>|~>?|\^|=)?(.*)$", word).groups()
        part = _partial(rest)
        if part is None:
            return None
        if op in ("~", "~>"):
            bounds += _tilde(*part)
        elif op == "^":
            bounds += _caret(*part)
        elif op in ("<", ">", "<=", ">="):
            bounds += _compare(op, *part)
        else:
            bounds += _span(*part)
    return bounds


def parse_range(text: str) -> list[tuple[Bound, ...]] | None:
    """Alternatives of bounds, or None when the text is no range (a branch name).

    One alternative that is no range makes the whole text none.
    """
    alternatives = [_conjunction(part) for part in re.split(r"\s*\|\|\s*", text)]
    return None if None in alternatives else alternatives


def _literal_key(version: Version) -> Column:
    major, minor, patch, pre = version
    identifiers = [
        F.struct(
            F.lit(0 if p.isdigit() else 1).alias("is_word"),
            F.lit(len(p) if p.isdigit() else 0).alias("digits"),
            F.lit(p).alias("word"),
        )
        for p in pre
    ]
    kind = "array<struct<is_word:int,digits:int,word:string>>"
    return F.struct(
        F.lit(major).cast("long").alias("major"),
        F.lit(minor).cast("long").alias("minor"),
        F.lit(patch).cast("long").alias("patch"),
        F.lit(0 if pre else 1).alias("is_release"),
        F.array(*identifiers).cast(kind).alias("pre"),
    )


def _holds(key: Column, bound: Bound) -> Column:
    other = _literal_key(bound.version)
    return {
        "=": key == other,
        "<": key < other,
        "<=": key <= other,
        ">": key > other,
        ">=": key >= other,
    }[bound.op]


def satisfies(key: Column, text: str) -> Column:
    """Does a version key lie in the range? Text that is no range admits nothing.

    A pre-release only counts when a bound of the same alternative names a
    pre-release of the same three numbers.
    """
    alternatives = parse_range(text)
    if alternatives is None:
        return F.lit(False)
    result = F.lit(False)
    for bounds in alternatives:
        inside = F.lit(True)
        allowed = key["is_release"] == 1
        for bound in bounds:
            inside = inside & _holds(key, bound)
            major, minor, patch, pre = bound.version
            if pre:
                allowed = allowed | (
                    (key["major"] == major) & (key["minor"] == minor) & (key["patch"] == patch)
                )
        result = result | (inside & allowed)
    return F.coalesce(result, F.lit(False))
