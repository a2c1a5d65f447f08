"""License scans: base phrases, and blocks of text that contain a license template.

Only column expressions and joins. A text is reduced once to its words (runs of letters, digits
and non-ASCII characters, A-Z lower-cased). Base phrases are counted in the row.

Template containment is an exact set-similarity join. A block (a line) holds a template when at
least THRESHOLD of the template's distinct words are in it. The words of all templates get one
global order, by the number of blocks of the whole corpus that hold them, rare ones first. A
block that holds a template must share a word with the template's prefix, have enough template
words (length filter), and have enough of them left behind the shared word (positional filter).
Only blocks that pass are joined with the templates' prefixes and verified. Templates are
parameters, at most MAX_TEMPLATES, so their side may be broadcast.

Matches are keyed by the text's content, so copies of a text are matched once.

Defined results: null, empty and wordless texts have zero words, no labels and score 0; repeated
rows each get the same result; other columns stay, in struct `row`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import ascii_lower, stored

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
MAX_TEMPLATES = 1000

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: First lines of well-known notices, with the label that each stands for.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
)

#: Everything that is neither part of a word nor a line's end.
_BETWEEN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: Columns that name a text by its content.
_KEY = ("key_a", "key_b", "key_n")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words_in(spaced: Column) -> Column:
    """Words of a text in which each stands between two spaces of its own."""
    return (_spaces(spaced) / 2).cast("long")


def _phrase(phrase: str, spaced: Column, n_words: Column) -> tuple[Column, Column, Column]:
    """Places of a phrase: their number, the first and the last word."""
    sought = "".join(f" {w} " for w in phrase.split())
    size = len(phrase.split())
    count = (
        (F.length(spaced) - F.length(F.replace(spaced, F.lit(sought), F.lit("")))) / len(sought)
    ).cast("long")
    first = F.when(count > 0, _words_in(F.substring_index(spaced, sought, 1)))
    last = F.when(count > 0, n_words - _words_in(F.substring_index(spaced, sought, -1)) - size)
    return count, first, last


def _needed(size: int) -> int:
    """Template words that a block must hold at least."""
    return max(1, -(-int(size * THRESHOLD * 1000) // 1000))


def template_order(blocks: DataFrame, every: list[str]) -> list[str]:
    """All words of the templates, the rarest in the corpus' blocks first."""
    rows = blocks.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    counts = {r.word: r["count"] for r in rows}  # at most a row for each template word
    return sorted(every, key=lambda w: (counts.get(w, 0), w))


def contained(blocks: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """Which block (all columns but `words`) holds which template, and how much of it."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    spark = blocks.sparkSession
    every = sorted({w for _, t in templates for w in t.split()})
    # Texts are read once: only the template words of each block go on.
    words = F.array_intersect("words", F.array(*map(F.lit, every)))
    blocks = stored(blocks.withColumn("held", words).drop("words").where(F.size("held") > 0))
    order = template_order(blocks, every)
    place = {w: k for k, w in enumerate(order)}
    prefixes, whole, starts = [], [], set()
    for number, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=place.get)
        need = _needed(len(words))
        whole.append((number, label, words, need))
        for at, word in enumerate(words[: len(words) - need + 1]):
            prefixes.append((word, number, at, len(words), need))
            starts.add(word)
    prefix = spark.createDataFrame(prefixes, "word string, template int, at int, size int, need int")
    full = spark.createDataFrame(whole, "template int, label string, template_words array<string>, need int")
    least = min(w[3] for w in whole)
    held = F.array_intersect(F.array(*map(F.lit, order)), F.col("held"))  # in the global order
    start = F.array(*map(F.lit, sorted(starts)))
    able = blocks.withColumn("held", held)
    able = able.where((F.size("held") >= least) & F.arrays_overlap("held", start))
    key = [c for c in able.columns if c != "held"]
    each = able.select(*key, "held", F.posexplode("held").alias("pos", "word"))
    found = each.join(F.broadcast(prefix), "word").where(
        F.least(F.col("size") - F.col("at"), F.size("held") - F.col("pos")) >= F.col("need")
    )
    candidates = found.select(*key, "held", "template").dropDuplicates([*key, "template"])
    both = candidates.join(F.broadcast(full), "template")
    shared = F.size(F.array_intersect("held", "template_words"))
    return both.where(shared >= F.col("need")).select(
        *key, "label", (shared / F.size("template_words")).alias("containment")
    )


def scan(
    docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """Every row as struct `row` with its words, base places, labels and score."""
    phrases = phrases or PHRASES
    whole = F.col(text).cast("string")
    clean = F.regexp_replace(ascii_lower(F.coalesce(whole, F.lit(""))), _BETWEEN, " ")
    rows = docs.select(
        F.struct("*").alias("row"), clean.alias("clean"), F.xxhash64(whole).alias("key_a"),
        F.hash(whole).alias("key_b"), F.coalesce(F.length(whole), F.lit(0)).alias("key_n"),
    )
    lines = rows.select(*_KEY, F.posexplode(F.split("clean", "\n")).alias("line", "content"))
    blocks = lines.select(
        *_KEY, "line", F.array_distinct(F.split(F.trim("content"), " +")).alias("words")
    ).where(F.size("words") > 1)
    hits = contained(blocks, templates).groupBy(*_KEY).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")
    )
    flat = F.trim(F.regexp_replace("clean", "[ \n]+", " "))
    flat = F.when(flat == "", F.lit("")).otherwise(
        F.concat(F.lit(" "), F.replace(flat, F.lit(" "), F.lit("  ")), F.lit(" "))
    )
    slim = rows.select("row", *_KEY, flat.alias("spaced")).withColumn("n_words", _words_in(F.col("spaced")))
    places = {p: _phrase(p, F.col("spaced"), F.col("n_words")) for p in phrases}
    named = slim.select(
        "row", *_KEY, "n_words",
        reduce(lambda a, b: a + b, (p[0] for p in places.values())).alias("n_base"),
        F.array_min(F.array(*(p[1] for p in places.values()))).alias("first_word"),
        F.array_max(F.array(*(p[2] for p in places.values()))).alias("last_word"),
        F.array_sort(F.array_distinct(F.filter(
            F.array(*(F.when(places[p][0] > 0, F.lit(label)) for p, label in phrases.items())),
            lambda label: label.isNotNull(),
        ))).alias("base"),
    )
    joined = named.join(hits, list(_KEY), "left")
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", nothing)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select(
        "row", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
