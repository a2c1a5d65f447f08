"""A word index that grows by immutable segments and finds the best chunks without reading all.

A write adds one segment: its chunks with their words, and their postings in blocks. Chunks are
ordered by length and cut into windows of `window` chunks; a block is one word in one window, with
the highest count of the word and the shortest length in it. Those two bound the BM25 score of all
chunks of the window for any corpus average, so a search first adds up the bounds of its words
(slim columns only), scores the most promising windows, and then reads just the windows whose bound
reaches the k-th best score found. The result is exact.

A replaced or deleted chunk stays in its segment and gets a tombstone, which holds no words; a
search takes the tombstones off the chunk frequencies of its own words, so statistics are those of
live chunks. `merge` rewrites segments of one size class as one, without the dead chunks.

A manifest per generation, written last, names the live segments. A write that fails before it
leaves nothing that a reader sees, and the next one overwrites its folders. One writer at a time;
readers keep the generation they opened.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import text as text_fn
from folioscope.operators import postings, search

WINDOW = 128
#: Segments of one size class that are merged into one.
FANOUT = 8
#: Windows that a search names to the scan; more meet it in a join.
NAMED_WINDOWS = 1000

_MANIFEST = "segment int, docs long, total long, removals array<int>"
_BLOCKS = f"{postings.BLOCKS}, segment int"


def _terms(units: Sequence[Sequence[str]]) -> list[str]:
    return sorted({word for unit in units for word in unit})


def _sum(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


@dataclass
class Statistics:
    """Live chunks, their words, and for each search unit the live chunks that hold it."""

    n: int
    total: int
    held: list[int]

    def weight(self, unit: int, tf: Column, length: Column, k1: float, b: float) -> Column:
        idf = math.log(1.0 + (self.n - self.held[unit] + 0.5) / (self.held[unit] + 0.5))
        average = F.lit(self.total / self.n if self.n else 1.0)
        return F.lit(idf) * search.term_weight(tf, length, average, k1, b)


class SegmentedIndex:
    """The index of a folder as of its newest generation, or an older one."""

    def __init__(
        self, spark: SparkSession, folder: str, key: Sequence[str], window: int = WINDOW,
        buckets: int = postings.BUCKETS, generation: int | None = None,
    ):
        self.spark, self.folder, self.key = spark, folder, list(key)
        self.window, self.buckets = window, buckets
        self.generation = self._newest() if generation is None else generation
        #: Live segments with their chunks and words, dead chunks included.
        self.segments: dict[int, tuple[int, int]] = {}
        #: Generations that took chunks out.
        self.removals: list[int] = []
        if self.generation:
            rows = self._manifests().where(F.col("gen") == self.generation).collect()
            self.segments = {r.segment: (r.docs, r.total) for r in rows if r.segment is not None}
            self.removals = list(rows[0].removals)

    # --- generations ------------------------------------------------------------------------

    def _manifests(self) -> DataFrame:
        reader = self.spark.read.schema(f"{_MANIFEST}, gen int")
        return reader.parquet(f"{self.folder}/manifest")

    def _newest(self) -> int:
        try:
            return self._manifests().agg(F.max("gen")).first()[0] or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def _commit(self, generation: int, segments: dict[int, tuple[int, int]], removals: list[int]) -> None:
        rows = [(number, docs, total, removals) for number, (docs, total) in sorted(segments.items())]
        # An index without segments is a row as well.
        frame = self.spark.createDataFrame(rows or [(None, 0, 0, removals)], _MANIFEST)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/gen={generation}")
        self.generation, self.segments, self.removals = generation, segments, removals

    def _of_segments(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{name}").where(F.col("segment").isin(sorted(self.segments)))

    def _tombstones(self) -> DataFrame:
        schema = "segment int, ordinal long, length long"
        if not self.removals or not self.segments:
            return self.spark.createDataFrame([], schema)
        return self._of_segments("removed", f"{schema}, gen int").where(F.col("gen").isin(self.removals)).drop("gen")

    def live(self) -> DataFrame:
        """Chunks of the index: segment, ordinal, key, length and words."""
        if not self.segments:
            keys = self.spark.createDataFrame([], "segment int, ordinal long, length long, words array<string>")
            return keys.select("*", *[F.lit(None).alias(name) for name in self.key])
        return self._alive(self._of_segments("docs"))

    def _alive(self, docs: DataFrame) -> DataFrame:
        dead = self._tombstones().select("segment", "ordinal")
        return docs.join(dead, ["segment", "ordinal"], "left_anti")

    # --- writes -----------------------------------------------------------------------------

    def add(self, chunks: DataFrame) -> None:
        """New chunks (key and `content`) as one segment; keys that are there already need replace."""
        self._apply(chunks, None)

    def replace(self, chunks: DataFrame) -> None:
        """Chunks that take the place of those with their keys, or are new."""
        self._apply(chunks, chunks)

    def delete(self, keys: DataFrame) -> None:
        """Take chunks out by their keys."""
        self._apply(None, keys)

    def _apply(self, chunks: DataFrame | None, keys: DataFrame | None) -> None:
        generation = self.generation + 1
        segments, removals = dict(self.segments), list(self.removals)
        if keys is not None and segments:
            self._remove(keys, generation)
            removals.append(generation)
        if chunks is not None:
            words = text_fn.code_words(F.col("content"))
            docs = chunks.select(*self.key, words.alias("words")).select(*self.key, *self._packed())
            segments |= self._segment(docs, generation)
        self._commit(generation, segments, removals)

    @staticmethod
    def _packed() -> list[Column]:
        """Length and words in one line, which travels in less room than a list."""
        return [F.size("words").cast("long").alias("length"), F.array_join("words", " ").alias("line")]

    def _segment(self, docs: DataFrame, number: int) -> dict[int, tuple[int, int]]:
        """Write the chunks (packed) and their blocks; nothing but two totals comes back."""
        ordered = docs.select(*self.key, "length", "line").repartitionByRange("length", *self.key)
        ordered = ordered.sortWithinPartitions("length", *self.key)
        words = F.filter(F.split("line", " "), lambda w: w != "").alias("words")
        place = f"{self.folder}/docs/segment={number}"
        numbered = ordered.select(*self.key, "length", words, F.monotonically_increasing_id().alias("ordinal"))
        numbered.write.mode("overwrite").option("compression", "zstd").parquet(place)
        stored = self.spark.read.parquet(place)
        # Chunks are stored in the order of their windows, so blocks are made where a chunk is read;
        # a window that two tasks read has two blocks a word.
        postings.word_blocks(stored, self.buckets, self.window).write.mode("overwrite").option(
            "compression", "zstd"
        ).parquet(f"{self.folder}/blocks/segment={number}")
        row = stored.agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("total")).first()
        return {number: (row.docs, row.total)} if row.docs else {}

    def _remove(self, keys: DataFrame, generation: int) -> None:
        live = self._alive(self._of_segments("docs").select("segment", "ordinal", "length", *self.key))
        found = live.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        place = f"{self.folder}/removed/gen={generation}"
        found.select("segment", "ordinal", "length").write.mode("overwrite").parquet(place)

    def merge(self, fanout: int = FANOUT) -> list[int]:
        """Rewrite the segments of each size class that has `fanout` of them; their numbers."""
        dead = {row.segment: row["count"] for row in self._tombstones().groupBy("segment").count().collect()}
        classes: dict[int, list[int]] = {}
        for number, (docs, _) in self.segments.items():
            size = docs - dead.get(number, 0)
            classes.setdefault(int(math.log(max(size, 1), fanout)), []).append(number)
        merged = sorted(n for numbers in classes.values() if len(numbers) >= fanout for n in numbers)
        if merged:
            generation = self.generation + 1
            docs = self._of_segments("docs").where(F.col("segment").isin(merged))
            docs = self._alive(docs.select("segment", "ordinal", *self.key, *self._packed()))
            kept = {n: size for n, size in self.segments.items() if n not in merged}
            self._commit(generation, kept | self._segment(docs, generation), self.removals)
        return merged

    # --- search -----------------------------------------------------------------------------

    def _hits(self, words: Sequence[str]) -> DataFrame:
        """Blocks of some words: runs are sorted, so only pages that may hold them are read."""
        numbers = self.spark.range(1).select(
            F.array(*[postings.word_bucket(F.lit(w), self.buckets) for w in words]).alias("b")
        ).first()["b"]
        blocks = self._of_segments("blocks", _BLOCKS)
        return blocks.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("word").isin(list(words)))

    def _counted(self, hits: DataFrame, units: Sequence[Sequence[str]]) -> DataFrame:
        """Live chunks of some blocks with the count of every search unit."""
        each = hits.select("segment", "word", F.explode("entries").alias("e"))
        each = each.select("segment", "e.ordinal", "e.length", "word", "e.positions")
        each = each.join(self._tombstones().select("segment", "ordinal"), ["segment", "ordinal"], "left_anti")
        places = F.map_from_entries(F.collect_list(F.struct("word", "positions")))
        held = each.groupBy("segment", "ordinal", "length").agg(places.alias("places"))
        counts = [postings.unit_count(F.col("places"), unit).alias(f"tf{i}") for i, unit in enumerate(units)]
        return held.select("segment", "ordinal", "length", *counts)

    def _statistics(self, units: Sequence[Sequence[str]]) -> Statistics:
        dead = self._tombstones().agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).first()
        words = _terms(units)
        held = {w: 0 for w in words}
        counted = self._hits(words).select("word", "n")
        if dead.n:
            each = self._hits(words).select("segment", "word", F.explode("entries.ordinal").alias("ordinal"))
            lost = each.join(self._tombstones().select("segment", "ordinal"), ["segment", "ordinal"], "left_semi")
            counted = counted.unionByName(lost.select("word", F.lit(-1).cast("long").alias("n")))
        held |= {row.word: row.n for row in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
        phrases = [i for i, unit in enumerate(units) if len(unit) > 1]
        counts = [held[unit[0]] for unit in units]
        if phrases:
            # No block says where words follow each other: those of the phrases' words are read.
            asked = [units[i] for i in phrases]
            found = self._counted(self._hits(_terms(asked)), asked)
            row = found.agg(*[F.count_if(F.col(f"tf{j}") > 0) for j in range(len(asked))]).first()
            for j, i in enumerate(phrases):
                counts[i] = row[j]
        docs, total = (sum(size[k] for size in self.segments.values()) for k in (0, 1))
        return Statistics(docs - dead.n, total - (dead.total or 0), counts)

    def bounds(
        self, units: Sequence[Sequence[str]], known: Statistics, k1: float = search.K1, b: float = search.B
    ) -> DataFrame:
        """Every window that holds a search unit's words with the most that a chunk in it can score."""
        words = _terms(units)
        name = {word: i for i, word in enumerate(words)}
        is_word = {word: F.col("word") == word for word in words}
        windows = self._hits(words).groupBy("segment", "at").agg(
            *[F.max(F.when(is_word[w], F.col("most"))).alias(f"most{i}") for w, i in name.items()],
            *[F.min(F.when(is_word[w], F.col("shortest"))).alias(f"shortest{i}") for w, i in name.items()],
        )
        parts = []
        for i, unit in enumerate(units):
            most = [F.col(f"most{name[w]}") for w in unit]
            lengths = [F.col(f"shortest{name[w]}") for w in unit]
            tf = F.least(*most) if len(most) > 1 else most[0]
            # A chunk with all words of a phrase is as long as the longest of their shortest.
            length = F.greatest(*lengths) if len(lengths) > 1 else lengths[0]
            every = _sum([m.isNotNull().cast("int") for m in most]) == len(most)
            parts.append(F.when(every, known.weight(i, tf, length, k1, b)).otherwise(0.0))
        return windows.select("segment", "at", _sum(parts).alias("bound")).where("bound > 0")

    def _scored(self, hits: DataFrame, units: Sequence[Sequence[str]], known: Statistics, k1: float, b: float) -> DataFrame:
        counted = self._counted(hits, units)
        found = [F.col(f"tf{i}") for i in range(len(units))]
        parts = [known.weight(i, tf, F.col("length"), k1, b) for i, tf in enumerate(found)]
        score = F.round(_sum(parts), search.SCORE_DIGITS).alias("bm25")
        return counted.where(_sum(found) > 0).select("segment", "ordinal", score)

    def _in_windows(self, words: Sequence[str], windows: DataFrame) -> DataFrame:
        """Blocks of the words in some windows."""
        hits = self._hits(words)
        listed = windows.select("segment", "at").limit(NAMED_WINDOWS + 1).collect()
        if len(listed) > NAMED_WINDOWS:
            return hits.join(windows.select("segment", "at"), ["segment", "at"], "left_semi")
        named: dict[int, list[int]] = {}
        for row in listed:
            named.setdefault(row.segment, []).append(row["at"])
        # The plain list of windows reaches the scan.
        chosen = F.lit(False)
        for segment, places in named.items():
            chosen = chosen | ((F.col("segment") == segment) & F.col("at").isin(places))
        return hits.where(chosen & F.col("at").isin(sorted({row["at"] for row in listed})))

    def needed(
        self, units: Sequence[Sequence[str]], known: Statistics, k: int, k1: float = search.K1, b: float = search.B
    ) -> tuple[DataFrame, float]:
        """The windows that may hold one of the k best chunks, and the k-th best score found so far."""
        words = _terms(units)
        bounds = self.bounds(units, known, k1, b).persist()
        try:
            every, most = bounds.count(), max(2, -(-2 * k // self.window))
            while True:
                first = bounds.orderBy(F.desc("bound"), "segment", "at").limit(most)
                best = self._scored(self._in_windows(words, first), units, known, k1, b).select("bm25")
                row = best.orderBy(F.desc("bm25")).limit(k).agg(F.count("bm25").alias("n"), F.min("bm25").alias("low")).first()
                reached = row.low if row.n == k else 0.0
                # Scores are rounded, bounds are not.
                needed = bounds.where(F.col("bound") >= reached - 10.0**-search.SCORE_DIGITS)
                if most >= every or (row.n == k and needed.count() <= 2 * most):
                    return needed, reached
                most *= 4
        finally:
            bounds.unpersist()

    def top(
        self, terms: Sequence[str], k: int, k1: float = search.K1, b: float = search.B
    ) -> DataFrame:
        """The k best chunks by BM25 (terms as of `search.query_terms`), ties by key."""
        units = [term.split() for term in terms if term.split()]
        if not units or not self.segments:
            return self.live().select(*self.key, F.lit(None).cast("double").alias("bm25")).where("false")
        known = self._statistics(units)
        windows, reached = self.needed(units, known, k, k1, b)
        scored = self._scored(self._in_windows(_terms(units), windows), units, known, k1, b)
        scored = scored.where(F.col("bm25") >= reached)
        docs = self._of_segments("docs").select("segment", "ordinal", *self.key)
        named = docs.join(scored, ["segment", "ordinal"])
        return named.select(*self.key, "bm25").orderBy(F.desc("bm25"), *self.key).limit(k)
