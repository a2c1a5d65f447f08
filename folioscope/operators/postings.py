"""A persisted inverted index for repeated word searches.

A block is one word in some chunks that were read together: their numbers, lengths and the word's
positions in them. Tasks write the blocks of their own chunks in runs sorted by bucket and word, so
postings are neither shuffled nor sorted as rows, and a search reads the pages that may hold the
words of the query. Keys, lengths and numbers of the chunks are rows of the same files (`chunk`,
null in a block), made in the same pass, so words are written nowhere but in blocks; they give names
and totals of any scope.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioscope.functions import text as text_fn
from folioscope.operators import search
from folioscope.session import ship_package
from folioscope.sources.work import stored

BUCKETS = 64


@dataclass
class WordIndex:
    """The tables of an index, its chunk key and the bucket count it was written with.

    `lengths` has the chunks that a search may find, `postings` maybe those of more.
    """

    postings: DataFrame
    lengths: DataFrame
    key: list[str]
    buckets: int

    def within(self, contents: DataFrame) -> WordIndex:
        """The index of the chunks of some contents."""
        kept = contents.select("content_id").distinct()
        lengths = self.lengths.join(kept, "content_id", "left_semi")
        return WordIndex(self.postings, lengths, self.key, self.buckets)


def word_bucket(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.encode(word, "UTF-8")), F.lit(buckets)).cast("int")


#: Words that are grouped at a time, which bounds the memory of a task.
GROUPED = 2_000_000
BLOCKS = (
    "word string, at long, n long, most int, shortest long, "
    "entries array<struct<ordinal:long,length:long,positions:array<int>>>, bucket int"
)

_POSITIONS = pa.list_(pa.int32())
_ENTRY = pa.struct([("ordinal", pa.int64()), ("length", pa.int64()), ("positions", _POSITIONS)])
_BLOCK_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(_ENTRY), pa.int32())


def _grouped(part: pa.RecordBatch, window: int | None, buckets: int) -> pa.RecordBatch:
    """The blocks of some chunks, ordered by bucket, word and window."""
    held = part.column("words")
    starts = held.offsets.to_numpy()
    coded = held.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.array([zlib.crc32(name.encode()) % buckets for name in names], np.int32)
    # Numbers of words in the order of the run.
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda i: (hashed[i], names[i]))] = np.arange(len(names))
    word = place[coded.indices.to_numpy()]
    row = np.repeat(np.arange(part.num_rows), np.diff(starts))
    position = np.arange(len(row)) + starts[0] - starts[row]
    order = np.argsort(word, kind="stable")
    word, row, position = word[order], row[order], position[order].astype(np.int32)
    ordinal = part.column("ordinal").to_numpy()
    at = ordinal // window if window else np.zeros(len(ordinal), np.int64)
    length = part.column("length").to_numpy()

    def changes(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.flatnonzero(new)

    entry = changes(word, row)  # one word in one chunk
    size = np.diff(np.append(entry, len(word)))
    owner, said = row[entry], word[entry]
    block = changes(said, at[owner])
    ends = np.append(block, len(entry)).astype(np.int32)
    positions = pa.ListArray.from_arrays(np.append(entry, len(word)).astype(np.int32), position)
    entries = pa.StructArray.from_arrays(
        [pa.array(ordinal[owner]), pa.array(length[owner]), positions], ["ordinal", "length", "positions"]
    )
    back = np.argsort(place)[said[block]]
    columns = {
        "word": pa.array(names, pa.string()).take(pa.array(back)),
        "at": pa.array(at[owner[block]]),
        "n": pa.array(np.diff(ends).astype(np.int64)),
        "most": pa.array(np.maximum.reduceat(size, block).astype(np.int32)),
        "shortest": pa.array(np.minimum.reduceat(length[owner], block)),
        "entries": pa.ListArray.from_arrays(ends, entries),
        "bucket": pa.array(hashed[back]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def word_blocks(
    docs: DataFrame, buckets: int = BUCKETS, window: int | None = None, name: str | None = None
) -> DataFrame:
    """A row per word and group of chunks (ordinal, length, words) that a task reads together, or
    per word and window of ordinals in such a group. A struct column to ``name`` the chunks gives a
    row per chunk beside them."""
    blocks = T.StructType.fromDDL(BLOCKS)
    shape = blocks if name is None else T.StructType([*blocks.fields, T.StructField(name, docs.schema[name].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").offsets.to_numpy()
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(words, words[first] + GROUPED, "right")) - 1
                part = batch.slice(first, max(1, last - first))
                first += part.num_rows
                if name is not None:
                    named = part.column(name)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.nulls(part.num_rows, kind) for kind in _BLOCK_TYPES], named], shape.names
                    )
                if len(part.column("words").flatten()):
                    found = _grouped(part, window, buckets)
                    if name is not None:
                        found = found.append_column(name, pa.nulls(found.num_rows, named.type))
                    yield found

    ship_package(docs.sparkSession)
    read = ["ordinal", "length", "words", *([] if name is None else [name])]
    return docs.select(*read).mapInArrow(run, shape)


def numbered(chunks: DataFrame, key: Sequence[str], dealt: bool = True) -> DataFrame:
    """Chunks with their words and a number; texts are dealt out, which takes less than their words."""
    dealt = chunks.select(*key, "content").repartition(*key) if dealt else chunks.select(*key, "content")
    words = dealt.select(*key, text_fn.code_words(F.col("content")).alias("words"))
    length = F.size("words").cast("long")
    return words.select(*key, length.alias("length"), "words", F.monotonically_increasing_id().alias("ordinal"))


def postings(chunks: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Where every word of the chunks occurs."""
    return word_blocks(numbered(chunks, key), buckets)


def write_index(chunks: DataFrame, key: Sequence[str], folder: str, buckets: int = BUCKETS) -> None:
    """Write the postings of the chunks, as they are dealt out, in runs by word bucket and word."""
    named = numbered(chunks, key, dealt=False).withColumn("chunk", F.struct(*key, "length", "ordinal"))
    blocks = word_blocks(named, buckets, name="chunk")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/postings")
    made = chunks.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(",".join(key)).alias("key"))
    made.write.mode("overwrite").parquet(f"{folder}/about")


def read_index(spark: SparkSession, folder: str) -> WordIndex:
    about = spark.read.parquet(f"{folder}/about").first()
    chunks = spark.read.parquet(f"{folder}/postings").where("chunk is not null")
    return WordIndex(
        spark.read.schema(BLOCKS).parquet(f"{folder}/postings").where("bucket is not null"),
        chunks.select("chunk.*"), about["key"].split(","), about["buckets"],
    )


def _earlier(places: Column, step: int) -> Column:
    return F.transform(places, lambda p: p - step)


def unit_count(places: Column, words: Sequence[str]) -> Column:
    """How often the words follow each other, from their positions in a chunk."""
    first = F.try_element_at(places, F.lit(words[0]))
    for step, word in enumerate(words[1:], 1):
        there = F.coalesce(F.try_element_at(places, F.lit(word)), F.array().cast("array<int>"))
        first = F.array_intersect(first, _earlier(there, step))
    return F.coalesce(F.size(first), F.lit(0)).cast("long")


def score_postings(
    index: WordIndex, terms: Sequence[str], k1: float = search.K1, b: float = search.B
) -> DataFrame:
    """BM25 of every chunk that holds a search unit (as of `search.query_terms`), from postings."""
    units = [t.split() for t in terms]
    words = sorted({w for u in units for w in u})
    spark = index.postings.sparkSession
    if not units:
        return index.lengths.select(*index.key, F.lit(None).cast("double").alias("bm25")).where("false")
    numbers = spark.range(1).select(
        F.array(*[word_bucket(F.lit(w), index.buckets) for w in words]).alias("b")
    ).first()["b"]
    hits = index.postings.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("word").isin(words))
    each = hits.select("word", F.explode("entries").alias("e"))
    # A group has at most one row for each word of the query.
    places = F.map_from_entries(F.collect_list(F.struct("word", "e.positions")))
    held = each.groupBy(F.col("e.ordinal").alias("ordinal")).agg(places.alias("places"))
    counts = held.select("ordinal", *[unit_count(F.col("places"), u).alias(f"tf{i}") for i, u in enumerate(units)])
    some = [F.col(f"tf{i}") > 0 for i in range(len(units))]
    # Statistics and scores read the same counts.
    counted = stored(
        counts.where(reduce(or_, some)).join(index.lengths, "ordinal").select(*index.key, "length", *counts.columns[1:]),
        "counts",
    )
    found = [F.col(f"tf{i}") for i in range(len(units))]
    frequent = counted.agg(
        F.struct(*[F.count_if(tf > 0).alias(f"df{i}") for i, tf in enumerate(found)]).alias("d")
    ).select("d").scalar()
    totals = index.lengths.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).alias("s")
    ).select("s").scalar()
    scored = counted.withColumn("_d", frequent).withColumn("_s", totals)
    average = F.col("_s.total") / F.col("_s.n")
    parts = [
        search.idf(F.col("_s.n"), F.col(f"_d.df{i}")) * search.term_weight(tf, F.col("length"), average, k1, b)
        for i, tf in enumerate(found)
    ]
    return scored.select(*index.key, F.round(sum(parts[1:], parts[0]), search.SCORE_DIGITS).alias("bm25"))
