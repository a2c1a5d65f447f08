"""What the operators of this subpackage share: tables, the shared folder, words as numbers.

Words are 64-bit fingerprints. They come from one polynomial over the bytes of a word and a
final mix, computed for a whole block of texts at once. Two different words share a
fingerprint with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one vectorised step holds at a time.
BLOCK_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether a document belongs to the fold that nothing is learned from."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(fold == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares; a temporary one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there; this cuts the lineage."""
    folder = shared_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a fixed bijection)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_A
    values = (values ^ (values >> np.uint64(27))) * _MIX_B
    return values ^ (values >> np.uint64(31))


def _byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for first, last in separators:
        inside[first : last + 1] = False
    return inside


#: Bytes of words between white space, and of words of letters, digits and non-ASCII characters.
SPACED = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
PLAIN = _byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (one more offset than rows)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    count = len(column)
    if not count:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + count + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def blocks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most BLOCK_BYTES of text, or one row."""
    _, offsets = text_buffers(batch.column(text))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield batch.slice(first, last - first)
        first = last


def carried(docs: DataFrame, text: str, keep: tuple[str, ...] | None, *more: Column) -> DataFrame:
    """Rows as struct `row` for a Python stage; named columns only, with the text beside them, and what else is given.

    Without names the whole row travels, text included, and comes back.
    """
    if keep is None:
        return docs.select(F.struct("*").alias("row"), *more)
    return docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"), *more)


def with_text(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    """A batch of carried rows as columns row and text."""
    held = "text" in batch.schema.names
    content = batch.column("text") if held else batch.column("row").field(text)
    return pa.RecordBatch.from_arrays([batch.column("row"), content], ["row", "text"])


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    member = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = member[1:] != member[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True  # a word never crosses rows
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = member[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def word_prints(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True
) -> np.ndarray:
    """A fingerprint of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    source = place + np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    letters = _LOWER[data[source]] if lower else data[source]
    terms = (letters.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, before) + lengths.astype(np.uint64))


def words(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a column, lower-cased, and each row's first word."""
    data, offsets = text_buffers(column)
    starts, ends, rows = word_spans(data, offsets, inside)
    return word_prints(data, starts, ends), rows


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit fingerprints as Spark's long."""
    return values.view(np.int64)


# --- fixed-size counts over all rows --------------------------------------------------------

#: Cells of a count sketch and of the blocks it travels in; they do not grow with the input.
SKETCH_BITS, BLOCK_BITS = 22, 14

SKETCH_SCHEMA = "block int, packed binary"


def sketch_cells(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max() < 256 else np.int64
    raw = counts.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    kind = np.uint8 if packed[0] == 1 else np.int64
    raw = pa.decompress(packed[1:], packed[0] << BLOCK_BITS, codec="zstd", asbytes=True)
    return np.frombuffer(raw, kind)


def sketch_rows(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The non-empty blocks of one task's sketch, packed, for `collect_ranks` to add up."""
    parts = counts.reshape(-1, 1 << BLOCK_BITS)
    numbers = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), pa.array([_pack(parts[n]) for n in numbers], pa.binary())],
        ["block", "packed"],
    )


def whole_blocks(size: int) -> int:
    """The size rounded up to whole blocks."""
    return -(-size // (1 << BLOCK_BITS)) << BLOCK_BITS


def collect_counts(frame: DataFrame, size: int) -> np.ndarray:
    """Add all tasks' counts of a table of fixed size block by block."""
    result = np.zeros((whole_blocks(size) >> BLOCK_BITS, 1 << BLOCK_BITS), np.int64)
    for row in _added(frame, _pack).toLocalIterator():
        result[row.block] = _unpack(bytes(row.packed))
    return result.ravel()[:size]


def collect_ranks(frame: DataFrame) -> np.ndarray:
    """Add all tasks' sketches block by block; each cell's count as a rank from 0 to 255.

    The driver gets one byte for each cell. A rank is the count on a logarithmic scale.
    """

    def ranks(total: np.ndarray) -> bytes:
        return np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8).tobytes()

    result = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for row in _added(frame, ranks).collect():
        result[row.block] = np.frombuffer(bytes(row.packed), np.uint8)
    return result.ravel()


def _added(frame: DataFrame, pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """The sum of each block over all tasks, packed."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                total += _unpack(packed.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())],
            ["block", "packed"],
        )

    return frame.groupBy("block").applyInArrow(add, SKETCH_SCHEMA)
