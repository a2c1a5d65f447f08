"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task cuts its documents into shards of bounded size. Words that no benchmark item holds
cannot be part of a match, so a shard keeps only runs of benchmark words that are long enough,
sorts the suffixes of these runs (prefix doubling, to the depth of the longest item) and
binary-searches every benchmark suffix in them. That gives the longest verbatim matches with
their places, and all places of every window. Work is local to the rows: nothing is shuffled.

Benchmark items travel to the tasks in blocks of at most `block_bytes` of text, one pass over
the same rows for each block, so no broadcast grows without a bound.

Defined results: a null or empty document has no words and no hits; a null, empty or wordless
item has no windows; a null item_id counts for hits but is in no list; repeated rows each get
the same result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioscope.llm import common

#: Words in a window.
WINDOW = 10
#: Text of benchmark items that one pass holds.
BLOCK_BYTES = 32 << 20

_MATCH = (
    T.StructType().add("item_id", T.LongType()).add("item_start", T.IntegerType())
    .add("doc_start", T.IntegerType()).add("length", T.IntegerType())
)
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("matches", T.ArrayType(_MATCH)),
    ]
)


class Items:
    """The words of a block of benchmark items as small numbers, with windows and suffixes."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        prints, rows = common.words(pa.array(texts, pa.string()), common.PLAIN)
        self.ids = ids
        self.vocabulary = np.unique(prints)
        self.words = np.searchsorted(self.vocabulary, prints).astype(np.int64) + 1
        sizes = np.diff(rows)
        self.depth = int(sizes.max(initial=0))
        item = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(prints)) - rows[:-1][item]
        self.item, self.place, self.left = item, place, sizes[item] - place
        short = sizes[item] < window
        starts = np.flatnonzero(np.where(short, place == 0, self.left >= window))
        lengths = np.minimum(window, self.left[starts])
        self.shortest = int(lengths.min(initial=window))
        # Equal windows are searched once; `owners` lists the items of each.
        keys: dict[bytes, int] = {}
        self.owners: list[set[int]] = []
        first = []
        for start, length in zip(starts, lengths):
            key = self.words[start : start + length].tobytes()
            if key not in keys:
                keys[key] = len(keys)
                first.append((start, length))
                self.owners.append(set())
            self.owners[keys[key]].add(int(item[start]))
        self.windows = np.array(first, np.int64).reshape(-1, 2)


def suffix_order(sequence: np.ndarray, run_left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared up to `depth` words or the run's end."""
    _, rank = np.unique(sequence, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step, count = 1, len(sequence)
    while step < depth and rank.max(initial=0) < count:
        second = np.zeros(count, np.int64)
        ahead = np.flatnonzero(run_left > step)
        second[ahead] = rank[ahead + step]
        _, rank = np.unique(rank * (count + 2) + second, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def _common(
    sequence: np.ndarray, run_left: np.ndarray, at: np.ndarray,
    wanted: np.ndarray, start: np.ndarray, length: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Words that text at `at` shares with each query, and the order of the text to the query."""
    shared = np.zeros(len(at), np.int64)
    order = np.zeros(len(at), np.int64)
    going = np.arange(len(at))
    while len(going):
        going = going[shared[going] < length[going]]
        step = shared[going]
        inside = step < run_left[at[going]]
        have = np.where(inside, sequence[np.minimum(at[going] + step, len(sequence) - 1)], 0)
        want = wanted[start[going] + step]
        order[going] = np.sign(have - want)
        going = going[have == want]
        shared[going] += 1
    return shared, order


def search(
    sequence: np.ndarray, run_left: np.ndarray, suffixes: np.ndarray,
    wanted: np.ndarray, start: np.ndarray, length: np.ndarray, after: bool,
) -> np.ndarray:
    """Binary search: how many suffixes come before each query (or, `after`, not behind it)."""
    low = np.zeros(len(start), np.int64)
    high = np.full(len(start), len(suffixes), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        _, order = _common(
            sequence, run_left, suffixes[middle], wanted, start[open_], length[open_]
        )
        right = (order <= 0) if after else (order < 0)
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and which range it is from."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(int(sizes.sum())) - (np.cumsum(sizes) - sizes)[owner] + low[owner], owner


def match_shard(column: pa.Array, items: Items, window: int) -> list[tuple]:
    """For each row its words, the ranges of hit words, the items and the longest matches."""
    prints, rows = common.words(column, common.PLAIN)
    sizes = np.diff(rows)
    hits: list[list] = [[] for _ in sizes]
    found: list[set] = [set() for _ in sizes]
    matches: list[list] = [[] for _ in sizes]
    if len(prints) and len(items.windows):
        where = np.searchsorted(items.vocabulary, prints)
        where[where == len(items.vocabulary)] = 0
        word = np.where(items.vocabulary[where] == prints, where + 1, 0).astype(np.int64)
        # Runs of benchmark words inside one document.
        border = np.zeros(len(word) + 1, dtype=bool)
        border[rows] = border[0] = border[-1] = True
        border[:-1] |= word == 0
        border[1:] |= word == 0
        cuts = np.flatnonzero(border)
        first, last = cuts[:-1], cuts[1:]
        keep = (word[first] > 0) & (last - first >= items.shortest)
        position, _ = _spread(first[keep], last[keep])
        if len(position):
            left = np.repeat(last[keep], (last - first)[keep]) - position
            sequence = word[position]
            suffixes = suffix_order(sequence, left, items.depth)
            start, length = items.windows.T
            low, high = (
                search(sequence, left, suffixes, items.words, start, length, after)
                for after in (False, True)
            )
            place, owner = _spread(low, high)
            begin = position[suffixes[place]]
            change = np.zeros(len(word) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + length[owner], -1)
            covered = np.cumsum(change)[:-1] > 0
            row = np.searchsorted(rows, begin, "right") - 1
            for r, o in np.unique(np.stack([row, owner], 1), axis=0) if len(row) else ():
                found[r] |= items.owners[o]
            edge = np.zeros(len(word) + 1, dtype=bool)
            edge[1:-1] = covered[1:] != covered[:-1]
            edge[rows] = edge[0] = edge[-1] = True
            cuts = np.flatnonzero(edge)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if covered[a]:
                    r = int(np.searchsorted(rows, a, "right")) - 1
                    hits[r].append([int(a - rows[r]), int(b - rows[r])])
            for r, at, query, size in _longest(sequence, left, suffixes, position, word, rows, items):
                matches[r].append((items.ids[items.item[query]], int(items.place[query]), at, size))
    return [
        (int(n), h, sorted({items.ids[i] for i in f} - {None}), m)
        for n, h, f, m in zip(sizes, hits, found, matches)
    ]


def _longest(sequence, left, suffixes, position, word, rows, items: Items) -> Iterator[tuple]:
    """All places of the longest match of every benchmark suffix, where it cannot start earlier."""
    start = np.flatnonzero(items.left >= items.shortest)
    length = items.left[start]
    spot = search(sequence, left, suffixes, items.words, start, length, False)
    best = np.zeros(len(start), np.int64)
    for near in (spot - 1, spot):
        at = suffixes[np.clip(near, 0, len(suffixes) - 1)]
        shared, _ = _common(sequence, left, at, items.words, start, length)
        best = np.maximum(best, np.where((near >= 0) & (near < len(suffixes)), shared, 0))
    keep = best >= items.shortest
    start, best = start[keep], best[keep]
    low, high = (
        search(sequence, left, suffixes, items.words, start, best, after) for after in (False, True)
    )
    place, owner = _spread(low, high)
    begin = position[suffixes[place]]
    row = np.searchsorted(rows, begin, "right") - 1
    query = start[owner]
    earlier = (items.place[query] > 0) & (begin > rows[row])
    earlier &= word[np.maximum(begin - 1, 0)] == items.words[np.maximum(query - 1, 0)]
    for r, b, q, size in zip(row[~earlier], begin[~earlier], query[~earlier], best[owner][~earlier]):
        yield int(r), int(b - rows[r]), int(q), int(size)


def item_blocks(
    benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", text: str = "text"
) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded text; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        if texts and size + len(row.t) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t)
    yield ids, texts


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Every row as struct `row` with n_words, n_hit, hit ranges, items and longest matches.

    `keep` names the columns that `row` holds, by default all.
    """
    context = docs.sparkSession.sparkContext
    frame = common.carried(docs, text, keep)
    row = frame.schema["row"]
    blocks = item_blocks(benchmark, block_bytes)
    block, number = next(blocks), 0
    while block is not None:
        following = next(blocks, None)
        sent = context.broadcast(Items(*block, window))
        # Between two passes the text stays beside the named columns.
        beside = ["text"] if keep is not None and following is not None else []

        def match(batches, sent=sent, more=number > 0, beside=beside):
            items = sent.value
            for batch in batches:
                at = 0
                for part in common.blocks(common.with_text(batch, text), "text"):
                    results = match_shard(part.column("text"), items, window)
                    if more:
                        before = batch.slice(at, part.num_rows).to_pylist()
                        results = [_joined(x, y) for x, y in zip(before, results)]
                    at += part.num_rows
                    columns = list(zip(*results))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in ("row", *beside)]
                        + [pa.array(list(c), t) for c, t in zip(columns, _arrow_types())],
                        ["row", *beside, *_FOUND.names],
                    )

        fields = [row, *(T.StructField(c, T.StringType()) for c in beside), *_FOUND.fields]
        frame = frame.mapInArrow(match, T.StructType(fields))
        block, number = following, number + 1
    size = F.aggregate("hit", F.lit(0).cast("long"), lambda a, h: a + h[1] - h[0])
    return frame.withColumn("n_hit", size)


def _joined(before: dict, now: tuple) -> tuple:
    """The results of an earlier block with those of the next."""
    merged: list[list[int]] = []
    for a, b in sorted([*before["hit"], *now[1]]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    matches = [(m["item_id"], m["item_start"], m["doc_start"], m["length"]) for m in before["matches"]]
    return now[0], merged, sorted({*before["items"], *now[2]}), [*matches, *now[3]]


def _arrow_types() -> list[pa.DataType]:
    match = pa.struct(
        [("item_id", pa.int64()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]
    )
    return [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.list_(match)]


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return find_matches(docs, benchmark, text).where("n_hit = 0").select("row.*")
