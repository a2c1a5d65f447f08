"""Periodic runs of words: Lyndon arrays by grouping suffixes, Lyndon roots extended into runs.

1. The suffixes of a word sequence are grouped by their first word and the groups refined from
   the highest down (the first phase of Baier's suffix sorter). When a group is taken, each of
   its suffixes hands its group's context to the nearest lower suffix on its left. In the end a
   suffix's group has the longest Lyndon word that starts there as its context, so the sizes of
   the contexts are the Lyndon array. This is done under an order of the words and its reverse.
2. Every run holds a Lyndon root: a Lyndon word of one of the two arrays with the run's smallest
   period as its length. So each entry (start, length) of both arrays is extended as far as the
   period holds, by longest common extensions (LCE) to the right and to the left: binary searches
   over prefix fingerprints, for all entries of a block of texts at once. Each run is then
   compared word by word; if a fingerprint misled, that run is extended word by word.
3. A run of `exponent` periods or more repeats each of its short n-grams inside the text. Stretches
   of words without a repeated n-gram hold no run and are left out before step 1; that is exact,
   as a run and every word that could prolong it lie in one stretch.

A text is one row and is worked on whole by one task; the memory of a step grows with the longest
text, not with the table.

Defined results: words end at ASCII white space and keep their case; null, empty and blank texts
have no words and no runs; repeated rows are worked on one by one; ties of the longest run go to
the smallest start, then the smallest period; rows come back as struct `row`, whatever their other
columns are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm import common

#: Two primes below 2**31 and the bases of the prefix fingerprints.
_PRIMES = ((2147483629, 1103515245), (2147483587, 1220703125))

SCHEMA = (
    "n_words long, n_runs long, start long, length long, period long, "
    "runs_sha256 string, collapsed_sha256 string"
)

#: For the number of a text's words, the place in the text that each word is taken from.
Places = Callable[[object, int], "np.ndarray | None"]


def lyndon_array(ranks: list[int]) -> list[int]:
    """For every place the length of the longest Lyndon word that starts there.

    `ranks` are numbers in the order of the words. The groups are a list from high to low;
    `before` and `after` link the suffixes whose group is not taken yet.
    """
    n = len(ranks)
    first: dict[int, list[int]] = {}
    for place, rank in enumerate(ranks):
        first.setdefault(rank, []).append(place)
    members = [first[rank] for rank in sorted(first)]
    size = [1] * len(members)
    lower = list(range(-1, len(members) - 1))
    higher = list(range(1, len(members) + 1))
    group = [0] * n
    for number, places in enumerate(members):
        for place in places:
            group[place] = number
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    current = len(members) - 1
    while current >= 0:
        context = size[current]
        # Members ascend, and so do the lower suffixes on their left.
        given: dict[int, int] = {}
        for place in members[current]:
            if group[place] != current:
                continue  # it went to a higher group, which has been taken
            left, right = before[place], after[place]
            if right < n:
                before[right] = left
            if left >= 0:
                after[left] = right
                given[left] = given.get(left, 0) + 1
        grown: dict[tuple[int, int], list[int]] = {}
        for left, times in given.items():
            grown.setdefault((times, group[left]), []).append(left)
        # More copies of the context are higher: they go above their old group first.
        for times, old in sorted(grown, reverse=True):
            number, top = len(members), higher[old]
            moved = grown[times, old]
            members.append(moved)
            size.append(size[old] + times * context)
            lower.append(old)
            higher.append(top)
            lower[top] = higher[old] = number
            for left in moved:
                group[left] = number
        current = lower[current]
    return [size[number] for number in group]


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1) modulo a prime, by doubling."""
    powers = np.ones(max(count, 1), np.int64)
    done, step = 1, base
    while done < count:
        more = min(done, count - done)
        powers[done : done + more] = powers[:more] * step % prime
        done, step = done + more, step * step % prime
    return powers


class Extensions:
    """Longest common extensions of pairs of places of one sequence of numbers."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for base, prime in _PRIMES:
            powers = _powers(base, prime, len(ids) + 1)
            terms = (ids.astype(np.int64) + 1) % prime * powers[:-1] % prime
            sums = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(terms, out=sums[1:])  # under 2**63 for 2**32 words
            self.sums.append(sums)
            self.powers.append(powers)

    def _equal(self, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from two places (one < other) have one fingerprint."""
        same = np.ones(len(one), bool)
        for (_, prime), sums, powers in zip(_PRIMES, self.sums, self.powers):
            low = (sums[one + length] - sums[one]) % prime * powers[other - one] % prime
            same &= low == (sums[other + length] - sums[other]) % prime
        return same

    def right(self, one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from two places on are equal, at most `most`."""
        return self._search(lambda k, at: self._equal(one[at], other[at], k), most)

    def left(self, one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before two places are equal, at most `most`."""
        return self._search(lambda k, at: self._equal(one[at] - k, other[at] - k, k), most)

    @staticmethod
    def _search(equal: Callable[[np.ndarray, np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while True:
            at = np.flatnonzero(low < high)
            if not len(at):
                return low
            middle = (low[at] + high[at] + 1) // 2
            same = equal(middle, at)
            low[at[same]] = middle[same]
            high[at[~same]] = middle[~same] - 1


def find_runs(
    ids: np.ndarray, edges: np.ndarray, exponent: int = 4, shortest: int = 6
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of several sequences laid end to end: starts, lengths and smallest periods.

    `edges` holds where each sequence starts, and the end of the last. A run is `exponent` (2 or
    more) periods and `shortest` words long at least, lies in one sequence and cannot be prolonged.
    """
    places, periods = [], []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        order = ids[begin:end].tolist()
        for ranks in (order, [-rank for rank in order]):
            sizes = np.array(lyndon_array(ranks), np.int64)
            fits = np.flatnonzero(sizes * exponent <= end - begin)
            places.append(fits + begin)
            periods.append(sizes[fits])
    if not places:
        none = np.zeros(0, np.int64)
        return none, none, none
    keys = np.unique((np.concatenate(places) << 32) + np.concatenate(periods))
    place, period = keys >> 32, keys & ((1 << 32) - 1)
    sequence = np.searchsorted(edges, place, "right") - 1
    begin, end = edges[sequence], edges[sequence + 1]
    extend = Extensions(ids)
    following = place + period
    start = place - extend.left(place, following, place - begin)
    stop = following + extend.right(place, following, end - following)
    whole = stop - start >= np.maximum(exponent * period, shortest)
    roots: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    for entry in zip(*(column[whole].tolist() for column in (start, period, stop, place, begin, end))):
        roots.setdefault(entry[:3], []).append(entry[3:])
    found = set()
    for (first, p, last), entries in roots.items():
        if np.array_equal(ids[first : last - p], ids[first + p : last]):
            found.add((first, p, last - first))
        else:
            found.update(_word_by_word(ids, p, *entry) for entry in entries)
    kept = sorted(run for run in found if run[2] >= max(exponent * run[1], shortest))
    first, p, size = np.array(kept, np.int64).reshape(-1, 3).T
    return first, size, p


def _word_by_word(ids: np.ndarray, period: int, place: int, begin: int, end: int) -> tuple[int, int, int]:
    """A root's start, period and length where a fingerprint was not to be trusted."""
    start, stop = place, place + period
    while start > begin and ids[start - 1] == ids[start - 1 + period]:
        start -= 1
    while stop < end and ids[stop] == ids[stop - period]:
        stop += 1
    return start, period, stop - start


def repeating_stretches(
    prints: np.ndarray, rows: np.ndarray, exponent: int = 4, shortest: int = 6
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold runs, over all texts of a block.

    In a run of `exponent` periods an n-gram of exponent - 1 words occurs again after a period or
    stood there a period before, so every word of a run is in an n-gram that its text repeats.
    """
    n = max(exponent - 1, 1)
    if len(prints) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    last = len(prints) - n + 1
    grams = row[:last].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        grams = common.mix(grams + prints[k : k + last])
    grams = grams[row[:last] == row[n - 1 :]]
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    order = np.argsort(grams)
    equal = grams[order][1:] == grams[order][:-1]
    repeated = np.zeros(len(grams), bool)
    repeated[order[1:][equal]] = repeated[order[:-1][equal]] = True
    change = np.zeros(len(prints) + 1, np.int64)
    np.add.at(change, at[repeated], 1)
    np.add.at(change, at[repeated] + n, -1)
    inside = np.cumsum(change)[:-1] > 0
    edge = np.ones(len(prints) + 1, bool)
    edge[1:-1] = (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    held = inside[starts] & (ends - starts >= shortest)
    return starts[held], ends[held]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _read(
    texts: pa.Array, keys: list[object], places: Places | None, exponent: int, shortest: int
) -> list[list[object]]:
    """The result columns of a block of texts."""
    data, offsets = common.text_buffers(texts)
    starts, ends, rows = common.word_spans(data, offsets, common.SPACED)
    prints = common.word_prints(data, starts, ends, lower=False)
    raw = data.tobytes()
    split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    for k, key in enumerate(keys if places else []):
        taken = places(key, len(split[k])) if split[k] else None
        if taken is not None:
            prints[rows[k] : rows[k + 1]] = prints[rows[k] : rows[k + 1]][taken]
            split[k] = [split[k][place] for place in taken.tolist()]
    low, high = repeating_stretches(prints, rows, exponent, shortest)
    owner = np.searchsorted(rows, low, "right") - 1
    ids, edges, known = [], [0], {}
    for k, a, b in zip(owner.tolist(), low.tolist(), high.tolist()):
        # Numbers of the words themselves, so equal numbers are equal words.
        ids.append([known.setdefault(word, len(known)) for word in split[k][a - rows[k] : b - rows[k]]])
        edges.append(edges[-1] + b - a)
    laid = np.array([word for part in ids for word in part], np.int64)
    start, length, period = find_runs(laid, np.array(edges, np.int64), exponent, shortest)
    stretch = np.searchsorted(edges, start, "right") - 1
    of = owner[stretch]
    start = start - np.array(edges)[stretch] + low[stretch] - rows[of]
    borders = np.searchsorted(of, np.arange(len(split) + 1))
    result = []
    for k, words in enumerate(split):
        first, last = int(borders[k]), int(borders[k + 1])
        held = sorted(zip(start[first:last].tolist(), period[first:last].tolist(), length[first:last].tolist()))
        listed = "".join(f"{s},{n},{p}\n" for s, p, n in held)
        if held:
            drop = np.zeros(len(words) + 1, np.int64)
            for s, p, n in held:
                drop[s + p] += 1
                drop[s + n] -= 1
            kept = [word for word, out in zip(words, np.cumsum(drop).tolist()) if not out]
            s, p, n = max(held, key=lambda run: (run[2], -run[0], -run[1]))
        else:
            kept, s, p, n = words, None, None, None
        result.append([len(words), len(held), s, n, p, _digest(listed.encode()), _digest(b" ".join(kept))])
    return result


def collapse(
    docs: DataFrame,
    text: str = "text",
    key: str | None = None,
    places: Places | None = None,
    exponent: int = 4,
    shortest: int = 6,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Each row as struct `row` with its runs and a digest of the text without repetitions.

    n_words and n_runs; start, length and period of the longest run; digests of all runs (lines
    `start,length,period` by start and period) and of the words that no run holds after its first
    period. `places(value of column key, number of words)` may rearrange a text's words first.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    names = ["row", *(field.split()[0] for field in SCHEMA.split(", "))]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    source = common.carried(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(common.with_text(batch, text), "text"):
                keys = part.column("row").field(key).to_pylist() if key else [None] * part.num_rows
                found = _read(part.column("text"), keys, places, exponent, shortest)
                columns = [pa.array(column, kind) for column, kind in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names)

    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(run, f"row {row}, {SCHEMA}")


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The places of the query's texts: a tenth of them end in a repetition fixed by the id."""
    number = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if number % 10 or not n:
        return None
    g = number // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    taken = np.arange(n)
    taken[start:] = start + (taken[start:] - start) % period
    return taken
