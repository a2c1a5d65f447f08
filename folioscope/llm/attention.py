"""LM scoring with a causal self-attention model on subword ids, trained with numpy and onnxruntime.

A text is its lower-cased words and an end; each word is cut into pieces by a public tokenizer.
The model predicts a piece in two steps. Self-attention over the last pieces predicts its class:
queries, keys and values of the pieces, a bias for each distance, a causal mask, one hidden
layer and a softmax over CLASSES clusters. Within a class the piece follows from the piece
before it, by counts of all training texts. The two factors multiply to a distribution over
all pieces. Every piece of the training texts has its own row, class and counts.

Pieces are numbered by frequency. Counts of pairs of the first KNOWN + 1 pieces are a table in
memory. All other pairs that occur are rows; the most frequent ones, at most HOT_WORDS, go to
every task and the others are joined.

Texts are scored in overlapping windows of WINDOW pieces that advance by half: the first half is
context, the second is scored, so every piece is scored once with at least half a window of
context (or all there is). All windows of a block are scored in one batch.

Passages come from one more part of the model. A passage ends behind one place in about PASSAGE, by
a hash of the last pieces, so equal stretches of texts are cut alike. All passages of the training
texts are counted, a table that grows with the texts. With the share of those that occur again
(`odds`), a passage is one of the other texts' passages, by their counts; otherwise the pieces'
model writes it. The two add up. A training text is scored without its own passages, so a text
that occurs twice stands apart from one that occurs once.

The base is the unigram of words. Word counts come from all training texts by one aggregation.
The most frequent words, at most HOT_WORDS, go to every task; the others are joined by their
fingerprint, so no word is a hot key and no document's words are gathered.

The training texts are cut into pieces once and stored so; all learning reads the pieces.

Everything is learned from all training texts. The classes follow from the counts of all
neighbouring pieces. The attention weights start from EPOCHS
passes over about SAMPLE_ROWS texts of at most SAMPLE_CHARS characters, by a hash of the id; from
there every task passes once over its share of all training texts, and the tasks' weights are
averaged by their numbers of pieces. So the weights depend a little on how the table is split.

Defined results: null and empty texts are one end token; without training texts the base is 0
and the model knows only uniform pieces; pieces in no training text share one symbol and get
equal shares of its probability; repeated rows are scored (and learned from) each; null
ids belong to the training texts; other columns stay, in struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from folioscope.llm import common
from folioscope.llm.common import stored

SAMPLE_ROWS, SAMPLE_CHARS = 1600, 20_000
HOT_WORDS = 1_000_000
#: The fold whose texts are held out: crc32(id) mod 5.
HELD_OUT = 1

#: KNOWN is the number of the last piece whose pairs are counted in a dense table.
KNOWN, CLASSES, WINDOW = 2047, 64, 32
HALF = WINDOW // 2
DIM, HIDDEN = 8, 24
EPOCHS, BATCH = 6, 512
#: Adam's rate in the pass over all texts, and the steps after which it has halved.
RATE, RATE_STEPS = 0.01, 100
#: Weight of a class's own distribution against the counts behind the piece before.
BACKOFF = 20.0

#: Numbers that tell a piece's neighbours, and rows of a table by piece that travel together.
REDUCED, TABLE_ROWS = 48, 256

#: A passage ends behind one place in PASSAGE (a power of two), by a hash of REACH pieces.
PASSAGE, REACH = 64, 4

#: Pieces that a step over cut texts holds, and counts of words or pairs that a task adds up before it sends them.
BLOCK_PIECES, MERGED = 1 << 20, 1_000_000

#: The end as a word fingerprint.
END = np.uint64(0x0E0DE0DE0DE0DE0D)


class Pieces:
    """Cuts words into pieces; remembers the pieces of a bounded number of words."""

    MEMORY = 1_000_000

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size, self.end = self.lib.get_piece_size(), self.lib.eos_id()
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.int32)
        self.clear()

    def clear(self) -> None:
        self.prints = np.zeros(0, np.uint64)
        self.spans = np.zeros((0, 2), np.int64)
        self.ids = np.zeros(0, np.int32)

    def of(self, prints: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in `ids` for distinct fingerprints; words(places) are the texts."""
        at = np.searchsorted(self.prints, prints)
        new = at == len(self.prints)
        new[~new] = self.prints[at[~new]] != prints[~new]
        fresh = np.flatnonzero(new)
        if len(fresh):
            if len(self.prints) + len(fresh) > self.MEMORY and len(self.prints):
                self.clear()
                return self.of(prints, words)
            lists = self.lib.encode(words(fresh), num_threads=1)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            # Pieces are appended; only the small index is sorted anew.
            starts = np.cumsum(sizes) - sizes + len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))])
            every = np.concatenate([self.prints, prints[fresh]])
            order = np.argsort(every, kind="stable")
            spans = np.stack([np.concatenate([self.spans[:, 0], starts]), np.concatenate([self.spans[:, 1], starts + sizes])], 1)
            self.prints, self.spans = every[order], spans[order]
            at = np.searchsorted(self.prints, prints)
        return self.spans[at, 0], self.spans[at, 1]


class Words:
    """Words of a block of texts and where the pieces of each distinct one stand."""

    def __init__(self, column: pa.Array, pieces: Pieces):
        data, offsets = common.text_buffers(column)
        starts, ends, rows = common.word_spans(data, offsets, common.SPACED)
        prints = common.word_prints(data, starts, ends)
        coded = pa.array(prints).dictionary_encode()
        self.unique, self.index, self.rows = coded.dictionary.to_numpy(), coded.indices.to_numpy(), rows
        first = np.empty(len(self.unique), np.int64)
        first[self.index] = np.arange(len(prints))  # any place of the word will do

        def words(places: np.ndarray) -> list[str]:
            lowered, some = common._LOWER[data].tobytes(), first[places]
            spans = zip(starts[some].tolist(), ends[some].tolist())
            return [lowered[a:b].decode("utf-8", "replace") for a, b in spans]

        self.low, high = pieces.of(self.unique, words)
        self.sizes = high - self.low


@dataclass
class Texts:
    """Pieces of a block of texts and where each text starts and ends in them."""

    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def known(self, index: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the pieces and of the piece before each in its text, the end before the first."""
        target = index[self.ids]
        before = np.empty_like(target)
        before[1:] = target[:-1]
        before[self.first] = index[end]
        return target, before


class Block(Words, Texts):
    """Words and pieces of a block of texts."""

    def __init__(self, column: pa.Array, pieces: Pieces):
        super().__init__(column, pieces)
        rows, sizes = self.rows, self.sizes[self.index]
        # Pieces of each text's words, then its end.
        before = np.concatenate([[0], np.cumsum(sizes)])
        self.first = before[rows[:-1]] + np.arange(len(rows) - 1)
        self.last = before[rows[1:]] + np.arange(1, len(rows))
        # The block is one more text's end longer with each row, so a word's pieces move by its row.
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        move = np.repeat(self.low[self.index] - before[:-1], sizes)
        place = np.arange(int(before[-1]))
        self.ids = np.full(len(place) + len(rows) - 1, pieces.end, np.int32)
        self.ids[place + np.repeat(row, sizes)] = pieces.ids[place + move]


def chunks(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half windows of texts: start, number of pieces, pieces before it in its text, text."""
    size = last - first
    count = -(-size // HALF)
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    start = first[text] + number * HALF
    return start, np.minimum(HALF, last[text] - start), number * HALF, text


def passages(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of texts: start, text, fingerprint."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = common.mix(np.arange(1, int(ids.max()) + 2, dtype=np.uint64)).take(ids)
    reach = mixed.copy()
    for k in range(1, REACH):
        reach[k:] += mixed[:-k] * np.uint64(2 * k + 1)
    ends = common.mix(reach) < np.uint64((1 << 64) // PASSAGE)
    for k in range(REACH - 1):  # what stands before a text has no say
        ends[(first + k).clip(0, len(ends) - 1)] = False
    ends[last - 1] = True
    stops = np.flatnonzero(ends) + 1
    starts = np.append(0, stops[:-1])
    size = stops - starts
    powers = np.cumprod(np.full(int(size.max()), common._BASE, np.uint64))
    terms = mixed * powers.take(np.arange(len(ids)) - np.repeat(starts, size))
    prints = common.mix(np.add.reduceat(terms, starts) + size.astype(np.uint64))
    return starts, np.searchsorted(last, starts, "right"), prints


_DISTANCE = (np.arange(HALF, WINDOW)[:, None] - np.arange(WINDOW)).clip(-1)
#: Half windows whose arrays fit a processor's cache.
STEP = 96


class Graph:
    """Steps of the network for onnxruntime, whose exponents and small products cost a fraction of numpy's."""

    def __init__(self, inputs: str, outputs: str, *nodes: str):
        self.inputs, self.outputs, self.nodes = inputs.split(), outputs.split(), nodes
        self.sessions: dict = {}

    def run(self, **values: np.ndarray) -> list[np.ndarray]:
        kind = next(iter(values.values())).dtype
        if kind not in self.sessions:
            self.sessions[kind] = self._session(kind)
        return self.sessions[kind].run(self.outputs, values)

    def _session(self, kind: np.dtype):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        return onnxruntime.InferenceSession(self._model(kind), options, providers=["CPUExecutionProvider"])

    def _model(self, kind: np.dtype) -> bytes:
        """The nodes ("result = Operator argument ... name:numbers") in ONNX's protocol buffers."""

        def number(value: int) -> bytes:
            return bytes([value & 127 | 128]) + number(value >> 7) if value > 127 else bytes([value])

        def field(key: int, value: bytes | str | int) -> bytes:
            if isinstance(value, int):
                return number(key << 3) + number(value)
            raw = value.encode() if isinstance(value, str) else value
            return number(key << 3 | 2) + number(len(raw)) + raw

        def node(text: str) -> bytes:
            result, operator, *rest = text.replace("=", "").split()
            raw = b"".join(field(1, name) for name in rest if ":" not in name) + field(2, result) + field(4, operator)
            for name, values in (item.split(":") for item in rest if ":" in item):
                raw += field(5, field(1, name) + b"".join(field(8, int(v)) for v in values.split(",")) + field(20, 7))
            return raw

        def ends(key: int, names: list[str]) -> bytes:
            kinds = field(2, field(1, field(1, 11 if kind == np.float64 else 1)))
            return b"".join(field(key, field(1, name) + kinds) for name in names)

        graph = b"".join(field(1, node(text)) for text in self.nodes) + field(2, "steps")
        graph += ends(11, self.inputs) + ends(12, self.outputs)
        return field(1, 7) + field(8, field(2, 12)) + field(7, graph)


#: Weights u of the keys, and the sums of values with them; the last column of v makes the sum of the weights.
_ATTENTION = Graph("q k v b", "u s", "kt = Transpose k perm:0,2,1", "p = MatMul q kt", "e = Exp p", "u = Mul e b", "s = MatMul u v")
#: The same for weights that could leave the range of exponents.
_STEEP_ATTENTION = Graph(
    "q k v b d", "u s", "kt = Transpose k perm:0,2,1", "p = MatMul q kt", "c = Add p d", "top = ReduceMax c axes:2",
    "f = Sub c top", "e = Exp f", "u = Mul e b", "s = MatMul u v",
)
_HEAD = Graph("a m x o n", "h y t", "f = MatMul a m", "g = Add f x", "h = Tanh g", "l = MatMul h o", "y = Exp l", "t = MatMul y n")
_STEEP_HEAD = Graph(
    "a m x o n", "h y t l", "f = MatMul a m", "g = Add f x", "h = Tanh g", "w = MatMul h o", "top = ReduceMax w axes:1",
    "l = Sub w top", "y = Exp l", "t = MatMul y n",
)


@dataclass
class Forward:
    """What a step over some half windows leaves: pieces in rows, their weights and exponents."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray  # with a column of ones; zeros where a text has no pieces
    u: np.ndarray  # weights of the keys
    weight: np.ndarray  # and their sum
    mixed: np.ndarray  # mean values and a one
    hidden: np.ndarray  # hidden layer and a one
    y: np.ndarray  # exponents of the logits
    total: np.ndarray  # and their sum
    logit: np.ndarray | None = None  # where exponents could leave their range


class Net:
    """The weights as tables by piece, with the biases as one more row or column."""

    def __init__(self, w: dict[str, np.ndarray]):
        e, kind = w["e"], w["e"].dtype
        self.q, self.k = e @ w["q"] / kind.type(np.sqrt(DIM)), e @ w["k"]
        self.v = np.concatenate([e @ w["v"], np.ones((len(e), 1), kind)], 1)
        # The last hidden unit is always tanh(20), a one.
        self.x = np.concatenate([e @ w["x"], np.zeros((len(e), 1), kind)], 1)
        self.m = np.zeros((DIM + 1, HIDDEN + 1), kind)
        self.m[:-1, :-1], self.m[-1, :-1], self.m[-1, -1] = w["m"], w["bx"], 20
        self.o = np.concatenate([w["o"], w["bo"][None]])
        self.n = np.ones((CLASSES, 1), kind)
        # Columns of m that the gradient needs, and one that it fills.
        self.back = np.ascontiguousarray(np.concatenate([w["m"].T, np.zeros((HIDDEN, 1), kind)], 1))
        far = np.sqrt((self.q**2).sum(1).max() * (self.k**2).sum(1).max()) + np.abs(w["d"]).max()
        self.steep, self.high = far > 60, np.abs(self.o).sum(0).max() > 60
        seen = _DISTANCE >= 0
        self.bias = np.where(seen, w["d"][_DISTANCE] if self.steep else np.exp(w["d"])[_DISTANCE], -1e30 if self.steep else 0).astype(kind)
        self.seen = seen.astype(kind)

    def forward(self, keys: np.ndarray, known: np.ndarray) -> Forward:
        here = keys[:, HALF:]
        q, k, v = self.q.take(here, 0), self.k.take(keys, 0), self.v.take(keys, 0)
        v[known == 0, :HALF] = 0
        if self.steep:
            bias = np.repeat(self.bias[None], len(keys), 0)
            bias[known == 0, :, :HALF] = -1e30
            u, sums = _STEEP_ATTENTION.run(q=q, k=k, v=v, b=self.seen, d=bias)
        else:
            u, sums = _ATTENTION.run(q=q, k=k, v=v, b=self.bias)
        sums = sums.reshape(-1, DIM + 1)
        weight = sums[:, DIM:].copy()
        sums /= weight
        head = _STEEP_HEAD if self.high else _HEAD
        return Forward(q, k, v, u, weight, sums, *head.run(a=sums, m=self.m, x=self.x.take(here.ravel(), 0), o=self.o, n=self.n))


@dataclass
class Model:
    """Weights, classes and tables of the model; indexes are pieces, the last one those never seen."""

    index: np.ndarray  # piece id -> index
    classes: np.ndarray  # index -> class
    w: dict[str, np.ndarray]
    inside: np.ndarray | None = None  # log10 of a piece within its class, behind a piece, for the first pieces
    rest: float = 0.0  # log10 of one of the pieces never seen
    weight: np.ndarray | None = None  # what a piece's share of its class counts against the counts behind a piece
    behind: np.ndarray | None = None  # log10 of what the pieces of a class count behind a piece
    pairs: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0))  # other pairs and their gains

    def score(self, block: Block) -> np.ndarray:
        """log10 probability of every text of a block by its pieces, as far as pairs are at hand."""
        return np.add.reduceat(self.logs(block)[0], block.first)

    def logs(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of every piece without the gains of pairs that are not at hand, and these pairs with their places."""
        target, before = block.known(self.index, self.w["end"][0])
        start, size, known, _ = chunks(block.first, block.last)
        net, inside, classes = Net(self.w), self.inside.ravel(), self.classes
        other = np.flatnonzero((target >= len(self.inside)) | (before >= len(self.inside)))
        cell = before * len(self.inside) + target
        cell[other] = 0  # its value is taken off again
        result = np.zeros(len(target))
        ahead = np.concatenate([np.zeros(HALF, np.int64), before, np.zeros(HALF, np.int64)])
        goal = np.concatenate([classes.take(target), np.zeros(HALF, np.int64)])
        cell = np.concatenate([cell, np.zeros(HALF, np.int64)])
        for a in range(0, len(start), STEP):
            s, n = start[a : a + STEP], size[a : a + STEP]
            keys = ahead[s[:, None] + np.arange(WINDOW)]
            here = (s[:, None] + np.arange(HALF)).ravel()
            f = net.forward(keys, known[a : a + STEP])
            place = np.arange(len(here)) * CLASSES + goal.take(here)
            if f.logit is None:
                value = np.log10(f.y.ravel().take(place) / f.total[:, 0])
            else:
                value = (f.logit.ravel().take(place) - np.log(f.total[:, 0])) * np.float32(1 / np.log(10))
            value += inside.take(cell.take(here))
            inner = (np.arange(HALF) < n[:, None]).ravel()
            result[here[inner]] = value[inner]
        pair, value = self.others(before[other], target[other])
        result[other] += value - inside[0]
        result[target == len(classes) - 1] += self.rest
        missing = ~self.at_hand(pair)[0]
        return result, other[missing], pair[missing]

    def at_hand(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some pairs have their gain here, and the gains (0 for the others)."""
        known, gains = self.pairs
        at = np.searchsorted(known, pair).clip(0, max(0, len(known) - 1))
        found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        return found, np.where(found, gains[at] if len(known) else 0, 0.0)

    def others(self, before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs outside the table as numbers, and log10 of the piece within its class."""
        pair = before * len(self.classes) + target
        value = np.log10(self.weight[target]) - self.behind[before, self.classes[target]]
        return pair, value + self.at_hand(pair)[1]

    def gains(self, pair: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What its count adds to log10 of a piece behind a piece."""
        return np.log10(1 + n / self.weight[pair % len(self.classes)])

    def learn_counts(
        self, pairs: np.ndarray, pieces: int, counts: np.ndarray | None = None, behind: np.ndarray | None = None
    ) -> None:
        """Distribution of a piece within its class behind a piece, from counts of all texts.

        Besides the table of the first pieces' pairs, counts are those of all pieces and behind
        those of the classes behind a piece in all other pairs.
        """
        head, size = KNOWN + 1, len(self.classes)
        pairs = pairs[: head * head].reshape(head, head)
        member = np.eye(CLASSES)[self.classes]
        own = (pairs.sum(0) if counts is None else counts) + 0.5
        prior = own / (own @ member)[self.classes]
        behind = np.zeros((size, CLASSES)) if behind is None else behind.copy()
        behind[:head] += pairs @ member[:head]
        inner = behind[:head][:, self.classes[:head]]
        self.inside = np.log10((pairs + BACKOFF * prior[:head]) / (inner + BACKOFF)).astype(np.float32)
        self.weight, self.behind = BACKOFF * prior, np.log10(behind + BACKOFF).astype(np.float32)
        self.rest = -float(np.log10(max(1, pieces - size + 1)))


def add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to the rows of a table; a row may occur often."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
    if len(starts):
        total[rows[starts]] += np.add.reduceat(values[order], starts, 0)


def directions(size: int, head: int, seed: int = 9) -> np.ndarray:
    """Random directions for the pieces behind a piece, then for those before it.

    Those of the first `head` pieces are the same for any number of pieces.
    """
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((2, n, REDUCED)) for n in (head, size - head)]
    return np.concatenate(parts, 1).reshape(-1, REDUCED).astype(np.float32)


def add_neighbours(total: np.ndarray, pair: np.ndarray, n: np.ndarray, onto: np.ndarray) -> None:
    """Add the roots of pairs' counts along the neighbours' directions to both pieces' rows."""
    before, target = np.divmod(pair, len(onto) // 2)
    root = np.sqrt(n)[:, None]
    add_rows(total, before, root * onto[target])
    add_rows(total, target, root * onto[len(onto) // 2 + before])


def find_classes(
    pairs: np.ndarray, counts: np.ndarray | None = None, neighbours: np.ndarray | None = None
) -> np.ndarray:
    """Cluster pieces by the pieces next to them; frequent ones are clusters of their own.

    Besides the table of the first pieces' pairs, counts are those of all pieces and neighbours
    the rows that add_neighbours made from all other pairs.
    """
    counts, head = pairs.sum(0) if counts is None else counts, len(pairs)
    size = len(counts)
    own = np.argsort(-counts, kind="stable")[: CLASSES // 3]
    profile = np.sqrt(np.concatenate([pairs, pairs.T], 1) / (counts[:head, None] + 5.0)).astype(np.float32)
    onto = directions(size, head)
    reduced = np.zeros((size, REDUCED), np.float32)
    reduced[:head] = profile @ np.concatenate([onto[:head], onto[size : size + head]])
    if neighbours is not None:
        reduced += (neighbours / np.sqrt(counts + 5.0)[:, None]).astype(np.float32)
    groups = CLASSES - len(own)
    heavy = np.argsort(-counts, kind="stable")
    centres = reduced[heavy[len(own) : len(own) + groups]]
    weight = np.log1p(counts).astype(np.float32)
    for _ in range(12):
        near = (reduced**2).sum(1)[:, None] - 2 * reduced @ centres.T + (centres**2).sum(1)
        label = near.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, reduced * weight[:, None])
        total = np.bincount(label, weight, groups)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
    label = label + len(own)
    label[own] = np.arange(len(own))
    return label.astype(np.int64)


def find_known(counts: np.ndarray) -> np.ndarray:
    """Index of every piece by its frequency: all that occur have their own, the others share the last."""
    own = max(KNOWN, min(int((counts > 0).sum()), len(counts) - 1))
    index = np.full(len(counts), own, np.int64)
    index[np.argsort(-counts, kind="stable")[:own]] = np.arange(own)
    return index


class Fit:
    """Weights and Adam's moments; learns the classes of a block's pieces."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in w.items() if k != "end"}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.step = 0

    def learn(self, block: Texts, model: Model, rng: np.random.Generator, rate) -> None:
        """One pass over all half windows of a block; rate(step) is Adam's."""
        target, before = block.known(model.index, model.w["end"][0])
        wanted = model.classes[target]
        start, size, known, _ = chunks(block.first, block.last)
        order = rng.permutation(len(start))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            place = start[part][:, None] + np.arange(-HALF, HALF)
            keys = before[place.clip(0, len(before) - 1)]
            want = wanted[place[:, HALF:].clip(0, len(target) - 1)]
            grads = _gradients(self.w, keys, want, size[part], known[part])
            self.step += 1
            for name, grad in grads.items():
                one, two = self.moments[name]
                one += 0.1 * (grad - one)
                two += 0.01 * (grad * grad - two)
                move = one / (1 - 0.9**self.step)
                self.w[name] -= rate(self.step) * move / (np.sqrt(two / (1 - 0.99**self.step)) + 1e-7)


def train(
    block: Block, pieces: Pieces, index: np.ndarray | None = None, classes: np.ndarray | None = None
) -> Model:
    """Fit attention weights on a block; known pieces and classes come from it if not given."""
    if index is None:
        index = find_known(np.bincount(block.ids, minlength=pieces.size))
    target, before = block.known(index, pieces.end)
    size = int(index.max()) + 1
    if classes is None:
        head, neighbours = KNOWN + 1, np.zeros((size, REDUCED))
        inner = (before < head) & (target < head)
        pairs = np.bincount(before[inner] * head + target[inner], minlength=head * head).reshape(head, head)
        other = np.unique(before[~inner] * size + target[~inner], return_counts=True)
        add_neighbours(neighbours, *other, directions(size, head))
        classes = find_classes(pairs, np.bincount(target, minlength=size), neighbours)
    rng = np.random.default_rng(17)

    def normal(*shape: int, scale: float = 1.0) -> np.ndarray:
        return (rng.standard_normal(shape) * scale / np.sqrt(shape[0])).astype(np.float32)

    w = {
        "e": (rng.standard_normal((KNOWN + 1, DIM)) * 0.3).astype(np.float32),
        "q": normal(DIM, DIM), "k": normal(DIM, DIM), "v": normal(DIM, DIM),
        "x": normal(DIM, HIDDEN), "m": normal(DIM, HIDDEN), "bx": np.zeros(HIDDEN, np.float32),
        "o": normal(HIDDEN, CLASSES), "bo": np.log(np.bincount(classes[target], minlength=CLASSES) + 1.0).astype(np.float32),
        "d": np.zeros(WINDOW, np.float32),
    }
    w["bo"] -= w["bo"].max()
    # The first pieces and all other weights start the same for any number of pieces.
    more = np.random.default_rng(18).standard_normal((size - KNOWN - 1, DIM)) * 0.3
    w["e"] = np.concatenate([w["e"], more.astype(np.float32)])
    end = {"end": np.array([pieces.end])}
    fit, model = Fit(w), Model(index, classes, w | end)
    steps = max(1, EPOCHS * -(-len(chunks(block.first, block.last)[0]) // BATCH))
    for _ in range(EPOCHS):
        fit.learn(block, model, rng, lambda step: 0.02 * (1 - step / (steps + 1)))
    return Model(index, classes, fit.w | end)


def _gradients(w: dict, keys: np.ndarray, want: np.ndarray, size: np.ndarray, known: np.ndarray) -> dict:
    """Gradients of the mean log loss of the classes in some half windows."""
    # Only rows of pieces that occur are worked on, so a step costs the same for any number of pieces.
    whole, used = w["e"], np.flatnonzero(np.bincount(keys.ravel(), minlength=len(w["e"])))
    number = np.zeros(len(whole), np.int64)
    number[used] = np.arange(len(used))
    w, keys = w | {"e": whole[used]}, number[keys]
    net, kind = Net(w), whole.dtype
    g = {name: np.zeros_like(value) for name, value in (w | {"o": net.o, "m": net.m[:, :-1]}).items() if name not in ("end", "bo", "bx")}
    shares = ((np.arange(HALF) < size[:, None]) / max(1, int(size.sum()))).astype(kind)
    dx, distances = np.empty((len(keys), WINDOW, DIM), kind), np.zeros((HALF, WINDOW))
    flat = lambda a: a.reshape(-1, a.shape[2])
    for a in range(0, len(keys), STEP):
        part = slice(a, a + STEP)
        f = net.forward(keys[part], known[part])
        y, place = f.y, np.arange(len(f.y))
        # y holds exponents; they become the gradient of the logits but for the factor of each row.
        y[place, want[part].ravel()] -= f.total[:, 0]
        factor = shares[part].reshape(-1, 1) / f.total
        dz = y @ net.o[:-1].T
        scaled = f.hidden * factor
        g["o"] += scaled.T @ y
        scaled *= f.hidden
        dz *= factor - scaled[:, :-1]
        g["m"] += f.mixed.T @ dz
        back = dz @ net.back
        back[:, DIM] = -np.einsum("ij,ij->i", back[:, :DIM], f.mixed[:, :DIM])
        back /= f.weight
        back = back.reshape(-1, HALF, DIM + 1)
        de = back @ f.v.transpose(0, 2, 1)
        de *= f.u
        distances += de.sum(0)
        dq, dk = de @ f.k, flat(de.transpose(0, 2, 1) @ f.q)
        dv = f.u.transpose(0, 2, 1) @ back[:, :, :DIM]
        dv[known[part] == 0, :HALF] = 0
        dv, dq = flat(dv), flat(dq) * kind.type(1 / np.sqrt(DIM))
        x = w["e"].take(keys[part], 0)
        fx, fq = flat(x), flat(np.ascontiguousarray(x[:, HALF:]))
        g["q"] += fq.T @ dq
        g["x"] += fq.T @ dz
        g["k"] += fx.T @ dk
        g["v"] += fx.T @ dv
        some = dk @ w["k"].T
        some += dv @ w["v"].T
        dx[part] = some.reshape(x.shape)
        dx[part, HALF:] += (dq @ w["q"].T + dz @ w["x"].T).reshape(-1, HALF, DIM)
    g["d"] = np.bincount(_DISTANCE.ravel().clip(0), np.where(_DISTANCE >= 0, distances, 0).ravel(), WINDOW).astype(kind)
    g["e"] = np.zeros_like(whole)
    g["e"][used] = np.stack([np.bincount(keys.ravel(), column, len(used)) for column in flat(dx).T], 1)
    return g | {"o": g["o"][:-1], "bo": g["o"][-1], "m": g["m"][:-1], "bx": g["m"][-1]}


# --- on Spark -------------------------------------------------------------------------------

_cutters: dict[int, Pieces] = {}


def _cutter(model: bytes) -> Pieces:
    """The tokenizer of this process, with what it remembers."""
    key = hash(model)
    if key not in _cutters:
        _cutters.clear()
        _cutters[key] = Pieces(model)
    return _cutters[key]


def sample(docs: DataFrame, doc_id: str, text: str) -> list[str]:
    """About SAMPLE_ROWS training texts by a hash of their ids, in a fixed order."""
    known = docs.where(~common.held_out(F.col(doc_id), HELD_OUT))
    hashed = known.withColumn("_h", F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(1 << 30)))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    # The share falls as the table grows, so the driver gets about SAMPLE_ROWS texts at any size.
    rows = hashed.where((F.col("_h") < int(share * (1 << 30))) & (F.length(text) <= SAMPLE_CHARS))
    return [r.t for r in sorted(rows.select("_h", F.col(text).alias("t")).collect())]


def score(
    docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Every row as struct `row` with n_tokens, n_known, train_tokens, base_score and score.

    `keep` names the columns that `row` holds, by default all.
    """
    context = docs.sparkSession.sparkContext
    with open(model_path, "rb") as file:
        raw = file.read()
    pieces = Pieces(raw)
    learned = docs.where(~common.held_out(F.col(doc_id), HELD_OUT)).select(F.col(text).alias("text"))
    sent = context.broadcast(raw)
    # The texts are cut once; what follows learns from their pieces.
    cut = stored(learned.mapInArrow(_cut(sent), "piece boolean, word long, n long, ids binary"))
    counted = stored(cut.where("piece is not null").groupBy("piece", "word").agg(F.sum("n").alias("n")))
    words, texts = counted.where(~F.col("piece")).drop("piece"), cut.where("piece is null").select("ids")
    often = np.zeros(pieces.size, np.int64)
    for row in counted.where("piece").collect():  # at most one row for each piece of the tokenizer
        often[row.word] = row.n
    sent.unpersist()

    index, kind, head = find_known(often), pieces.kind, KNOWN + 1
    size = int(index.max()) + 1
    often = np.bincount(index, often, size)
    sent = context.broadcast((index, pieces.end, kind))
    pairs = common.collect_counts(texts.mapInArrow(_count_pairs(sent), common.SKETCH_SCHEMA), head * head)
    others = neighbours = behind = None
    if size > head:
        found = texts.mapInArrow(_count_others(sent), "pair long, n long")
        others = stored(found.groupBy("pair").agg(F.sum("n").alias("n")))
        neighbours = _summed(others, size, REDUCED, add_neighbours, lambda: directions(size, head))
    sent.unpersist()
    start = Block(pa.array(sample(docs, doc_id, text), pa.string()), pieces)
    model = train(start, pieces, index, find_classes(pairs.reshape(head, head), often, neighbours))
    sent = context.broadcast((model, kind))
    model.w = _averaged(texts.mapInArrow(_learn(sent), "place int, total double, pieces long"), model.w)
    sent.unpersist()
    if others is not None:
        classes = model.classes
        behind = _summed(others, size, CLASSES, add_classes, lambda: classes)
    model.learn_counts(pairs, pieces.size, often, behind)
    less = 0
    if others is not None:
        less = _rare(others, others.count())
        near = others.where(F.col("n") > less).toArrow().sort_by("pair")  # at most HOT_WORDS rows
        pair, n = (near.column(c).to_numpy() for c in ("pair", "n"))
        model.pairs = pair, model.gains(pair, n)

    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    rare = _rare(words, kinds)
    hot = words.where(F.col("n") > rare).toArrow().sort_by("word")  # at most HOT_WORDS rows
    table = tuple(hot.column(c).to_numpy() for c in ("word", "n"))
    whole = _passages(texts, pieces.kind)
    seldom, repeats = whole[1:]
    sent = context.broadcast((raw, model, table, less > 0, repeats))

    fields = (
        "place long, n_tokens long, score double, hot_known long, hot_sum double, cold array<long>, times array<int>, "
        "pairs array<struct<number: int, pair: long, times: int>>, "
        "late array<struct<number: int, passage: long, own: int, others: long, odds: double>>"
    )
    is_known = (~common.held_out(F.col(doc_id), HELD_OUT)).alias("learned")
    carried = common.carried(docs, text, keep, is_known)
    shape = T.StructType([carried.schema["row"], *T.StructType.fromDDL(fields).fields])
    scored = stored(carried.mapInArrow(_score_rows(sent, text), shape))
    cold = scored.select("place", F.explode(F.arrays_zip("cold", "times")).alias("w")).select(
        "place", F.col("w.cold").alias("word"), F.col("w.times").alias("times")
    )
    # Words without a count add log10(0.5) each; that needs no join.
    half, none = F.lit(float(np.log10(0.5))), F.lit(0.0)
    sums = cold.join(words.where(F.col("n") <= rare), "word").select(
        "place", F.col("times").alias("known"), (F.col("times") * (F.log10(F.col("n") + 0.5) - half)).alias("more"),
        none.alias("gain"),
    )
    late = scored.select("place", F.explode("late").alias("p")).select("place", "p.*")
    seen = whole[0].where(F.col("n") <= seldom).select(F.col("passage").alias("print"), "n")
    late = late.join(seen, (F.col("passage") == F.col("print")) & (F.col("n") > F.col("own")), "left" if less else "inner")
    late = late.select("place", "number", "odds", F.coalesce(F.col("n") - F.col("own"), "others").alias("others"))
    if less:
        # Pairs without a count gain nothing. Gains lessen what a passage of other texts adds to its pieces.
        gains = others.where(F.col("n") <= less).mapInArrow(_gains(sent), "pair long, gain double")
        gained = (
            scored.select("place", F.explode("pairs").alias("p")).select("place", "p.*").join(gains, "pair")
            .groupBy("place", "number").agg(F.sum(F.col("times") * F.col("gain")).alias("gain"))
        )
        late = late.join(gained, ["place", "number"], "full").withColumn("gain", F.coalesce("gain", none))
    else:
        late = late.withColumn("gain", none)
    by = F.col("odds") + F.log10("others") - F.col("gain")
    added = F.when(F.col("others") > 0, F.greatest(by, none) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(by))))
    sums = sums.unionByName(
        late.select("place", F.lit(0).alias("known"), none.alias("more"), (F.col("gain") + F.coalesce(added, none)).alias("gain"))
    ).groupBy("place").agg(*(F.sum(c).alias(c) for c in ("known", "more", "gain")))
    unseen = F.coalesce(F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + t), F.lit(0))
    rest = float(np.log10(tokens + 0.5 * (kinds + 1))) if tokens else float(np.log10(0.5))
    base = F.col("hot_sum") + unseen * half + F.coalesce("more", none) - F.col("n_tokens") * F.lit(rest)
    return scored.join(sums, "place", "left").select(
        "row", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("gain", none)).alias("score"),
    )


@dataclass
class Repeats:
    """What a task knows of the passages of the training texts."""

    total: int  # passages
    odds: float  # log10 of the odds that a passage occurs again
    stay: float  # and log10 of the share of those that don't
    most: int  # passages that are not at hand occur at most so often
    prints: np.ndarray
    counts: np.ndarray

    def settle(
        self, prints: np.ndarray, text: np.ndarray, logs: np.ndarray, learned: np.ndarray, open_: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a block's passages add to their pieces' logs; passages left to the joins, with own and other counts and odds.

        `learned` tells whether a text was counted, `open_` whether a passage's log lacks gains.
        """
        # A text that was counted meets the passages of the others only.
        _, place, times = np.unique(common.mix(prints + text.astype(np.uint64)), return_inverse=True, return_counts=True)
        own = np.where(learned[text], times[place], 0)
        at = np.searchsorted(self.prints, common.signed(prints)).clip(0, max(0, len(self.prints) - 1))
        found = self.prints[at] == common.signed(prints) if len(self.prints) else np.zeros(len(prints), bool)
        others = np.where(found, self.counts[at] - own if len(self.prints) else 0, 0)
        here = np.bincount(text, minlength=len(learned)) * learned
        odds = self.odds - np.log10(np.maximum(1, self.total - here[text])) - logs
        late = np.flatnonzero(np.where(found, open_ & (others > 0), self.most > own))
        with np.errstate(divide="ignore"):
            by = np.where(others > 0, odds + np.log10(others), -np.inf)
        by[late] = -np.inf
        added = self.stay + np.maximum(by, 0) + np.log10(1 + 10.0 ** -np.abs(by))
        return added, late, own[late], others[late], odds[late]


def _passages(texts: DataFrame, kind: np.dtype) -> tuple[DataFrame, int, Repeats]:
    """Counts of all passages, the smallest count above which they are at hand, and what a task gets."""
    found = texts.mapInArrow(_count_passages(kind), "passage long, n long")
    whole = stored(found.groupBy("passage").agg(F.sum("n").alias("n")))
    n = F.col("n")
    total, kinds, again = whole.agg(F.coalesce(F.sum(n), F.lit(0)), F.count(n), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0))).first()
    share = (again + 0.5) / (total + 1) if total else 0.0
    seldom = _rare(whole, kinds)
    near = whole.where(n > seldom).toArrow().sort_by("passage")  # at most HOT_WORDS rows
    odds = float(np.log10(share / (1 - share))) if total else -np.inf
    repeats = Repeats(int(total), odds, float(np.log10(1 - share)), seldom, *(near.column(c).to_numpy() for c in ("passage", "n")))
    return whole, seldom, repeats


def _rare(words: DataFrame, kinds: int) -> int:
    """The smallest count above which at most HOT_WORDS words stand."""
    if kinds <= HOT_WORDS:
        return 0
    # Counts from 4,096 on are grouped by their first twelve bits, so few groups reach the driver.
    n = F.col("n")
    unit = F.when(n < 1 << 12, F.lit(1).cast("long")).otherwise(F.pow(2.0, F.floor(F.log2(n.cast("double"))) - 11).cast("long"))
    top = (n - n % unit) + unit - 1
    above = 0
    for row in words.groupBy(top.alias("top"), (n - n % unit).alias("low")).count().orderBy(F.desc("low")).collect():
        above += row["count"]
        if above > HOT_WORDS:
            return row.top
    return 0


def _cut(sent):
    """Pieces of every text, counts of words by MERGED words, then of the pieces of the task."""

    def counts(piece: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(keys), piece), keys.astype(np.int64), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(keys), pa.binary())], names)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        prints, n = (np.concatenate(x) for x in zip(*parts))
        coded = pa.array(prints).dictionary_encode()
        keys = coded.dictionary.to_numpy()
        return counts(False, common.signed(keys), np.bincount(coded.indices.to_numpy(), n, len(keys)))

    names = ["piece", "word", "n", "ids"]

    def run(batches):
        pieces = _cutter(sent.value)
        total, parts, waiting = np.zeros(pieces.size, np.int64), [], 0
        for batch in batches:
            for part in common.blocks(batch, "text"):
                block, count = Block(part.column("text"), pieces), part.num_rows
                total += np.bincount(block.ids, minlength=pieces.size)
                often = np.bincount(block.index, minlength=len(block.unique))
                parts.append((np.append(block.unique, END), np.append(often, count)))
                waiting += len(often) + 1
                if waiting > MERGED:
                    yield merged(parts)
                    parts, waiting = [], 0
                data = block.ids.astype(pieces.kind)
                offsets = np.append(0, block.last).astype(np.int64) * data.itemsize
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                none = [pa.nulls(count, pa.bool_()), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, ids.cast(pa.binary())], names)
        if parts:
            yield merged(parts)
        used = np.flatnonzero(total)
        yield counts(True, used, total[used])

    return run


def _cut_texts(batches, kind: np.dtype):
    """Blocks of cut texts with at most BLOCK_PIECES pieces, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("ids").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ids = np.frombuffer(data, np.uint8)
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        ids, offsets = ids[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // kind.itemsize
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_PIECES, "right")) - 1)
            yield Texts(ids[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a])
            a = b


def _count_pairs(sent):
    def run(batches):
        index, end, kind = sent.value
        size = KNOWN + 1
        total = np.zeros(common.whole_blocks(size * size), np.int32)
        for block in _cut_texts(batches, kind):
            target, before = block.known(index, end)
            cells = before * size + target
            if index.max() >= size:
                cells = cells[(target < size) & (before < size)]
            # Sorted cells and one addition for each are faster than additions all over the table.
            cells = np.sort(cells.astype(np.int32))
            ends = np.flatnonzero(np.append(cells[1:] != cells[:-1], len(cells) > 0))
            total[cells[ends]] += np.diff(ends, prepend=-1).astype(np.int32)
        yield from common.sketch_rows(total)

    return run


def _count_others(sent):
    """Counts of the pairs that _count_pairs leaves out, by MERGED pairs."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, n = (np.concatenate(x) for x in zip(*parts))
        keys, place = np.unique(pairs, return_inverse=True)
        n = np.bincount(place, n, len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n)], ["pair", "n"])

    def run(batches):
        index, end, kind = sent.value
        size, parts, waiting = int(index.max()) + 1, [], 0
        for block in _cut_texts(batches, kind):
            target, before = block.known(index, end)
            other = np.flatnonzero((target > KNOWN) | (before > KNOWN))
            parts.append(np.unique(before[other] * size + target[other], return_counts=True))
            waiting += len(parts[-1][0])
            if waiting > MERGED:
                yield merged(parts)
                parts, waiting = [], 0
        if parts:
            yield merged(parts)

    return run


def add_classes(total: np.ndarray, pair: np.ndarray, n: np.ndarray, classes: np.ndarray) -> None:
    """Add pairs' counts to the rows of the first pieces, in the columns of the second ones' classes."""
    before, target = np.divmod(pair, len(classes))
    add_rows(total.reshape(-1, 1), before * total.shape[1] + classes[target], n[:, None])


def _summed(pairs: DataFrame, size: int, width: int, fill, table) -> np.ndarray:
    """A table with a row for each piece, to which fill(table, pair, n, table()) adds all pairs.

    Its size depends on the tokenizer alone; it travels in blocks of TABLE_ROWS rows.
    """
    shape = (-(-size // TABLE_ROWS), TABLE_ROWS, width)

    def packed(numbers, tables: list[np.ndarray]) -> pa.RecordBatch:
        raw = [pa.compress(t.tobytes(), codec="zstd", asbytes=True) for t in tables]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(raw, pa.binary())], ["block", "packed"])

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, TABLE_ROWS * width * 8, codec="zstd", asbytes=True)).reshape(shape[1:])

    def run(batches):
        total, given = np.zeros(shape), table()
        for batch in batches:
            fill(total.reshape(-1, width), *(batch.column(c).to_numpy() for c in ("pair", "n")), given)
        used = np.flatnonzero(total.any((1, 2)))
        yield packed(used, [total[k] for k in used])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[1:])
        for batch in batches:
            for raw in batch.column("packed"):
                total += unpacked(raw.as_py())
        yield packed([key[0].as_py()], [total])

    result = np.zeros(shape)
    parts = pairs.mapInArrow(run, common.SKETCH_SCHEMA).groupBy("block").applyInArrow(add, common.SKETCH_SCHEMA)
    for row in parts.toLocalIterator():
        result[row.block] = unpacked(bytes(row.packed))
    return result.reshape(-1, width)[:size]


def _count_passages(kind: np.dtype):
    """Counts of the passages of cut texts, by MERGED passages."""

    def merged(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(common.signed(keys)), pa.array(n)], ["passage", "n"])

    def run(batches):
        parts, waiting = [], 0
        for block in _cut_texts(batches, kind):
            parts.append(passages(block.ids, block.first, block.last)[2])
            waiting += len(parts[-1])
            if waiting > MERGED:
                yield merged(parts)
                parts, waiting = [], 0
        if parts:
            yield merged(parts)

    return run


def _gains(sent):
    def run(batches):
        model = sent.value[1]
        for batch in batches:
            pair, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(model.gains(pair, n))], ["pair", "gain"])

    return run


def _learn(sent):
    """One pass over a task's texts from the common start: its weights times its pieces."""

    def run(batches):
        model, kind = sent.value
        fit, count = Fit(model.w), 0
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for block in _cut_texts(batches, kind):
            fit.learn(block, model, rng, lambda step: RATE / (1 + step / RATE_STEPS))
            count += len(block.ids)
        flat = np.concatenate([v.ravel() for v in fit.w.values()]).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * count), pa.array(np.full(len(flat), count))],
            ["place", "total", "pieces"],
        )

    return run


def _averaged(parts: DataFrame, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tasks' weights, averaged by their numbers of pieces; w without any."""
    sums = parts.groupBy("place").agg(F.sum("total").alias("total"), F.sum("pieces").alias("pieces"))
    # One row for each weight, at any size of the table.
    found = sums.where("pieces > 0").select("place", F.col("total") / F.col("pieces")).toArrow().sort_by("place")
    if not found.num_rows:
        return w
    flat, result, a = found.column(1).to_numpy(), dict(w), 0
    for name in w:
        if name != "end":
            result[name] = flat[a : a + w[name].size].reshape(w[name].shape).astype(np.float32)
            a += w[name].size
    return result


_PAIRS = {"number": pa.int32(), "pair": pa.int64(), "times": pa.int32()}
_LATE = {"number": pa.int32(), "passage": pa.int64(), "own": pa.int32(), "others": pa.int64(), "odds": pa.float64()}


def _score_rows(sent, text: str):
    def lists(owner: np.ndarray, count: int, kinds: dict, *columns: np.ndarray) -> pa.ListArray:
        """Structs of each row, from columns in the order of the rows."""
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), values)

    def run(batches):
        raw, model, (hot, often), joined, repeats = sent.value
        pieces = _cutter(raw)
        # Places number the rows of the whole table.
        place = TaskContext.get().partitionId() << 33
        logs = np.log10(often + 0.5)
        for batch in batches:
            whole = common.with_text(batch, text).append_column("learned", batch.column("learned"))
            for part in common.blocks(whole, "text"):
                block = Block(part.column("text"), pieces)
                count = part.num_rows
                unique = common.signed(np.append(block.unique, END))
                at = np.searchsorted(hot, unique).clip(0, max(0, len(hot) - 1))
                is_hot = hot[at] == unique if len(hot) else np.zeros(len(unique), bool)
                value = np.where(is_hot, logs[at] if len(hot) else 0, 0.0)
                row = np.repeat(np.arange(count), np.diff(block.rows))
                end = len(unique) - 1
                known = np.bincount(row, is_hot[block.index], count) + is_hot[end]
                total = np.bincount(row, value[block.index], count) + value[end]
                # Cold words of each row with their number.
                cold = ~is_hot[block.index]
                keys, times = np.unique(row[cold] * len(unique) + block.index[cold], return_counts=True)
                owner, word = keys // len(unique), unique[keys % len(unique)]
                if not is_hot[end]:
                    order = np.argsort(np.append(owner, np.arange(count)), kind="stable")
                    word = np.append(word, np.full(count, unique[end]))[order]
                    times = np.append(times, np.ones(count, np.int64))[order]
                    owner = np.append(owner, np.arange(count))[order]
                offsets = pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32())
                each, lack, pair = model.logs(block)
                start, owner, prints = passages(block.ids, block.first, block.last)
                # Pairs that are not at hand, by passage.
                lacking = np.searchsorted(start, lack, "right") - 1
                many = len(model.classes) ** 2
                keys, often_pair = np.unique((lacking * many + pair)[: None if joined else 0], return_counts=True)
                lacking = keys // many
                open_ = np.zeros(len(start), bool)
                open_[lacking] = True
                learned = part.column("learned").to_numpy(zero_copy_only=False)
                each = np.add.reduceat(each, start)
                added, late, own, others, odds = repeats.settle(prints, owner, each, learned, open_)
                score = np.bincount(owner, each + added, count)
                pairs = lists(owner[lacking], count, _PAIRS, lacking, keys % many, often_pair)
                late = lists(owner[late], count, _LATE, late, common.signed(prints[late]), own, others, odds)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), pa.array(place + np.arange(count)),
                        pa.array(np.diff(block.rows) + 1, pa.int64()), pa.array(score),
                        pa.array(known.astype(np.int64)), pa.array(total),
                        pa.ListArray.from_arrays(offsets, pa.array(word, pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                        pairs, late,
                    ],
                    ["row", "place", "n_tokens", "score", "hot_known", "hot_sum", "cold", "times", "pairs", "late"],
                )
                place += count

    return run
