"""Toxicity of whole texts from a bidirectional gated recurrent network, trained in numpy.

A word enters the network twice: as characters (its UTF-8 bytes, each with the log-odds of the
4-gram that ends there, read by a small bidirectional GRU) and as a word (its log-odds and a
learned vector, both by a hash). A bidirectional GRU reads windows of words; attention pools
its states into one logit. Windows overlap and cover the whole text; the largest logit of a
text, calibrated, is its score.

The network is fitted on a bounded sample: at most TOXIC_ROWS and CLEAN_ROWS labelled
documents of at most SAMPLE_CHARS characters, chosen by a hash of their ids. Scoring reads
every document whole and needs no shuffle.

Defined results: a null, empty or wordless text has no window and the score 0; repeated rows get
equal scores; if the labelled rows are all of one kind
(or none), every text gets that kind's share of toxic labels (0 without labels); null labels
and ids teach nothing; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioscope.llm import common

TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1200, 2400, 20_000

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
GRAM = 4
CHAR_HIDDEN, WORD_HIDDEN, CHAR_DIM, WORD_DIM = 4, 6, 6, 4
WORD_CELLS, GRAM_CELLS, VECTOR_CELLS = 1 << 20, 1 << 18, 1 << 12
EPOCHS, BATCH = 5, 128

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """The distinct words of a block of texts: bytes, 4-gram cells, word cells; rows by word."""

    def __init__(self, column: pa.Array):
        data, offsets = common.text_buffers(column)
        starts, ends, self.rows = common.word_spans(data, offsets, common.PLAIN)
        prints = common.word_prints(data, starts, ends)
        unique, first, self.index = np.unique(prints, return_index=True, return_inverse=True)
        self.data = data
        self.first, self.length = starts[first], (ends - starts)[first]
        self.word_cell = (unique >> np.uint64(44)).astype(np.int64)
        self.vector_cell = (unique & np.uint64(VECTOR_CELLS - 1)).astype(np.int64)

    def letters(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, 4-gram cells and mask of some words, padded to the longest of them."""
        length = self.length[chosen]
        place = np.arange(int(length.max(initial=1)))
        mask = place < length[:, None]
        at = np.minimum(self.first[chosen][:, None] + place, len(self.data) - 1)
        codes = np.where(mask, common._LOWER[self.data[at]], 0)
        gram = np.zeros(codes.shape, np.uint64)
        padded = np.pad(codes, ((0, 0), (GRAM - 1, 0))).astype(np.uint64)
        for k in range(GRAM):
            gram = (gram + padded[:, k : k + codes.shape[1]]) * np.uint64(0xD6E8FEB86659FD93)
        cells = (common.mix(gram) >> np.uint64(46)).astype(np.int64)
        return codes, cells, mask


# --- gated recurrent layers -----------------------------------------------------------------


def gru(xp: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: bool = False):
    """States of a GRU over time-first inputs already multiplied by their weights."""
    size = u.shape[0]
    h = np.zeros((xp.shape[1], size), np.float32)
    states, steps = np.empty((*xp.shape[:2], size), np.float32), []
    for t in range(len(xp)):
        a = h @ u
        zr = _sigmoid(xp[t, :, : 2 * size] + a[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(xp[t, :, 2 * size :] + r * a[:, 2 * size :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if trace:
            steps.append((h, a[:, 2 * size :], z, r, n, m))
        h = states[t] = new
    return (states, steps) if trace else states


def gru_back(grad: np.ndarray, steps: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a GRU's inputs and recurrent weights."""
    size = u.shape[0]
    dxp = np.empty((*grad.shape[:2], 3 * size), np.float32)
    du, dh = np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
    for t in range(len(grad) - 1, -1, -1):
        h, an, z, r, n, m = steps[t]
        d = dh + grad[t]
        dn = d * m * (1 - z) * (1 - n * n)
        dz = -d * m * (n - h) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dxp[t] = np.concatenate([dz, dr, dn], 1)
        da = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ da
        dh = d * (1 - m * (1 - z)) + da @ u.T
    return dxp, du


def start_weights(seed: int = 5) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.4 / np.sqrt(shape[0])).astype(np.float32)

    c, h = CHAR_HIDDEN, WORD_HIDDEN
    w: Weights = {"letters": (rng.standard_normal((256, CHAR_DIM)) * 0.3).astype(np.float32)}
    w["vectors"] = (rng.standard_normal((VECTOR_CELLS, WORD_DIM)) * 0.05).astype(np.float32)
    for side in ("f", "b"):
        w |= {f"cw{side}": normal(CHAR_DIM + 1, 3 * c), f"cu{side}": normal(c, 3 * c)}
        w |= {f"ww{side}": normal(2 * c + 1 + WORD_DIM, 3 * h), f"wu{side}": normal(h, 3 * h)}
        w |= {f"cb{side}": np.zeros(3 * c, np.float32), f"wb{side}": np.zeros(3 * h, np.float32)}
    return w | {"att": normal(2 * h), "out": normal(2 * h), "bias": np.zeros(1, np.float32)}


class Net:
    """The weights, the log-odds tables of words and 4-grams, and the calibration."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, weights: Weights | None = None):
        self.word_odds, self.gram_odds = word_odds, gram_odds
        self.w = weights or start_weights()
        self.scale, self.shift = 1.0, 0.0

    def char_inputs(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([self.w["letters"][codes], self.gram_odds[cells][:, :, None]], 2)

    def word_inputs(self, words: Words, chosen: np.ndarray) -> np.ndarray:
        """What the word layer reads of each chosen word."""
        out = np.empty((len(chosen), 2 * CHAR_HIDDEN + 1 + WORD_DIM), np.float32)
        order = np.argsort(words.length[chosen], kind="stable")
        sizes = words.length[chosen][order]
        first = 0
        while first < len(order):
            # Words of like length together; a step holds a bounded number of characters.
            last = int(np.searchsorted(sizes, sizes[first] + 2, "right"))
            last = min(last, first + max(1, (1 << 18) // int(sizes[first] + 2)))
            some = order[first:last]
            codes, cells, mask = words.letters(chosen[some])
            x = self.char_inputs(codes, cells).transpose(1, 0, 2)
            m = mask.T.astype(np.float32)
            for k, (side, way) in enumerate((("f", 1), ("b", -1))):
                xp = x[::way] @ self.w["cw" + side] + self.w["cb" + side]
                states = gru(xp, m[::way], self.w["cu" + side])
                out[some, k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN] = states[-1]
            first = last
        out[:, 2 * CHAR_HIDDEN] = self.word_odds[words.word_cell[chosen]]
        out[:, 2 * CHAR_HIDDEN + 1 :] = self.w["vectors"][words.vector_cell[chosen]]
        return out

    def window_logits(self, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows: index and mask are windows by words into `inputs`."""
        result = np.empty(len(index), np.float32)
        tables = {s: inputs @ self.w["ww" + s] + self.w["wb" + s] for s in "fb"}
        for first in range(0, len(index), 4096):
            part, m = index[first : first + 4096].T, mask[first : first + 4096].T.astype(np.float32)
            ahead = gru(tables["f"][part], m, self.w["wuf"])
            back = gru(tables["b"][part[::-1]], m[::-1], self.w["wub"])[::-1]
            h = np.concatenate([ahead, back], 2)
            e = np.where(m > 0, h @ self.w["att"], -1e9)
            p = np.exp(e - e.max(0))
            pooled = ((p / p.sum(0))[:, :, None] * h).sum(0)
            result[first : first + 4096] = pooled @ self.w["out"] + self.w["bias"][0]
        return result

    def logits(self, column: pa.Array) -> np.ndarray:
        """The largest window logit of every row; without words it is minus infinity."""
        words = Words(column)
        index, mask, row = windows(words.rows)
        result = np.full(len(column), -np.inf, np.float32)
        if len(words.length):
            index = np.where(mask, words.index[np.minimum(index, len(words.index) - 1)], 0)
            inputs = self.word_inputs(words, np.arange(len(words.length)))
            np.maximum.at(result, row, self.window_logits(inputs, index, mask))
        return result

    def scores(self, column: pa.Array) -> np.ndarray:
        logits = self.logits(column).astype(np.float64)
        some = np.isfinite(logits)
        return np.where(some, _sigmoid(self.scale * np.where(some, logits, 0) + self.shift), 0.0)


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows that cover every word of every row: places, mask and row."""
    size = np.diff(rows)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    first = rows[:-1][row] + number * STRIDE
    index = first[:, None] + np.arange(WINDOW)
    return index, index < rows[1:][row][:, None], row


# --- training -------------------------------------------------------------------------------


def _odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of a cell in toxic against clean texts, scaled."""
    rate = (counts + 4.0) / (totals[:, None] + 8.0)
    base = 4.0 / (totals + 8.0)
    odds = np.log(rate[1]) - np.log(rate[0]) - np.log(base[1] / base[0])
    return np.clip(odds / 3.0, -1.5, 1.5).astype(np.float32)


def fit_odds(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of word and 4-gram cells by the number of sample texts that hold them."""
    word = np.zeros((2, WORD_CELLS)), np.zeros((2, GRAM_CELLS))
    for text, label in zip(texts, labels):
        words = Words(pa.array([text], pa.string()))
        if not len(words.length):
            continue
        word[0][label, np.unique(words.word_cell)] += 1
        order = np.argsort(words.length)
        for part in np.array_split(order, max(1, len(order) // 4000)):
            _, cells, mask = words.letters(part)
            word[1][label, np.unique(cells[mask])] += 1
    totals = np.bincount(labels, minlength=2).astype(float)
    return _odds(word[0], totals), _odds(word[1], totals)


def _gradients(net: Net, words: Words, index: np.ndarray, mask: np.ndarray, target: np.ndarray) -> Weights:
    """Gradients of the mean log loss of some windows."""
    w, c, h = net.w, CHAR_HIDDEN, WORD_HIDDEN
    used, index = np.unique(index, return_inverse=True)
    index = index.reshape(mask.shape)
    codes, cells, cmask = words.letters(used)
    chars = net.char_inputs(codes, cells).transpose(1, 0, 2)
    cm, m = cmask.T.astype(np.float32), mask.T.astype(np.float32)
    ahead, back = (
        gru(chars[::way] @ w["cw" + s] + w["cb" + s], cm[::way], w["cu" + s], True)
        for s, way in (("f", 1), ("b", -1))
    )
    x = np.concatenate(
        [ahead[0][-1], back[0][-1], net.word_odds[words.word_cell[used]][:, None], w["vectors"][words.vector_cell[used]]], 1
    )
    runs = {}
    for s, way in (("f", 1), ("b", -1)):
        runs[s] = gru((x @ w["ww" + s] + w["wb" + s])[index.T[::way]], m[::way], w["wu" + s], True)
    states = np.concatenate([runs["f"][0], runs["b"][0][::-1]], 2)
    e = np.where(m > 0, states @ w["att"], -1e9)
    p = np.exp(e - e.max(0))
    p /= p.sum(0)
    pooled = (p[:, :, None] * states).sum(0)
    logit = pooled @ w["out"] + w["bias"][0]
    d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
    g: Weights = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    dpool = d[:, None] * w["out"]
    dp = (states * dpool).sum(2)
    de = p * (dp - (p * dp).sum(0))
    g["att"] = np.einsum("tb,tbh->h", de, states)
    dstates = p[:, :, None] * dpool + de[:, :, None] * w["att"]
    dx = np.zeros_like(x)
    for s, way, part in (("f", 1, slice(0, h)), ("b", -1, slice(h, 2 * h))):
        dxp, g["wu" + s] = gru_back(dstates[::way, :, part], runs[s][1], w["wu" + s])
        dt = np.zeros((len(used), 3 * h), np.float32)
        np.add.at(dt, index.T[::way].ravel(), dxp.reshape(-1, 3 * h))
        g["ww" + s], g["wb" + s] = x.T @ dt, dt.sum(0)
        dx += dt @ w["ww" + s].T
    g["vectors"] = np.zeros_like(w["vectors"])
    np.add.at(g["vectors"], words.vector_cell[used], dx[:, 2 * c + 1 :])
    dchars = np.zeros_like(chars)
    for s, way, run, part in (("f", 1, ahead, slice(0, c)), ("b", -1, back, slice(c, 2 * c))):
        grad = np.zeros_like(run[0])
        grad[-1] = dx[:, part]
        dxp, g["cu" + s] = gru_back(grad, run[1], w["cu" + s])
        flat = chars[::way].reshape(-1, chars.shape[2])
        g["cw" + s], g["cb" + s] = flat.T @ dxp.reshape(-1, 3 * c), dxp.sum((0, 1))
        dchars += (dxp @ w["cw" + s].T)[::way]
    g["letters"] = np.zeros_like(w["letters"])
    np.add.at(g["letters"], codes.T.ravel(), dchars[:, :, :CHAR_DIM].reshape(-1, CHAR_DIM))
    return g


def train(texts: list[str], labels: np.ndarray) -> Net:
    """Fit the network: each epoch learns from every text's window of the largest logit."""
    net = Net(*fit_odds(texts, labels))
    rng = np.random.default_rng(11)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    groups, size = [], 200
    for first in range(0, len(texts), size):
        words = Words(pa.array(texts[first : first + size], pa.string()))
        index, mask, row = windows(words.rows)
        index = np.where(mask, words.index[np.minimum(index, max(0, len(words.index) - 1))], 0) if len(row) else index
        groups.append((words, index, mask, row, labels[first : first + size]))
    step = 0
    for epoch in range(EPOCHS):
        for number in rng.permutation(len(groups)):
            words, index, mask, row, label = groups[number]
            if not len(row):
                continue
            if epoch:
                inputs = net.word_inputs(words, np.arange(len(words.length)))
                worth = net.window_logits(inputs, index, mask)
            else:
                worth = np.where(mask, net.word_odds[words.word_cell][index], -9).max(1)
            order = np.lexsort((worth, row))
            top = order[np.append(row[order][1:] != row[order][:-1], True)]
            pick = np.unique(np.concatenate([top, rng.integers(0, len(row), len(row) // 4)]))
            pick = pick[(label[row[pick]] == 0) | np.isin(pick, top)]
            rng.shuffle(pick)
            for part in np.array_split(pick, max(1, round(len(pick) / BATCH))):
                step += 1
                grads = _gradients(net, words, index[part], mask[part], label[row[part]])
                for name, grad in grads.items():
                    one, two = moments[name]
                    one += 0.1 * (grad - one)
                    two += 0.01 * (grad * grad - two)
                    rate = 0.02 / (1 + epoch)
                    net.w[name] -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)
    _calibrate(net, groups)
    return net


def _calibrate(net: Net, groups: list) -> None:
    """Scale and shift of the largest logits, fitted by Newton steps with a small penalty."""
    logits, labels = [], []
    for words, index, mask, row, label in groups:
        if len(row):
            best = np.full(len(label), -np.inf)
            inputs = net.word_inputs(words, np.arange(len(words.length)))
            np.maximum.at(best, row, net.window_logits(inputs, index, mask))
            logits.append(best[np.unique(row)])
            labels.append(label[np.unique(row)])
    if not logits:
        return
    x, y = np.concatenate(logits), np.concatenate(labels)
    x = np.stack([x, np.ones(len(x))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(x @ b)
        gradient = x.T @ (p - y) + 0.1 * (b - (1.0, 0.0))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
    net.scale, net.shift = float(b[0]), float(b[1])


def sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[list[str], np.ndarray]:
    """The bounded sample of labelled documents outside the held-out fold, in a fixed order."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        .where(~common.held_out(F.col("doc_id"), 0))
    )
    chosen = None
    for value, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        some = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most TOXIC_ROWS + CLEAN_ROWS short rows: safe to broadcast.
    texts = docs.select("doc_id", F.col(text).alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761) % (1 << 32))
    return [r.t for r in rows], np.array([r.y for r in rows], np.int64)


def score(
    docs: DataFrame, labels: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Every row as struct `row` with its score; the network is fitted from `labels` first.

    `keep` names the columns that `row` holds, by default all.
    """
    texts, known = sample(docs, labels, text)
    net = train(texts, known) if len(np.unique(known)) == 2 else None
    share = float(known.mean()) if len(known) else 0.0
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            for part in common.blocks(common.with_text(batch, text), "text"):
                if sent.value is None:
                    values = np.full(part.num_rows, share)
                else:
                    values = sent.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(values, pa.float64())], ["row", "score"]
                )

    carried = common.carried(docs, text, keep)
    shape = T.StructType([carried.schema["row"], T.StructField("score", T.DoubleType())])
    return carried.mapInArrow(run, shape)


def predicted(score_column: str = "score") -> Column:
    return (F.col(score_column) >= 0.5).cast("int")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the network does not call toxic."""
    return score(docs, labels, text).where(predicted() == 0).select("row.*")
