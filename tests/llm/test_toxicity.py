"""Gradients by differences, windows, held-out accuracy and edge rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from folioscope.llm import toxicity


def made(seed, count):
    """Texts of random syllables; toxic ones hold words with one of two stems."""
    random.seed(seed)
    parts = ["ka", "lo", "mi", "ter", "en", "su"]
    word = lambda: "".join(random.choice(parts) for _ in range(random.randint(1, 3)))
    texts, labels = [], []
    for _ in range(count):
        words = [word() for _ in range(random.randint(5, 150))]
        toxic = random.random() < 0.4
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randrange(len(words)), random.choice(["vexo", "grumz"]) + word())
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_windows_cover_every_word():
    rows = np.cumsum([0, 0, 1, 63, 64, 65, 113, 500])
    index, mask, row = toxicity.windows(rows)
    for r, size in enumerate(np.diff(rows)):
        seen = set(index[row == r][mask[row == r]].tolist())
        assert seen == set(range(rows[r], rows[r] + size))


def test_gradients_match_differences():
    words = toxicity.Words(pa.array(["some words vexoka mi lo", "other ter words"]))
    index, mask, row = toxicity.windows(words.rows)
    index = np.where(mask, words.index[np.minimum(index, len(words.index) - 1)], 0)
    rng = np.random.default_rng(0)
    odds = rng.standard_normal(toxicity.WORD_CELLS).astype(np.float32), rng.standard_normal(toxicity.GRAM_CELLS).astype(np.float32)
    net = toxicity.Net(*odds)
    target = np.array([1.0, 0.0])

    def loss():
        inputs = net.word_inputs(words, np.arange(len(words.length)))
        logit = net.window_logits(inputs, index, mask).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(logit)) - target * logit))

    grads = toxicity._gradients(net, words, index, mask, target)
    for name in ("cwf", "cub", "wwb", "wuf", "att", "out", "bias", "cbf", "wbb"):
        flat, grad = net.w[name].reshape(-1), grads[name].reshape(-1)
        k = int(np.abs(grad).argmax())
        old = flat[k]
        flat[k] = old + 0.01
        up = loss()
        flat[k] = old - 0.01
        down = loss()
        flat[k] = old
        assert abs((up - down) / 0.02 - grad[k]) < 0.03 * abs(grad[k]) + 1e-4, name


def test_held_out_accuracy_and_edge_rows(spark):
    texts, labels = made(3, 900)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "?!", "x"), (2003, "vexoka " * 9000, "x"), (2003, "vexoka " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(
        [(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5000, None)], "doc_id long, toxic int"
    )
    got = toxicity.score(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.row.doc_id: r.score for r in got}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [int(scores[i] >= 0.5) == labels[i] for i in held]
    assert np.mean(right) > 0.95
    assert scores[2000] == scores[2001] == scores[2002] < 0.5 <= scores[2003]
    assert toxicity.accepted(docs, known).columns == docs.columns


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, none).first().score == 0.0
    assert toxicity.score(docs.where("false"), none).count() == 0
