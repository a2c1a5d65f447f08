"""Base scores against plain Python, the model's distribution, its gradients and edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import attention, queries

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(attention, "EPOCHS", 1)
    monkeypatch.setattr(attention, "SAMPLE_ROWS", 150)


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path("piece_bpe_32k.model")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check_base(rows, got):
    counts = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            counts.update([*words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    for r in got:
        tokens = [*words(r.row.text), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score <= 0


@pytest.mark.parametrize("hot", [1_000_000, 20, 1])
def test_base_scores(spark, path, monkeypatch, hot):
    monkeypatch.setattr(attention, "HOT_WORDS", hot)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows += [(None, "null id"), (900, None), (901, ""), (902, " \t"), (903, "Same word " * 5000), (903, "Same word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = attention.score(docs.selectExpr("*", "'x' as score", "'y' as place"), path).collect()
    assert len(got) == len(rows)
    check_base(rows, got)


def test_no_training_texts(spark, path):
    docs = spark.createDataFrame([(next(i for i in range(99) if held(i)), "held out")], "doc_id long, text string")
    got = attention.score(docs, path).collect()
    check_base([(r.row.doc_id, r.row.text) for r in got], got)
    assert attention.score(docs.where("false"), path).count() == 0


def trained(path, texts):
    with open(path, "rb") as file:
        pieces = attention.Pieces(file.read())
    block = attention.Block(pa.array(texts), pieces)
    model = attention.train(block, pieces)
    size = attention.KNOWN + 1
    pairs = np.zeros((size, size), np.int64)
    np.add.at(pairs, (model.index[block.ids[:-1]], model.index[block.ids[1:]]), 1)
    model.learn_counts(pairs.ravel(), pieces.size)
    return model, pieces


def test_pieces_of_a_context_sum_to_one(path):
    """The probability of 'a b' and any piece behind it, over all pieces, is that of 'a b'."""
    model, pieces = trained(path, ["some words and other words again " * 20] * 3)
    inside = 10.0 ** model.inside.astype(np.float64)
    member = np.eye(attention.CLASSES)[model.classes]
    sums = inside @ member
    used = member.sum(0) > 0
    assert np.allclose(sums[:, used], 1, atol=1e-4)
    one = attention.Block(pa.array(["some words"]), pieces)
    assert model.score(one)[0] < 0


def test_windows_score_each_piece_once_whatever_the_batch(path):
    model, pieces = trained(path, ["some words and other words again " * 20] * 3)
    texts = ["", "one", "word " * 31, "some words and other words again " * 40]
    together = model.score(attention.Block(pa.array(texts), pieces))
    alone = [model.score(attention.Block(pa.array([t]), pieces))[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-5)


def test_gradients_match_differences(path):
    rng = np.random.default_rng(2)
    with open(path, "rb") as file:
        pieces = attention.Pieces(file.read())
    block = attention.Block(pa.array(["some words and other words again " * 9] * 4), pieces)
    model = attention.train(block, pieces)
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    keys = rng.integers(0, 40, (3, attention.WINDOW))
    want = rng.integers(0, attention.CLASSES, (3, attention.HALF))
    size, known = np.array([16, 5, 16]), np.array([0, 16, 16])

    def loss():
        x = w["e"][keys]
        e = (x[:, 16:] @ w["q"] / np.sqrt(attention.DIM)) @ (x @ w["k"]).transpose(0, 2, 1) + w["d"][attention._DISTANCE]
        open_ = np.broadcast_to(attention._DISTANCE >= 0, e.shape).copy()
        open_[known == 0, :, :16] = False
        p = np.where(open_, np.exp(e), 0)
        p /= p.sum(2, keepdims=True)
        logit = np.tanh(x[:, 16:] @ w["x"] + p @ (x @ w["v"]) @ w["m"] + w["bx"]) @ w["o"] + w["bo"]
        value = np.take_along_axis(logit, want[:, :, None], 2)[:, :, 0] - np.log(np.exp(logit).sum(2))
        return -(value * (np.arange(16) < size[:, None])).sum() / size.sum()

    grads = attention._gradients(w, keys, want, size, known)
    for name in ("e", "q", "k", "v", "x", "m", "bx", "o", "bo", "d"):
        flat, grad = w[name].reshape(-1), grads[name].reshape(-1)
        k = int(np.abs(grad).argmax())
        old = flat[k]
        flat[k] = old + 1e-4
        up = loss()
        flat[k] = old - 1e-4
        down = loss()
        flat[k] = old
        assert (up - down) / 2e-4 == pytest.approx(grad[k], rel=2e-2, abs=1e-5), name


def test_small_memory_changes_nothing(path, monkeypatch):
    with open(path, "rb") as file:
        raw = file.read()
    texts = ["some words and other words", "more words", "even more of them"]
    whole = attention.Pieces(raw)
    want = [attention.Block(pa.array([t]), whole).ids.tolist() for t in texts]
    monkeypatch.setattr(attention.Pieces, "MEMORY", 2)
    tight = attention.Pieces(raw)
    assert [attention.Block(pa.array([t]), tight).ids.tolist() for t in texts] == want


def test_texts_outside_the_start_are_learned_from(spark, path, monkeypatch):
    """The start of the weights sees no text at all; pieces, classes and weights must still come from all."""
    monkeypatch.setattr(attention, "SAMPLE_CHARS", 0)
    docs = spark.createDataFrame([(i, f"zebra quilt marmalade {i} " * 60) for i in range(40)], "doc_id long, text string")

    def mean(rate):
        monkeypatch.setattr(attention, "RATE", rate)
        got = attention.score(docs, path).collect()
        return sum(r.score for r in got) / sum(r.n_tokens for r in got)

    without, learned = mean(0.0), mean(0.01)
    # Three words are six pieces or so; unknown ones alone cost 4.5 each.
    assert learned > without + 0.1
    assert without > -10


class Sent:
    def __init__(self, value):
        self.value = value


def test_learning_needs_no_texts_once_they_are_cut(path, monkeypatch):
    """The stored pieces, in blocks of any size, give the texts' pieces, words and pairs again."""
    with open(path, "rb") as file:
        raw = file.read()
    texts = ["some words and Other words again " * 30, None, "", "one", "zebra quilt " * 50]
    block = attention.Block(pa.array(texts), attention.Pieces(raw))
    monkeypatch.setattr(attention, "MERGED", 3)
    monkeypatch.setattr(attention.common, "BLOCK_BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    rows = pa.Table.from_batches(list(attention._cut(Sent(raw))([batch])))
    words, often = Counter(), Counter()
    for r in rows.to_pylist():
        if r["piece"] is not None:
            (often if r["piece"] else words)[r["word"]] += r["n"]
    assert sorted(words.values()) == sorted(Counter(w for t in texts for w in [*map(str, (t or "").lower().split()), None]).values())
    assert often == Counter(block.ids.tolist())
    ids = rows.filter(pa.compute.is_null(rows.column("piece"))).select(["ids"]).combine_chunks()
    index = attention.find_known(np.bincount(block.ids, minlength=32_000))
    end, kind = attention.Pieces(raw).end, attention.Pieces(raw).kind
    target, before = block.known(index, end)
    size = attention.KNOWN + 1
    want = np.bincount(before * size + target, minlength=size * size)
    for pieces in (1, 70, 1 << 20):
        monkeypatch.setattr(attention, "BLOCK_PIECES", pieces)
        parts = list(attention._cut_texts(ids.slice(1).to_batches(), kind))
        assert np.concatenate([p.ids for p in parts]).tolist() == block.ids[block.last[0] :].tolist()
        assert all(p.first[0] == 0 and p.last[-1] == len(p.ids) for p in parts)
        monkeypatch.setattr(attention.common, "sketch_rows", lambda total: [total])
        (got,) = attention._count_pairs(Sent((index, end, kind)))(ids.to_batches())
        assert (got[: size * size] == want).all()


@pytest.mark.parametrize("steep, high", [(1, 1), (40, 1), (1, 30), (40, 30)])
def test_weights_of_any_size_give_the_softmax(path, steep, high):
    model, pieces = trained(path, ["some words and other words again " * 20] * 3)
    model.w |= {"q": model.w["q"] * steep + 1, "k": model.w["k"] * steep + 1, "o": model.w["o"] * high + 1}
    block = attention.Block(pa.array(["some words again and other words", "", "words"]), pieces)
    net = attention.Net(model.w)
    assert (net.steep, net.high) == (steep > 1, high > 1)
    w = {k: v.astype(np.float64) for k, v in model.w.items() if k != "end"}
    target, before = block.known(model.index, pieces.end)
    want = np.zeros(3)
    for text, (a, b) in enumerate(zip(block.first, block.last)):
        assert b - a <= attention.HALF
        for i in range(a, b):
            x = w["e"][before[a : i + 1]]
            p = x[-1] @ w["q"] / np.sqrt(attention.DIM) @ (x @ w["k"]).T + w["d"][i - a - np.arange(i - a + 1)]
            p = np.exp(p - p.max())
            hidden = np.tanh(x[-1] @ w["x"] + (p / p.sum()) @ (x @ w["v"]) @ w["m"] + w["bx"])
            logit = hidden @ w["o"] + w["bo"]
            value = logit[model.classes[target[i]]] - logit.max() - np.log(np.exp(logit - logit.max()).sum())
            want[text] += value / np.log(10) + model.inside[before[i], target[i]] + (target[i] == attention.KNOWN) * model.rest
    assert np.allclose(model.score(block), want, rtol=1e-4)


@pytest.mark.parametrize("hot", [0, 1, 3, 4, 9, 50])
def test_frequent_words_fit_the_bound(spark, monkeypatch, hot):
    monkeypatch.setattr(attention, "HOT_WORDS", hot)
    counts = [1, 1, 2, 2, 7, 4095, 4096, 5000, 10**6, 10**6 + 1, 3 * 10**9]
    words = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "word long, n long")
    rare = attention._rare(words, len(counts))
    assert sum(n > rare for n in counts) <= hot
    assert sum(n > rare for n in counts) >= min(hot, len(counts)) - 1


def within(model, pairs):
    """log10 of a piece in its class behind a piece, from the counts of all pairs in plain Python."""
    # Indexes without a count weigh a half, as those of pieces never seen do together.
    weight, same, behind, count = [0.5] * len(model.classes), Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        a, b = model.index[a], model.index[b]
        weight[b] += n
        behind[a, model.classes[b]] += n
        count[a, b] += n
    for i, kind in enumerate(model.classes):
        same[kind] += weight[i]

    def value(before, target):
        a, b = model.index[before], model.index[target]
        kind = model.classes[b]
        share = weight[b] / same[kind]
        return math.log10((count[a, b] + attention.BACKOFF * share) / (behind[a, kind] + attention.BACKOFF))

    return value


def pairs_of(block, end):
    before = np.concatenate([[end], block.ids[:-1]])
    before[block.first] = end
    return Counter(zip(before.tolist(), block.ids.tolist()))


@pytest.mark.parametrize("hot", [1_000_000, 30])
def test_every_piece_of_the_texts_is_told_apart(spark, path, monkeypatch, hot):
    """Scores are those of counts of all pairs in plain Python, whether these fit the table, a task or neither."""
    with open(path, "rb") as file:
        pieces = attention.Pieces(file.read())
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()}
    text |= {900 + i: f"zebra quilt {'marmalade ' * i}" for i in range(12)} | {990: None, 991: "☃ never"}
    text |= {2000 + i: text[i] for i in list(text)[:9]} | {3000: "zebra quilt " * 900}
    monkeypatch.setattr(attention, "KNOWN", 99)
    monkeypatch.setattr(attention, "HOT_WORDS", hot)
    models = []
    score_rows = attention._score_rows
    monkeypatch.setattr(attention, "_score_rows", lambda sent, name: models.append(sent.value[1]) or score_rows(sent, name))
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 5)  # a task gets several blocks
    got = {r.row.doc_id: r.score for r in attention.score(docs.coalesce(2), path).collect()}
    spark.conf.unset(batch)
    got = {i: got[i] for i in text}
    (model,) = models
    block = attention.Block(pa.array([t for i, t in text.items() if not held(i)]), pieces)
    assert (model.index == attention.find_known(np.bincount(block.ids, minlength=pieces.size))).all()
    assert len(set(model.index[block.ids])) == len(set(block.ids)) > 200
    pairs = pairs_of(block, pieces.end)
    others = sum(max(model.index[list(p)]) > 99 for p in pairs)
    assert len(model.pairs[0]) <= min(others, hot) and (hot < others or len(model.pairs[0]) == others)
    whole = attention.Block(pa.array(list(text.values())), pieces)
    # The network's part is the logs less the counts' part.
    plain = attention.Model(model.index, model.classes, model.w, np.zeros((100, 100), np.float32))
    plain.weight, plain.behind = np.ones(len(model.classes)), np.zeros((len(model.classes), attention.CLASSES))
    logs, _, _ = plain.logs(whole)
    value = within(model, pairs)
    for a, b in zip(whole.first, whole.last):
        for k, before in zip(range(a, b), [pieces.end, *whole.ids[a : b - 1].tolist()]):
            logs[k] += value(before, whole.ids[k]) + (model.index[whole.ids[k]] == len(model.classes) - 1) * model.rest
    # Passages of a text, and what those of all other texts add to them.
    found = [[] for _ in text]
    start, owner, _ = attention.passages(whole.ids, whole.first, whole.last)
    for a, b, t in zip(start, [*start[1:], len(whole.ids)], owner):
        found[t].append((tuple(whole.ids[a:b]), logs[a:b].sum()))
    every = Counter(p for i, f in zip(text, found) if not held(i) for p, _ in f)
    total = sum(every.values())
    share = (sum(n for n in every.values() if n > 1) + 0.5) / (total + 1)
    want = {}
    for i, f in zip(text, found):
        own = Counter(p for p, _ in f if not held(i))
        rest = total - sum(own.values())
        again = [math.log(share * (every[p] - own[p]) / rest) if every[p] > own[p] else -math.inf for p, _ in f]
        want[i] = sum(np.logaddexp(math.log(1 - share) + x * math.log(10), y) for (_, x), y in zip(f, again)) / math.log(10)
    assert list(got.values()) == pytest.approx([want[i] for i in got], rel=1e-4)


def test_equal_stretches_are_cut_alike(path):
    with open(path, "rb") as file:
        pieces = attention.Pieces(file.read())
    text = " ".join(f"w{i * i % 1009}" for i in range(900))
    block = attention.Block(pa.array(["", text, "one", "other words " + text, None, "x " * 3000]), pieces)
    start, owner, prints = attention.passages(block.ids, block.first, block.last)
    assert set(block.first) <= set(start) and (np.diff(start) > 0).all()
    assert (owner == np.searchsorted(block.first, start, "right") - 1).all()
    one, other = ({int(p) for p in prints[owner == k]} for k in (1, 3))
    assert 10 < len(one) and len(one - other) <= 1 and prints[0] == prints[owner == 4][0]
    size = np.diff(np.append(start, len(block.ids)))[owner == 1]
    assert 20 < size.mean() < 200
    lone = attention.Block(pa.array([text]), pieces)
    assert attention.passages(lone.ids, lone.first, lone.last)[2].tolist() == prints[owner == 1].tolist()


@pytest.mark.parametrize("hot", [1_000_000, 8])
def test_texts_that_occur_twice_are_scored_apart(spark, path, monkeypatch, hot):
    """A text's copy anywhere in the training texts tells it from texts of the same kind that occur once."""
    monkeypatch.setattr(attention, "HOT_WORDS", hot)
    rng = np.random.default_rng(4)
    words = ["tion", "re", "an", "the", "er", "in", "on", "nd", "ha", "ing"]
    rows = [(i, " ".join("".join(rng.choice(words, 3)) for _ in range(150))) for i in range(60)]
    fold = next(i for i in range(1000, 1100) if held(i))
    *learned, seen = [i for i in range(60) if not held(i)][:7]
    rows += [(next(k for k in range(1000 * (i + 2), 10**6) if not held(k)), rows[i][1]) for i in learned] + [(fold, rows[seen][1])]
    twice = Counter(t for _, t in rows)
    got = attention.score(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    often = [r.score / r.n_tokens for r in got if twice[r.row.text] == 2 and r.row.doc_id != seen]
    once = [r.score / r.n_tokens for r in got if twice[r.row.text] == 1]
    assert len(often) == 13 and min(often) > max(once) + 0.5


def test_pieces_beyond_the_table_follow_their_counts(spark, path):
    """Two rare words are as frequent, but only one stands behind the third: that tells the texts apart."""
    with open(path, "rb") as file:
        pieces = attention.Pieces(file.read())
    # Words of one piece, more than the table holds.
    every = [pieces.lib.id_to_piece(i)[1:] for i in range(pieces.size) if pieces.lib.id_to_piece(i)[:1] == "▁"]
    single = [w for w in every if w.isascii() and w.isalpha() and w == w.lower() and len(pieces.lib.encode(w)) == 1]
    common, (a, b, c) = single[: attention.KNOWN + 200], single[-3:]
    assert len(common) == attention.KNOWN + 200
    rows = [(i, " ".join(common)) for i in range(9) if not held(i)]
    rows += [(100 + i, f"{a} {b}") for i in range(4) if not held(100 + i)]
    rows += [(200 + i, f"{common[0]} {c}") for i in range(4) if not held(200 + i)]
    fold = [i for i in range(300, 400) if held(i)]
    rows += [(fold[0], f"{a} {b}"), (fold[1], f"{a} {c}")]
    got = attention.score(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    score = {r.row.doc_id: r.score for r in got}
    assert score[fold[0]] > score[fold[1]] + 0.5
