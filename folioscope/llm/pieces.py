"""SentencePiece encoding and decoding for models of the merge type, with a table of prefixes.

The merge encoding of a prefix has exactly one last token. The table holds it for each prefix
of a text: an automaton lists the tokens that end at a place, and the right one is the token
that is compatible with the last token of the prefix before it, i.e. merging the two tokens'
characters gives these two tokens back. Ids are then read off backwards. The work is linear in
the text, whatever its length.

No token holds white space behind another character, or a character that is in no token, so a
text is cut there into words whose ids and decoded text are kept in a table of bounded size.

Defined results: null counts as empty; an empty text has the end id only and decodes to an
empty text; characters unknown to the model become the ids of their bytes; repeated rows and
other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from folioscope.llm import common

SPACE = "▁"

#: Words whose ids a worker remembers, and pairs of tokens.
MEMORY = 300_000
#: Longer words are encoded anew each time.
LONG_WORD = 64

_WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file: tokens with their scores, byte ids and the end id."""

    digest: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    end: int


def load_model(path: str) -> Model:
    """Read a model file on the driver; it must be of the merge type with byte fallback."""
    import sentencepiece

    with open(path, "rb") as file:
        raw = file.read()
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    count = lib.get_piece_size()
    special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(count)]
    byte_ids = tuple(lib.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    if not all(lib.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte tokens")
    return Model(
        hashlib.sha256(raw).hexdigest(),
        tuple(lib.id_to_piece(i) for i in range(count)),
        tuple(lib.get_score(i) for i in range(count)),
        tuple(not s for s in special),
        byte_ids,
        lib.eos_id(),
    )


class Codec:
    """Encodes words with a prefix table and decodes their ids."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.plain[i]}
        self.count = len(model.pieces)
        self.bytes = {i: b for b, i in enumerate(model.byte_ids)}
        self.automaton = ahocorasick.Automaton()
        self.joins = set()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
            self.joins.update(zip(piece, piece[1:]))
        self.automaton.make_automaton()
        self.letters = {c for piece in self.ids for c in piece}
        self.pairs: dict[int, bool] = {}
        # Half of the words remembered are the newest, half the ones before them.
        self.words: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        # Whether a token's characters merge to it, as they do at the start of a text.
        self.alone = {i: self.merge(p) == [i] for p, i in self.ids.items()}

    def merge(self, text: str) -> list[int]:
        """The merge rule itself, on the few characters of one or two tokens."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.model.scores[i] > best):
                    best, at = self.model.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        text = self.model.pieces[before] + self.model.pieces[token]
        known = self.pairs[before * self.count + token] = self.merge(text) == [before, token]
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special treatment of its ends."""
        size, count, pairs = len(text), self.count, self.pairs
        last: list[int | None] = [None] * (size + 1)
        length = [1] * (size + 1)
        # Matches come by their end, so every shorter prefix is settled.
        for end, (token, width) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            before = last[end - width]
            if before is None:  # the start of the text, or a character in no token
                fits = self.alone[token]
            else:
                fits = pairs.get(before * count + token)
                if fits is None:
                    fits = self.compatible(before, token)
            if fits:
                last[end], length[end] = token, width
        result: list[int] = []
        while size:
            token = last[size]
            if token is not None:
                result.append(token)
            elif text[size - 1] in self.letters:
                raise ValueError("no token fits: the model is not of the merge type")
            else:
                raw = text[size - 1].encode("utf-8", "surrogatepass")
                result.extend(self.model.byte_ids[b] for b in reversed(raw))
            size -= length[size]
        return result[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; byte ids in a row are read as UTF-8, the marks of spaces as spaces."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if self.model.plain[i]:
                out.append(self.model.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def word(self, word: str) -> tuple[str, str]:
        """Ids (as text) and decoded text of a word, from the table or computed."""
        known = self.words.get(word) or self.older.get(word)
        if known is not None:
            return known
        parts, first = [], 0
        if not word.lstrip(SPACE).isalpha():  # letters are rarely worth a cut
            for k, pair in enumerate(zip(word, word[1:]), 1):
                if pair not in self.joins:
                    parts.append(word[first:k])
                    first = k
        parts.append(word[first:])
        if len(parts) > 1:
            get, new = self.words.get, self.word
            each = [get(p) or new(p) for p in parts]
            known = " ".join(e[0] for e in each), "".join(e[1] for e in each)
        else:
            ids = self.encode(word)
            known = " ".join(map(str, ids)), self.decode(ids)
        if len(word) <= LONG_WORD:
            if len(self.words) >= MEMORY // 2:
                self.older, self.words = self.words, {}
            self.words[word] = known
        return known

    def text(self, text: str) -> tuple[list[str], str]:
        """Ids of a whole text word by word, as text and with the end id, and the decoded text."""
        if not text:
            return [str(self.model.end)], ""
        get, new = self.words.get, self.word
        marked = SPACE + text.replace(" ", SPACE)
        found = [get(w) or new(w) for w in _WORDS.findall(marked)]
        ids = [f[0] for f in found]
        ids.append(str(self.model.end))
        return ids, "".join([f[1] for f in found])[1:]


_codecs: dict[str, Codec] = {}


def codec(model: Model) -> Codec:
    """The codec of a model in this process."""
    if model.digest not in _codecs:
        _codecs.clear()
        _codecs[model.digest] = Codec(model)
    return _codecs[model.digest]


_CODED = (
    T.StructType().add("n_tokens", T.LongType()).add("ids_sha256", T.StringType())
    .add("decoded_sha256", T.StringType()).add("decoded", T.StringType())
    .add("ids", T.ArrayType(T.IntegerType()))
)


def code(
    docs: DataFrame, path: str, text: str = "text", more: tuple[str, ...] = (),
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Every row as struct `row`, with n_tokens, the two digests and what `more` names besides.

    `more` may hold "ids" (the ids themselves) and "decoded" (the decoded text); `keep` names
    the columns that `row` holds, by default all.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(load_model(path))
    fields = [_CODED[n] for n in ("n_tokens", "ids_sha256", "decoded_sha256", *more)]
    carried = common.carried(docs, text, keep)
    shape = T.StructType([carried.schema["row"], *fields])
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(sent.value)
        for batch in batches:
            whole = common.with_text(batch, text)
            for first in range(0, whole.num_rows, 512):
                part = whole.slice(first, 512)
                rows: dict[str, list] = {f.name: [] for f in fields}
                for value in part.column("text"):
                    ids, back = coder.text(value.as_py() or "")
                    joined = " ".join(ids)
                    rows["n_tokens"].append(joined.count(" ") + 1)
                    rows["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                    if "ids" in rows:
                        rows["ids"].append(np.fromstring(joined, np.int32, sep=" "))
                    if "decoded" in rows:
                        rows["decoded"].append(back)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row")]
                    + [pa.array(rows[f.name], kinds.get(f.name, pa.int64() if f.name == "n_tokens" else pa.string())) for f in fields],
                    ["row", *rows],
                )

    return carried.mapInArrow(run, shape)
