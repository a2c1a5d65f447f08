"""Embedding providers and the Arrow stage that calls them."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.functions import text as text_fn
from folioscope.session import ship_package

DIMENSIONS = 768
BATCH = 64


class Embedder(Protocol):
    max_input_tokens: int | None  # None: texts of any length

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


_WORD = re.compile(r"\w+")


class _Places(dict):
    """Twice the dimension of each word, plus one where it adds; remembers a bounded number of words."""

    MEMORY, LONGEST = 200_000, 64

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        digest = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
        place = (digest >> 1) % self.dimensions * 2 + (digest & 1)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MEMORY:
                self.clear()
            self[word] = place
        return place


#: One table of this process for each number of dimensions.
_places: dict[int, _Places] = {}


class HashingEmbedder:
    """Offline default: signed word hashes, scaled to length one."""

    max_input_tokens = None

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        places = _places.setdefault(self.dimensions, _Places(self.dimensions))
        found = [places[word] for word in _WORD.findall(text.lower())]
        sums = np.bincount(np.array(found, np.int64), minlength=2 * self.dimensions).astype(float)
        vector = sums[1::2] - sums[::2]
        length = math.sqrt(vector @ vector)
        return (vector / length if length else vector).tolist()


class HttpEmbedder:
    """A provider behind HTTP, in the request shape of a local or a hosted API."""

    def __init__(
        self,
        url: str,
        model: str,
        api_key: str | None = None,
        dimensions: int | None = None,
        timeout: float = 120.0,
    ):
        self.url, self.model, self.api_key = url.rstrip("/"), model, api_key
        self.dimensions, self.timeout = dimensions, timeout
        self.max_input_tokens = 8000 if api_key else 1900

    def request(self, texts: Sequence[str]) -> urllib.request.Request:
        headers = {"Content-Type": "application/json"}
        body: dict = {"model": self.model, "input": list(texts)}
        if self.api_key:
            headers["Authorization"] = f"Bearer {self.api_key}"
            body["encoding_format"] = "float"
            if self.dimensions is not None:
                body["dimensions"] = self.dimensions
            target = f"{self.url}/embeddings"
        else:
            body["truncate"] = True
            target = f"{self.url}/api/embed"
        return urllib.request.Request(target, json.dumps(body).encode(), headers)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            raise ValueError("embed() needs at least one text")
        with urllib.request.urlopen(self.request(texts), timeout=self.timeout) as answer:
            return self.vectors(json.load(answer))

    @staticmethod
    def vectors(answer: dict) -> list[list[float]]:
        if "embeddings" in answer:
            return answer["embeddings"]
        return [item["embedding"] for item in sorted(answer["data"], key=lambda d: d["index"])]


def check_dimension(embedder: Embedder, expected: int = DIMENSIONS) -> str | None:
    """What is wrong with a provider, or None when it answers with the right size."""
    try:
        size = len(embedder.embed(["dim"])[0])
    except Exception as error:  # noqa: BLE001 - any provider failure is the answer
        return str(error)
    if size != expected:
        return f"the provider returns {size} dimensions, the chunk table holds {expected}"
    return None


def embed_batch(embedder: Embedder, texts: Sequence[str]) -> tuple[list, list]:
    """Vectors and errors of one batch; a failed batch is tried again text by text."""
    try:
        return list(embedder.embed(texts)), [None] * len(texts)
    except Exception:  # noqa: BLE001 - a provider may fail in any way
        vectors, errors = [], []
        for text in texts:
            try:
                vectors.append(embedder.embed([text])[0])
                errors.append(None)
            except Exception as error:  # noqa: BLE001
                vectors.append(None)
                errors.append(str(error))
        return vectors, errors


def windows(text: str, most: int | None) -> list[str]:
    """The whole text in windows of at most so many estimated tokens, cut at line ends."""
    if most is None:
        return [text]
    size = most * text_fn.CHARS_PER_TOKEN
    out, at = [], 0
    while len(text) - at > size:
        line = text.rfind("\n", at, at + size)
        end = line + 1 if line > at else at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def pooled(vectors: Sequence[Sequence[float] | None]) -> list[float] | None:
    """The mean of a text's window vectors, scaled to length one; a lone vector stays."""
    if len(vectors) == 1 or any(v is None for v in vectors):
        return None if any(v is None for v in vectors) else list(vectors[0])
    sums = [sum(values) for values in zip(*vectors)]
    length = math.sqrt(sum(v * v for v in sums))
    return [v / length for v in sums] if length else sums


def embed_whole(embedder: Embedder, texts: Sequence[str], batch: int) -> tuple[list, list]:
    """Vectors and errors of whole texts; what exceeds the provider's input goes in windows."""
    cut = [windows(t, embedder.max_input_tokens) for t in texts]
    flat = [w for each in cut for w in each]
    vectors, errors = [], []
    for at in range(0, len(flat), batch):
        some, failed = embed_batch(embedder, flat[at : at + batch])
        vectors += some
        errors += failed
    out, why, at = [], [], 0
    for each in cut:
        end = at + len(each)
        out.append(pooled(vectors[at:end]))
        why.append(next((e for e in errors[at:end] if e), None))
        at = end
    return out, why


def embed_chunks(
    chunks: DataFrame, embedder: Embedder, batch: int = BATCH, requests: int | None = None
) -> DataFrame:
    """Vectors for chunks that have none; failures keep the chunk and say why.

    Equal texts are embedded once: only the first text per hash goes to the provider
    and the vector joins back. A text longer than the provider takes goes in windows, whose
    vectors are pooled. ``requests`` bounds how many tasks call it at a time.
    """
    wanted = chunks.where(F.col("embedding").isNull())
    texts = wanted.groupBy("content_sha256").agg(F.min("content").alias("content"))
    texts = texts.select("content_sha256", F.col("content").alias("text"))
    if requests:
        texts = texts.repartition(requests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors, errors = embed_whole(embedder, part.column("text").to_pylist(), batch)
                columns = [
                    part.column("content_sha256"), pa.array(vectors, pa.list_(pa.float32())),
                    pa.array(errors, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["content_sha256", "_vector", "_error"])

    ship_package(chunks.sparkSession)
    schema = "content_sha256 string, _vector array<float>, _error string"
    done = texts.mapInArrow(run, schema)
    joined = chunks.join(done, "content_sha256", "left")
    return joined.select(
        *[c for c in chunks.columns if c not in ("embedding", "embedding_error")],
        F.coalesce("embedding", "_vector").alias("embedding"),
        F.when(F.col("embedding").isNull(), F.col("_error")).alias("embedding_error"),
    )
