"""Approximate nearest neighbours by counting collisions.

Vectors are scaled to length one and projected on PROJECTIONS random directions. A shard of the
vectors keeps one sorted array for each direction. A query opens a window around its own
projection in every array and widens it level by level (virtual rehashing: wider buckets need no
new tables). A vector that lies in at least the threshold's share of the windows is verified:
its cosine is computed in double precision from the original vectors. Widening stops for a
query once every vector nearer than its current last neighbour would have passed the threshold
with the wanted probability; there is no cap on candidates.

Every vector is indexed. Shards and blocks of queries have bounded sizes; each shard meets each
block in one task, and the best of all shards are merged. The number of meetings grows with
shards times blocks, which is the size of the search itself (queries are a share of the rows).

Defined results: null vectors, and those of length zero or with a null or non-finite component,
take no part, nor do rows without an id; vectors of different dimensions are never neighbours;
of repeated query ids the smallest vector asks, once; repeated candidates are candidates each;
ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PROJECTIONS = 48
#: Share of windows that must hold a vector, and the probability that a neighbour passes it.
THRESHOLD, CERTAINTY = 0.5, 0.95
#: First half-width of a window in units of a vector's length, and how it grows.
FIRST, GROWTH = 0.6, 1.35
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048

SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def width_for(projections: int, needed: int, certainty: float) -> float:
    """Half-width, in units of the distance, at which a vector passes with that probability.

    A projected difference is normal with the distance as its deviation, so the number of
    windows that hold the vector is binomial.
    """
    low, high = 0.0, 8.0
    for _ in range(50):
        width = (low + high) / 2
        p = erf(width / sqrt(2))
        # The upper tail of the binomial, summed term by term.
        term, tail = (1 - p) ** projections, 0.0
        for k in range(projections + 1):
            if k >= needed:
                tail += term
            term *= (projections - k) / (k + 1) * p / max(1 - p, 1e-300)
        low, high = (low, width) if tail >= certainty else (width, high)
    return high


class Index:
    """The sorted projections of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((vectors.shape[1], PROJECTIONS))
        projected = (vectors / self.norms[:, None]) @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(projected.T, self.order.astype(np.int64), 1)
        self.needed = max(1, int(np.ceil(THRESHOLD * PROJECTIONS)))
        self.reach = width_for(PROJECTIONS, self.needed, CERTAINTY)

    def cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        dots = (self.vectors[rows] * query).sum(1)
        return dots / (self.norms[rows] * np.sqrt((query * query).sum()))

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the query's k nearest in this shard, nearest first."""
        count = len(self.ids)
        centre = (query / np.sqrt((query * query).sum())) @ self.directions
        hits = np.zeros(count, np.int64)
        seen = self.ids == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        low = high = None
        width = FIRST
        while True:
            new_low = np.array([np.searchsorted(s, c - width) for s, c in zip(self.sorted, centre)])
            new_high = np.array([np.searchsorted(s, c + width, "right") for s, c in zip(self.sorted, centre)])
            if low is None:
                low = high = new_low
            parts = [o[a:b] for o, a, b in zip(self.order, new_low, low)]
            parts += [o[a:b] for o, a, b in zip(self.order, high, new_high)]
            low, high = new_low, new_high
            hits += np.bincount(np.concatenate(parts), minlength=count)
            fresh = np.flatnonzero((hits >= self.needed) & ~seen)
            seen[fresh] = True
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.cosines(query, fresh)])
            best = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k:
                distance = sqrt(max(0.0, 2 - 2 * scores[-1]))
                if width >= self.reach * distance:
                    return rows, scores
            if (high - low == count).all():
                return rows, scores
            width *= GROWTH


def _meet(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The nearest of a shard for a block of queries."""
    out: list[tuple[int, int, float]] = []
    if vectors.num_rows and queries.num_rows:
        values = [np.array(v, np.float64) for v in vectors.column("vector").to_pylist()]
        asked = [np.array(v, np.float64) for v in queries.column("vector").to_pylist()]
        ids = np.array(vectors.column("vec_id").to_pylist(), np.int64)
        size = np.array([len(v) for v in values])
        for dimension in {len(v) for v in asked} & set(size.tolist()):
            some = np.flatnonzero(size == dimension)
            index = Index(ids[some], np.stack([values[i] for i in some]))
            for own, query in zip(queries.column("vec_id").to_pylist(), asked):
                if len(query) == dimension:
                    rows, scores = index.search(own, query, k)
                    out.extend((own, int(index.ids[r]), float(s)) for r, s in zip(rows, scores))
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table(
        {"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())}
    )


def nearest(
    table: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k nearest rows for every row that `queries` selects: query_id, rank, vec_id, score."""
    sound = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), queries.alias("asks"))
    sound = sound.where(F.col("vec_id").isNotNull() & usable("vector"))
    asked = sound.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-sound.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    indexed = sound.select(
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
        every(blocks).alias("block"), "vec_id", "vector",
    )
    asking = asked.select(
        every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        "vec_id", "vector",
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left, right, k)

    found = indexed.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(meet, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
