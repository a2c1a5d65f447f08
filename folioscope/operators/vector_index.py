"""A persisted vector index: inverted lists, residual codes, exact re-ranking.

Vectors are scaled to length one. Spark's k-means finds the centres of the lists; a vector goes to
its nearest centre and is stored in that list's partition with a code for each part of what is left
(the residual), the number of the nearest word of a small code book. A search ranks the centres on
the driver, reads the codes of the best lists only, adds up one table entry per code in column
expressions, and compares the best rows on their original vectors.

`nearest` reads as many lists as a bounded sample of queries needed for nearly all of their neighbours
(measured when the index is built), and is approximate. `exact` is not: no vector of a list is
nearer to the query than its centre's product plus the longest residual of the list, so it reads
every list whose bound reaches the k-th best score, and of these all vectors.

Centres and code book are fitted on a bounded sample (`SAMPLE` rows); every row is indexed. A batch
writes its own folders, so a repeated one overwrites itself. Defined results: null, zero and
non-finite vectors are left out, as they have no cosine, and so are those with fewer entries than the
longest of the first batch, or more; ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import vectors
from folioscope.operators import search
from folioscope.session import ship_package

PARTS, CODE_WORDS = 16, 64
#: Rows that centres and code book are fitted on, and lists that an index has, at most.
SAMPLE, MOST_LISTS = 200_000, 4096
#: Candidates for each row asked for, lists that an exact search tries first.
RERANK, FIRST_LISTS = 20, 16
#: Distances that a task holds at a time.
CELLS = 1 << 20
#: Rows and queries of the sample that says how many lists to read, and the share of neighbours wanted.
TRIED_ROWS, TRIED, NEIGHBOURS, SHARE = 4000, 200, 10, 0.97


def _sound(vector: Column, width: int | None = None) -> Column:
    def finite(entry: Column) -> Column:
        return entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) != float("inf"))

    sound = vector.isNotNull() & F.forall(vector, finite) & (vectors.norm(vector) > 0)
    return sound if width is None else sound & vectors.has_dimension(vector, width)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _means(rows: DataFrame, count: int, seed: int) -> np.ndarray:
    """Centres of an array column by Spark's k-means; a single one is the mean."""
    if count < 2:
        width = rows.agg(F.max(F.size("v"))).first()[0]
        means = rows.agg(*[F.avg(F.col("v")[k]) for k in range(width)]).first()
        return np.array([list(means)])
    model = KMeans(k=count, seed=seed, maxIter=12).fit(rows.select(array_to_vector("v").alias("features")))
    return np.array(model.clusterCenters())


def _parts(rows: np.ndarray, parts: int) -> np.ndarray:
    """Rows cut into equal parts, the last one filled up with zeros."""
    width = -(-rows.shape[1] // parts)
    filled = np.zeros((len(rows), parts * width))
    filled[:, : rows.shape[1]] = rows
    return filled.reshape(len(rows), parts, width)


def _lists_for(rows: np.ndarray, centres: np.ndarray) -> int:
    """Lists to read so that SHARE of the neighbours of some rows among all of them are in one."""
    home = _nearest_row(rows, centres)
    tried = rows[:TRIED]
    order = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)
    products = tried @ rows.T
    products[np.arange(len(tried)), np.arange(len(tried))] = -2.0  # a row is no neighbour of itself
    near = np.argsort(-products, axis=1)[:, : min(NEIGHBOURS, len(rows) - 1)]
    places = np.take_along_axis(order, home[near], axis=1).ravel()
    return int(np.quantile(places, SHARE, method="higher")) + 1 if len(places) else 1


def _nearest_row(rows: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The nearest of some points for each row; at most CELLS distances are held at a time."""
    own, step = (among * among).sum(1), max(1, CELLS // len(among))
    parts = [np.argmin(own - 2 * rows[a : a + step] @ among.T, axis=1) for a in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _arrays(rows: np.ndarray) -> pa.ListArray:
    """Rows as an Arrow column of lists."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


class VectorIndex:
    """The vectors of a folder with the key columns they were written with."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str]):
        self.spark, self.folder, self.key = spark, folder, list(key)
        centres = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()
        words = spark.read.parquet(f"{folder}/words").orderBy("code").collect()
        self.centres = np.array([row.centre for row in centres])
        self.words = np.array([row.word for row in words])
        self.parts = -(-self.centres.shape[1] // self.words.shape[1])
        self.probes = spark.read.parquet(f"{folder}/about").first()["probes"]

    # --- writes -----------------------------------------------------------------------------

    @classmethod
    def build(
        cls, frame: DataFrame, key: Sequence[str], folder: str, vector: str = "embedding",
        lists: int | None = None, parts: int = PARTS, code_words: int = CODE_WORDS, seed: int = 7,
    ) -> VectorIndex:
        """Fit centres and code book, then write all rows as batch 0."""
        spark = frame.sparkSession
        held = F.col(vector)
        row = frame.where(_sound(held)).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(held)).alias("width")).first()
        count = row.n
        if not count:
            raise ValueError("an index needs a vector")
        units = cls._units(frame.where(_sound(held, row.width)).select(held.alias("v")))
        sample = units.sample(min(1.0, SAMPLE / count), seed=seed).persist()
        try:
            if sample.isEmpty():
                sample = units
            lists = lists or max(1, min(round(count**0.5), MOST_LISTS))
            centres = _means(sample, min(lists, count), seed)
            some = np.array([row.v for row in sample.limit(TRIED_ROWS).collect()])
            probes = _lists_for(some, centres)
            words = _means(cls._residuals(sample, centres, parts), min(code_words, count * parts), seed)
        finally:
            sample.unpersist()
        for name, column, number, rows in (("centres", "centre", "list", centres), ("words", "word", "code", words)):
            table = [(k, [float(x) for x in row]) for k, row in enumerate(rows)]
            spark.createDataFrame(table, f"{number} int, {column} array<double>").coalesce(1).write.mode(
                "overwrite"
            ).parquet(f"{folder}/{name}")
        about = spark.range(1).select(F.lit(probes).alias("probes"))
        about.write.mode("overwrite").parquet(f"{folder}/about")
        index = cls(spark, folder, key)
        index.add(frame, 0, vector)
        return index

    @staticmethod
    def _units(frame: DataFrame) -> DataFrame:
        """Vectors scaled to length one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _unit(_matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, 0))
                yield pa.RecordBatch.from_arrays([_arrays(rows)], ["v"])

        ship_package(frame.sparkSession)
        return frame.mapInArrow(run, "v array<double>")

    @staticmethod
    def _residuals(units: DataFrame, centres: np.ndarray, parts: int) -> DataFrame:
        """The parts of all rows' residuals, each a row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for b in batches if b.num_rows):
                rows = _matrix(batch.column("v"))
                left = rows - centres[_nearest_row(rows, centres)]
                cut = _parts(left, parts).reshape(-1, -(-rows.shape[1] // parts))
                yield pa.RecordBatch.from_arrays([_arrays(cut)], ["v"])

        return units.mapInArrow(run, "v array<double>")

    def add(self, frame: DataFrame, batch: int, vector: str = "embedding") -> None:
        """Write rows under the fitted centres; batches have numbers of their own."""
        ship_package(self.spark)
        centres, words, parts = self.centres, self.words, self.parts
        held = [*self.key, "vector"]
        names = [*held, "list", "reach", "codes"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (b for b in batches if b.num_rows):
                rows = _unit(_matrix(part.column("vector")))
                lists = _nearest_row(rows, centres)
                left = rows - centres[lists]
                cut = _parts(left, parts)
                codes = _nearest_row(cut.reshape(-1, cut.shape[2]), words).reshape(len(rows), parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(name) for name in held), pa.array(lists.astype(np.int32)),
                        pa.array(np.linalg.norm(left, axis=1)), _arrays(codes.astype(np.int32)),
                    ],
                    names,
                )

        sound = _sound(F.col(vector), centres.shape[1])
        rows = frame.where(sound).select(*self.key, F.col(vector).alias("vector"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        coded = rows.mapInArrow(run, f"{kinds}, list int, reach double, codes array<int>")
        # A hot list is split over files.
        coded.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(
            f"{self.folder}/rows/batch={batch}"
        )
        reaches = self.spark.read.parquet(f"{self.folder}/rows/batch={batch}").groupBy("list")
        reaches.agg(F.max("reach").alias("reach")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/reach/batch={batch}"
        )

    # --- search -----------------------------------------------------------------------------

    def _rows(self, lists: Sequence[int]) -> DataFrame:
        """Rows of some lists; other lists' folders are not opened."""
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        return rows.where(F.col("list").isin([int(n) for n in lists]))

    def _approximate(self, query: np.ndarray, products: np.ndarray, lists: Sequence[int]) -> Column:
        """The product with a row's centre plus a table entry for each of its codes."""
        tables = _parts(query[None, :], self.parts)[0] @ self.words.T
        score = F.lit(0.0)
        for number in lists:
            score = F.when(F.col("list") == int(number), float(products[number])).otherwise(score)
        for part in range(self.parts):
            score = score + vectors.literal_vector(tables[part])[F.col("codes")[part]]
        return score

    def _best(self, rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        scored = search.vector_score(rows.select(*self.key, "vector"), query, out="score", embedding="vector")
        return search.top_k(scored, "score", self.key, k).select(*self.key, "score")

    def nearest(self, query: Sequence[float], k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
        """About the k nearest rows by cosine: key and `score`, exact for each row returned."""
        unit = _unit(np.array([query], float))[0]
        products = self.centres @ unit
        lists = np.argsort(-products, kind="stable")[: probes or self.probes]
        rows = self._rows(lists)
        approximate = rows.select(*self.key, self._approximate(unit, products, lists).alias("about"))
        # k * rerank rows at most.
        chosen = approximate.orderBy(F.desc("about"), *self.key).limit(k * rerank).select(*self.key)
        return self._best(rows.join(F.broadcast(chosen), self.key, "left_semi"), query, k)

    def exact(self, query: Sequence[float], k: int, first: int = FIRST_LISTS) -> DataFrame:
        """The k nearest rows of all: lists are left out only if none of their rows can be one."""
        return self._best(self._rows(self.lists_needed(query, k, first)), query, k)

    def lists_needed(self, query: Sequence[float], k: int, first: int = FIRST_LISTS) -> list[int]:
        """The lists that may hold one of the k nearest rows."""
        unit = _unit(np.array([query], float))[0]
        products = self.centres @ unit
        reach = np.full(len(products), -np.inf)
        reaches = self.spark.read.parquet(f"{self.folder}/reach").groupBy("list").agg(F.max("reach").alias("reach"))
        for row in reaches.collect():
            reach[row.list] = row.reach
        bound = products + reach
        tried = np.argsort(-products, kind="stable")[:first]
        found = self._best(self._rows(tried), query, k).agg(F.count("score").alias("n"), F.min("score").alias("low")).first()
        low = found.low if found.n == k else -2.0
        # Scores are rounded, and bounds have the rounding errors of a few sums.
        return [int(n) for n in np.flatnonzero(bound >= low - 1e-8)]

