"""Near-duplicate documents by MinHash bands, odd sketches and full sets.

1. A document's set of word n-grams gives `SAMPLES` MinHash values. They are cut into bands, whose
   keys are buckets, and folded into an odd sketch: every value flips one bit of a parity bitmap,
   so values that two documents share cancel out in the exclusive or of their bitmaps.
2. Equal sets become one node. Nodes of one bucket are candidates. The bits left in the exclusive
   or estimate the similarity; candidates far under the threshold go no further.
3. What is left is verified on the full sets.
4. In a group of thousands of near copies nodes share their buckets. A bucket's hub, the node with
   most neighbours, is tried with all others first. Then nodes of buckets that still hold different
   components are dealt to blocks of bounded size. Blocks that share a bucket meet; in them pairs of
   different components whose bitmaps are close are compared on their full sets, and a link comes
   out if it joins two components. A pair inside a component would add nothing to it, so the
   components are those of all candidates.

With 32 bands of 5 values a pair at a Jaccard of 0.85 misses all bands with a chance of 7e-9 (0.80:
3e-6), and the margin of the sketch is 6.5 deviations of the number of common values. Both are far
below what a test could see; no bucket is cut off and no candidate dropped for its number.

Sets are kept as 64-bit fingerprints of n-grams, equal sets recognised by one of the set.

Defined results: A-Z are lower-cased, words end at ASCII white space; a text with fewer words than
n is one n-gram; null, empty or blank texts have no n-grams, link with nothing and are their own
component; repeated rows are copies like any others; a null id is kept, it names no component;
other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm import common
from folioscope.llm.common import stored
from folioscope.llm.components import components
from folioscope.llm.jaccard import _sets as node_sets, set_print, shingle_sets

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 1024
#: Deviations of the number of common samples that the sketch allows below the threshold.
DEVIATIONS = 6.5
#: Nodes of a home bucket, and n-grams of theirs, that a block holds on average.
BLOCK_NODES, BLOCK_GRAMS = 512, 500_000
#: Nodes of a bucket whose sketches meet at a time, and rows of sketches that a task gets on average.
BUCKET_NODES, TASK_ROWS = 1024, 20_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = common.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP)
_FACTORS = common.mix(_SEEDS) | np.uint64(1)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of some sets that are not empty: a row per set, a column per function."""
    grams = np.concatenate(sets)
    starts = np.cumsum([0] + [len(grams) for grams in sets[:-1]])
    found = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        hashed = (grams ^ _SEEDS[k]) * _FACTORS[k]
        hashed ^= hashed >> np.uint64(29)
        hashed *= _STEP
        found[:, k] = np.minimum.reduceat(hashed, starts)
    return found


def bands(values: np.ndarray) -> np.ndarray:
    """One key for each band of values; bands of different places never share a key on purpose."""
    keys = np.tile(_SEEDS[:BANDS], (len(values), 1))
    for k in range(ROWS):
        keys = common.mix((keys + values[:, k::ROWS]) * _STEP)
    return keys


def sketches(values: np.ndarray) -> np.ndarray:
    """Odd sketches as 64-bit words: bit b is set if an odd number of values fall on b."""
    bit = common.mix(values + _SEEDS) % np.uint64(BITS)
    flat = bit.astype(np.int64) + np.arange(len(values))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(values) * BITS) & 1
    packed = np.packbits(odd.astype(np.uint8).reshape(len(values), BITS), axis=1)
    return packed.view(np.uint64)


def similarity(differing: np.ndarray | float) -> np.ndarray | float:
    """The similarity that a number of differing bits stands for."""
    share = np.minimum(2.0 * np.asarray(differing) / BITS, 1 - 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-share)


def most_differing(num: int, den: int) -> int:
    """Bits that the sketches of two sets at the threshold may differ in, with a wide margin."""
    share = num / den
    low = share - DEVIATIONS * math.sqrt(share * (1 - share) / SAMPLES)
    return int(np.flatnonzero(similarity(np.arange(BITS + 1)) >= low)[-1])


def _described(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Each document with its set's size and fingerprint, band keys and odd sketch."""
    names = ["id", "n", "sig", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                sizes = np.array([len(grams) for grams in sets], np.int64)
                sigs = np.array([set_print(grams) if len(grams) else 0 for grams in sets], np.uint64)
                # A set too small to differ in one n-gram is near equal ones only, which are one node.
                able = np.flatnonzero((den * sizes >= num * (sizes + 1)) & (sizes > 0))
                keys, bits = [[]] * len(sets), [[]] * len(sets)
                if len(able):
                    values = samples([sets[k] for k in able])
                    for k, key, sketch in zip(able, common.signed(bands(values)), common.signed(sketches(values))):
                        keys[k], bits[k] = key, sketch
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(sizes), pa.array(common.signed(sigs)),
                        pa.array(keys, longs), pa.array(bits, longs),
                    ],
                    names,
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(
        run, f"id {kind}, n long, sig long, bands array<long>, sketch array<long>"
    )


def _differing(one: str, other: str) -> Column:
    """Set bits in the exclusive or of two sketches."""
    apart = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x)


def _sizes_fit(one: str, other: str, num: int, den: int) -> Column:
    return F.least(one, other) * den >= F.greatest(one, other) * num


def _close(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and odd sketches allow the threshold."""
    for side in "ab":
        named = (F.col(c).alias(side if c == "sig" else f"{side}_{c}") for c in ("sig", "n", "sketch"))
        pairs = pairs.join(nodes.select(*named), side)
    close = _differing("a_sketch", "b_sketch") <= most_differing(num, den)
    return pairs.where(_sizes_fit("a_n", "b_n", num, den) & close).select("a", "b", "a_n", "b_n")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets are near, each compared once."""
    found = node_sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), texts, n)
    for side in "ab":
        pairs = pairs.join(found.select(F.col("sig").alias(side), F.col("grams").alias(f"{side}_grams")), side)
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    return pairs.where(shared * den >= (F.col("a_n") + F.col("b_n") - shared) * num).select("a", "b")


class _Groups:
    """Which components have been joined by the links found so far."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, label: int) -> int:
        while (up := self.above.get(label, label)) != label:
            self.above[label] = self.above.get(up, up)
            label = up
        return label

    def join(self, one: int, other: int) -> bool:
        one, other = self.find(one), self.find(other)
        if one != other:
            self.above[max(one, other)] = min(one, other)
        return one != other


def _close_places(
    part: pa.Table, one: np.ndarray, other: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places x < y of nodes of two blocks in different components whose sizes and sketches fit."""
    size, label = part.column("n").to_numpy(), part.column("label").to_numpy()
    bits = part.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
    most, same = most_differing(num, den), len(one) == len(other) and bool((one == other).all())
    found = [np.zeros((2, 0), np.int64)]
    for x in one:  # a row of the comparison at a time
        y = other[label[other] != label[x]]
        small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        y = y[small * den >= large * num]
        y = y[y > x] if same else y
        y = y[np.bitwise_count(bits[x] ^ bits[y]).sum(1) <= most]
        found.append(np.stack([np.full(len(y), x), y]))
    return tuple(np.concatenate(found, axis=1))


def _meetings(table: pa.Table, names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """A task's rows by meeting of two blocks (the columns named), with the places of both blocks."""
    table = table.sort_by([(name, "ascending") for name in names])
    keys = [table.column(name).to_numpy() for name in names]
    cuts = np.flatnonzero(np.any([key[1:] != key[:-1] for key in keys], axis=0)) + 1
    cuts = [0, *cuts.tolist(), table.num_rows]
    for first, last in zip(cuts[:-1], cuts[1:]):
        part = table.slice(first, last - first)
        block = part.column("block").to_numpy()
        sides = (np.flatnonzero(block == part.column(name)[0].as_py()) for name in ("low", "high"))
        yield part, *sides


def _near_others(num: int, den: int):
    """The nodes of a bucket that are close to one of another component."""

    def run(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)]
        for part, one, other in _meetings(table, ("key", "low", "high")):
            places = np.unique(np.concatenate(_close_places(part, one, other, num, den)))
            found.append(part.column("sig").to_numpy()[places])
        return pa.table({"sig": pa.array(np.unique(np.concatenate(found)))})

    return run


def shared_grams(column: pa.ListArray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers of common n-grams of the sets at some places with those at others."""
    grams, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    cells, often = np.unique(grams, return_inverse=True, return_counts=True)[1:]
    kept = often[cells] > 1
    rows, cells = rows[kept], np.unique(cells[kept], return_inverse=True)[1]
    order = np.argsort(cells, kind="stable")
    rows, cells = rows[order], cells[order]
    shared, width = np.zeros((len(one), len(other)), np.int64), 4096
    for at in range(0, int(cells[-1]) + 1 if len(cells) else 0, width):
        first, end = np.searchsorted(cells, [at, at + width])
        holds = np.zeros((len(sizes), width), np.float32)
        holds[rows[first:end], cells[first:end] - at] = 1
        shared += (holds[one] @ holds[other].T).astype(np.int64)
    return shared


def _met(num: int, den: int):
    """The links that two blocks add: close nodes of different components, compared on full sets.

    Links that join components already joined by one before add nothing and are left out, so a
    task gives fewer rows than it has nodes.
    """

    def meet(part: pa.Table, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
        x, y = _close_places(part, first, second, num, den)
        if not len(x):
            return []
        one, other = np.unique(x), np.unique(y)
        sets = part.column("grams").combine_chunks()
        shared = shared_grams(sets, one, other)[np.searchsorted(one, x), np.searchsorted(other, y)]
        size = sets.value_lengths().to_numpy().astype(np.int64)
        near = shared * den >= (size[x] + size[y] - shared) * num
        sig, label = part.column("sig").to_numpy(), part.column("label").to_numpy()
        groups = _Groups()
        return [
            (int(sig[i]), int(sig[j])) for i, j in zip(x[near], y[near]) if groups.join(int(label[i]), int(label[j]))
        ]

    def run(table: pa.Table) -> pa.Table:
        links = [link for meeting in _meetings(table, ("low", "high")) for link in meet(*meeting)]
        columns = list(zip(*links)) or [[], []]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip("ab", columns)})

    return run


def _active(mixed: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Nodes close to one of another component in a bucket, by sketches alone."""
    sizes = mixed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET_NODES).cast("int").alias("blocks"))
    number = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block")
    met = mixed.join(nodes.select("sig", "n", "sketch"), "sig").join(sizes, "key").select(
        "key", "sig", "label", "n", "sketch", number, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    rows = mixed.count()
    task = F.pmod(F.xxhash64("key", "low", "high"), F.lit(1 + rows // TASK_ROWS)).alias("task")
    return met.select("*", task).groupBy("task").applyInArrow(_near_others(num, den), "sig long").distinct()


def _between(
    posts: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, n: int, num: int, den: int
) -> DataFrame | None:
    """Links between nodes of one bucket that are in different components; None if there are none.

    First the sketches tell which nodes are close to one of another component; only those go on. A
    home is a full bucket that a node or a neighbour of it is in, so near copies are at home in a
    few. A home's nodes are dealt to blocks of bounded size; two blocks meet if a bucket has nodes
    of both.
    """
    labelled = posts.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "sig"))
    buckets = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    mixed = stored(labelled.join(buckets.select("key"), "key"))
    mixed = stored(mixed.join(_active(mixed, nodes, num, den), "sig", "left_semi"))
    if mixed.isEmpty():
        return None
    fullest = F.max(F.struct("many", "key")).alias("place")
    places = mixed.join(mixed.groupBy("sig").agg(fullest), "sig")
    places = mixed.join(places.groupBy("key").agg(F.max("place").alias("place")), "key")
    homes = places.groupBy("sig", "label").agg(F.max("place").alias("place"))
    homes = homes.select("sig", "label", F.col("place.key").alias("home"))
    homes = stored(homes.join(nodes.select("sig", "n", "sketch"), "sig"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_GRAMS)).cast("int")
    number = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    placed = homes.join(homes.groupBy("home").agg(blocks.alias("blocks")), "home")
    placed = stored(placed.select("sig", "label", "n", "sketch", F.xxhash64("home", number).alias("block")))
    # Blocks of a bucket: a few, as a block holds up to BLOCK_NODES of its nodes.
    held = mixed.select("key", "sig").join(placed.select("sig", "block"), "sig")
    held = held.groupBy("key").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    low = held.select("blocks", F.posexplode("blocks").alias("at", "low"))
    pairs = low.select("low", F.explode(F.expr("slice(blocks, at + 1, size(blocks))")).alias("high")).distinct()
    grams = node_sets(placed.select("sig"), texts, n)
    weight = placed.groupBy("block").agg((F.sum("n") + F.count(F.lit(1))).alias("weight"))
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    sides = stored(sides)
    total = sides.join(weight, "block").agg(F.sum("weight").alias("total")).first().total
    task = F.pmod(F.xxhash64("low", "high"), F.lit(1 + total // BLOCK_GRAMS)).alias("task")
    rows = sides.join(placed, "block").join(grams, "sig").select("*", task)
    return rows.groupBy("task").applyInArrow(_met(num, den), "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (its component's smallest id) and kept.

    Two documents link when den * intersection >= num * union of their sets of n-grams. A document
    is kept if it has its component's id.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    described = stored(_described(texts, n, num, den))
    nodes = stored(
        described.where(F.size("bands") > 0).select("sig", "n", "bands", "sketch").dropDuplicates(["sig"])
    )
    posts = nodes.select("sig", F.explode("bands").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    posts = stored(posts.join(shared, "key"))
    # The node with most neighbours in its buckets is near more of them than the others.
    worth = posts.groupBy("sig").agg(F.sum("many").alias("worth"))
    ranked = stored(posts.join(worth, "sig"))
    hubs = ranked.groupBy("key").agg(F.max(F.struct("worth", "sig")).alias("hub"))
    tried = ranked.join(hubs, "key").select("sig", F.col("hub.sig").alias("hub")).where("sig <> hub")
    tried = tried.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b")).distinct()
    pairs = stored(_close(tried, nodes, num, den))
    links = stored(_verified(pairs, texts, n, num, den))
    labels = components(links)
    # In a bucket of two nodes the only pair holds the hub.
    more = _between(posts.where("many > 2"), nodes, labels, texts, n, num, den)
    if more is not None:
        labels = components(links.unionByName(more))
    return _named(described, labels, doc_id)


def _named(described: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """Every document with its component's smallest id."""
    rows = described.select("id", F.col("n").alias("n_shingles"), "sig")
    held = rows.where("n_shingles > 0").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    held = held.withColumn("label", F.coalesce("label", "sig"))
    # Stored, so that the join below is one of two plain tables, whose hot keys Spark splits.
    smallest = stored(held.groupBy("label").agg(F.min("id").alias("component_id")))
    named = held.join(smallest, "label").select("id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return named.unionByName(alone).select(F.col("id").alias(doc_id), "n_shingles", "component_id", kept)
