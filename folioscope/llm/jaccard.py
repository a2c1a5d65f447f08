"""Exact Jaccard join of documents on word n-grams, down to its connected components.

1. All n-grams of all documents are counted in a sketch of fixed size. It gives one global
   order, rare n-grams first (any total order gives the same links; a rarer one gives fewer
   candidates).
2. Equal sets become one node. A node keeps its prefix in that order: a link needs a common
   n-gram in the prefixes, whose length follows from the threshold.
3. Nodes that share a prefix n-gram are candidates if lengths, positions of the shared n-gram
   and the suffix bound allow the threshold; each pair is verified once on the full sets.
4. A group of thousands of near copies shares its n-grams. Instead of all its pairs, one hub
   per n-gram, the node with the fewest n-grams of its own, is joined with the others first.
   Then only pairs whose nodes are still in different components are joined, and of these never
   two of the n-gram's largest component. A link is left out only if its ends are already
   connected, so the components are exact.
5. `near_pairs` and `near_links` give all links, those inside a component too. Both ends of a
   link are in one component, so the nodes of a large component are dealt to blocks of bounded
   size by a hash. A node goes only to meetings with blocks that hold one of its prefix n-grams.
   Where two blocks meet, the pairs that share a prefix n-gram and pass the length and positional
   filters are verified on the full sets. Each pair meets once; pairs are not made as rows unless
   they are asked for, and no set is read from the texts again.

Sets are kept as 64-bit fingerprints of n-grams; equal sets are recognised by a 64-bit
fingerprint of the set with its size.

Defined results: A-Z are lower-cased, words end at ASCII white space; a text with fewer words
than n is one n-gram; null, empty or blank texts have no n-grams, link with nothing and are
their own component; repeated rows are linked like any copies; a null id is kept, it names no
component; other columns of the input are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm import common
from folioscope.llm.common import stored
from folioscope.llm.components import components

#: Parts of the fingerprint range whose counts bound the overlap of two sets (suffix filter).
PARTS = 32
#: Bits of the map that says which nodes' sets a verification needs; 2 MB, whatever the input.
MAP_BITS = 24

#: Nodes of a component, and n-grams of theirs, that a block holds on average.
BLOCK_NODES, BLOCK_GRAMS = 3072, 1_000_000
#: N-grams in as many sets of a meeting are multiplied as columns, the others paired set by set.
HEAVY, WIDTH = 64, 4096

#: Rows of the list of documents that leave, about 80 bytes each, that may go to every task.
BROADCAST_ROWS = 200_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """For each row its distinct n-grams, sorted by fingerprint."""
    prints, rows = common.words(column, common.SPACED)
    grams = np.zeros(0, np.uint64)
    if len(prints) >= n:
        last = len(prints) - n + 1
        grams = np.zeros(last, np.uint64)
        for k in range(n):
            grams = (grams + prints[k : k + last]) * _STEP
        grams = common.mix(grams)
    sets = []
    for first, end in zip(rows[:-1], rows[1:]):
        if end - first >= n:
            sets.append(np.unique(grams[first : end - n + 1]))
        elif end > first:
            total = np.array([end - first], np.uint64)
            for word in prints[first:end]:
                total = common.mix((total + word) * _STEP)
            sets.append(total)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_print(grams: np.ndarray) -> np.uint64:
    total = np.array([len(grams)], np.uint64) * _STEP + grams.sum(dtype=np.uint64)
    return common.mix(total ^ np.bitwise_xor.reduce(common.mix(grams)))[0]


def _at_least(num: int, den: int, size: np.ndarray | int):
    """The smallest whole number not under num / den of a size."""
    return -(-num * size // den)


def _column_at_least(num: int, den: int, size: Column) -> Column:
    """The same for a column of whole numbers."""
    return ((size * num + (den - 1)) / den).cast("long")


def gram_order(texts: DataFrame, n: int) -> np.ndarray:
    """Ranks of the counts of all n-grams of all texts, in cells: the global order."""

    def count(batches):
        total = np.zeros(1 << common.SKETCH_BITS, np.int32)
        for batch in batches:
            for part in common.blocks(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                cells = common.sketch_cells(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                total += np.bincount(cells, minlength=len(total)).astype(np.int32)
        yield from common.sketch_rows(total)

    return common.collect_ranks(texts.select("text").mapInArrow(count, common.SKETCH_SCHEMA))


def _prefixes(texts: DataFrame, order: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Each document with its set's size and fingerprint, its prefix and the counts by part.

    `worth` is the mean rank of the prefix: of near copies, those with the fewest n-grams of
    their own have the largest.
    """
    sent = texts.sparkSession.sparkContext.broadcast(order)
    names = ["id", "n", "sig", "worth", "parts", "prefix"]

    def run(batches):
        ranks = sent.value
        for batch in batches:
            for part in common.blocks(batch, "text"):
                sizes, sigs, worths, hists, prefixes = [], [], [], [], []
                for grams in shingle_sets(part.column("text"), n):
                    size = len(grams)
                    sizes.append(size)
                    sigs.append(int(common.signed(np.array([set_print(grams)]))[0]) if size else 0)
                    # No other set can be near one that is too small to differ in one n-gram.
                    keep = size - _at_least(num, den, size) + 1 if den * size >= num * (size + 1) else 0
                    rank = ranks[common.sketch_cells(grams)]
                    first = np.lexsort((grams, rank))[:keep]
                    worths.append(int(rank[first].mean() * 16) if keep else 0)
                    prefixes.append(common.signed(grams[first]))
                    hists.append(
                        np.bincount((grams & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) if keep else []
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()),
                        pa.array(worths, pa.int32()), pa.array(hists, pa.list_(pa.int32())), pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names,
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(
        run, f"id {kind}, n long, sig long, worth int, parts array<int>, prefix array<long>"
    )


def _near(a_n: Column, a_pos: Column, b_n: Column, b_pos: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes with a first common n-gram at these positions can be near."""
    swap = a_n > b_n
    small, large = F.least(a_n, b_n), F.greatest(a_n, b_n)
    small_pos, large_pos = F.when(swap, b_pos).otherwise(a_pos), F.when(swap, a_pos).otherwise(b_pos)
    need = _column_at_least(num, num + den, small + large)
    # The shorter set needs a shorter prefix: the overlap is at least 2t / (1 + t) of its size.
    index = small - _column_at_least(2 * num, num + den, small) + 1
    return (
        (small * den >= large * num)
        & ((small_pos < index) | ((small == large) & (large_pos < index)))
        & (F.least(small - small_pos, large - large_pos) >= need)
    )


def _pair(frame: DataFrame, one: str, other: str) -> DataFrame:
    """Two columns of nodes as (a, b), a < b, each pair once."""
    a, b = F.least(one, other).alias("a"), F.greatest(one, other).alias("b")
    return frame.where(F.col(one) != F.col(other)).select(a, b).distinct()


def _bounded(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Suffix filter: the overlap cannot exceed the common counts of the parts."""
    slim = nodes.select("sig", "n", "parts")
    both = pairs
    for side in "ab":
        both = both.join(
            slim.select(*(F.col(c).alias(side if c == "sig" else f"{side}_{c}") for c in slim.columns)), side
        )
    most = F.aggregate(
        F.zip_with("a_parts", "b_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x
    )
    need = _column_at_least(num, num + den, F.col("a_n") + F.col("b_n"))
    return both.where(most >= need).select("a", "b", "a_n", "b_n")


def _sets(wanted: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The full sets of some nodes (column sig), each once."""
    sent = texts.sparkSession.sparkContext.broadcast(_node_map(wanted))

    def sets(batches):
        bits = sent.value
        for batch in batches:
            for part in common.blocks(batch, "text"):
                sigs, rows = [], []
                for grams in shingle_sets(part.column("text"), n):
                    if len(grams) > 1:
                        sig = set_print(grams)
                        cell = int(sig >> np.uint64(64 - MAP_BITS))
                        if bits[cell >> 3] >> (cell & 7) & 1:
                            sigs.append(int(np.array([sig]).view(np.int64)[0]))
                            rows.append(common.signed(grams))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["sig", "grams"]
                )

    found = texts.select("text").mapInArrow(sets, "sig long, grams array<long>")
    return stored(found.join(wanted, "sig", "left_semi").dropDuplicates(["sig"]))


def _verified(
    pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int
) -> tuple[DataFrame, DataFrame]:
    """The pairs whose sets really are near, each compared once on the full sets; and the sets."""
    found = _sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), texts, n)
    both = pairs.join(found.select(F.col("sig").alias("a"), F.col("grams").alias("ga")), "a")
    both = both.join(found.select(F.col("sig").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    near = both.where(shared * den >= (F.col("a_n") + F.col("b_n") - shared) * num)
    return near.select("a", "b"), found


def _node_map(wanted: DataFrame) -> np.ndarray:
    """A bit for each cell of node fingerprints that holds a wanted node."""
    rows = wanted.select(F.shiftrightunsigned("sig", 64 - MAP_BITS).alias("cell"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    packed = rows.groupBy(F.shiftright("cell", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(cell & 7 as int))")).alias("mask")
    )
    blocks = packed.groupBy(F.shiftright("byte", 12).alias("block")).agg(
        F.collect_list(F.struct("byte", "mask")).alias("cells")
    )
    for row in blocks.toLocalIterator():
        for byte, mask in row.cells:
            bits[byte] = mask
    return bits


class _Lists:
    """The lists of n-grams of a meeting's nodes, turned round: which nodes hold an n-gram."""

    def __init__(self, column: pa.ListArray):
        grams, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
        nodes = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((nodes, grams))
        grams, nodes, places = grams[order], nodes[order], places[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        often = np.diff(np.append(first, len(grams)))
        cell, count = np.repeat(np.arange(len(often)), often), np.repeat(often, often)
        rare = (count > 1) & (count < HEAVY)
        self.cell, self.node, self.place = cell[rare], nodes[rare], places[rare]
        heavy = count >= HEAVY
        self.heavy_node, self.heavy_place = nodes[heavy], places[heavy]
        self.heavy_cell = np.unique(cell[heavy], return_inverse=True)[1]

    def rare_pairs(self):
        """Places of two entries of one rare n-gram, the smaller node first; each pair once."""
        for step in range(1, HEAVY):
            left = np.flatnonzero(self.cell[step:] == self.cell[:-step])
            if not len(left):
                return
            yield left, left + step

    def heavy(self):
        """Nodes, and places in their lists, of every heavy n-gram."""
        ends = np.searchsorted(self.heavy_cell, np.arange(1 + int(self.heavy_cell.max(initial=-1))), "right")
        return zip(np.split(self.heavy_node, ends[:-1]), np.split(self.heavy_place, ends[:-1])) if len(ends) else ()


def _possible(a_n, a_pos, b_n, b_pos, num: int, den: int) -> np.ndarray:
    """`_near` for arrays: sizes, and positions of a common n-gram, that allow the threshold."""
    swap = a_n > b_n
    small, large = np.minimum(a_n, b_n), np.maximum(a_n, b_n)
    small_pos, large_pos = np.where(swap, b_pos, a_pos), np.where(swap, a_pos, b_pos)
    index = small - _at_least(2 * num, num + den, small) + 1
    return (
        (small * den >= large * num)
        & ((small_pos < index) | ((small == large) & (large_pos < index)))
        & (np.minimum(small - small_pos, large - large_pos) >= _at_least(num, num + den, small + large))
    )


def _candidates(prefixes: pa.ListArray, size: np.ndarray, split: int, num: int, den: int) -> np.ndarray:
    """Which of the nodes before `split` (rows) can be near which behind it (columns)."""
    total, lists = len(size), _Lists(prefixes)
    able = np.zeros((split, total - split), bool)
    for left, right in lists.rare_pairs():
        a, b = lists.node[left], lists.node[right]
        across = (a < split) & (b >= split)
        left, right, a, b = left[across], right[across], a[across], b[across]
        fits = _possible(size[a], lists.place[left], size[b], lists.place[right], num, den)
        able[a[fits], b[fits] - split] = True
    for nodes, places in lists.heavy():
        middle = np.searchsorted(nodes, split)
        a, b = nodes[:middle], nodes[middle:]
        block = np.ix_(a, b - split)
        if len(a) and len(b) and not able[block].all():
            able[block] |= _possible(
                size[a][:, None], places[:middle][:, None], size[b], places[middle:], num, den
            )
    return able


def _common(sets: pa.ListArray, split: int, able: np.ndarray) -> np.ndarray:
    """Numbers of common n-grams of the nodes before `split` with those behind it, where able."""
    lists = _Lists(sets)
    shared = np.zeros(able.shape, np.float32)
    for left, right in lists.rare_pairs():
        a, b = lists.node[left], lists.node[right]
        across = (a < split) & (b >= split)
        a, b = a[across], b[across] - split
        here = able[a, b]
        np.add.at(shared, (a[here], b[here]), 1)
    for at in range(0, int(lists.heavy_cell.max(initial=-1)) + 1, WIDTH):
        first, end = np.searchsorted(lists.heavy_cell, [at, at + WIDTH])
        holds = np.zeros((len(sets), min(WIDTH, int(lists.heavy_cell[end - 1]) + 1 - at)), np.float32)
        holds[lists.heavy_node[first:end], lists.heavy_cell[first:end] - at] = 1
        shared += holds[:split] @ holds[split:].T
    return shared.astype(np.int64)  # sums of ones: exact


def _meet(num: int, den: int, pairs: bool):
    """All links of two blocks of a component: as pairs, or added up for each node by copies."""

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        block = table.column("block").to_numpy()
        # A block that meets itself is taken twice; a pair counts where its first node is earlier.
        one, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
        table, split = table.take(np.append(one, other)), len(one)
        sigs, copies = table.column("sig").to_numpy(), table.column("copies").to_numpy()
        sets, prefixes = (table.column(c).combine_chunks() for c in ("grams", "prefix"))
        size = sets.value_lengths().to_numpy().astype(np.int64)
        able = _candidates(prefixes, size, split, num, den)
        if low == high:
            able = np.triu(able, 1)
        shared = _common(sets, split, able)
        near = able & (shared * den >= (size[:split, None] + size[split:] - shared) * num)
        if pairs:
            a, b = np.nonzero(near)
            a, b = sigs[a], sigs[split:][b]
            return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
        linked = np.append(near @ copies[split:], near.T @ copies[:split])
        return pa.table({"sig": pa.array(sigs), "linked": pa.array(linked)})

    return run


def _met(found: "_Found") -> DataFrame:
    """Nodes of components with their sets, grouped by component and two blocks that meet.

    A component of one block, as nearly all are, meets once. In others a node goes to the blocks
    where a prefix n-gram of its own occurs, so a long chain of nodes is not compared with itself
    throughout.
    """
    placed = stored(found.nodes.join(found.labels.withColumnRenamed("node", "sig"), "sig"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_GRAMS)).cast("int")
    # A row for each component of several blocks only: fewer than nodes by the size of a block.
    large = stored(placed.groupBy("label").agg(blocks.alias("blocks")).where("blocks > 1"))
    dealt = placed.join(large, "label", "left").withColumn(
        "block", F.pmod(F.xxhash64("sig"), F.coalesce("blocks", F.lit(1))).cast("int")
    )
    dealt = stored(dealt.select("label", "sig", "copies", "prefix", "block", F.col("blocks").isNotNull().alias("several")))
    posts = dealt.where("several").select("label", "sig", "block", F.explode("prefix").alias("gram"))
    where = posts.groupBy("label", "gram").agg(F.array_sort(F.collect_set("block")).alias("places"))
    where = stored(where.where(F.size("places") > 1))
    routes = posts.join(where, ["label", "gram"]).groupBy("sig").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places")
    )
    own = F.array("block")
    others = F.explode(F.array_union(own, F.coalesce("places", own))).alias("other")
    routed = dealt.join(stored(routes), "sig", "left").join(found.sets.dropDuplicates(["sig"]), "sig")
    met = routed.select("label", "sig", "copies", "prefix", "grams", "block", others)
    return met.select(
        "label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "sig", "copies", "prefix", "grams",
    ).groupBy("label", "low", "high")


def near_pairs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as pairs of nodes (a, b), each once; and a row per document
    with its id, n_shingles and node, null without n-grams. Documents of one node link as well."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = _labelled(texts, n, num, den)
    pairs = _met(found).applyInArrow(_meet(num, den, True), "a long, b long")
    node = F.when(F.col("n") > 0, F.col("sig")).alias("node")
    return pairs, found.members.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), node)


def near_links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """The rows of `near_components` with n_links, the number of other documents linked with each."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = _labelled(texts, n, num, den)
    linked = _met(found).applyInArrow(_meet(num, den, False), "sig long, linked long")
    linked = linked.groupBy("sig").agg(F.sum("linked").alias("linked"))
    # Sets too small to be near another one are no nodes, but have copies.
    copies = found.members.where("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("copies"))
    n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0).cast("long"))
    counts = copies.join(linked, "sig", "left").select("sig", n_links.alias("n_links"))
    labels = found.labels.withColumnRenamed("node", "sig")
    # One stored row for each set, so that documents meet it in one join of two plain tables.
    return _named(found.members, stored(counts.join(labels, "sig", "left")), doc_id)


def near_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """One row per document: id, n_shingles and component_id, its component's smallest id.

    Two documents link when den * intersection >= num * union of their sets of n-grams.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = _labelled(texts, n, num, den)
    return _named(found.members, found.labels.withColumnRenamed("node", "sig"), doc_id)


class _Found(NamedTuple):
    """What the join gives; all tables are stored."""

    members: DataFrame  # the documents with their nodes
    nodes: DataFrame  # the sets that can be near others, with their copies and prefixes
    labels: DataFrame  # every linked node with its component's label
    sets: DataFrame  # the full sets of all linked nodes and more; a node may come twice


def _labelled(texts: DataFrame, n: int, num: int, den: int) -> _Found:
    """Documents, nodes, and the components of the nodes."""
    members = stored(_prefixes(texts, gram_order(texts, n), n, num, den))
    nodes = stored(
        members.where(F.size("prefix") > 0)
        .groupBy("sig").agg(
            *(F.first(c).alias(c) for c in ("n", "worth", "parts", "prefix")), F.count(F.lit(1)).alias("copies")
        )
    )
    # A post is a node's prefix n-gram; size and position travel in one number.
    posts = nodes.select("worth", "sig", "n", F.posexplode("prefix").alias("pos", "gram"))
    posts = posts.select("gram", "worth", "sig", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    hubs = posts.groupBy("gram").agg(
        F.count(F.lit(1)).alias("many"), F.max(F.struct("worth", "sig", "at")).alias("hub")
    )
    hubs = hubs.where("many > 1").select(
        "gram", "many", F.col("hub.sig").alias("hub"), F.col("hub.at").alias("hub_at")
    )
    shared = stored(posts.drop("worth").join(hubs, "gram"))

    def near(one: str, other: str) -> Column:
        (a_n, a_pos), (b_n, b_pos) = (
            (F.shiftright(c, 32), F.col(c).bitwiseAND((1 << 32) - 1)) for c in (one, other)
        )
        return _near(a_n, a_pos, b_n, b_pos, num, den)

    tried = _pair(shared.where(near("at", "hub_at")), "sig", "hub")
    pairs = stored(_bounded(tried, nodes, num, den))
    links, sets = _verified(pairs, texts, n, num, den)
    links = stored(links)
    labels = components(links)

    # N-grams of two nodes are settled: their only pair holds the hub.
    rest = shared.where("many > 2").select("gram", "at", F.col("sig").alias("node"))
    rest = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rest.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("gram").agg(
        F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")
    )
    largest = largest.where("kinds > 1").select("gram", F.col("top.label").alias("top"))
    mixed = stored(rest.join(largest, "gram"))
    others = mixed.where("label <> top").select(
        "gram", F.col("at").alias("other_at"), F.col("node").alias("other"), F.col("label").alias("other_label")
    )
    apart = mixed.join(others, "gram").where(
        (F.col("label") != F.col("other_label")) & near("at", "other_at")
    )
    more = _bounded(_pair(apart, "node", "other").join(pairs, ["a", "b"], "left_anti"), nodes, num, den)
    more = stored(more)
    if not more.isEmpty():
        late, found = _verified(more, texts, n, num, den)
        links, sets = links.unionByName(late), sets.unionByName(found)
        labels = components(links)
    return _Found(members, nodes, labels, sets)


def _named(members: DataFrame, marks: DataFrame, doc_id: str) -> DataFrame:
    """Every document with its component's smallest id, and n_links if the marks of sets have it."""
    more = ["n_links"] if "n_links" in marks.columns else []
    named = members.where("n > 0").join(marks, "sig", "left")
    named = named.select("id", "n", *more, F.coalesce("label", "sig").alias("label"))
    # Stored, so that the join below is one of two plain tables, whose hot keys Spark splits.
    smallest = stored(named.groupBy("label").agg(F.min("id").alias("component_id")))
    none = [F.lit(0).cast("long").alias(name) for name in more]
    alone = members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), *none)
    return (
        named.join(smallest, "label")
        .select("id", F.col("n").alias("n_shingles"), "component_id", *more)
        .unionByName(alone)
        .withColumnRenamed("id", doc_id)
    )


def distinct_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """The documents, with one of each component: that of the smallest id.

    Rows with one id and different texts are told apart by their texts; of rows equal in both
    one stays. Texts without words stay.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.md5(text).alias("digest"))
    near = near_components(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", n, num, den)
    marks = near.where("n_shingles > 0").groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.first("component_id").alias("first")
    )
    leave = ~F.col("key").eqNullSafe(F.col("first"))
    marks = stored(
        marks.where(leave | (F.col("copies") > 1)).select(F.col("key").alias("mark"), leave.alias("leave"))
    )
    # A short list goes to the documents; a long one meets them in a shuffle.
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    # Rows travel in a struct, so no column of theirs can be taken for one of the marks.
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    same = [F.col(f"key.{part}").eqNullSafe(F.col(f"mark.{part}")) for part in ("id", "digest")]
    marked = rows.join(marks, same[0] & same[1], "left")
    kept = marked.where("leave is null")
    if not marks.where("not leave").isEmpty():
        kept = kept.unionByName(marked.where("not leave").dropDuplicates(["key"]))
    return kept.select("row.*")
