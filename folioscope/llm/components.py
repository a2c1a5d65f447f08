"""Connected components of a table of links, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row.n, row.h


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Every linked node with the smallest node of its component: columns node, label.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the
    smaller ones, until every node hangs on its root. A round is a few aggregations that
    combine before they shuffle and joins whose one side has a row per node, so a node with
    very many links is split like any skewed join key. The loop keeps nothing on the driver
    but a count and a checksum of the links.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges = stored(edges.where("u <> v").distinct())
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.where("u <> v").distinct()
        root = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
