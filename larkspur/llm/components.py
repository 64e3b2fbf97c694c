"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._common import cut


#: A node with more than this share of all links, and more than LINKS of them, is a hub; there are fewer than 2 / SHARE.
SHARE, LINKS = 1 / 2048, 256


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _with_least(edges: DataFrame, of: DataFrame, links: float) -> DataFrame:
    """a, b of ``edges`` and m, the least b that ``of`` has for a.

    Links of hubs, which one key would lead to one task, stay where they are and get m by broadcast.
    """
    least = of.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_links"))
    hubs = least.where(F.col("_links") > links).select(F.col("a").alias("_hub"), F.col("m").alias("_m"))
    rest = least.where(F.col("_links") <= links).select(F.col("a").alias("_n"), "m")
    told = edges.join(F.broadcast(hubs), F.col("a") == F.col("_hub"), "left")
    few = told.where("_hub is null").join(rest, F.col("a") == F.col("_n")).select("a", "b", "m")
    return few.union(told.where("_hub is not null").select("a", "b", F.col("_m").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b); nodes without a link are not returned.

    Each round joins every node's neighbours to the smallest of them; a round only
    aggregates and joins on the node, so no neighbourhood is held in memory, and
    hubs' links are joined by broadcast, so none is one task's. The
    number of rounds follows the logarithm of the largest component.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = max(LINKS, SHARE * before[0])
        large = _with_least(both, both, links).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = _with_least(large, large, links)
        small = low.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
