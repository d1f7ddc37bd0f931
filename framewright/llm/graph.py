"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_from

#: Shares of a hub's links at a join, rows of a partition, and links from which a node is a hub: fewer are one task's.
SALTS, PART_ROWS, HUB_ROWS = 64, 100_000, 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges (a, b) of comparable keys.

    Returns (node, component): component is the smallest key that the node reaches. Nodes are those on some edge;
    self loops are allowed and keep a node; edges with a null end are left out; an empty table gives an empty one.

    Alternates large-star and small-star steps until the edge set is a forest of stars, which it always becomes. Each step
    is one partial aggregation and one equi-join, in which hubs are split, and the rows never exceed the input's edges
    plus one row for each node.
    """
    edges = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    # A step has no more rows than the links and nodes there were at first.
    before, now = None, _state(links)
    while now != before:
        links = cut(_small_star(_large_star(links, now[0]), now[0]))
        before, now = now, _state(links)
    return (
        nodes.distinct()
        .join(links.select(F.col("a").alias("node"), "b"), "node", "left")
        .select("node", F.coalesce("b", "node").alias("component"))
    )


def _state(links: DataFrame) -> tuple[int, int | None]:
    """How many links there are, and a number that changes with them."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its rows need, however many the session deals out: the steps are many and small."""
    return df.coalesce(max(1, rows // PART_ROWS))


def _with_least(links: DataFrame, rows: int) -> DataFrame:
    """links (a, b) with m, the smallest b of their a. The m of a hub is repeated for SALTS shares, which b picks, so that
    a hub's links are not one task's; hot_from bounds the hubs."""
    least = _sized(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), rows)
    most = max(HUB_ROWS, hot_from(rows))
    if rows < most:  # too few links for any hub
        return _sized(links.join(least.drop("n"), "a"), rows)
    hub = F.col("n") >= most
    shares = F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    hubs = F.broadcast(least.where(hub).select("a", F.lit(True).alias("hub")))
    share = F.when(F.col("hub").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    dealt = links.join(hubs, "a", "left").select("a", "b", share.alias("share"))
    joined = dealt.join(least.select("a", "m", F.explode(shares).alias("share")), ["a", "share"])
    return _sized(joined.select("a", "b", "m"), rows)


def _pairs(links: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """The distinct (a, b) that the named columns of every row give."""
    each = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))
    return links.select(each.alias("p")).select("p.a", "p.b")


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours."""
    joined = _with_least(_pairs(links, ("a", "b"), ("b", "a")), 2 * rows).where("b > a")
    return _sized(joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), rows)


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    return _sized(_pairs(_with_least(links, rows), ("b", "m"), ("a", "m")).where("a <> b").distinct(), rows)
