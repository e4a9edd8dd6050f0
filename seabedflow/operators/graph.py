"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import drop_tables as release
from ..plans.store import shared_table as durable


def components(edges: DataFrame, tag: str = "cc", rounds: int = 50) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)``: one row ``(id, component)`` for each end.

    Alternates large-star and small-star steps, each a shuffle on the node, until the edges are stars
    around the smallest id of each component. ``a`` and ``b`` are longs. The edges stay a table; the driver
    sees two sums of it in each round. The number of rounds grows with the logarithm of the longest
    chain; running out of ``rounds`` raises.
    """

    def clean(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(r)

    cur = durable(clean(edges), f"{tag}-edges")
    nodes = durable(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{tag}-nodes")
    before = mark(cur)
    for _ in range(rounds):
        # large star: each larger neighbour gets the smallest node of the neighbourhood
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur2 = durable(clean(large), f"{tag}-large")
        release(cur)
        # small star: the smaller neighbours and the node itself get the smallest of them
        low = cur2.groupBy("a").agg(F.min("b").alias("m"))
        small = cur2.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = durable(clean(small), f"{tag}-small")
        release(cur2)
        now = mark(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = nodes.join(cur.select(F.col("a").alias("id"), F.col("b").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))
    return out
