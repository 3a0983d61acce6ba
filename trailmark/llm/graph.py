"""Connected components of an edge table by alternating star contraction, as joins and minima over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds grow with the logarithm of the longest chain; this many stand for chains beyond any input.
MAX_ROUNDS = 60


def _toward_minimum(arcs: DataFrame) -> DataFrame:
    """arcs (key, other): every key and its others are tied to the least of them. Only minima are gathered, never the others of a key."""
    least = arcs.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("least"))
    return arcs.join(least, "key")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, component): component is the least node that can be reached. Loops and repeated edges are allowed; nodes without an edge do not appear. An empty table gives an empty result."""
    links = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.select(F.col("hi").alias("key"), F.col("lo").alias("other")).unionByName(links.select(F.col("lo").alias("key"), F.col("hi").alias("other")))
        large = _toward_minimum(both).where("other > key").select(F.col("other").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        star = _toward_minimum(large.select(F.col("hi").alias("key"), F.col("lo").alias("other")))
        small = star.select(F.explode(F.array(F.struct(F.col("other").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("key").alias("hi"), F.col("least").alias("lo")))).alias("e")).select("e.*")
        links = written(small.where("hi <> lo").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
