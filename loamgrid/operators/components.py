"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable, evenly


#: Up to so many edges, which are counted each round, minima are broadcast: two longs for each node at most.
BROADCAST_EDGES = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """(hi, m): the smallest neighbour below each node that has one."""
    return edges.groupBy("hi").agg(F.min("lo").alias("m"))


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or stay with a node that has none below."""
    below = (F.broadcast(_least(edges)) if small else evenly(_least(edges), "hi")).withColumnRenamed("hi", "at")
    return edges.join(below, F.col("lo") == F.col("at"), "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    least = _least(edges)
    moved = edges.join(F.broadcast(least) if small else evenly(least, "hi"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is its smallest member.

    Two star contractions a round; the number of rounds grows with the logarithm of the longest
    shortest path. Every round is checkpointed; only one count and one hash reach the driver.
    A hub's edges meet only in minima with partial results and in joins that the skew join can split.
    Self loops keep their node as a component of one; null ends are ignored; repeated edges count once.
    """
    clean = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    once = durable(clean.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct())
    loops, stars = once.where("hi = lo").select(F.col("hi").alias("node")), once.where("hi <> lo")
    before = _state(stars)
    for _ in range(max_rounds):
        if not before[0]:
            break
        small = before[0] <= BROADCAST_EDGES
        stars = durable(_small_star(_large_star(stars, small), small))
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    alone = loops.select("node", F.col("node").alias("component"))
    return leaves.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
