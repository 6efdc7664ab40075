"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) rows with u > v.

    Large-star links each larger neighbour of a node to the node's least neighbour, itself included; small-star links
    the smaller neighbours and the node itself to that least one. The least neighbour comes from a grouped minimum,
    which combines before the shuffle, so a hub never gathers its neighbours in one task.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of an edge table (a, b): component is the least id reachable.

    Self-links and rows with a null end are ignored; repeated links count once; an empty table gives an empty result.
    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = scratch.table(f"{tag}-0", now), None
    for i in range(1, max_rounds + 1):
        now = scratch.table(f"{tag}-{i}", _star(_star(now, large=True), large=False))
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        scratch.drop(f"{tag}-{i - 1}")
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).filter("id is not null").distinct()
    return ids.join(now.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
