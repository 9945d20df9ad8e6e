"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress.storage import settle


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Labels every node that occurs in an edge with the smallest node it can reach.

    edges: pairs of long ids; direction, repeats and self loops don't matter, pairs with a null are ignored.
    Returns (node, component). Nodes without an edge to another node aren't returned.
    Each round links every node's larger neighbours to the smallest node of its neighbourhood (large star), then
    does the same with its smaller ones (small star); the number of rounds is logarithmic in the size of a
    component. No neighbourhood is ever collected: minima are aggregated and joined back.
    """
    pairs = (
        edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = settle(pairs, "edges")
    if state.isEmpty():
        return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        state = settle(_small_star(_large_star(state)), "edges")
        mark = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return label.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")  # read back, so that hubs' joins can be split
    return (
        both.where("v > u").join(low.hint("shuffle_merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Here every edge points from the larger node u to the smaller node v."""
    low = settle(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = edges.join(low.hint("shuffle_merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).select("u", "v").distinct()
