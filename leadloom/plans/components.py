"""Connected components as alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.plans.storage import BROADCAST_IDS, materialise


def _narrow(df: DataFrame, few: bool) -> DataFrame:
    """A table of few rows in as many tasks as there are cores: more would take longer to start than to run."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if few else df


def _with_least(pairs: DataFrame, few: bool) -> DataFrame:
    """(u, v, least): every pair with the least v of its u.

    Of few pairs the least are broadcast; else both sides are shuffled, and a hub's rows are split by the adaptive skew
    join.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(F.broadcast(_narrow(least, few)) if few else least, "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, few).withColumn("least", F.least("u", "least"))
    return _narrow(linked.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct(), few)


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    linked = _with_least(edges, few)
    moved = linked.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return _narrow(moved.unionByName(linked.select("u", F.col("least").alias("v"))).distinct(), few)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the least node id reachable.

    ``edges`` holds two long columns, in any direction, repeats and self-links allowed; nulls are dropped. Each round
    is two aggregations and two joins, cut by a table in the shared folder. Rounds grow with the logarithm of the
    longest chain, not with its length. Pairs are counted in each round: up to ``BROADCAST_IDS`` are joined by broadcasts
    in few tasks. Nodes without links are not returned.
    """
    pairs = (
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .filter("u <> v")
        .distinct()
    )
    pairs = materialise(pairs, "edges")
    seen, n = None, pairs.count()
    for _ in range(max_rounds):
        few = n <= BROADCAST_IDS
        pairs = materialise(_small_star(_large_star(pairs, few), few), "stars")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
