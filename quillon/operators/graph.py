"""Connected components of a graph of pairs, and running places, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.shared import kept, shuffled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with the least node of u's neighbours: least is written, so both sides of the join are plain shuffles
    and Spark can split a hub's pairs."""
    return pairs.join(shuffled(kept(least, "least")), "u")


def components(edges: DataFrame, each: Callable[[int, DataFrame], None] = lambda step, pairs: None) -> DataFrame:
    """(node, component): the component of each node of ``edges`` (a, b) is its smallest node.

    Alternating stars: each node ties its larger neighbours to the smallest one (large star), then its smaller ones and
    itself (small star), until every component is one star. Paths halve, so rounds grow with the logarithm of the
    longest one; a round exchanges the pairs twice. ``each`` is told of every round. Nulls are no nodes; self-pairs give
    a node of its own. No edges give no rows.
    """
    given = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    tied = kept(given.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    before, step = _state(tied), 0
    while before[0]:
        both = tied.unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = _star(tied.select(F.col("v").alias("u"), F.col("u").alias("v")), least).select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()  # v > u here
        large = kept(large.filter("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("w"))  # all v are smaller
        tied_up = _star(large, least).filter(F.col("v") != F.col("w")).select(F.col("v").alias("u"), F.col("w").alias("v"))
        tied = kept(tied_up.unionByName(least.select("u", F.col("w").alias("v"))).distinct(), "pairs")
        step += 1
        each(step, tied)
        after = _state(tied)
        if after == before:
            break
        before = after
    return nodes.join(shuffled(tied.select(F.col("u").alias("node"), F.col("v").alias("component"))), "node", "left").withColumn("component", F.coalesce("component", "node"))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """df with the place (from 0) of each row among those of its keys, in the given order, without one task for a key:
    rows are sorted in ranges of keys and order, and each range's first place comes from the counts of those before it.
    df needs columns that make the order total, else equal rows get their places in any order."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    placed = kept(ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__id", 33)), "ranged")
    # a row for each key in each range that it reaches into: keys and ranges together, not rows
    counts = placed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", earlier).drop("__n")
    safe = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__range"]]
    on = safe[0]
    for c in safe[1:]:
        on = on & c
    joined = placed.alias("l").join(shuffled(starts).alias("r"), on)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("l.__id") - F.col("r.__first") + F.col("r.__before")).alias(name))
