"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohera.plans.shared import cut, salted_lookup


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour v of u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_lookup(both.filter("v > u"), least, "u", "v", how="inner").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every u, and its smaller neighbours, are tied to u's smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = salted_lookup(down, least, "u", "v", how="inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node that it reaches.

    `edges` has columns u and v of one orderable type. Self-loops, repeated and reversed edges are allowed;
    rows with a null end are ignored. Rounds grow with the logarithm of the longest path; each is cut off in the
    shared checkpoint folder, and only its row count and checksum reach the driver. Stars are summed by partial
    minima, and the lookups are salted, so a hub is never one task's work.
    """
    known = edges.select("u", "v").filter("u is not null and v is not null")
    loops = known.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = cut(known.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        now = cut(_small_star(_large_star(now)))
        mark, last = _mark(now), mark
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = named.select(F.col("component").alias("node"), "component")
    return named.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
