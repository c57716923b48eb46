"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskgraph.llm.scratch import Scratch
from riskgraph.operators.joins import attach_group_stats


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of the edges with the smallest node it is connected to.

    A large star links every larger neighbour of a node to the smallest neighbour, a small star every
    smaller one; repeated, the edges end as one star per component. The smallest neighbour is a map-side
    combined minimum that is joined back with hot nodes split off, so no neighbourhood meets in one
    task. Every round is a written table. Nulls and loops link nothing; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    stars, seen = scratch.keep(pairs, "stars"), None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            attach_group_stats(both, ["u"], {"m": F.min("v")})
            .filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u > v").distinct()
        )
        large = scratch.keep(large, "stars")
        small = attach_group_stats(large, ["u"], {"m": F.min("v")})
        linked = small.select(F.col("u"), F.col("m").alias("v")).unionByName(
            small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        after = scratch.keep(linked.distinct(), "stars")
        scratch.drop(stars, large)
        stars = after
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
