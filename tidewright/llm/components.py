"""Connected components of a link table by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_materialized, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node of its component. Rounds: logarithmic.

    A node's neighbours are never collected: each step takes a minimum, which is combined before the shuffle, and joins it
    back, a join that adaptive execution may split at a hub. Loops and repeated links are allowed; no links, no rows.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        lower = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "small")
        drop_materialized(large)
        drop_materialized(edges)
        edges, before, known = after, known, signature(after)
        if known == before:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def signature(edges: DataFrame) -> tuple:
    """Count and two 64-bit hash folds of a set of rows: when they stay, so did the rows."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first()
    return tuple(row)
