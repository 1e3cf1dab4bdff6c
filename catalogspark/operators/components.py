"""Connected components of an undirected edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input: it is shuffled and never sent through the driver, whatever its size at run time."""
    return df.hint("merge")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the smallest node of each component) by alternating large-star and small-star rounds.

    Each round replaces edges by edges to the smallest known neighbour, using one min-aggregation and one join per star, so a
    node with very many neighbours is aggregated map-side and never collected. Rounds go on until nothing
    changes and grow with the logarithm of the diameter. Lineage is cut with checkpoints.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    cur = (edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct().checkpoint())
    sign = None
    while True:
        # large-star: every larger neighbour of u is linked to the smallest node around u
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(merged(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every smaller neighbour of u, and u itself, is linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(merged(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = (moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
