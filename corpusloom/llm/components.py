"""Connected components by alternating large-star and small-star rounds.

Each round is an aggregation and a join over edges; no vertex's neighbours are
collected, so a vertex with millions of links is only a hot join key, which AQE
splits. Edges are cut from their lineage with checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, swept


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for each vertex of an edge; component is the smallest vertex.

    Self-loops and nulls are dropped, repeated edges count once; no edges give no
    rows.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
        .checkpoint()
    )
    before = _sum(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u <> v")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = _sum(e)
        swept(spark)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.unionByName(roots.select("u", F.col("u").alias("v"))).select(F.col("u").alias("v"), F.col("v").alias("component"))


def _sum(e: DataFrame) -> tuple:
    """The same for the same edges."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
