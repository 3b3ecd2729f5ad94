"""Connected components by alternating large-star and small-star rounds over DataFrames.

Each round aggregates minima with a map-side combine and joins them back one row a key, so a hub costs no
more than its edges; each round is one job whose edges are written to the shared folder, which cuts the lineage.
It ends when all edges are stars around their roots, so edges that are stars already cost a single round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import Staged


def _stars(edges: DataFrame) -> bool:
    """Whether each u of edges(u, v) has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out")))).alias("x"))
    each = ends.groupBy("x.id").agg(F.sum("x.out").alias("out"), F.min("x.out").alias("low"))
    worst = each.agg(F.max("out"), F.max(F.when(F.col("low") == 0, F.col("out")).otherwise(0))).first()
    return (worst[0] or 0) <= 1 and not worst[1]


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b: long) -> (id, root): root is the smallest id reachable; ids without an edge are absent.

    Loops (a = b), nulls and repeated edges are left out; an empty table gives an empty result."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    now = Staged(e, "edges")
    while not _stars(now.df):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = Staged(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now.drop()
        now = after
    return now.df.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.df.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
