"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: (u, v) with v < u, distinct. A hub's edges are a plain equi-join, which Spark splits if skewed."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))
    out = around.join(least, F.col("u") == F.col("of"))
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of one integer type, in any direction and repeated. Returns node, root for every node that has an
    edge to another; root is the smallest node of its component. Null ends and loops are left out; no edges give no rows."""
    spark = edges.sparkSession
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = common.stage(now, "edges"), None
    for _ in range(MOST_ROUNDS):
        wide = common.stage(_star(now, True), "edges")
        after = common.stage(_star(wide, False), "edges")
        common.drop_staged(spark, now)
        common.drop_staged(spark, wide)
        now, before = after, mark
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
