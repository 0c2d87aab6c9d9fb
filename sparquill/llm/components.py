"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import forget, spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots; root is the component's smallest node.

    Alternates large-star and small-star steps: each node's neighbours are pointed to the smallest one, until
    nothing changes. The edge list never grows, each step keeps partial minima only, and its result is written
    to the shared folder, so no step depends on an executor's memory. A hub's edges are spread over tasks.
    """
    up = F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    now = stored(edges.where("a <> b").select(*up).distinct())
    seen = None
    while True:
        total = 2 * now.count()
        both = now.select("v", "u").union(now.select("u", "v")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("low"), F.count("*").alias("degree")).select("n", F.least("n", "low").alias("low"), "degree")
        large = spread_join(both.where("m > n"), least, "n", "degree", "m", total).select(F.col("m").alias("v"), F.col("low").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("low"), F.count("*").alias("degree"))
        small = spread_join(large, least, "v", "degree", "u", total).select(F.explode(F.array(F.struct("u", "low"), F.struct(F.col("v").alias("u"), "low"))).alias("e"))
        new = stored(small.select(F.col("e.u").alias("v"), F.col("e.low").alias("u")).where("v <> u").distinct())
        forget(now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = state
