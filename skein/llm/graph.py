"""Connected components over links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, store


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node) of every node in ``links`` (a, b), by alternating stars.

    Each round replaces links by links to a neighbourhood's smallest node; rounds grow with
    the logarithm of the longest chain.  Nulls are no nodes; self links and repeats do no harm.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.toDF("u", "v"))
        new = store(moved.filter("u <> v").distinct(), "edges")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if row == before:
            break
        before = row
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    alone = roots.select(F.col("root").alias("node")).distinct()
    return roots.unionByName(alone.withColumn("root", F.col("node")))
