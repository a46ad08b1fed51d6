"""Connected components of a table of links, without a collected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.storage import stored


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``links`` (a, b) reaches.

    Labels spread along links and are then followed once more (their own label's label), so
    rounds grow with the logarithm of the longest chain.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        spread = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(spread, labels["node"] == spread["a"]).select("node", "root", F.least("root", "near").alias("new"))
        hop = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        new = stored(nearer.join(hop, "new", "left").select("node", F.col("root").alias("was"), F.least("new", "far").alias("root")))
        labels = new.select("node", "root")
        if new.filter("was <> root").isEmpty():
            return labels
