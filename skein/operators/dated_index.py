"""Records in buckets by key and day, for interval joins that leave them where they lie."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.storage import shared_path

DAY = 86_400


def _day(seconds: Column) -> Column:
    return F.floor(seconds / DAY)


def build(records: DataFrame, key: str, seconds: str, buckets: int = 64) -> DataFrame:
    """``records`` as a table in ``buckets`` by ``key`` and ``day``, each sorted by both; read it as often as wanted."""
    spark, name = records.sparkSession, f"dated_{uuid.uuid4().hex}"
    dated = records.withColumn("day", _day(F.col(seconds)))
    dated.repartition(buckets, key, "day").write.bucketBy(buckets, key, "day").sortBy(key, "day").option("path", shared_path(spark, "dated")).saveAsTable(name)
    return spark.table(name)


def within(index: DataFrame, probes: DataFrame, key: str, seconds: str, at: str, drift: int) -> DataFrame:
    """Pairs of ``probes`` (``key``, ``at``) and indexed records at most ``drift`` seconds apart.

    A probe goes to each day that its interval touches; a pair meets on the record's own day alone, and
    buckets meet buckets, so the index is neither shuffled nor sorted again.
    """
    days = F.sequence(_day(F.col(at) - drift), _day(F.col(at) + drift))
    dealt = probes.withColumn("day", F.explode(days))
    return index.join(dealt, [key, "day"]).filter(F.abs(F.col(seconds) - F.col(at)) <= drift)
