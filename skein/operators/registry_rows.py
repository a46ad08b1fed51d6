"""Registry rows: which claim of an alias holds, and how often an entity changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alias_priority(claims: DataFrame, alias: str, target: str, priority: Column, seq: Column) -> DataFrame:
    """the target of the highest priority (of equal ones the earliest) and the number of claims."""
    return claims.groupBy(alias).agg(F.max_by(target, F.struct(priority, -seq)).alias("target"), F.count("*").alias("claims"))


def entity_versions(rows: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """One version, and one more for each row whose state differs from the key's previous one."""
    was = F.lag(state).over(Window.partitionBy(key).orderBy(seq))
    changed = F.count_if(F.col("_was").isNotNull() & (F.col("_was") != F.col(state)))
    return rows.withColumn("_was", was).groupBy(key).agg((F.lit(1) + changed).cast("long").alias("version"))
