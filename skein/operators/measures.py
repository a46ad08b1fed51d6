"""Aggregations: rates, histograms, percentiles, diffs of pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.prices import safe_rate
from skein.operators.storage import stored

# Confidence buckets (label, from, to).
CONFIDENCE_BUCKETS = (("0.00-0.50", 0.00, 0.50), ("0.50-0.70", 0.50, 0.70), ("0.70-0.85", 0.70, 0.85), ("0.85-0.95", 0.85, 0.95), ("0.95-1.00", 0.95, 1.00))


def values_at_ranks(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Keys, and for each name of ``places`` the element at that place (from 0, a Column of n, the key's rows) of the key's values in order.

    Rows are counted by value and dealt by ranges of key and value; sums of the ranges say in which of a key's
    ranges a place is, and only that one is gone through.  So a key's values, however many, are never in one task.
    Nulls have no rank, and rows without a key count for none.
    """
    kept = df.filter(F.col(value).isNotNull())
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    counts = kept.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    dealt = stored(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*keys, "_part").agg(F.sum("_k").alias("_s"))
    each = Window.partitionBy(*keys)
    upto = ranges.select(*keys, "_part", (F.sum("_s").over(each.orderBy("_part")) - F.col("_s")).alias("_before"), "_s", F.sum("_s").over(each).alias("n"))
    asked = upto.select("*", F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), place.cast("long").alias("_at")) for name, place in places.items()])))
    asked = asked.filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_s"))).select(*keys, "_part", "_name", (F.col("_at") - F.col("_before")).alias("_at"))
    running = dealt.join(asked.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi").withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys, "_part").orderBy("_v")))
    found = running.join(asked, [*keys, "_part"]).filter(F.col("_upto") > F.col("_at"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def value_at_rank(df: DataFrame, keys: list[str], value: str, place: Column) -> DataFrame:
    """Keys, value: the element at one place (``values_at_ranks``)."""
    return values_at_ranks(df, keys, value, {value: place})


def nearest_place(p: float) -> Column:
    """``round(p * (n - 1))``, half to even."""
    return F.bround(F.lit(p) * (F.col("n") - 1)).cast("long")


def low_place(p: float) -> Column:
    """``max(0, int(n * p) - 1)``."""
    return F.greatest(F.lit(0), F.floor(F.col("n") * p).cast("long") - 1)


def tier_rates(df: DataFrame, group: str, tier: Column, tiers: list[str], matched: list[str]) -> DataFrame:
    """Counts by tier for each group, and the share of the matched tiers."""
    named = df.withColumn("_tier", tier)
    counts = [F.count_if(F.col("_tier") == t).alias(f"n_{t}") for t in tiers]
    rate = safe_rate(F.count_if(F.col("_tier").isin(matched)), F.count("*"))
    return named.groupBy(group).agg(F.count("*").alias("n"), *counts, rate.alias("rate"))


def confidence_bucket(score: Column) -> Column:
    """The label of a score's bucket (right-open, the last closed), clamped to 0..1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.coalesce(*[F.when(s < hi, F.lit(n)) for n, _, hi in CONFIDENCE_BUCKETS[:-1]], F.lit(CONFIDENCE_BUCKETS[-1][0]))


def histogram(df: DataFrame, score: Column) -> DataFrame:
    """Five buckets (``confidence_bucket``), all of them."""
    found = df.filter(score.isNotNull()).groupBy(confidence_bucket(score).alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(n,) for n, _, _ in CONFIDENCE_BUCKETS], "bucket string")
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def volume_with_total(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, and a row ``total``."""
    return df.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col(key)).alias(key), "n")


def pairing_sets(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """For each key the sorted distinct values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def pairing_diff(legacy: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's bucket: identical, legacy_only, new_only, legacy_superset, new_superset or mixed."""
    both = pairing_sets(legacy, key, value, "old").join(pairing_sets(new, key, value, "now"), key, "full")
    more, less = F.size(F.array_except("now", "old")), F.size(F.array_except("old", "now"))
    bucket = (
        F.when(F.col("now").isNull(), "legacy_only").when(F.col("old").isNull(), "new_only").when((more == 0) & (less == 0), "identical")
        .when(more == 0, "legacy_superset").when(less == 0, "new_superset").otherwise("mixed")
    )
    return both.select(key, bucket.alias("bucket"))


def shares(df: DataFrame, group: str, key: str) -> DataFrame:
    """Counts by group and key with their share of the group in percent (decimal)."""
    counts = df.groupBy(group, key).agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("t"))
    return counts.join(total, group).select(group, key, "n", (F.lit(100.0).cast("decimal(4,1)") * F.col("n") / F.col("t")).cast("double").alias("pct"))


def backfill_report(before: DataFrame, after: DataFrame, sport: str) -> DataFrame:
    """Measure, sport, n: rows and rows without a sport before and after a backfill, how many it recovered, and rows by sport.

    Each version is counted once, by sport; the report is made of these counts.
    """
    counts = lambda d, w: d.groupBy(F.nullif(F.trim(sport), F.lit("")).alias("sport")).agg(F.count("*").alias("k")).withColumn("w", F.lit(w))
    both = counts(before, "before").unionByName(counts(after, "after"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    is_, none = lambda w: F.col("w") == w, F.col("sport").isNull()
    totals = both.agg(n(is_("before")).alias("rows_before"), n(is_("before") & none).alias("null_before"), n(is_("after")).alias("rows_after"), n(is_("after") & none).alias("null_after"))
    totals = totals.withColumn("recovered", F.col("null_before") - F.col("null_after"))
    each = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("sport"), F.col(c).alias("n")) for c in totals.columns])))
    return each.unionByName(both.filter(is_("after") & ~none).select(F.lit("coverage").alias("measure"), "sport", F.col("k").alias("n")))


def fan_out_snapshot(sends: DataFrame, connections: DataFrame, now: Column, top_n: int = 10, recent: int = 20) -> DataFrame:
    """Measure, key, n, bytes, messages, tickers, age (whole seconds) of a fan-out's state.

    sends: subscriber, channel, ticker, bytes, messages.  connections: subscriber, event, ts, seq.
    Rows: ``connections`` (different subscribers), ``channel`` totals, the ``top_n`` ``subscriber`` rows by bytes
    (of equals the smaller one) with the age of their first connect, ``max_tickers`` of one subscriber,
    ``reconnects_1h`` before ``now``, and the last ``recent`` events by seq.
    """
    none = lambda kind="long": F.lit(None).cast(kind)
    row = lambda d, measure, **c: d.select(F.lit(measure).alias("measure"), *[(c[k] if k in c else none("string" if k == "key" else "long")).cast("string" if k == "key" else "long").alias(k) for k in ("key", "n", "bytes", "messages", "tickers", "age")])
    by_ticker = sends.groupBy("subscriber", "channel", "ticker").agg(F.sum("bytes").alias("bytes"), F.sum("messages").alias("messages"))
    channel = by_ticker.groupBy("channel").agg(F.sum("bytes").alias("bytes"), F.sum("messages").alias("messages"))
    each = by_ticker.groupBy("subscriber").agg(F.sum("bytes").alias("bytes"), F.sum("messages").alias("messages"), F.count_distinct("ticker").alias("tickers"))
    since = connections.filter("event = 'connect'").groupBy("subscriber").agg(F.min("ts").alias("since"))
    first = each.orderBy(F.col("bytes").desc(), "subscriber").limit(top_n).join(since, "subscriber", "left")
    last = connections.orderBy(F.col("seq").desc()).limit(recent)
    sec = lambda c: F.floor(F.timestamp_diff("MICROSECOND", F.col(c), now) / 1e6)
    again = connections.filter((F.col("event") == "connect") & (F.col("ts") >= now - F.expr("INTERVAL 1 HOUR")))
    parts = [
        row(each.agg(F.count("*").alias("n")), "connections", n=F.col("n")), row(channel, "channel", key=F.col("channel"), bytes=F.col("bytes"), messages=F.col("messages")),
        row(first, "subscriber", key=F.col("subscriber"), bytes=F.col("bytes"), messages=F.col("messages"), tickers=F.col("tickers"), age=sec("since")),
        row(each.agg(F.coalesce(F.max("tickers"), F.lit(0)).alias("m")), "max_tickers", tickers=F.col("m")), row(again.agg(F.count("*").alias("n")), "reconnects_1h", n=F.col("n")),
        row(last, "recent", key=F.concat_ws(":", "event", F.col("subscriber").cast("string")), n=F.col("seq"), age=sec("ts")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
