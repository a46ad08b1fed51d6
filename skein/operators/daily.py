"""The daily measurement of a resolver, composed of scans by window, scopes, tiers, queue, log and the diff with an older pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.domain import scope
from skein.functions.prices import safe_rate
from skein.functions.text import INDIVIDUAL_SPORTS
from skein.operators.joins import top
from skein.operators.measures import confidence_bucket, nearest_place, values_at_ranks

# Reasons that apply without review, and that of a record without a result.
APPLIED = ("strict", "alias", "fuzzy")
SKIPPED = "signal_extraction_skipped"
#: Keys of a bucket that are shown.
SAMPLES = 30
COLUMNS = ("measure", "sport", "provider", "key", "n", "value", "samples")


def _rows(df: DataFrame, measure: Column | str, **given: Column | str) -> DataFrame:
    """``df`` as rows of the report; columns that are not given are null."""
    kinds = {"n": "long", "value": "double", "samples": "array<long>"}
    named = {"measure": F.lit(measure) if isinstance(measure, str) else measure} | given
    return df.select(*[(F.col(v) if isinstance(v := named.get(c), str) else F.lit(None) if v is None else v).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def measured(records: DataFrame, outcomes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Records (provider, rec, sport, title, seen_at) seen in [start, end), their scope, and the reason and confidence of those in scope.

    outcomes: provider, rec, reason, confidence, at most one for each record.
    """
    seen = records.filter((F.col("seen_at") >= start) & (F.col("seen_at") < end))
    scoped = seen.select("provider", "rec", F.trim(F.coalesce("sport", F.lit(""))).alias("sport"), scope(F.col("provider"), F.col("sport"), F.col("title")).alias("scope"))
    both = scoped.join(outcomes.select("provider", "rec", "reason", "confidence"), ["provider", "rec"], "left")
    inside = F.col("scope") == "head_to_head"
    return both.select("provider", "sport", "scope", F.when(inside, F.coalesce(F.trim("reason"), F.lit(SKIPPED))).alias("reason"), F.when(inside, F.col("confidence")).alias("confidence"))


def record_measures(rows: DataFrame) -> DataFrame:
    """A01, A04, A07 of ``measured`` rows: rates overall, by sport and by path, counts by tier, scope and confidence.

    Rows are counted by all dimensions at once, in one shuffle; grouping sets run over these counts.  A set
    without rows has none in the report.
    """
    path = F.when(F.lower("sport").isin(*INDIVIDUAL_SPORTS), "personal").otherwise("team")
    kept = F.coalesce(F.col("reason") != SKIPPED, F.lit(False))
    counts = rows.groupBy("sport", "provider", "scope", "reason", path.alias("path"), kept.alias("kept"), F.when(kept & F.col("confidence").isNotNull(), confidence_bucket(F.col("confidence"))).alias("bucket")).agg(F.count("*").alias("n"))
    dims = ["sport", "provider", "scope", "reason", "path", "kept", "bucket"]
    sets = {
        "records": ["sport", "provider", "scope", "reason"], "tier_per_sport": ["sport", "reason", "kept"], "capability_per_sport": ["sport", "kept"], "path_rate": ["path", "kept"],
        "capability_overall": ["kept"], "scope_count": ["scope"], "confidence_histogram": ["bucket", "kept"], "capability_unfiltered": [],
    }
    bits = lambda held: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in held)
    every = counts.withColumn("_reason", F.col("reason")).groupingSets([[F.col(c) for c in held] for held in sets.values()], *dims)
    summed = every.agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("_reason").isin(*APPLIED), F.col("n"))), F.lit(0)).alias("applied"))
    measure = F.coalesce(*[F.when(F.col("gid") == bits(held), F.lit(name)) for name, held in sets.items()])
    named = summed.withColumn("measure", measure)
    whole = named.filter(F.col("measure").isin("records", "scope_count", "capability_unfiltered") | F.col("kept"))
    whole = whole.filter((F.col("measure") != "confidence_histogram") | F.col("bucket").isNotNull())
    rate = F.when(F.col("measure").isin("capability_per_sport", "path_rate", "capability_overall", "capability_unfiltered"), safe_rate(F.col("applied"), F.col("n")))
    key = F.when(F.col("measure") == "records", F.concat_ws("/", "scope", "reason")).otherwise(F.coalesce("reason", "path", "scope", "bucket"))
    return _rows(whole, F.col("measure"), sport="sport", provider="provider", key=key, n="n", value=rate)


def queue_measures(queue: DataFrame, now: Column, abandoned_days: int = 14) -> DataFrame:
    """Depth, median and 95th percentile of the seconds in the queue, and the share older than some days, of pending rows (sport, status, created_at) by sport."""
    aged = queue.filter("status = 'pending'").select(F.trim(F.coalesce("sport", F.lit(""))).alias("sport"), (F.timestamp_diff("MICROSECOND", F.col("created_at"), now) / 1e6).alias("age"))
    depth = aged.groupBy("sport").agg(F.count("*").alias("n"), F.count_if(F.col("age") >= abandoned_days * 86400).alias("old"))
    n = F.col("n") - 1
    at = values_at_ranks(aged, ["sport"], "age", {"low": F.floor(n / 2), "high": F.ceil(n / 2), "p95": nearest_place(0.95)})
    parts = [_rows(depth, "queue_depth", sport="sport", n="n"), _rows(at, "queue_median", sport="sport", value=(F.col("low") + F.col("high")) / 2), _rows(at, "queue_p95", sport="sport", value="p95")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(_rows(depth, "queue_abandonment", sport="sport", value=safe_rate(F.col("old"), F.col("n"))))


def log_volume(log: DataFrame) -> DataFrame:
    """Log rows (reason) by reason, blank where there is none, and in all."""
    counts = log.groupBy(F.trim(F.coalesce("reason", F.lit(""))).alias("reason")).agg(F.count("*").alias("k"))
    summed = counts.rollup("reason").agg(F.sum("k").alias("n"), F.grouping("reason").alias("g"))
    return _rows(summed, F.when(F.col("g") == 1, "log_total").otherwise("log_volume"), key="reason", n="n")


def dispositions(legacy: DataFrame, new: DataFrame, excluded: DataFrame) -> DataFrame:
    """Event, bucket, series of each event that either pairing (event, ticker) has.

    Tickers that the new extractor refuses (``excluded``: ticker) don't count on the legacy side; an event of
    which nothing else is left is ``extraction_excluded``.  The series is that of the event's smallest ticker
    with a dash, of the new side first.  Sets are compared by counts, so no event's tickers are gathered.
    """
    side = lambda d, old: d.select("event", "ticker", F.lit(old).alias("o"), F.lit(not old).alias("v"))
    pairs = side(legacy, True).unionByName(side(new, False)).groupBy("event", "ticker").agg(F.max("o").alias("o"), F.max("v").alias("v"))
    refused = excluded.select("ticker").distinct().withColumn("x", F.lit(True))
    marked = pairs.join(refused, "ticker", "left").withColumn("e", F.col("o") & F.col("x").isNull())
    dashed = lambda c: F.min(F.when(F.col(c) & F.contains("ticker", F.lit("-")), F.col("ticker")))
    each = marked.groupBy("event").agg(F.count_if("e").alias("old"), F.count_if("v").alias("now"), F.count_if(F.col("e") & F.col("v")).alias("both"), F.coalesce(dashed("v"), dashed("o")).alias("t"))
    bucket = (
        F.when((F.col("old") == 0) & (F.col("now") == 0), "extraction_excluded").when(F.col("old") == 0, "new_only").when(F.col("now") == 0, "legacy_only")
        .when((F.col("both") == F.col("old")) & (F.col("both") == F.col("now")), "agree_same").when(F.col("both") > 0, "agree_partial").otherwise("both_different")
    )
    return each.select("event", bucket.alias("bucket"), F.coalesce(F.split_part("t", F.lit("-"), F.lit(1)), F.lit("")).alias("series"))


def diff_measures(found: DataFrame, cohort: DataFrame) -> DataFrame:
    """Dispositions by bucket and cohort (series), with the smallest events of each bucket that is no agreement."""
    inside = cohort.select("series").distinct().withColumn("c", F.lit(True))
    split = found.join(inside, "series", "left").select("event", "bucket", F.when(F.col("c"), "cohort").otherwise("out_of_cohort").alias("part"))
    counts = split.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    shown = top(split.filter("bucket <> 'agree_same'"), ["bucket", "part"], SAMPLES, F.col("event"))
    shown = shown.groupBy("bucket", "part").agg(F.array_sort(F.collect_list("event")).alias("samples"))
    return _rows(counts.join(shown, ["bucket", "part"], "left"), "pairing_diff", key=F.concat_ws("/", "bucket", "part"), n="n", samples="samples")


def daily_measurement(records: DataFrame, outcomes: DataFrame, queue: DataFrame, log: DataFrame, start: Column, end: Column, diff: DataFrame | None = None) -> DataFrame:
    """All measures of a window as rows of COLUMNS: those of records, queue (at the window's end), log, and of ``diff`` (``diff_measures``) where there is one.

    Records of any provider share one join with their outcomes.  Null or blank sports are one sport; nulls in
    reasons are blank in the log and skipped records among outcomes; empty inputs give no rows of their measures.
    """
    found = record_measures(measured(records, outcomes, start, end)).unionByName(queue_measures(queue, end)).unionByName(log_volume(log))
    return found.unionByName(diff) if diff is not None else found
