"""Re-resolution passes of all providers at once: admitted under a hard limit, decided, measured, appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import domain
from skein.operators.storage import stored


def trailing_mean(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """provider, mean: the mean of ``scanned`` over runs of the ``days`` before ``now`` (runs: provider, started, scanned)."""
    recent = runs.filter((F.col("started") < now) & (F.col("started") >= now - F.make_dt_interval(F.lit(days))))
    return recent.groupBy("provider").agg(F.avg("scanned").alias("mean"))


def reselection_passes(candidates: DataFrame, decide: Callable[[DataFrame], DataFrame], runs: DataFrame, now: Column, limit: int = domain.CANDIDATE_LIMIT, apply: bool = True) -> tuple[DataFrame, DataFrame]:
    """The decisions (provider, record, outcome), and a metrics row for each provider.

    candidates: provider, record, select_ms.  A provider with more than ``limit`` candidates is refused: none of its
    records is decided and its row says ``stopped``.  Without ``apply`` nothing is decided and no row is to be
    appended (``appended`` false).  ``decide`` gives outcome for each record: auto_apply, no_match, review, or null
    for a crash; a crash of one record stops no other.  ``runs`` gives the trailing mean.
    """
    sizes = stored(candidates.groupBy("provider").agg(F.count("*").alias("scanned"), F.max("select_ms").alias("select_ms")), "sizes")
    admitted = candidates.join(sizes.filter((F.col("scanned") <= limit) & F.lit(apply)).select("provider"), "provider", "left_semi")
    decided = stored(decide(admitted).select("provider", "record", "outcome"), "decided")
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    outcomes = decided.groupBy("provider").agg(of("auto_apply"), of("no_match"), of("review"), F.count_if(F.col("outcome").isNull()).alias("crashes"))
    halts = domain.reselection_halts(F.col("scanned"), F.col("select_ms"), F.col("mean"), limit)
    rows = sizes.join(trailing_mean(runs, now), "provider", "left").join(outcomes, "provider", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("auto_apply", "no_match", "review", "crashes")]
    stopped = F.col("scanned") > limit
    return decided, rows.select("provider", now.alias("started"), "scanned", *zero, halts.alias("halts"), stopped.alias("stopped"), (F.lit(apply) & ~stopped).alias("appended"))


def append_runs(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with the rows of ``metrics`` that are to be appended; a run that is there already (provider, started) stays one."""
    new = metrics.filter("appended").select("provider", "started", "scanned")
    return runs.unionByName(new.join(runs.select("provider", "started").distinct(), ["provider", "started"], "left_anti"))
