"""Prices, ticks and clocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(text: Column) -> Column:
    """a decimal string times 100 (rounded half to even), a whole string as it is; else null."""
    t = F.trim(text)
    return F.when(F.instr(t, ".") > 0, F.bround(t.try_cast("double") * 100)).otherwise(t.try_cast("int")).cast("int")


def complement(ask: Column, opposite_bid: Column) -> Column:
    """a missing price is what the other side's price leaves of 100."""
    return F.coalesce(ask, 100 - opposite_bid)


def yes_side(last: Column, bid: Column) -> Column:
    """the last price from the yes side: flipped where that lies nearer to the bid."""
    return F.when(F.abs(100 - last - bid) < F.abs(last - bid), 100 - last).otherwise(last)


def clock_seconds(text: Column) -> Column:
    """``mm:ss`` (or minutes alone) in seconds."""
    m, s = F.regexp_extract(text, r"^(\d+):(\d{2})", 1), F.regexp_extract(text, r"^(\d+):(\d{2})", 2)
    return F.when(text.rlike(r"^\d+:\d{2}"), m.cast("int") * 60 + s.cast("int")).when(text.rlike(r"^\d+'?$"), F.regexp_extract(text, r"^(\d+)", 1).cast("int") * 60)


def linear_contribution(ratio: Column, threshold: float) -> Column:
    """0.20 at the threshold, 0.30 at 1."""
    return 0.20 + (ratio - threshold) / (1 - threshold) * 0.10


def band(confidence: Column, apply: float = 0.85, review: float = 0.70) -> Column:
    """what a confidence leads to."""
    return F.when(confidence >= apply, "auto_apply").when(confidence >= review, "review_queue").otherwise("no_match")


def safe_rate(n: Column, d: Column) -> Column:
    """0 where nothing is divided by."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def nearest_rank(values: Column, p: float) -> Column:
    """The element at ``round(p * (n - 1))`` (half to even) of the sorted array; 0 if empty."""
    at = F.bround(F.lit(p) * (F.size(values) - 1)).cast("int")
    return F.coalesce(F.get(F.array_sort(values), at), F.lit(0))


def low_rank(values: Column, p: float) -> Column:
    """The element at ``max(0, int(n * p) - 1)`` of the sorted array."""
    return F.get(F.array_sort(values), F.greatest(F.lit(0), F.floor(F.size(values) * p).cast("int") - 1))


def cohort_size(universe: Column, pct: float, least: int) -> Column:
    """the share of the universe, at least ``least``, at most all; none for no share."""
    size = F.least(F.greatest(F.bround(universe * pct / 100).cast("long"), F.lit(least)), universe)
    return F.when((universe <= 0) | F.lit(pct <= 0), F.lit(0)).otherwise(size)
