from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import daily, measures, mutations, review
from skein.plans import resolver
from skein.plans.registry import Tables

T0 = dt.datetime(2026, 5, 5, 18)
AT = lambda h: F.lit(T0 + dt.timedelta(hours=h)).cast("timestamp")


def test_dispositions_equal_sets(spark):
    rng = random.Random(3)
    pairs = lambda: [(rng.randrange(40), rng.choice(["A-1", "A-2", "B-1", "C-1", "plain"])) for _ in range(70)]
    legacy, new, refused = pairs(), pairs(), {"B-1", "C-1"}
    new = [p for p in new if p[0] % 3]
    df = lambda rows: spark.createDataFrame(rows, "event long, ticker string")
    got = {r.event: (r.bucket, r.series) for r in daily.dispositions(df(legacy), df(new), spark.createDataFrame([(x,) for x in refused] * 2, "ticker string")).collect()}
    expected = {}
    for e in {k for k, _ in legacy + new}:
        old, now = {t for k, t in legacy if k == e}, {t for k, t in new if k == e}
        left = old - refused
        if not left and not now:
            bucket = "extraction_excluded"
        elif left and now:
            bucket = "agree_same" if left == now else "agree_partial" if left & now else "both_different"
        else:
            bucket = "new_only" if now else "legacy_only"
        named = sorted(t for t in now if "-" in t) or sorted(t for t in old if "-" in t)
        expected[e] = (bucket, named[0].split("-")[0] if named else "")
    assert got == expected and len({b for b, _ in got.values()}) == 6


def test_measures_of_a_window(spark):
    rec = lambda i, p, s, t, h: (p, i, s, t, T0 + dt.timedelta(hours=h))
    records = [rec(1, "fl", "Tennis", "x", 0), rec(2, "fl", None, "x", 1), rec(3, "kalshi", " ", "x", 1), rec(4, "kalshi", "Soccer", "A vs B: Total Maps", 1), rec(5, "kalshi", "Soccer", "A vs B", 1), rec(6, "kalshi", "Soccer", "A vs B", 1), rec(7, "fl", "Tennis", "x", 2), rec(8, "fl", "Tennis", "x", -1)]
    outcomes = [("fl", 1, "strict", 1.0), ("fl", 2, "no_match", 0.1), ("kalshi", 3, "strict", 1.0), ("kalshi", 4, "strict", 1.0), ("kalshi", 5, "fuzzy", None), ("fl", 8, "strict", 1.0)]
    r = spark.createDataFrame(records, "provider string, rec long, sport string, title string, seen_at timestamp")
    o = spark.createDataFrame(outcomes, "provider string, rec long, reason string, confidence double")
    queue = spark.createDataFrame([("a", "pending", T0 - dt.timedelta(days=d)) for d in (1, 2, 14, 20)] + [("a", "approved", T0), (None, "pending", T0)], "sport string, status string, created_at timestamp")
    log = spark.createDataFrame([("strict",), (None,), (" ",)], "reason string")
    found = daily.daily_measurement(r, o, queue, log, AT(0), AT(2)).collect()
    got = {(x.measure, x.sport, x.key): (x.n, x.value) for x in found if x.measure != "records"}
    assert sum(x.n for x in found if x.measure == "records") == 6
    assert got["scope_count", None, "head_to_head"] == (4, None) and got["scope_count", None, "prop_market_filtered_out"] == (1, None) and got["scope_count", None, "non_sport_filtered_out"] == (1, None)
    assert got["capability_overall", None, None] == (3, 2 / 3) and got["capability_unfiltered", None, None] == (6, 2 / 6)
    assert got["capability_per_sport", "", None] == (1, 0.0) and got["capability_per_sport", "Soccer", None] == (1, 1.0)
    assert got["path_rate", None, "personal"] == (1, 1.0) and got["path_rate", None, "team"] == (2, 0.5)
    assert got["tier_per_sport", "Soccer", "fuzzy"] == (1, None) and ("tier_per_sport", "Soccer", daily.SKIPPED) not in got
    assert got["confidence_histogram", None, "0.95-1.00"] == (1, None) and got["confidence_histogram", None, "0.00-0.50"] == (1, None)
    hour = 3600.0
    assert got["queue_depth", "a", None] == (4, None) and got["queue_median", "a", None] == (None, 8 * 24 * hour + 2 * hour) and got["queue_p95", "a", None] == (None, 482 * hour) and got["queue_abandonment", "a", None] == (None, 0.5)
    assert got["queue_depth", "", None] == (1, None) and got["log_volume", None, ""] == (2, None) and got["log_total", None, None] == (3, None)
    none = daily.daily_measurement(r.limit(0), o.limit(0), queue.limit(0), log.limit(0), AT(0), AT(2))
    assert none.filter("measure <> 'log_total'").count() == 0


def test_merge_of_null_keys_and_digests(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, digest string, v string")
    before, batch = df([(None, "x", "old"), (1, None, "old"), (2, "d", "old"), (3, "e", "old")]), df([(None, "x", "new"), (1, None, "new"), (2, None, "new"), (4, None, "new")])
    got = {r.id: (r.action, r.v) for r in mutations.classified_merge(before, batch, "id", "digest").collect()}
    assert got == {None: ("unchanged", "old"), 1: ("unchanged", "old"), 2: ("update", "new"), 3: ("kept", "old"), 4: ("insert", "new")}


def test_names_that_hold_a_part(spark):
    rng = random.Random(5)
    words = lambda n, k: sorted({"".join(rng.choice("ab c") for _ in range(rng.randrange(k))) for _ in range(n)})
    whole, part = words(150, 12), words(60, 6)
    got = review.holding(spark.createDataFrame([(w,) for w in whole], "whole string"), spark.createDataFrame([(p,) for p in part], "part string")).collect()
    assert sorted((r.whole, r.part) for r in got) == sorted((w, p) for w in whole for p in part if p in w) and "" in part


def test_phase_of_one_group(spark):
    teams = spark.createDataFrame([(1, "Carlos Alcaraz", 1, 1), (2, "Alcaraz C.", 2, 3), (3, "Carlos Moya", 1, 1), (4, "Moya D.", 1, 1)], "id long, name string, created_at long, aliases long")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (9, 3)], "node long, root long")
    aliases = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 2)], "alias string, team_id long")
    fixtures = spark.createDataFrame([(7, 2, 2), (8, 2, 1), (9, 1, 3)], "fixture_id long, home_id long, away_id long")
    queue = spark.createDataFrame([(2, "pending"), (2, "approved"), (1, "pending")], "team_id long, status string")
    report = lambda only=None: [tuple(r) for r in review.phase_report(clusters, teams, aliases, fixtures, queue, only).orderBy("section").collect()]
    group, left = ("merge_group", 1, 2, 1, 2, 1, None), ("skipped", 3, 3, None, None, None, ["Carlos Moya", "Moya D.", "9"])
    assert report() == [group, left] and report(1) == [group, left]
    with pytest.raises(ValueError):
        report(2)


def test_backfill_of_nothing(spark):
    empty = spark.createDataFrame([], "sport string")
    assert {(r.measure, r.n) for r in measures.backfill_report(empty, empty, "sport").collect()} == {(m, 0) for m in ("rows_before", "null_before", "rows_after", "null_after", "recovered")}


def test_values_at_ranks_over_many_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaab"), rng.randrange(60)) for _ in range(500)] + [("c", 5), ("c", None), (None, 1)]
    n = F.col("n") - 1
    got = {r.k: (r.first, r.mid, r.last) for r in measures.values_at_ranks(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", {"first": F.lit(0), "mid": F.floor(n / 2), "last": n}).collect()}
    held = {k: sorted(v for x, v in rows if x == k and v is not None) for k in "abc"}
    assert got == {k: (v[0], v[(len(v) - 1) // 2], v[-1]) for k, v in held.items()}


def test_a_changed_folder_is_resolved_anew(spark, tmp_path):
    for name in ("orders", "lineitem", "part"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    before = resolver._state(t)
    assert resolver._state(t) == before
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    assert resolver._state(t) != before
