"""What the review of round 3 found, on inputs that showed it."""

from __future__ import annotations

import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import joins, live, resolve, review
from skein.plans.harness import ORACLE_SQL, QUERIES
from skein.sources import pages
from skein.streaming import feeds, upsert
from tests.compare import differences


def compared(spark, folder, name: str, **tables) -> tuple[list, str]:
    """The query's rows over the given tables, each one file, and how they differ from its twin's."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = QUERIES[name](spark, str(folder))
    return found.collect(), differences(found, con, ORACLE_SQL[name])


def test_confidence_of_zero_without_collision(spark, tmp_path):
    events = spark.createDataFrame([(9, 0.0), (6, 5.0), (3, 1.5), (4, 2.0)], "event_id long, value double")
    rows, said = compared(spark, tmp_path, "P27_display_confidence", events=events)
    assert said == "" and dict(map(tuple, rows))[9] == "0.00"


def test_halts_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """The five prices add up to a multiple of 20, which floats in this order miss."""
    prices = [198684.0, 102772.54, 305746.07, 339126.06, 54611.33]
    orders = spark.createDataFrame([(i, 1, p) for i, p in enumerate(prices)], "o_orderkey long, o_custkey long, o_totalprice double")
    for i, order in enumerate((F.col("o_orderkey"), F.col("o_orderkey").desc(), F.col("o_totalprice"))):
        orders.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{i}/orders.parquet")
        assert [tuple(r) for r in QUERIES["P32_reselection_halts"](spark, f"{tmp_path}/{i}").collect()] == [(1, ["limit"])]


def test_newest_failures_of_one_time_go_by_number(spark, monkeypatch):
    monkeypatch.setattr(review, "MINED", 1)
    log = spark.createDataFrame([(2, '{"sport": "Golf", "home": "a"}', "no_match", 9), (1, '{"sport": "Golf", "home": "b"}', "no_match", 9)], "rec long, reason_detail string, reason_code string, decided_at long")
    assert [r.raw for r in review.mine_failures(log, "Golf", F.lit(5), "rec").collect()] == ["a"]
    flipped = log.withColumn("rec", -F.col("rec"))
    assert [r.raw for r in review.mine_failures(flipped, "Golf", F.lit(5), "rec").collect()] == ["b"]


def test_clock_of_polls_that_tie_and_go_back(spark):
    said = [(1, 1, 600, 100_000), (2, 2, 500, 90_000), (3, 2, 500, 95_000), (4, 3, 493, 105_000), (5, 4, 500, 90_000)]
    rows = spark.createDataFrame([(i, 7, "Golf", "in", 1, s, at, poll) for i, poll, s, at in said], "event_id long, user_id long, sport string, state string, period int, seconds long, at long, poll long")
    running = lambda **k: {r.event_id: r.running for r in feeds.clock_running(rows, ["user_id"], "poll", "event_id", **k).collect()}
    assert running() == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert running(signed=True) == {1: True, 2: True, 3: True, 4: True, 5: True}


def test_clock_query_with_ties(spark, tmp_path):
    """Even events' polls run ahead, so polls tie and times go back."""
    at = datetime.datetime(2024, 1, 1)
    ids = [1, 2, 3, 5000, 5001, 5003, 10000, 10001, 10002, 10003, 10005, 10007, 15000, 15001, 15003, 15005, 15006, 15007]
    events = spark.createDataFrame([(i, at, u, "view", float(i * 37 % 100)) for u in (1, 2) for i in ids], "event_id long, ts timestamp, user_id long, event_type string, value double")
    events = events.withColumn("event_id", F.col("event_id") + 20000 * (F.col("user_id") - 1))
    assert compared(spark, tmp_path, "T09_clock_running", events=events)[1] == ""


def _parties(spark):
    customers = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 6)], "c_custkey long, c_nationkey int")
    return {"customer": customers, "orders": spark.createDataFrame([(7, 1), (8, 2), (9, 3)], "o_orderkey long, o_custkey long")}


def test_unpaired_buckets_ask_all_orders(spark, tmp_path):
    rows, said = compared(spark, tmp_path, "J27_unpaired_buckets", **_parties(spark))
    assert said == "" and [tuple(r) for r in rows] == [(6, [4])]


def test_difference_takes_all_orders_away(spark, tmp_path):
    rows, said = compared(spark, tmp_path, "U06_difference", **_parties(spark))
    assert said == "" and [tuple(r) for r in rows] == [(4,)]


def _copies(spark):
    """600 parts of one brand under three token sets; half of the custkeys have fixtures."""
    at = datetime.datetime(2001, 7, 1)
    named = lambda i: ("red bolt", "SMALL") if i % 3 == 0 else ("red bolt", "LARGE") if i % 2 else ("red gear", "LARGE")
    parts = spark.createDataFrame([(i, *named(i), "Brand#1", i % 50) for i in range(600)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int")
    orders = spark.createDataFrame([(i, i, at) for i in range(300)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    return {"part": parts, "orders": orders}


def test_copies_are_members_and_not_paired(spark, tmp_path):
    tables = _copies(spark)
    for name, most in (("J47_subset_pairs", 5), ("F17_fragmentation_verdict", 20), ("J50_duplicate_candidates", 5)):
        rows, said = compared(spark, tmp_path, name, **tables)
        kinds = [r.kind for r in rows]
        assert said == "" and kinds.count("member") == 600 and 0 < kinds.count("pair") <= most


def test_bundles_of_copies(spark, tmp_path):
    rows, said = compared(spark, tmp_path, "K17_bundle_files", **_copies(spark))
    assert said == ""
    assert sum(r.n for r in rows if r.file == "team_classes.jsonl") == 600 and sum(r.n for r in rows if r.file == "fragmentation.md") < 60


def test_shared_lists_move_as_single_aliases_do(spark):
    groups = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, 14)], "canonical long, dupe long")
    holders = spark.createDataFrame([(11, "x"), (11, "y"), (1, "y"), (12, "x"), (2, "x"), (13, "y"), (14, "x"), (14, "y"), (4, "y")], "team_id long, list string")
    lists = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("y", "c"), ("y", "d")], "list string, alias string")
    assert sorted(map(tuple, review.moving_aliases(groups, holders, lists).collect())) == [(11, 2), (13, 2), (14, 2)]


def test_pairs_are_counted_in_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART", 10)
    members = spark.createDataFrame([(g, i) for g in range(60) for i in range(3)], "g long, id long")
    found = joins.collision_pairs(members, "g", "id", 60)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 60), (0, 2, 60), (1, 2, 60)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() and ", 18)" in found._jdf.queryExecution().toString()


def test_ties_of_equal_names_are_looked_up_once(spark):
    ties = spark.range(500).select(F.col("id").alias("tie"), F.lit("real madrid fc").alias("x"), F.lit("arsenal").alias("y"))
    results = spark.createDataFrame([(1, "arsenal", "real madrid", 1, 2)], "result long, home string, away string, home_agg int, away_agg int")
    found = live.aggregate_lookup(ties, results)
    assert {tuple(r)[1:] for r in found.collect()} == {(2, 1)} and found.count() == 500
    assert "min(tie" in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_names_are_reconciled_once(spark):
    incoming = spark.range(300).select("id", F.when(F.col("id") >= 0, "red bolt fc").alias("name"))
    known = spark.createDataFrame([(1, "bolt", None), (2, "bolt", "USA"), (3, "gear", None)], "team_id long, known_name string, country string")
    found = review.reconcile(incoming, known, ("red", "fc"))
    assert found.count() == 600 and {r.basis for r in found.collect()} == {"exact-distinctive"}
    assert "Aggregate [name" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.action, r.matches) for r in review.classify_teams(incoming, known, ("red", "fc")).collect()} == {("BACKFILL-CANDIDATE", 2)}


def test_titles_meet_games_by_near_names(spark):
    """Against all pairs; names are compared apart from records, so none explodes a record's tokens."""
    words = ("real", "madrid", "bolt", "gear", "ring")
    name = lambda i: f"{words[i % 5]} {words[i * 7 // 5 % 5]}"
    at = datetime.datetime(2024, 1, 1)
    recs = [(i, at + datetime.timedelta(minutes=7 * i), name(i), name(3 * i + 1)) for i in range(40)]
    games = [(i, at + datetime.timedelta(minutes=9 * i), name(3 * i), name(i + 2)) for i in range(40)]
    j = lambda a, b: len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
    one = lambda h, a, x, y: (j(h, x) + j(a, y)) / 2 if j(h, x) and j(a, y) else 0.0
    want = {}
    for r, t, x, y in recs:
        fit = [(-max(one(h, a, x, y), one(h, a, y, x)), g) for g, u, h, a in games if abs((t - u).total_seconds()) <= 1800]
        best = min((f for f in fit if f[0] < -0.5), default=None)
        if best:
            want[r] = (best[1], -best[0])
    found = joins.title_pairs(spark.createDataFrame(recs, "rec long, at timestamp, first string, second string"), spark.createDataFrame(games, "game long, game_at timestamp, home string, away string"))
    assert len(want) > 5 and {r.rec: (r.game, r.score) for r in found.collect()} == want
    assert "array_union(x" not in found._jdf.queryExecution().analyzed().toString()


def test_ties_of_equal_bracket_and_names_are_scored_once(spark):
    pairs = spark.createDataFrame([(1, 0, 5, "real madrid", "arsenal", 3, 2, 1, None), (1, 0, 4, "real madrid", "arsenal", None, 2, 1, "home"), (2, 0, 6, "real madrid", "arsenal", None, 1, 1, None)], "bracket long, round int, place long, home string, away string, agg_home int, agg_away int, legs int, winner string")
    names = lambda turned: F.when(F.lit(turned), "arsenal").otherwise("real madrid")
    ties = [spark.range(i * 100, i * 100 + 100).select(F.col("id").alias("tie"), F.lit(b).alias("bracket"), names(turned).alias("home"), names(not turned).alias("away")) for i, (b, turned) in enumerate(((1, False), (1, True), (2, False)))]
    found = live.bracket_aggregate(pairs, ties[0].unionByName(ties[1]).unionByName(ties[2]))
    assert {r.tie: tuple(r)[1:] for r in found.collect()} == {i: (3, 2, 2) if i < 100 else (2, 3, 2) for i in range(200)}
    assert "Aggregate [bracket" in found._jdf.queryExecution().optimizedPlan().toString()


def test_landed_pages_share_folders(spark, tmp_path):
    """All pages are there, in a folder for each thousand; one that is not there is missing, not empty."""
    rows = spark.range(5100).select("id", F.lit("a b").alias("sport"), (F.floor(F.col("id") / 2) + 1).cast("int").alias("page"))
    template = pages.land_pages(rows, "page", f"file://{tmp_path}/feed")
    assert sorted(p.name for p in (tmp_path / "feed").iterdir() if p.is_dir()) == ["shelf=0", "shelf=1", "shelf=2"]
    said = [json.loads(pages._fetch(template, n)) for n in (1, 999, 1000, 2000, 2550)]
    assert [[e["id"] for e in s["data"]] for s in said] == [[2 * n - 2, 2 * n - 1] for n in (1, 999, 1000, 2000, 2550)] and [s["has_more"] for s in said] == [True] * 4 + [False]
    for missing in (2551, 9999):
        with pytest.raises(FileNotFoundError):
            pages._fetch(template, missing)
    assert [tuple(r) for r in pages.sport_counts(pages.read_pages(spark, template, tries=1)).collect()] == [("A_B", 200)]


def test_equal_pairs_are_looked_up_once(spark):
    """Copies of records and of fixtures meet as one of each; the nearest one, of equals the smallest id, is found as before."""
    at = datetime.datetime(2024, 1, 1)
    later = lambda m: at + datetime.timedelta(minutes=m)
    records = [(i, *((1, 2) if i % 5 else (2, 1)), later((0, 20, 45)[i % 3]), (None, "a", "b")[i % 7 % 3]) for i in range(210)]
    games = [(1000 - i, *((1, 2) if i % 4 else (2, 1)), later((5, 15, 40, 100)[i % 4]), (None, "a", "b", "a")[i % 9 % 4]) for i in range(180)]
    want = {}
    for r, h, a, t, c in records:
        fit = [((x, y) != (h, a), abs(t - u), g, d) for g, x, y, u, d in games if {x, y} == {h, a} and abs(t - u).total_seconds() <= 1800 and (c is None or d is None or c == d)]
        if fit:
            turned, _, g, d = min(fit, key=lambda f: f[:3])
            want[r] = (g, d, turned)
    pairs = spark.createDataFrame(records, "rec long, home_id long, away_id long, kickoff timestamp, competition_id string")
    fixtures = spark.createDataFrame(games, "fixture_id long, home_id long, away_id long, fixture_at timestamp, competition_id string")
    found = resolve.fixture_of(pairs, fixtures, 1800)
    assert len(want) > 150 and {r.rec: tuple(r)[1:] for r in found.collect()} == want and found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [home_id" in plan and "min(fixture_id" in plan


def test_a_bucket_of_many_rows_is_written_by_several_tasks(spark):
    s = upsert.events_and_outcomes(spark, "status string", "outcome int, price double")
    records = spark.range(4).select(F.col("id").alias("game"), F.lit("open").alias("status"), F.array(F.struct(F.lit(1).alias("outcome"), F.lit(0.5).alias("price"))).alias("outcomes"))
    acts = s._classified(s.manifest(), "events", upsert.Incoming(records.select("game", "status"), ["status"], "game"), datetime.datetime(2024, 1, 1), 60)
    rows, dirty = s._next(s.manifest(), "events", acts, ["status"], datetime.datetime(2024, 1, 1))
    assert len(dirty) > 1 and "REBALANCE" in s.dealt(rows)._jdf.queryExecution().toString().upper()
