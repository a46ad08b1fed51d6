from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import bundles, runner

TEAMS, PAIRS, PROPOSALS = "bundle string, id long, name string, country string, action string", "bundle string, anchor long, partner long, n_anchor long, n_partner long, classification string, winner long, phantom long", "bundle string, alias string, team long, verdict string"


def files(spark, path):
    """(bundle, file) -> lines in their order, and how many part files each has."""
    rows = sorted(bundles.read_lines(spark, path).collect(), key=lambda r: (r.bundle, r.file, r.part, r.start, r.at))
    said, parts = {}, {}
    for r in rows:
        said.setdefault((r.bundle, r.file), []).append(r.line)
        parts.setdefault((r.bundle, r.file), set()).add(r.part)
    return said, {k: len(v) for k, v in parts.items()}


def test_bundle_files_are_in_order(spark):
    teams = [("a/b#1", 3, "x|y", None, "SKIP"), ("a/b#1", 2, "b", "USA", "INSERT"), ("a/b#1", 1, "a\nc", None, "INSERT"), (None, 9, "n", None, "BACKFILL"), ("", 8, "m", "FRA", "BACKFILL-CANDIDATE"), (" ", 8, "m", "FRA", "BACKFILL-CANDIDATE")]
    pairs = [("a/b#1", 1, 2, 5, 0, "ALIAS-LINK", 1, 2), ("a/b#1", 3, 2, 4, 0, "ALIAS-LINK", 3, 2), ("p", 4, 5, 1, 1, "MERGE-REQUIRED", None, None)]
    proposals = [("a/b#1", "q", 1, "clean"), ("a/b#1", "q", 1, "clean"), ("a/b#1", None, 2, "colliding")]
    got, _ = files(spark, bundles.write_bundles(spark.createDataFrame(teams, TEAMS), spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(proposals, PROPOSALS)))
    assert {b for b, _ in got} == {"a/b#1", "Unknown", "p", "all"}
    assert got["a/b#1", "classification.md"] == ["# a/b#1: classification", "", "- INSERT: 2", "- BACKFILL: 0", "- BACKFILL-CANDIDATE: 0", "- SKIP: 1", "", "## Teams", "", "| class | id | name | country |", "|---|---|---|---|",
                                                "| INSERT | 1 | a c | - |", "| INSERT | 2 | b | USA |", "| SKIP | 3 | x\\|y | - |", ""]
    assert got["Unknown", "classification.md"][2:6] == ["- INSERT: 0", "- BACKFILL: 1", "- BACKFILL-CANDIDATE: 2", "- SKIP: 0"] and got["Unknown", "classification.md"][11:14] == ["| BACKFILL | 9 | n | - |"] + ["| BACKFILL-CANDIDATE | 8 | m | FRA |"] * 2
    assert [json.loads(x) for x in got["a/b#1", "seed.jsonl"]] == [{"id": 1, "name": "a\nc", "country": None}, {"id": 2, "name": "b", "country": "USA"}] and ("Unknown", "seed.jsonl") not in got
    assert got["a/b#1", "phantom_release.md"][2:] == ["- phantoms: 1", "", "## Release first, then add the clean aliases", "", "| phantom | winner |", "|---|---|", "| 2 | 1 |", ""]
    assert got["p", "fragmentation.md"] == ["# p: fragmentation", "", "- ALIAS-LINK: 0", "- MERGE-REQUIRED: 1", "", "## MERGE-REQUIRED", "", "| anchor | fixtures | partner | partner's fixtures |", "|---|---|---|---|", "| 4 | 1 | 5 | 1 |", ""]
    assert got["a/b#1", "aliases_audited.md"][2:5] == ["- clean: 2", "- same_team: 0", "- colliding: 1"] and "| - | 2 |" in got["a/b#1", "aliases_audited.md"] and "## same_team" not in got["a/b#1", "aliases_audited.md"]
    assert [json.loads(x)["league"] for x in got["all", "index.jsonl"]] == ["Unknown", "a/b#1", "p"] and got["all", "index.md"][2] == "- leagues: 3"


def test_a_large_bundle_is_dealt_over_tasks(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"b{i % 7}", i, f"n{rng.randrange(10**6):06}", None, rng.choice(bundles.ACTIONS)) for i in range(6_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, parts = files(spark, bundles.write_bundles(spark.createDataFrame(rows, TEAMS), spark.createDataFrame([], PAIRS), spark.createDataFrame([], PROPOSALS)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = sorted((bundles.ACTIONS.index(a), n, str(i)) for b, i, n, _, a in rows if b == "hot")
    assert got["hot", "classification.md"][11:-1] == [f"| {bundles.ACTIONS[a]} | {i} | {n} | - |" for a, n, i in mine]
    assert max(parts.values()) > 1


def test_empty_tables_write_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in (TEAMS, PAIRS, PROPOSALS)]
    path = bundles.write_bundles(*empty)
    assert bundles.read_lines(spark, path).count() == 0


def test_enumeration_has_unknown_countries_last(spark):
    stages = [("Spain", "La Liga", 1, "b"), ("Spain", "La Liga", 1, "a"), ("Spain", "La Liga", 2, "c"), (None, "Cup", 3, "d"), ("unknown", "Cup", 4, "e"), ("austria", "x", 5, None), ("Brazil", "y", 6, "f")]
    got, _ = files(spark, bundles.write_lines(bundles.enumeration(spark.createDataFrame(stages, "country string, league string, stage_id long, stage string")), "enumeration"))
    assert got["all", "enumeration.md"][2:4] == ["- leagues: 5", "- stages: 6"]
    assert [x.split(" | ")[0][2:] for x in got["all", "enumeration.md"][9:-1]] == ["austria", "Brazil", "Spain", "Unknown", "unknown"]
    assert json.loads(got["all", "enumeration.jsonl"][2]) == {"country": "Spain", "league": "La Liga", "stage_id": 1, "stage": "a"}


def test_harvest_ranks_by_occurrences(spark):
    rows = [("s", f"a{i}", "Raw", 1, "Ref", n, 0.875, v) for i, (n, v) in enumerate([(2, "clean"), (30, "clean"), (4, "colliding"), (2, "clean")])]
    got, _ = files(spark, bundles.write_lines(bundles.harvest(spark.createDataFrame(rows, "bundle string, alias string, raw string, team long, reference string, n long, score double, verdict string")), "harvest"))
    report = got["s", "harvest_report.md"]
    assert report[2:7] == ["- all: 4", "- occurrences: 38", "- clean: 3", "- same_team: 0", "- colliding: 1"]
    assert [x.split(" | ")[1] for x in report if x.startswith("| ") and "Raw" in x] == ["a1", "a0", "a3", "a2"] and "0.88" in report[12]
    assert [json.loads(x)["alias"] for x in got["s", "harvest_candidates.jsonl"]] == ["a1", "a2", "a0", "a3"]


NOW = dt.datetime(2026, 5, 8)


@pytest.fixture
def passes(spark):
    rows = [(p, i, 100.0 if p != "slow" else 6_000.0) for p, n in (("few", 3), ("many", 12), ("slow", 2), ("more", 11)) for i in range(n)]
    runs = [("many", NOW - dt.timedelta(days=d), n) for d, n in ((1, 1), (7, 3), (8, 900))] + [("few", NOW, 1)]
    return spark.createDataFrame(rows, "provider string, record long, select_ms double"), spark.createDataFrame(runs, "provider string, started timestamp_ntz, scanned long")


def test_passes_stop_at_the_limit_and_survive_crashes(spark, passes):
    candidates, runs = passes
    outcome = F.when(F.col("record") == 0, F.lit(None)).when(F.col("record") == 1, "no_match").otherwise("auto_apply")
    decided, metrics = runner.reselection_passes(candidates, lambda d: d.withColumn("outcome", outcome), runs, F.lit(NOW).cast("timestamp_ntz"), 11)
    got = {r.provider: r for r in metrics.collect()}
    assert {p: (r.scanned, r.auto_apply, r.no_match, r.review, r.crashes, list(r.halts), r.stopped, r.appended) for p, r in got.items()} == {
        "few": (3, 1, 1, 0, 1, [], False, True), "many": (12, 0, 0, 0, 0, ["candidates", "limit"], True, False),
        "slow": (2, 0, 1, 0, 1, ["latency"], False, True), "more": (11, 9, 1, 0, 1, [], False, True),
    }
    assert decided.count() == 16 and decided.filter("provider = 'many'").count() == 0
    once = runner.append_runs(runs, metrics)
    assert once.count() == 6 and runner.append_runs(once, metrics).count() == 6  # few's run of this time is there already


def test_dry_run_decides_nothing(spark, passes):
    decided, metrics = runner.reselection_passes(passes[0], lambda d: d.withColumn("outcome", F.lit("review")), passes[1], F.lit(NOW).cast("timestamp_ntz"), apply=False)
    assert decided.count() == 0 and {(r.review, r.appended, r.stopped) for r in metrics.collect()} == {(0, False, False)}
