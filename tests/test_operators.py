from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.operators import feeds, graph, joins, measures, mutations, resolve, review
from skein.sources import files
from skein.streaming import feeds as stream

T0 = dt.datetime(2026, 5, 5, 18)


def test_within_equals_the_plain_join(spark):
    rng = random.Random(1)
    rows = lambda n: [(i, rng.randrange(3), T0 + dt.timedelta(seconds=rng.randrange(-9000, 9000))) for i in range(n)]
    a, b = rows(60), rows(60)
    left, right = spark.createDataFrame(a, "l long, k long, lt timestamp"), spark.createDataFrame(b, "r long, k long, rt timestamp")
    got = {(x.l, x.r) for x in joins.within(left, right, ["k"], "lt", "rt", 900).collect()}
    assert got == {(i, j) for i, k, t in a for j, m, u in b if k == m and abs((t - u).total_seconds()) <= 900}


def test_similarity_policy(spark):
    rows = [("one", 1, 0.9), ("exact", 1, 1.0), ("exact", 2, 0.9), ("two", 1, 0.9), ("two", 2, 0.8), ("twins", 1, 1.0), ("twins", 2, 1.0), ("low", 1, 0.5)]
    got = {r.rec: (r.state, r.target) for r in joins.similarity_policy(spark.createDataFrame(rows, "rec string, team long, score double"), "rec", "team", "score", 0.78).collect()}
    assert got == {"one": ("match", 1), "exact": ("match", 1), "two": ("collision", None), "twins": ("collision", None)}


def test_resolver(spark):
    teams = spark.createDataFrame([(1, "soccer", "Arsenal"), (2, "soccer", "Atletico Madrid"), (3, "soccer", "Real Sociedad"), (4, "soccer", "Real Sociedad II"), (5, "soccer", "Liverpool")], "team_id long, sport string, name string")
    aliases = spark.createDataFrame([("arsenal", "soccer", 1), ("atletico madrid", "soccer", 2)], "alias string, sport string, team_id long")
    fixtures = spark.createDataFrame([(10, 1, 2, T0), (11, 5, 2, T0)], "fixture_id long, home_id long, away_id long, fixture_at timestamp")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    records = [
        ("straight", "Arsenal", "Atlético Madrid", at(20)), ("turned", "Atletico Madrid", "Arsenal", at(0)), ("late", "Arsenal", "Atletico Madrid", at(31)),
        ("spelled", "Liverpool FC", "Atletico Madrid", at(0)), ("clash", "Real Sociedad", "Arsenal", at(0)), ("typo", "Liverpol", "Atletico Madrd", at(45)), ("none", "Qwx", "Zzz", at(0)), ("lone", "Arsenal", "Zzz", at(0)),
    ]
    df = spark.createDataFrame([(r, "soccer", h, a, k) for r, h, a, k in records], "rec string, sport string, home string, away string, kickoff timestamp")
    final, log = resolve.resolve(df, teams, aliases, fixtures)
    got = {r.rec: (r.reason, r.fixture_id) for r in final.collect()}
    assert got["straight"] == ("strict", 10) and got["turned"] == ("strict", 10)
    assert got["spelled"] == ("alias", 11)
    assert got["clash"][0] == "review_queue"
    assert got["none"] == ("no_match", None)
    assert got["lone"] == ("review_queue", None)
    assert got["late"][0] == "strict" and got["late"][1] not in (10, 11)  # no fixture within 30 minutes: a new one
    assert got["typo"][0] in ("review_queue", "fuzzy")
    assert log.filter("rec = 'none'").count() == 3 and log.filter("rec = 'straight'").count() == 1


def test_prefixes_lose_no_pair(spark):
    """Names at the threshold or above always meet, by edit ratio and by token sets."""
    from skein.functions.similarity import edit_ratio, indel, token_set, token_set_ratio

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
    many = lambda: " ".join(sorted(word() for _ in range(rng.randint(1, 3))))
    for make, ratio, plain, sets, floor in ((word, edit_ratio, indel, False, 0.78), (many, edit_ratio, indel, False, 0.85), (many, token_set_ratio, token_set, True, 0.78)):
        names, teams = sorted({make() for _ in range(80)}), [(i, make()) for i in range(80)]
        n = spark.createDataFrame([(x, "s") for x in names], "name string, sport string")
        c = spark.createDataFrame([(i, "s", x) for i, x in teams], "team_id long, sport string, name string")
        got = {(r.name, r.team_id) for r in resolve.team_scores(n, c, ratio, floor, sets).collect()}
        assert got == {(x, i) for x in names for i, y in teams if plain(x, y) >= floor}


def test_pair_joins_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xy"), rng.sample("abcdefghij", rng.randint(1, 6))) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, g string, t array<string>")
    same = [(i, j, set(x), set(y)) for i, g, x in rows for j, h, y in rows if i < j and g == h]
    got = {(r.a, r.b, r.shared) for r in joins.jaccard_pairs(df, "id", "t", 0.5, ["g"]).collect()}
    assert got == {(i, j, len(x & y)) for i, j, x, y in same if 2 * len(x & y) >= len(x | y)}
    assert {(r.a, r.b) for r in joins.subset_pairs(df, "id", "t", ["g"]).collect()} == {(i, j) for i, j, x, y in same if x < y or y < x}
    members = df.select("id", F.explode("t").alias("r"))
    for least, small in ((1, 1000), (3, 1000), (1, 20), (3, 20), (2, 0)):
        got = {(r.a, r.b, r.shared) for r in joins.collision_pairs(members, "r", "id", least, small).collect()}
        assert got == {(i, j, len(set(x) & set(y))) for i, _, x in rows for j, _, y in rows if i < j and len(set(x) & set(y)) >= least}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    for a, b in links:
        assert a == b or got[a] == got[b] <= min(a, b)


def test_merges(spark):
    m = lambda rows: spark.createDataFrame(rows, "k long, m map<string,int>")
    got = {r.k: r.m for r in mutations.patch_maps(m([(1, {"a": 1, "b": 2}), (2, None), (3, {"a": 1})]), m([(1, {"b": 9}), (2, {"c": 3})]), "k", "m").collect()}
    assert got == {1: {"a": 1, "b": 9}, 2: {"c": 3}, 3: {"a": 1}}
    t = spark.createDataFrame([(1, "x")], "id long, v string")
    rows = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a")], "id long, v string")
    assert [tuple(r) for r in mutations.insert_absent(t, rows, ["id"]).collect()] == [(2, "a")]


def test_histogram_keeps_empty_buckets(spark):
    got = {r.bucket: r.n for r in measures.histogram(spark.createDataFrame([(-1.0,), (0.7,), (0.85,), (2.0,), (None,)], "s double"), F.col("s")).collect()}
    assert got == {"0.00-0.50": 1, "0.50-0.70": 0, "0.70-0.85": 1, "0.85-0.95": 1, "0.95-1.00": 1}


def test_json_feed(spark, tmp_path):
    event = {"EVENT_ID": "e1", "HOME_NAME": "Arsenal", "AWAY_NAME": "Atlético", "SHORTNAME_HOME": "ARS", "HOME_PARTICIPANT_TEAM_ID": ["p1"], "START_TIME": 1000, "STAGE_TYPE": "LIVE"}
    (tmp_path / "f.json").write_text(json.dumps({"TOURNAMENT_STAGE_ID": "t", "NAME": "UCL", "EVENTS": [event, {"EVENT_ID": None}]}) + "\n{bad\n")
    events = files.events_of(files.json_feed(spark, str(tmp_path)))
    assert events.count() == 2
    s = feeds.signal(events).first()
    assert [c.weight for c in s.home_candidates] == [1.0, 0.9, 0.7] and s.kickoff.timestamp() == 1000
    assert feeds.live_rows(events).filter("id = 'e1'").first().state == "live"
    assert files.validated(events, {"id": F.col("EVENT_ID").isNotNull()}).filter("size(drift) = 1").count() == 1


def test_list_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("﻿# leagues\nEPL | England\nepl | england\n\nLaLiga|Spain\n")
    assert [r.fields for r in files.list_file(spark, str(tmp_path / "l.txt")).orderBy("at").collect()] == [["EPL", "England"], ["LaLiga", "Spain"]]
    inv = files.key_inventory(spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": [1]}',)], "j string"), "j")
    assert {r.key: (r.n, r.types) for r in inv.collect()} == {"a": (2, ["array", "number"]), "b": (1, ["string"])}
    found = spark.range(1).select(files.ids_in(F.lit('{"x": {"team_id": "1"}, "y": [{"team_id": "2"}, {"team_id": "1"}]}'), "team_id").alias("v")).first().v
    assert found == ["1", "2"]


def test_key_inventory_of_nested_records(spark):
    rows = [("tennis", '{"DATA": [{"E": {"id": "7"}}, {"E": {"id": 5, "x": null}}, 1, [{"d": true}]], "n": 2.50}'), ("tennis", '{"DATA": [], "n": 10}'), ("golf", '[{"DATA": "12"}]'), ("golf", "no json"), ("golf", None)]
    rows.append(("deep", '{"a":' * 12 + '[0,0,0,0,0,0,{"last": "v"}]' + "}" * 12))
    found = {(r.sport, r.key): (r.n, r.types, r["sample"]) for r in files.key_inventory(spark.createDataFrame(rows, "sport string, j string"), "j", "sport").collect()}
    deep = {k: found.pop(k) for k in [*found] if k[0] == "deep"}
    assert len(deep) == 13 and deep[("deep", ".".join("a" * 12) + "[].last")] == (1, ["string"], "v")
    assert found == {
        ("tennis", "DATA"): (2, ["array"], None), ("tennis", "DATA[].E"): (1, ["object"], None), ("tennis", "DATA[].E.id"): (1, ["number", "string"], "5"),
        ("tennis", "DATA[].E.x"): (1, [], None), ("tennis", "DATA[][].d"): (1, ["boolean"], "true"), ("tennis", "n"): (2, ["number"], "10"), ("golf", "[].DATA"): (1, ["string"], "12"),
    }


def test_mine_failures(spark):
    said = {k: f" {k.upper()}-é " for k in review.NAME_KEYS} | {"sport": "Tennis", review.COUNTRY_KEYS[-1]: " FR "}
    rows = [(json.dumps(said), "no_match", 9), ('{"sport": "Tennis", "home": 5, "away": " . ", "home_name": null}', "review_queue", 9), ('{"sport": "Golf", "home": "x"}', "no_match", 9)]
    rows += [('{"sport": "Tennis", "home": "x"}', "strict", 9), ('{"sport": "Tennis", "home": "old"}', "no_match", 1), ("no json", "no_match", 9)]
    log = spark.createDataFrame(rows, "reason_detail string, reason_code string, decided_at long")
    found = review.mine_failures(log, "Tennis", F.lit(5)).collect()
    assert sorted(map(tuple, found)) == sorted((f"{k.upper()}-é", f"{k} e", "FR") for k in review.NAME_KEYS)
    many = spark.range(60_000).select(F.format_string('{"sport": "Golf", "home": "n%d"}', "id").alias("reason_detail"), F.lit("no_match").alias("reason_code"), F.col("id").alias("decided_at"))
    mined = review.mine_failures(many, "Golf", F.lit(5_000)).agg(F.count("*"), F.min(F.substring("raw", 2, 9).cast("int"))).first()
    assert tuple(mined) == (50_000, 10_000)


def test_feed_shapes(spark):
    titles = spark.createDataFrame([(1, "s", "Will Real Madrid beat Atletico Madrid?"), (2, "s", "Nothing here")], "rec long, sport string, title string")
    games = spark.createDataFrame([(7, "s", ["real madrid", "madrid"], ["atletico madrid"]), (8, "s", ["real"], ["madrid"])], "game long, sport string, home array<string>, away array<string>")
    assert [tuple(r) for r in feeds.phrase_match(titles, games).collect()] == [(1, 7)]
    aliases = spark.createDataFrame([("madrid", "a"), ("real madrid", "b")], "alias string, sport string")
    assert [tuple(r) for r in feeds.longest_alias(titles, aliases).collect()] == [(1, "b")]
    assert [r.category for r in feeds.incidents(spark.createDataFrame([("Own goal by X",), ("Yellow card",), ("hm",)], "text string")).collect()] == ["own_goal", "card", "other"]
    o = spark.range(1).select(feeds.orientations(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("C"))).alias("o")).first().o
    assert o == ["AC", "BC", "CA", "CB"]
    k = spark.range(1).select(feeds.market_kickoff(F.lit(None).cast("timestamp"), F.lit("2026-05-05").cast("date"), F.lit(None).cast("string")).alias("k")).first().k
    assert k.confidence == 0.6 and k.at.hour == 18
    book = spark.range(1).select(feeds.order_book(F.array(F.array(F.lit("0.17"), F.lit("5")), F.array(F.lit("x")))).alias("b")).first().b
    assert [tuple(x) for x in book] == [(17, 5.0)]
    t = spark.range(1).select(feeds.trade(F.lit("no"), F.lit(0.4), F.lit(60.0), F.lit(10.0)).alias("t")).first().t
    assert (t.side, t.cents, t.cost) == ("NO", 60, 6.0)
    rows = [Row(label="Tie", ticker="t", _yb=1, yes_bid_dollars=None), Row(label="A", ticker="a", _yb=None, yes_bid_dollars="0.42")]
    records = spark.createDataFrame([([(r.label, r.ticker, r._yb, r.yes_bid_dollars, None, None, None, None) for r in rows],)], "o array<struct<label: string, ticker: string, _yb: int, yes_bid_dollars: string, _ya: int, yes_ask_dollars: string, _na: int, no_ask_dollars: string>>")
    shown = records.select(feeds.outcomes(F.col("o")).alias("o")).first().o
    assert [(x.label, x.yes_bid) for x in shown] == [("A", 42), ("Tie", 1)]


def test_nested_shapes(spark):
    pair = "struct<home: string, away: string, home_agg: int, away_agg: int, winner: string>"
    b = spark.createDataFrame([(1, [(1, [("X", "Y", 2, 1, "X")]), (2, [("Y", "X", 0, 3, None)])])], f"id long, rounds array<struct<round: int, pairs: array<{pair}>>>")
    pairs = feeds.bracket_pairs(b)
    assert [r.round for r in pairs.collect()] == [2, 1]
    ties = spark.createDataFrame([(5, "X", "Y")], "tie long, home string, away string")
    assert [tuple(r) for r in feeds.aggregate_of(pairs, ties).collect()] == [(5, 2, 1)]
    said = [(1, 1, 44, "3 minutes of added time"), (1, 1, 46, "5 minutes of added time"), (1, 2, 90, "no")]
    assert [tuple(r) for r in feeds.added_time(spark.createDataFrame(said, "id long, half int, at int, text string")).collect()] == [(1, 1, 3)]


def test_review(spark):
    queue = spark.createDataFrame([("a", "pending", "H", "A", 0), ("b", "approved", "H", "A", 0)], "rec string, status string, home_name string, away_name string, rejection_count int")
    fixtures = spark.createDataFrame([(1, 2, T0, "f1")], "home_id long, away_id long, kickoff timestamp, fixture_id string")
    approvals = spark.createDataFrame([("a", 1, 2, T0), ("b", 1, 2, T0)], "rec string, home_id long, away_id long, kickoff timestamp")
    q, linked, aliases = review.approve(queue, fixtures, approvals)
    assert {r.rec: r.status for r in q.collect()} == {"a": "approved", "b": "approved"}
    assert [tuple(r) for r in linked.collect()] == [("a", "f1")] and aliases.count() == 2
    assert {r.rec: (r.status, r.rejection_count) for r in review.reject(queue, approvals).collect()} == {"a": ("rejected", 1), "b": ("approved", 0)}
    assert review.unit_or_none("1.5") is None and review.unit_or_none("0.5") == 0.5
    assert review.markdown([{"a": "x|y"}], ["a"], "T").endswith("| x\\|y |\n")
    c = spark.range(1).select(review.candidate_set(F.lit("fl:1, k:a:b, bad")).alias("c")).first().c
    assert [tuple(x) for x in c] == [("fl", "1"), ("k", "a:b")]


def test_merge_and_rollback(spark):
    members = spark.createDataFrame([(r, t) for r in range(3) for t in (1, 2)] + [(9, 3)], "record long, team long")
    clusters = review.duplicate_clusters(members, "record", "team", 3, 4)
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "id long, n int")
    mapping = mutations.merge_mapping(clusters, rows, "id", F.col("n").desc(), F.col("id"))
    assert {r.id: r.canonical for r in mapping.collect()} == {1: 2, 2: 2}
    aliases = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "alias string, team_id long")
    fixtures = spark.createDataFrame([(7, 1, 3)], "fixture_id long, home_id long, away_id long")
    state = review.pre_state(mapping, aliases, fixtures)
    moved = review.move_aliases(aliases, mapping)
    assert {(r.alias, r.team_id) for r in moved.collect()} == {("x", 2), ("y", 2), ("z", 3)}
    assert {(r.alias, r.team_id) for r in review.rollback(moved, state).collect()} == {("x", 1), ("y", 2), ("z", 3)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"t{i % 3}", float(i), T0 + dt.timedelta(minutes=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, ticker string, price double, at timestamp")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    live = stream.source(spark, str(tmp_path / "in"), df.schema, 1)
    counted = stream.windowed(live, "at", "10 minutes", "1 hour", "ticker")
    got = stream.run_once(counted, "w", "complete", str(tmp_path / "cp")).groupBy("ticker").agg(F.sum("n").alias("n")).collect()
    assert {r.ticker: r.n for r in got} == {"t0": 7, "t1": 7, "t2": 6}
    last = {r.ticker: r.price for r in stream.last_write_wins(df, "ticker", "seq").collect()}
    assert last == {"t0": 18.0, "t1": 19.0, "t2": 17.0}


def test_copies_are_classes_and_hot_lists_are_dealt(spark, monkeypatch):
    """Three thousand equal rows are one class; a list longer than its limit gives the same pairs."""
    rows = [(i, "x", ["a", "b", "c"]) for i in range(3000)] + [(3000 + i, "x", ["a", "b", f"t{i % 7}"]) for i in range(70)] + [(4000, "x", []), (4001, "x", None), (4002, None, ["a"])]
    df = spark.createDataFrame(rows, "id long, g string, t array<string>").repartition(8)
    members, pairs = joins.jaccard_classes(df, "id", "t", 0.5, ["g"])
    got = {r.id: (r["class"], r.size, r.n_links) for r in members.collect()}
    assert got[5] == (0, 3000, 3069) and got[3000 + 8] == (3001, 10, 3069) and pairs.count() == 28 and 4000 not in got and 4001 not in got
    monkeypatch.setattr(joins, "LIST", 3)
    monkeypatch.setattr(joins.dealt, "__defaults__", (3,))
    small = df.filter("id >= 2980")
    got = {(r.a, r.b) for r in joins.jaccard_pairs(small, "id", "t", 0.5, ["g"]).collect()}
    assert len(got) == 90 * 89 // 2
    p = spark.range(9000).select("id", F.lit("hot").alias("token"), F.lit(9000).alias("list"))
    parts = joins.dealt(p, p.select(F.col("id").alias("b"), "token", "list").filter("b < 2"), ["token"], 1000)
    assert parts.count() == 18000
    dealt = p.select(F.pmod(F.xxhash64("id"), F.lit(9)).alias("part")).groupBy("part").count().agg(F.max("count")).first()[0]
    assert dealt < 1200


def test_trigram_matches_of_copies(spark):
    left = spark.createDataFrame([(i, "s", "red bolt") for i in range(50)] + [(50, "s", "zzz"), (51, None, "red bolt"), (52, "s", None)], "l long, g string, x string")
    right = spark.createDataFrame([(i, "s", "red bolts") for i in range(40)] + [(90, "s", "red bolt"), (91, "q", "red bolt")], "r long, g string, y string")
    got = joins.trigram_top(left, right, "l", "x", "r", "y", 0.3, 3, ["g"]).collect()
    assert len(got) == 150 and {(r.rid, r.rank) for r in got} == {(90, 1), (0, 2), (1, 3)}
