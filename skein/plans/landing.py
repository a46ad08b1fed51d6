"""Sources and sinks over provider rows made of harness tables: feeds are landed as JSON and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import domain, grammar, text
from skein.operators import feeds, joins, mutations, review
from skein.operators.storage import stored
from skein.plans.derived import FEED, MARKETS, SPORTS, feed, markets, pick, picked, quoted, values
from skein.plans.registry import Tables, query
from skein.sources import files
from skein.streaming import feeds as stream


def _string(c: str):
    return F.col(c).cast("string")


@query(f"WITH {FEED} SELECT CAST(rec AS VARCHAR) AS id, sport AS league, HOME_NAME AS home, nullif(AWAY_NAME, '') AS away, CAST(HOME_SCORE_CURRENT AS VARCHAR) AS home_score, lower(STAGE_TYPE) AS state, HOME_SCORE_CURRENT AS period FROM feed")
def S08_scoreboard_feed(t: Tables) -> DataFrame:
    side = lambda s, c, n: F.struct(F.lit(s).alias("homeAway"), c.alias("displayName"), _string(n).alias("score"))
    f = feed(t)
    event = F.struct(_string("rec").alias("id"), F.struct(F.lower("STAGE_TYPE").alias("state"), F.col("HOME_SCORE_CURRENT").alias("period"), F.lit("1:00").alias("displayClock")).alias("status"),
                     F.array(side("away", F.nullif("AWAY_NAME", F.lit("")), "AWAY_SCORE_CURRENT"), side("home", F.col("HOME_NAME"), "HOME_SCORE_CURRENT")).alias("competitors"))
    path = files.land(f.select(F.col("sport").alias("league"), F.array(event).alias("events")), "scoreboard")
    return files.scoreboard_events(files.json_feed(t.spark, path, files.SCOREBOARD)).select("id", "league", "home", "away", "home_score", "state", "period")


@query(f"WITH {FEED} SELECT rec AS id, lower(STAGE_TYPE) AS type, STAGE AS description, HOME_NAME AS home, HOME_SCORE_CURRENT AS home_score, CASE WHEN rec % 2 = 0 THEN AWAY_SCORE_CURRENT END AS away_agg, 'r' || rec % 3 AS round FROM feed")
def S09_typed_feed(t: Tables) -> DataFrame:
    score = lambda n, a: F.struct(F.col(n).alias("current"), a.alias("aggregated"))
    event = F.struct(
        F.col("rec").alias("id"), F.struct(F.lower("STAGE_TYPE").alias("type"), F.col("STAGE").alias("description")).alias("status"), F.struct(F.col("HOME_NAME").alias("name")).alias("homeTeam"), F.struct(F.col("AWAY_NAME").alias("name")).alias("awayTeam"),
        score("HOME_SCORE_CURRENT", F.lit(None).cast("int")).alias("homeScore"), score("AWAY_SCORE_CURRENT", F.when(F.col("rec") % 2 == 0, F.col("AWAY_SCORE_CURRENT"))).alias("awayScore"), F.struct(F.concat(F.lit("r"), (F.col("rec") % 3).cast("string")).alias("name")).alias("roundInfo"),
    )
    path = files.land(feed(t).select(F.array(event).alias("events")), "typed")
    return files.typed_events(files.json_feed(t.spark, path, files.TYPED)).select("id", "type", "description", "home", "home_score", "away_agg", "round")


@query(f"WITH {FEED} SELECT CAST(rec AS VARCHAR) AS id, sport AS league, HOME_NAME AS home, CAST(HOME_SCORE_CURRENT AS VARCHAR) AS home_score, STAGE AS status, CASE WHEN rec % 4 > 0 THEN rec % 4 || '''' END AS progress FROM feed")
def S10_status_feed(t: Tables) -> DataFrame:
    progress = F.when(F.col("rec") % 4 > 0, F.concat((F.col("rec") % 4).cast("string"), F.lit("'")))
    event = F.struct(
        _string("rec").alias("idEvent"), F.col("HOME_NAME").alias("strHomeTeam"), F.col("AWAY_NAME").alias("strAwayTeam"), _string("HOME_SCORE_CURRENT").alias("intHomeScore"), _string("AWAY_SCORE_CURRENT").alias("intAwayScore"),
        F.col("STAGE").alias("strStatus"), progress.alias("strProgress"), F.col("sport").alias("strLeague"),
    )
    path = files.land(feed(t).select(F.array(event).alias("events")), "statuses")
    return files.status_events(files.json_feed(t.spark, path, files.STATUSES)).select("id", "league", "home", "home_score", "status", "progress")


@query("SELECT event_id, user_id, event_type, value FROM events")
def S11_landed_stream(t: Tables) -> DataFrame:
    """Rows land as files and come back through a stream, some files at a time."""
    rows, folder = t.events.select("event_id", "user_id", "event_type", "value"), files.shared_path(t.spark, "landed")
    rows.repartition(4).write.parquet(folder)
    return stream.run_once(stream.source(t.spark, folder, rows.schema, 2), "stream", "append", f"{files.shared_path(t.spark, 'checkpoint')}")


@query("SELECT 'L' || n_regionkey AS league, n_nationkey AS stage, n_name || s AS name FROM nation, (VALUES (' Main'), (' Final')) v(s)")
def S12_league_stages(t: Tables) -> DataFrame:
    stage = lambda s: F.struct(F.col("n_nationkey").alias("stage"), F.concat("n_name", F.lit(s)).alias("name"))
    leagues = t.nation.select(F.concat(F.lit("L"), _string("n_regionkey")).alias("league"), F.array(stage(" Main"), stage(" Final")).alias("STAGES"))
    path = files.land(leagues, "leagues")
    return files.stages_of(files.json_feed(t.spark, path, "league string, STAGES array<struct<stage: int, name: string>>"))


@query("SELECT DISTINCT team FROM (SELECT unnest(['t' || l_suppkey, 't' || l_partkey % 50]) AS team FROM lineitem)")
def S13_roster_walk(t: Tables) -> DataFrame:
    """Ids at any depth of standings payloads, each once."""
    row = F.concat(F.lit('{"DATA": [{"GROUP": {"ROWS": [{"TEAM_ID": "t'), _string("l_suppkey"), F.lit('"}]}}, {"TEAM_ID": "t'), (F.col("l_partkey") % 50).cast("string"), F.lit('"}]}'))
    return t.lineitem.select(F.explode(files.ids_in(row, "TEAM_ID")).alias("team")).distinct()


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 30)")
def S14_team_details(t: Tables) -> DataFrame:
    wanted = t.lineitem.filter("l_quantity > 30").select(F.col("l_suppkey").alias("s_suppkey"))
    return files.details(wanted, t.supplier.select("s_suppkey", "s_name"), "s_suppkey")


@query("SELECT s_suppkey AS team_id, s_name AS name, [s_name, 'x' || s_suppkey] AS aliases FROM supplier")
def S15_roster_file(t: Tables) -> DataFrame:
    path = files.land(t.supplier.select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"), F.array("s_name", F.concat(F.lit("x"), _string("s_suppkey"))).alias("aliases")), "roster")
    return files.roster(t.spark, path, "team_id long, name string, aliases array<string>")


_SEEDS = (("red bolt", "USA"), ("hot gear", "DEU"), ("new team", "FRA"), ("cold widget", None))


@query(f"SELECT s.name, count(p_partkey) AS parts FROM (VALUES {values(_SEEDS)}) s(name, country) LEFT JOIN part ON p_name = s.name GROUP BY s.name")
def S17_seed_table(t: Tables) -> DataFrame:
    seeds = files.seeds(t.spark, list(_SEEDS), "name string, country string")
    return seeds.join(t.part, F.col("p_name") == F.col("name"), "left").groupBy("name").agg(F.count("p_partkey").alias("parts"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-01-10' - 3 AND DATE '2000-01-10' + 3")
def S20_backfill_sweep(t: Tables) -> DataFrame:
    days = files.requests(t.spark.createDataFrame([("all",)], "sport string"), 3).select(F.date_add(F.lit("2000-01-10").cast("date"), F.col("day")).alias("d"))
    return t.orders.join(F.broadcast(days), F.to_date("o_orderdate") == F.col("d"), "left_semi").select("o_orderkey")


@query(f"WITH {MARKETS} SELECT rec, title, series FROM market WHERE series <> ''")
def S21_backfill_markets(t: Tables) -> DataFrame:
    """Landed market records; those that break a rule of their schema are split off."""
    path = files.land(markets(t).select("rec", "title", "series"), "markets")
    read = files.validated(files.json_feed(t.spark, path, "rec long, title string, series string"), {"series": F.col("series") != "", "title": F.col("title").isNotNull()})
    return read.filter(F.size("drift") == 0).select("rec", "title", "series")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'summary' ELSE 'incidents' END AS source FROM orders")
def S22_detail_fallback(t: Tables) -> DataFrame:
    row = lambda n: F.lit(n).alias("source")
    first = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), row("summary"))
    return files.with_fallback(first, t.orders.select(F.col("o_orderkey").alias("id"), row("incidents")), "id")


_KEYS = ("home_provider_normalized", "away_provider_normalized", "home_provider_raw", "away_provider_raw", "home_canonical", "away_canonical", "home_name", "away_name", "home", "away")


@query(f"""WITH {FEED}, w AS (SELECT HOME_NAME, AWAY_NAME, rec, o_orderdate FROM feed WHERE sport = 'Tennis' AND rec % 3 > 0 AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, rec DESC LIMIT 50000)
  SELECT raw, trim(lower(raw)) AS normalized, CASE WHEN rec % 2 = 0 THEN 'FR' ELSE '' END AS country_hint FROM (SELECT rec, unnest(list_concat([HOME_NAME, upper(AWAY_NAME)], CASE WHEN rec % 4 = 0 THEN [HOME_NAME || ' x'] ELSE [] END)) AS raw FROM w) WHERE raw <> ''""")
def S23_failure_mining(t: Tables) -> DataFrame:
    """Keys of a failed record's detail, unpivoted; a record without a key has no name of it."""
    pair = lambda k, v: F.concat(F.lit(f', "{k}": "'), v, F.lit('"'))
    more = F.when(F.col("rec") % 4 == 0, pair("home_canonical", F.concat("HOME_NAME", F.lit(" x")))).otherwise("")
    hint = F.when(F.col("rec") % 2 == 0, F.lit(', "league_country": " FR "')).otherwise("")
    detail = F.concat(F.lit('{"sport": "'), "sport", F.lit('"'), pair("home_name", F.col("HOME_NAME")), pair("away", F.upper("AWAY_NAME")), more, hint, F.lit("}"))
    log = feed(t).select("rec", detail.alias("reason_detail"), F.when(F.col("rec") % 3 == 0, "strict").when(F.col("rec") % 3 == 1, "no_match").otherwise("review_queue").alias("reason_code"), F.col("o_orderdate").alias("decided_at"))
    return review.mine_failures(log, "Tennis", F.lit("1996-01-01").cast("timestamp_ntz"), "rec")


@query(f"WITH {FEED} SELECT rec FROM feed WHERE sport IN ('Soccer', 'Tennis')")
def S25_singleton_config(t: Tables) -> DataFrame:
    """The enabled sports of the one configuration row."""
    config = files.seeds(t.spark, [(1, ["Soccer", "Tennis"]), (2, ["Golf"])], "id int, sports array<string>").filter("id = 1").select(F.explode("sports").alias("sport"))
    return feed(t).join(F.broadcast(config), "sport", "left_semi").select("rec")


# ---- sinks: the next version of a table, read from where it was written


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'changed' ELSE c_name END AS name, CASE WHEN c_custkey = 7 THEN 'update' ELSE 'kept' END AS action FROM customer")
def K02_single_upsert(t: Tables) -> DataFrame:
    row = lambda d: d.withColumn("digest", F.sha2(F.col("name"), 256))
    one = t.spark.createDataFrame([(7, "changed")], "id long, name string")
    return stored(mutations.classified_merge(row(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))), row(one), "id", "digest").drop("digest"), "upsert")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk FROM orders")
def K03_chunked_upsert(t: Tables) -> DataFrame:
    return mutations.chunks(t.orders.select("o_orderkey"), "o_orderkey", 50)


@query("SELECT event_id, value FROM events UNION ALL SELECT event_id, value + 1 FROM events WHERE event_type = 'click'")
def K05_append_ticks(t: Tables) -> DataFrame:
    first = stored(t.events.select("event_id", "value"), "ticks")
    return first.unionByName(stored(t.events.filter("event_type = 'click'").select("event_id", (F.col("value") + 1).alias("value")), "ticks"))


@query("SELECT event_id, ts + INTERVAL 30 DAY AS expires_at FROM events")
def K06_expiring_insert(t: Tables) -> DataFrame:
    return stored(mutations.expiring(t.events.select("event_id", "ts"), "ts"), "snapshots").select("event_id", "expires_at")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS data FROM customer")
def K07_blob_upsert(t: Tables) -> DataFrame:
    blobs = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("data"))
    return mutations.update_where(blobs, blobs.filter("key % 10 = 0").withColumn("data", F.lit("new")), "key", ["data"], F.lit(True))


@query("SELECT DISTINCT p_name || p_brand AS alias FROM part WHERE p_name || p_brand NOT IN (SELECT p_name || p_brand FROM part WHERE p_type = 'SMALL')")
def K11_alias_write_back(t: Tables) -> DataFrame:
    alias = F.concat("p_name", "p_brand").alias("alias")
    return mutations.insert_absent(t.part.filter("p_type = 'SMALL'").select(alias).distinct(), t.part.select(alias), ["alias"])


@query("SELECT CAST(ts AS DATE) AS run, count(*) AS scanned, count(*) FILTER (event_type = 'error') AS crashes FROM events GROUP BY 1")
def K12_run_metrics(t: Tables) -> DataFrame:
    return stored(t.events.groupBy(F.to_date("ts").alias("run")).agg(F.count("*").alias("scanned"), F.count_if(F.col("event_type") == "error").alias("crashes")), "runs")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 HAVING day(CAST(ts AS DATE)) % 2 = 0")
def K13_report_guard(t: Tables) -> DataFrame:
    all_days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return mutations.unreported(all_days.filter(F.dayofmonth("day") % 2 == 1), all_days, "day")


def _lines(t: Tables, said: str) -> DataFrame:
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(said.split("\n")) if x], "at int, line string")


@query("""SELECT 0 AS at, '# Volume' AS line UNION ALL SELECT 2, '| event_type | n |' UNION ALL SELECT 3, '|---|---|' UNION ALL
  SELECT 3 + CAST(row_number() OVER (ORDER BY event_type) AS INT), '| ' || event_type || ' | ' || n || ' |' FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def K15_markdown_report(t: Tables) -> DataFrame:
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").limit(100).collect()  # a report of a few rows
    return _lines(t, review.markdown(rows, ["event_type", "n"], "Volume"))


@query("SELECT p_name AS alias, count(*) AS n FROM part GROUP BY 1")
def K16_harvest_json(t: Tables) -> DataFrame:
    path = files.land(t.part.groupBy(F.col("p_name").alias("alias")).agg(F.count("*").alias("n")), "harvest")
    return t.spark.read.schema("alias string, n long").json(path)


@query("SELECT p_brand AS league, count(*) AS teams FROM part GROUP BY 1")
def K17_league_bundles(t: Tables) -> DataFrame:
    """A folder for each league."""
    path = files.shared_path(t.spark, "bundles")
    t.part.select(F.col("p_brand").alias("league"), "p_name").write.partitionBy("league").json(path)
    return t.spark.read.schema("p_name string, league string").json(path).groupBy("league").agg(F.count("*").alias("teams"))


@query("SELECT event_id AS id, 'feed' AS provider, event_type AS endpoint, CAST(value * 10 AS INT) AS latency_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events")
def K18_call_events(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return stored(t.events.select(F.col("event_id").alias("id"), F.lit("feed").alias("provider"), F.col("event_type").alias("endpoint"), F.rint(F.col("value") * 10).cast("int").alias("latency_ms"), status.alias("status")), "calls")


@query("""WITH held AS (SELECT DISTINCT p_name AS alias, p_size AS team_id FROM part WHERE p_partkey % 4 = 0), w AS (SELECT DISTINCT p_name AS alias, p_size AS team_id FROM part WHERE p_partkey % 3 = 0), f AS (SELECT alias, min(team_id) AS first FROM w GROUP BY 1)
  SELECT w.alias, w.team_id, CASE WHEN w.alias NOT IN (SELECT alias FROM held) THEN CASE WHEN team_id = first THEN 'added' ELSE 'conflict' END WHEN (w.alias, w.team_id) IN (SELECT (alias, team_id) FROM held) THEN 'present' ELSE 'conflict' END AS outcome FROM w JOIN f USING (alias)""")
def K19_alias_add(t: Tables) -> DataFrame:
    rows = lambda n: t.part.filter(f"p_partkey % {n} = 0").select(F.col("p_name").alias("alias"), F.col("p_size").alias("team_id"))
    return mutations.add_aliases(rows(4), rows(3))


@query("SELECT event_id, 'resolver' AS run, event_type AS reason FROM events WHERE value > 50")
def K22_log_insert(t: Tables) -> DataFrame:
    return stored(t.events.filter("value > 50").select("event_id", F.lit("resolver").alias("run"), F.col("event_type").alias("reason")), "log")


@query("SELECT count(*) AS candidates, count(*) > 50000 AS stopped FROM orders WHERE o_totalprice > 100000")
def K23_runner_limit(t: Tables) -> DataFrame:
    n = t.orders.filter("o_totalprice > 100000").agg(F.count("*").alias("candidates"))
    halts = domain.reselection_halts(F.col("candidates"), F.lit(0), F.lit(None).cast("double"))
    return n.select("candidates", F.array_contains(halts, "limit").alias("stopped"))


# ---- streams


@query("SELECT user_id, arg_max(value, event_id) AS price FROM events GROUP BY user_id")
def T05_price_projection(t: Tables) -> DataFrame:
    return stream.last_write_wins(t.events.select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", F.col("value").alias("price"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 90)")
def T08_subscription_refresh(t: Tables) -> DataFrame:
    """What is to be subscribed to now and was not before."""
    now, before = t.events.filter("event_type = 'signup'").select("user_id"), t.events.filter("event_type = 'click' and value > 90").select("user_id")
    return now.subtract(before)


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def T12_keyed_merge(t: Tables) -> DataFrame:
    """Parsed events merged into games, batch after batch; the last one of each key stays."""
    rows = t.events.select(F.struct("user_id", "event_type").alias("key"), "event_id")
    merged = rows.limit(0)
    for batch in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        merged = stream.last_write_wins(merged.unionByName(batch), "key", "event_id")
    return merged.select("key.user_id", "key.event_type", "event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - CASE WHEN event_type = 'error' THEN INTERVAL 1 DAY ELSE INTERVAL 5 DAY END AND ts <= TIMESTAMP '2024-01-20'")
def T17_ttl_cache(t: Tables) -> DataFrame:
    """Answers expire after five days, failures after one."""
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    ttl = F.when(F.col("event_type") == "error", F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(F.lit(5)))
    return mutations.unexpired(t.events.filter(F.col("ts") <= now).withColumn("until", F.col("ts") + ttl), "until", now).select("event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def T18_bounded_admission(t: Tables) -> DataFrame:
    """A file at a time is admitted; the counts are those of all."""
    rows, folder = t.events.select("event_id", "event_type"), files.shared_path(t.spark, "landed")
    rows.repartition(3).write.parquet(folder)
    live = stream.source(t.spark, folder, rows.schema, 1)
    return stream.run_once(live.groupBy("event_type").agg(F.count("*").alias("n")), "admitted", "complete", files.shared_path(t.spark, "checkpoint"))


@query("SELECT event_type AS task, max(ts) AS last_pass, epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT > 7200 AS stale FROM events GROUP BY 1")
def T23_task_health(t: Tables) -> DataFrame:
    return stream.health(t.events, "event_type", "ts", F.lit("2024-02-01").cast("timestamp_ntz"), 7200).select(F.col("event_type").alias("task"), "last_pass", "stale")
