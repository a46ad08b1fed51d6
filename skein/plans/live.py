"""Live state and feeds over provider rows made of harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import domain, grammar
from skein.operators import feeds, joins, live, review
from skein.plans.derived import FEED, MARKETS, NORM, feed, markets, pick, picked, quoted, values
from skein.plans.registry import Tables, query
from skein.sources import files

_IN = f"({', '.join(map(quoted, live.LIVE_STAGES))})"
_POST = f"({', '.join(map(quoted, live.FINISHED_STAGES))})"
_STATE = f"CASE WHEN STAGE_TYPE IN {_IN} OR STAGE IN {_IN} THEN 'in' WHEN STAGE_TYPE IN {_POST} OR STAGE IN {_POST} THEN 'post' ELSE 'pre' END"


@query(f"WITH {FEED} SELECT rec, CASE {_STATE} WHEN 'in' THEN 'live' WHEN 'post' THEN 'final' ELSE 'scheduled' END AS state FROM feed")
def P24_state_normalisation(t: Tables) -> DataFrame:
    return feed(t).select("rec", live.normalized_state(live.stage_state(F.col("STAGE_TYPE"), F.col("STAGE"))).alias("state"))


_LABEL = "CASE STAGE " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in live.STAGE_LABELS) + " WHEN 'EXTRA_TIME_FIRST_HALF' THEN 'Extra Time First Half' WHEN 'EXTRA_TIME_SECOND_HALF' THEN 'Extra Time Second Half' WHEN 'FINISHED' THEN 'Finished' END"
_MINUTE = """CASE WHEN m > e THEN e || '+' || (m - e) || '''' ELSE m || '''' END"""


@query(f"""WITH {FEED}, f AS (SELECT *, {_STATE} AS state, CASE WHEN rec % 9 = 0 THEN '37' WHEN rec % 9 = 1 THEN '-1' END AS gt, rec * 37 % 4200 AS el FROM feed),
  g AS (SELECT f.*, p.e, greatest(p.s + 1, p.s + el // 60) AS m FROM f LEFT JOIN (VALUES ('FIRST_HALF', 0, 45), ('SECOND_HALF', 45, 90), ('EXTRA_TIME_FIRST_HALF', 90, 105), ('EXTRA_TIME_SECOND_HALF', 105, 120)) p(k, s, e) ON p.k = STAGE)
  SELECT EVENT_ID AS id, sport, HOME_NAME AS home, AWAY_NAME AS away, SHORTNAME_HOME AS home_abbr, coalesce(SHORTNAME_AWAY, upper(substr(AWAY_NAME, 1, 3))) AS away_abbr, CAST(HOME_SCORE_CURRENT AS VARCHAR) AS home_score, CAST(AWAY_SCORE_CURRENT AS VARCHAR) AS away_score,
    state, CASE STAGE WHEN 'FIRST_HALF' THEN 1 WHEN 'SECOND_HALF' THEN 2 ELSE 0 END AS period, STAGE = 'HALFTIME' AS is_halftime, state = 'in' AND STAGE <> 'HALFTIME' AS clock_running,
    CASE WHEN gt = '37' THEN CASE WHEN sport = 'Soccer' THEN '37''' ELSE '37' END WHEN sport = 'Soccer' AND state = 'in' AND e IS NOT NULL THEN {_MINUTE} WHEN state = 'in' THEN {_LABEL} WHEN state = 'post' THEN 'FT' ELSE '' END AS display_clock, START_UTIME * 1000 AS kickoff_ms FROM g""")
def P20_feed_rows(t: Tables) -> DataFrame:
    game_time = F.when(F.col("rec") % 9 == 0, "37").when(F.col("rec") % 9 == 1, "-1")
    return live.feed_rows(feed(t).withColumns({"GAME_TIME": game_time, "elapsed": F.col("rec") * 37 % 4200}))


_STATUS = ("Match Finished", "1H", "second half 2", "Not Started", "Postponed", "HT", "AET", "", "First Half", "Penalty Shootout", "live")
_PROGRESS = ("12", "45+2", "", None, "67'")


@query(f"""WITH {FEED}, f AS (SELECT *, {picked('rec', _STATUS)} AS status, {picked('rec // 11', _PROGRESS)} AS progress FROM feed), g AS (SELECT *, lower(status) AS l, regexp_extract(coalesce(progress, ''), '^(\\d+)', 1) AS m FROM f)
  SELECT rec AS id, sport, HOME_NAME AS home, AWAY_NAME AS away, upper(substr(split_part(HOME_NAME, ' ', 1), 1, 3)) AS home_abbr, upper(substr(split_part(AWAY_NAME, ' ', 1), 1, 3)) AS away_abbr, CAST(HOME_SCORE_CURRENT AS VARCHAR) AS home_score, CAST(AWAY_SCORE_CURRENT AS VARCHAR) AS away_score,
    CASE WHEN {' OR '.join(f'contains(l, {quoted(w)})' for w in live.OVER)} THEN 'post' ELSE 'in' END AS state, CASE WHEN sport <> 'Soccer' OR m = '' THEN 0 WHEN contains(l, '1h') OR contains(l, 'first half') THEN 1 WHEN contains(l, '2h') OR contains(l, 'second half') THEN 2 ELSE 0 END AS period,
    CASE WHEN sport = 'Soccer' AND m <> '' AND (contains(l, '1h') OR contains(l, 'first half') OR contains(l, '2h') OR contains(l, 'second half')) THEN m || '''' ELSE '' END AS display_clock, status AS detail
  FROM g WHERE status <> '' AND NOT ({' OR '.join(f'contains(l, {quoted(w)})' for w in live.NOT_BEGUN)}) AND AWAY_NAME <> ''""")
def P21_status_rows(t: Tables) -> DataFrame:
    own = feed(t).withColumn("eleventh", F.floor(F.col("rec") / 11))
    e = own.select(F.col("rec").alias("id"), "sport", pick("rec", _STATUS).alias("status"), pick("eleventh", _PROGRESS).alias("progress"), F.col("HOME_NAME").alias("home"), F.col("AWAY_NAME").alias("away"), F.col("HOME_SCORE_CURRENT").alias("home_score"), F.col("AWAY_SCORE_CURRENT").alias("away_score"))
    return live.status_rows(e)


_TYPE, _DESC, _ROUND = ("inprogress", "finished", "notstarted"), ("1st half", "2nd half", "Halftime", "Ended", "First half"), ("Semifinal, 2nd leg", "Final", "First leg", "")


@query(f"""WITH {FEED}, f AS (SELECT *, {picked('rec', _TYPE)} AS ty, lower({picked('rec // 3', _DESC)}) AS l, lower({picked('rec // 2', _ROUND)}) AS r, CASE WHEN rec % 6 < 2 THEN HOME_SCORE_CURRENT + 1 END AS ah, CASE WHEN rec % 4 < 2 THEN AWAY_SCORE_CURRENT END AS aa, rec * 11 % 3000 - 60 AS el, sport = 'Soccer' AS so FROM feed),
  g AS (SELECT *, CASE WHEN NOT so THEN 0 WHEN contains(l, '1st half') OR contains(l, 'first half') THEN 1 WHEN contains(l, '2nd half') THEN 2 ELSE 0 END AS period, CASE WHEN so AND contains(r, '2nd leg') THEN 2 WHEN so AND contains(r, 'first leg') THEN 1 END AS leg FROM f),
  h AS (SELECT *, so AND ((ah IS NOT NULL AND aa IS NOT NULL) OR leg IS NOT NULL) AS two FROM g)
  SELECT rec AS id, sport, CASE ty WHEN 'inprogress' THEN 'in' ELSE 'post' END AS state, HOME_NAME AS home, AWAY_NAME AS away, period, CASE WHEN period > 0 AND el >= 0 THEN (greatest(1, el // 60) + CASE WHEN period = 2 THEN 45 ELSE 0 END) || '''' ELSE '' END AS display_clock,
    two AS is_two_leg, CASE WHEN two THEN ah END AS aggregate_home, CASE WHEN two THEN aa END AS aggregate_away, leg AS leg_number FROM h WHERE ty <> 'notstarted' AND AWAY_NAME <> ''""")
def P22_typed_rows(t: Tables) -> DataFrame:
    own = feed(t).withColumns({"third": F.floor(F.col("rec") / 3), "second": F.floor(F.col("rec") / 2)})
    agg = lambda n, c: F.when(F.col("rec") % n < 2, c)
    e = own.select(
        F.col("rec").alias("id"), "sport", pick("rec", _TYPE).alias("type"), pick("third", _DESC).alias("description"), pick("second", _ROUND).alias("round"), F.col("HOME_NAME").alias("home"), F.col("AWAY_NAME").alias("away"),
        agg(6, F.col("HOME_SCORE_CURRENT") + 1).alias("home_agg"), agg(4, F.col("AWAY_SCORE_CURRENT")).alias("away_agg"), (F.col("rec") * 11 % 3000 - 60).alias("elapsed"),
    )
    return live.typed_rows(e)


@query(f"""WITH {FEED} SELECT rec, coalesce(CASE WHEN has THEN s END, '') AS state, CASE WHEN has THEN HOME_SCORE_CURRENT ELSE 0 END AS period, CASE WHEN has AND rec % 4 = 0 THEN false ELSE true END AS clock_running, has AND rec % 6 = 0 AS is_two_leg,
  CASE WHEN has AND rec % 6 = 0 THEN AWAY_SCORE_CURRENT END AS aggregate_home, CASE WHEN has THEN 'fl' ELSE '' END AS source FROM (SELECT *, rec % 3 > 0 AS has, {_STATE} AS s FROM feed)""")
def P23_live_contract(t: Tables) -> DataFrame:
    f = feed(t)
    rows = f.filter("rec % 3 > 0").select(
        "rec", live.stage_state(F.col("STAGE_TYPE"), F.col("STAGE")).alias("state"), F.lit("").alias("display_clock"), F.col("HOME_SCORE_CURRENT").alias("period"), (F.col("rec") % 4 != 0).alias("clock_running"), (F.col("rec") % 6 == 0).alias("is_two_leg"),
        F.when(F.col("rec") % 6 == 0, F.col("AWAY_SCORE_CURRENT")).alias("aggregate_home"), F.lit(None).cast("int").alias("aggregate_away"), F.lit(None).cast("int").alias("leg_number"), F.lit("fl").alias("source"),
    )
    return live.contract(f, rows, "rec").select("rec", "state", "period", "clock_running", "is_two_leg", "aggregate_home", "source")


@query(f"WITH {FEED} SELECT rec FROM feed WHERE {_STATE} = 'in' OR ({_STATE} = 'pre' AND abs(START_UTIME - 915148800 - rec * 60) % 10000 BETWEEN 0 AND 1800)")
def P41_live_predicate(t: Tables) -> DataFrame:
    f = feed(t).withColumn("state", live.stage_state(F.col("STAGE_TYPE"), F.col("STAGE")))
    return f.filter(feeds.counts_as_live(F.col("state"), F.abs(F.col("START_UTIME") - 915148800 - F.col("rec") * 60) % 10000, F.lit(0))).select("rec")


_NOTICE = ("{h} leads series 2-1", "Series tied 1:1.", "{a} wins series 4 - 2.", "Playoff night", None, "nobody leads series 3-0")


@query(f"""WITH {FEED}, n AS (SELECT rec, HOME_NAME AS h, AWAY_NAME AS a, replace(replace({picked('rec', _NOTICE)}, '{{h}}', upper(HOME_NAME)), '{{a}}', AWAY_NAME) AS t FROM feed)
  SELECT rec, CASE rec % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN a = '' THEN NULL WHEN contains(h, a) OR contains(a, h) THEN 4 ELSE 2 END END AS home_wins, CASE rec % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN a = '' THEN NULL WHEN contains(h, a) OR contains(a, h) THEN 2 ELSE 4 END END AS away_wins,
  CASE WHEN rec % 6 IN (0, 1, 5) OR (rec % 6 = 2 AND a <> '') THEN trim(rtrim(t, '.')) END AS summary FROM n""")
def F46_series_summary(t: Tables) -> DataFrame:
    said = F.replace(F.replace(pick("rec", _NOTICE), F.lit("{h}"), F.upper("HOME_NAME")), F.lit("{a}"), F.col("AWAY_NAME"))
    return feed(t).select("rec", live.series_of(said, F.col("HOME_NAME"), F.col("AWAY_NAME")).alias("s")).select("rec", "s.home_wins", "s.away_wins", "s.summary")


_SAID = ("Minimum of 3 min. of stoppage-time", "5 min of added time", "Corner", "2 MIN. OF ADDED TIME announced", "no added time")
_CTIME = ("45", "45+1", "90", "12", "90+2")


@query(f"""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS pos, {picked('l_partkey', _SAID)} AS t, {picked('l_suppkey', _CTIME)} AS m, CASE WHEN l_returnflag = 'N' THEN 'goal' ELSE 'Time' END AS c FROM lineitem),
  x AS (SELECT id, pos, t, m, CASE WHEN starts_with(m, '45') THEN 1 WHEN starts_with(m, '90') THEN 2 END AS half, TRY_CAST(nullif(regexp_extract(t, '(\\d+) (min\\.?|MIN\\.) (of|OF)', 1), '') AS INT) AS minutes FROM c WHERE lower(c) = 'time')
  SELECT id, half, min(minutes) AS minutes FROM (SELECT *, rank() OVER (PARTITION BY id, half ORDER BY pos) AS k FROM x WHERE minutes IS NOT NULL AND half IS NOT NULL) WHERE k = 1 GROUP BY id, half""")
def F47_added_time(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), pick("l_partkey", _SAID).alias("text"), pick("l_suppkey", _CTIME).alias("minute"), F.when(F.col("l_returnflag") == "N", "goal").otherwise("Time").alias("class"))
    order = F.struct("n", F.regexp_extract("text", r"(\d+)", 1).cast("int").alias("k"))
    return live.added_time(c.withColumn("at", order))


@query(f"""WITH {FEED} SELECT rec, CASE WHEN rec % 4 = 0 THEN '' ELSE SHORTNAME_HOME || ' ' || HOME_SCORE_CURRENT || ' - ' || HOME_NAME || ' ' || AWAY_SCORE_CURRENT END AS label,
  SHORTNAME_HOME || ' ' || HOME_SCORE_CURRENT || CASE WHEN rec % 3 > 0 THEN '/' || rec % 3 ELSE '' END || ' (20)' || ' - ' || HOME_NAME || ' ' || AWAY_SCORE_CURRENT || CASE WHEN rec % 5 > 0 THEN ' (' || rec % 5 || ')' ELSE '' END AS cricket FROM feed""")
def F48_compact_label(t: Tables) -> DataFrame:
    none = F.col("rec") % 4 == 0
    score = lambda c: F.when(none, "").otherwise(F.col(c).cast("string"))
    plain = lambda c: F.col(c).cast("string")
    some = lambda n: F.when(F.col("rec") % n > 0, (F.col("rec") % n).cast("string"))
    label = live.label_of(F.col("SHORTNAME_HOME"), score("HOME_SCORE_CURRENT"), F.col("HOME_NAME"), score("AWAY_SCORE_CURRENT"))
    cricket = live.cricket_label(F.col("SHORTNAME_HOME"), plain("HOME_SCORE_CURRENT"), some(3), F.lit("20"), F.col("HOME_NAME"), plain("AWAY_SCORE_CURRENT"), F.lit(""), some(5))
    return feed(t).select("rec", label.alias("label"), cricket.alias("cricket"))


@query("""SELECT p_partkey, list_sort(list_filter(list_distinct(list_concat([n], w, CASE WHEN len(w) >= 2 THEN [w[1] || ' ' || w[2], w[-2] || ' ' || w[-1]] ELSE [] END)), lambda x: length(x) >= 3)) AS phrases,
  list_sort(list_distinct(['fc ' || lower(p_name) || ' o', 'fc ' || lower(p_name) || ' oe'])) AS spellings FROM (SELECT p_partkey, p_name, 'fc ' || lower(p_name) || ' ab' AS n, string_split('fc ' || lower(p_name) || ' ab', ' ') AS w FROM part)""")
def F49_phrases(t: Tables) -> DataFrame:
    name = F.concat(F.lit("(FC) "), "p_name", F.lit(" áb"))
    return t.part.select("p_partkey", F.array_sort(live.phrases(name)).alias("phrases"), F.array_sort(live.spelled(F.concat(F.lit("FC "), "p_name", F.lit(" ö")))).alias("spellings"))


_GROUPS = ((1, "red bolt"), (1, "bolt"), (2, "widget"), (3, "small ring x"), (4, "gear"), (5, "cold gear"))


@query(f"""WITH g("group", alias) AS (VALUES {values(_GROUPS)}) SELECT p_partkey AS id, arg_min("group", (CASE WHEN p_name = alias THEN 0 ELSE 1 END) * 100 + "group") AS "group" FROM part JOIN g ON contains(' ' || p_name || ' ', ' ' || alias || ' ') OR contains(' ' || alias || ' ', ' ' || p_name || ' ') GROUP BY p_partkey""")
def F50_alias_groups(t: Tables) -> DataFrame:
    return live.alias_group(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), t.spark.createDataFrame(list(_GROUPS), "group int, alias string"))


# ---- signals


@query(f"""WITH {FEED} SELECT EVENT_ID AS rec, list_concat(list_transform(HOME_PARTICIPANT_TEAM_ID, lambda x: x || '|1.0'), [{NORM.format('HOME_NAME')} || '|0.9', {NORM.format('SHORTNAME_HOME')} || '|0.7']) AS home,
  list_concat(list_transform(coalesce(AWAY_PARTICIPANT_TEAM_ID, []), lambda x: x || '|1.0'), list_filter([{NORM.format('AWAY_NAME')} || '|0.9', {NORM.format('SHORTNAME_AWAY')} || '|0.7'], lambda x: x IS NOT NULL)) AS away,
  make_timestamp(coalesce(START_TIME, START_UTIME) * 1000000) AS kickoff FROM feed WHERE EVENT_ID IS NOT NULL AND AWAY_NAME <> ''""")
def P09_feed_signal(t: Tables) -> DataFrame:
    said = lambda c: F.transform(c, lambda x: F.concat_ws("|", x["normalized"], x["weight"].cast("string")))
    s = feeds.signal(feed(t))
    return s.select("rec", said("home_candidates").alias("home"), said("away_candidates").alias("away"), F.col("kickoff").cast("timestamp_ntz").alias("kickoff"))


@query(f"""WITH {FEED} SELECT rec, list_concat(list_transform(HOME_PARTICIPANT_TEAM_ID, lambda x: 'id:' || x), list_filter(['name:' || HOME_NAME, 'short:' || nullif(SHORTNAME_AWAY, '')], lambda x: x IS NOT NULL)) AS candidates FROM feed""")
def P11_candidate_array(t: Tables) -> DataFrame:
    c = feeds.team_candidates(F.col("HOME_NAME"), F.col("SHORTNAME_AWAY"), F.col("HOME_PARTICIPANT_TEAM_ID"))
    return feed(t).select("rec", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["raw"])).alias("candidates"))


@query(f"WITH {FEED} SELECT rec, coalesce(CASE WHEN rec % 3 = 0 THEN lower(SHORTNAME_AWAY) END, HOME_NAME) AS best FROM feed")
def P45_best_normalized(t: Tables) -> DataFrame:
    c = F.array_compact(F.array(feeds.candidate(F.when(F.col("rec") % 3 == 0, F.col("SHORTNAME_AWAY")), "short", 0.95), feeds.candidate(F.col("HOME_NAME"), "name", 0.9), feeds.candidate(F.lit("zz"), "x", 0.2)))
    return feed(t).select("rec", feeds.best_normalized(c).alias("best"))


@query(f"WITH {FEED} SELECT rec, CASE WHEN rec % 7 = 0 THEN make_timestamp(START_UTIME * 1000000) ELSE make_timestamp(coalesce(START_TIME, START_UTIME) * 1000000) END AS kickoff FROM feed")
def P14_kickoff_epoch(t: Tables) -> DataFrame:
    start = F.when(F.col("rec") % 7 == 0, "soon").otherwise(F.col("START_TIME").cast("string"))
    return feed(t).select("rec", feeds.kickoff(start, F.col("START_UTIME").cast("string")).cast("timestamp_ntz").alias("kickoff"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 1170 MINUTE WHEN 2 THEN o_orderdate + INTERVAL 18 HOUR END AS kickoff, CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM orders""")
def P13_kickoff_coalesce(t: Tables) -> DataFrame:
    r = F.col("o_orderkey") % 4
    k = feeds.market_kickoff(F.when(r == 0, F.col("o_orderdate").cast("timestamp")), F.when(r < 3, F.to_date("o_orderdate")), F.when(r == 1, "1930"))
    return t.orders.select("o_orderkey", k.alias("k")).select("o_orderkey", F.col("k.at").cast("timestamp_ntz").alias("kickoff"), "k.confidence")


_SPLIT = "CASE WHEN link IN (' at ', ' @ ') THEN tail ELSE first END AS home, CASE WHEN link IN (' at ', ' @ ') THEN first ELSE tail END AS away"


@query(f"WITH {MARKETS} SELECT rec, {_SPLIT} FROM (SELECT rec, first, link, trim(substr(title, length(first || link) + 1)) AS tail FROM market)")
def P12_title_split(t: Tables) -> DataFrame:
    return markets(t).select("rec", grammar.split_title(F.col("title")).alias("s")).select("rec", "s.home", "s.away")


@query(f"""WITH {MARKETS} SELECT rec, {_SPLIT}, abbr_block, day FROM (SELECT *, trim(substr(title, length(first || link) + 1)) AS tail FROM market) WHERE rec % 4 > 0 AND NOT (contains(title, ': ') AND list_contains([{', '.join(quoted(s.lower()) for s in domain.PROP_SUFFIXES)}], lower(trim(list_extract(string_split(title, ': '), -1)))))""")
def P10_market_signal(t: Tables) -> DataFrame:
    """Per-fixture tickers alone; every fourth one is an outright's and gives no signal."""
    day = F.upper(F.date_format("day", "yyMMMdd"))
    event = F.when(F.col("rec") % 4 == 0, F.concat(F.lit("KXEPLGAME-"), F.lit("26"))).otherwise(F.concat(F.lit("KXEPLGAME-"), day, "abbr_block"))
    records = markets(t).select("rec", "title", event.alias("event_ticker"), F.lit("KXEPLGAME").alias("series_ticker"))
    return feeds.market_signal(records).select("rec", "home", "away", "abbr_block", "day")


_PRICE = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 100 AS INT) WHEN 1 THEN CAST(round_even((o_orderkey % 100) / 100.0 * 100, 0) AS INT) WHEN 2 THEN CAST(o_orderkey % 100 AS INT) END"


@query(f"SELECT o_orderkey, {_PRICE} AS prob, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE {_PRICE} END AS yes FROM orders")
def P15_outcome_prices(t: Tables) -> DataFrame:
    r, n = F.col("o_orderkey") % 4, F.col("o_orderkey") % 100
    said = F.when(r == 0, n.cast("string")).when(r == 1, F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"))).when(r == 2, n.cast("string"))
    none = F.lit(None)
    o = F.struct(
        F.lit("A").alias("label"), F.lit("t").alias("ticker"), none.cast("int").alias("_yb"), F.when(F.col("o_orderkey") % 3 == 0, 7).alias("_ya"), none.cast("int").alias("_na"),
        said.alias("yes_bid_dollars"), said.alias("yes_ask_dollars"), none.cast("string").alias("no_ask_dollars"),
    )
    return t.orders.select("o_orderkey", feeds.outcomes(F.array(o)).alias("o")).select("o_orderkey", F.col("o")[0]["yes_bid"].alias("prob"), F.col("o")[0]["yes_ask"].alias("yes"))


@query(f"WITH {MARKETS} SELECT rec, regexp_replace(upper(series), '^(.+?)(SPREAD|TOTAL|MATCH|GAME|1H|F5)$', '\\1') AS base FROM market")
def P48_series_base(t: Tables) -> DataFrame:
    return markets(t).select("rec", grammar.split_suffix(F.col("series"))["base"].alias("base"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'winner' WHEN 1 THEN 'leg_winner' WHEN 2 THEN CASE WHEN month(o_orderdate) IN (3, 4) THEN 'series' ELSE 'outright' END WHEN 3 THEN 'series' END AS market_type FROM orders""")
def P19_kind_to_market_type(t: Tables) -> DataFrame:
    """Kinds of ticker identities as types of markets; a ticker that says nothing has none."""
    day = F.upper(F.date_format("o_orderdate", "yyMMMdd"))
    r = F.col("o_orderkey") % 5
    suffix = F.when(r == 0, F.concat(day, F.lit("ARSATM"))).when(r == 1, F.concat(day, F.lit("ARSATM-2"))).when(r == 2, day).when(r == 3, "26BOSNYKR1").otherwise("?")
    return t.orders.select("o_orderkey", suffix.alias("s")).select("o_orderkey", feeds.market_type(grammar.identity(F.col("s"), F.lit(False))["kind"]).alias("market_type"))


@query(f"""WITH {MARKETS} SELECT rec, day, '1930' AS time, abbr_block, [sport, CAST(day AS VARCHAR), '1930', abbr_block] AS key FROM market WHERE sport IS NOT NULL""")
def F77_fixture_key(t: Tables) -> DataFrame:
    """The fixture of a leg's ticker is its parent's: the leg number goes."""
    suffix = F.concat(F.upper(F.date_format("day", "yyMMMdd")), F.lit("1930"), F.col("abbr_block"), F.when(F.col("rec") % 2 == 0, "-3").otherwise(""))
    legs = grammar.with_identity(markets(t).filter("sport is not null").select("rec", "sport", suffix.alias("s")), F.col("s"), F.lit(False))
    m = legs.select("rec", "sport", grammar.parent_identity(F.col("i")).alias("i"))
    return m.select("rec", F.col("i.date").alias("day"), "i.time", "i.abbr_block", F.array("sport", F.col("i.date").cast("string"), "i.time", "i.abbr_block").alias("key"))


@query(f"""WITH {MARKETS} SELECT rec, CASE WHEN rec % 2 = 0 THEN 'per_fixture' ELSE 'tournament' END AS kind, CASE WHEN rec % 2 = 0 THEN abbr_block END AS abbr_block FROM market""")
def J26_leg_parent(t: Tables) -> DataFrame:
    leg = F.concat(F.upper(F.date_format("day", "yyMMMdd")), F.col("abbr_block"), F.lit("-2"))
    legs = grammar.with_identity(markets(t).select("rec", F.when(F.col("rec") % 2 == 0, leg).otherwise("MASTERS26").alias("s")), F.col("s"), F.lit(False))
    return legs.select("rec", grammar.parent_identity(F.col("i")).alias("i")).select("rec", "i.kind", "i.abbr_block")


@query(f"""WITH {FEED} SELECT rec, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate + INTERVAL (rec % 24) HOUR, '%H%M') AS hhmm, CASE WHEN SHORTNAME_AWAY IS NULL THEN NULL ELSE list_sort(list_distinct([SHORTNAME_HOME || SHORTNAME_AWAY, SHORTNAME_AWAY || SHORTNAME_HOME])) END AS orientations FROM feed WHERE rec % 11 <> 0""")
def F20_feed_identity(t: Tables) -> DataFrame:
    i = feeds.feed_identity(F.col("sport"), F.col("START_TIME"), F.col("SHORTNAME_HOME"), F.col("SHORTNAME_AWAY"))
    return feed(t).filter("rec % 11 <> 0").withColumn("sport", F.lit("Golf")).select("rec", i.alias("i")).select("rec", "i.day", "i.hhmm", "i.orientations")


@query(f"WITH {FEED} SELECT rec, list_sort(list_distinct(list_concat(list_transform(AWAY_PARTICIPANT_TEAM_ID, lambda x: HOME_PARTICIPANT_TEAM_ID[1] || x), list_transform(AWAY_PARTICIPANT_TEAM_ID, lambda x: x || HOME_PARTICIPANT_TEAM_ID[1])))) AS o FROM feed WHERE AWAY_PARTICIPANT_TEAM_ID IS NOT NULL")
def J33_orientations(t: Tables) -> DataFrame:
    return feed(t).filter("AWAY_PARTICIPANT_TEAM_ID is not null").select("rec", feeds.orientations(F.col("HOME_PARTICIPANT_TEAM_ID"), F.col("AWAY_PARTICIPANT_TEAM_ID")).alias("o"))


# ---- prices of streams


@query("SELECT event_id, upper(CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END) AS side, CAST(round_even(CASE WHEN event_id % 2 = 0 THEN 0.42 ELSE 0.6 END * 100, 0) AS INT) AS cents, round_even(CASE WHEN event_id % 2 = 0 THEN 0.42 ELSE 0.6 END * (event_id % 50), 2) AS cost FROM events")
def F42_trades(t: Tables) -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no")
    return t.events.select("event_id", feeds.trade(side, F.lit(0.42), F.lit(60.0), (F.col("event_id") % 50).cast("double")).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, list_filter([CASE WHEN event_id % 3 > 0 THEN (CAST(event_id % 90 + 5 AS INT)) || '@' || CAST(event_id % 7 AS DOUBLE) END, '17@5.0'], lambda x: x IS NOT NULL) AS book FROM events")
def F43_order_book(t: Tables) -> DataFrame:
    cents = F.concat(F.lit("0."), F.lpad((F.col("event_id") % 90 + 5).cast("string"), 2, "0"))
    levels = F.array(F.when(F.col("event_id") % 3 > 0, F.array(cents, (F.col("event_id") % 7).cast("string"))).otherwise(F.array(cents)), F.array(F.lit("0.17"), F.lit("5")))
    return t.events.select("event_id", F.transform(feeds.order_book(levels), lambda x: F.concat_ws("@", x["price"].cast("string"), x["quantity"].cast("string"))).alias("book"))


# ---- nested payloads


@query("""SELECT o_custkey AS id, CAST(year(o_orderdate) AS INT) AS round, o_orderkey AS place, 'h' || o_orderkey AS home, CAST(o_orderkey % 5 AS INT) AS home_agg FROM orders""")
def F52_bracket_pairs(t: Tables) -> DataFrame:
    """An order is a bracket of one round of one pair; places are its own number."""
    n = lambda k: (F.col("o_orderkey") % k).cast("int")
    pair = F.struct(F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("home"), F.lit("a").alias("away"), n(5).alias("home_agg"), n(3).alias("away_agg"), F.lit(None).cast("string").alias("winner"))
    b = t.orders.select(F.struct("o_custkey", "o_orderkey").alias("id"), F.array(F.struct(F.year("o_orderdate").alias("round"), F.array(pair).alias("pairs"))).alias("rounds"))
    return feeds.bracket_pairs(b).select("id.o_custkey", "round", F.col("id.o_orderkey").alias("place"), "home", "home_agg").withColumnRenamed("o_custkey", "id")


@query("SELECT n_nationkey AS id, 'G' || n_regionkey AS \"group\", r AS rank, n_name || r AS team, CAST(n_nationkey * r AS INT) AS points FROM nation, (VALUES (1), (2)) v(r)")
def F53_standings(t: Tables) -> DataFrame:
    row = lambda r: F.struct(F.lit(r).alias("rank"), F.concat(F.lit("t"), F.lit(str(r))).alias("team_id"), F.concat("n_name", F.lit(str(r))).alias("team"), (F.col("n_nationkey") * r).cast("int").alias("points"))
    group = F.struct(F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("group"), F.array(row(1), row(2)).alias("rows"))
    return feeds.standings(t.nation.select(F.col("n_nationkey").alias("id"), F.array(group).alias("groups"))).select("id", "group", "rank", "team", "points")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, n AS name, p AS position FROM supplier, (VALUES ('keeper', 'GK'), ('back', 'DF'), ('wing', 'FW')) v(n, p)")
def F54_lineups(t: Tables) -> DataFrame:
    player = lambda n, p, r: F.struct(F.lit(n).alias("name"), F.lit(p).alias("position"), F.lit(r).alias("rating"))
    a, b, c = player("keeper", "GK", 9.0), player("back", "DF", 6.0), player("wing", "FW", 7.5)
    even = F.col("s_suppkey") % 2 == 0
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(even, "home").otherwise("away").alias("side"), F.when(even, F.array(a, b, c)).alias("players"), F.when(~even, F.array(F.array(a), F.array(b, c))).alias("lines"))
    return feeds.lineups(rows).select("id", "side", "name", "position")


_INCIDENTS = ("Own goal by X", "GOAL!", "Yellow card", "red card", "Substitution", "VAR check", "kick off")


@query(f"""SELECT event_id, CASE WHEN contains(l, 'own goal') THEN 'own_goal' WHEN contains(l, 'goal') THEN 'goal' WHEN contains(l, 'yellow') OR contains(l, 'red card') THEN 'card' WHEN contains(l, 'substitution') THEN 'substitution' WHEN contains(l, 'var') THEN 'var' ELSE 'other' END AS category
  FROM (SELECT event_id, lower({picked('event_id', _INCIDENTS)}) AS l FROM events)""")
def F55_incidents(t: Tables) -> DataFrame:
    return feeds.incidents(t.events.select("event_id", pick("event_id", _INCIDENTS).alias("text"))).select("event_id", "category")


@query("SELECT event_id, list_sort(list_distinct(['a' || user_id, 'b' || event_id % 3, 'a' || event_id % 100])) AS ids FROM events")
def F57_nested_ids(t: Tables) -> DataFrame:
    s = lambda c: c.cast("string")
    json = F.concat(F.lit('{"x": {"team_id": "a'), s(F.col("user_id")), F.lit('"}, "y": [{"team_id" : "b'), s(F.col("event_id") % 3), F.lit('"}, [{"deep": {"team_id":"a'), s(F.col("event_id") % 100), F.lit('"}}]]}'))
    return t.events.select("event_id", F.array_sort(files.ids_in(json, "team_id")).alias("v"), "user_id").select("event_id", F.col("v").alias("ids"))


@query("""WITH p AS (SELECT p_partkey % 5 AS bracket, CAST(p_size % 4 AS INT) AS round, p_partkey AS place, p_name AS home, lower(p_type) AS away, CASE WHEN p_partkey % 6 > 0 THEN CAST(p_size % 3 AS INT) END AS agg_home, CAST(p_size % 4 AS INT) AS agg_away, CAST(p_partkey % 3 AS INT) AS legs, CASE WHEN p_partkey % 2 = 0 THEN 'home' END AS winner FROM part WHERE p_partkey < 60),
  ties AS (SELECT o_orderkey AS tie, o_custkey % 5 AS bracket, a.p_name AS x, lower(a.p_type) AS y, o_orderkey % 2 AS turn FROM orders JOIN part a ON a.p_partkey = o_custkey % 60),
  t AS (SELECT tie, bracket, CASE WHEN turn = 0 THEN x ELSE y END AS home, CASE WHEN turn = 0 THEN y ELSE x END AS away FROM ties),
  s AS (SELECT tie, agg_home, agg_away, legs, winner, round, place, turned, h + a AS score, h, a FROM (
    SELECT t.tie, p.*, v.turned, CASE WHEN contains(p.home, q.h) THEN 100 WHEN split_part(q.h, ' ', 1) <> q.h AND length(split_part(q.h, ' ', 1)) >= 4 AND contains(p.home, split_part(q.h, ' ', 1)) THEN 50 WHEN contains(p.home, substr(split_part(q.h, ' ', 1), 1, 3)) THEN 10 ELSE 0 END AS h,
      CASE WHEN contains(p.away, q.a) THEN 100 WHEN split_part(q.a, ' ', 1) <> q.a AND length(split_part(q.a, ' ', 1)) >= 4 AND contains(p.away, split_part(q.a, ' ', 1)) THEN 50 WHEN contains(p.away, substr(split_part(q.a, ' ', 1), 1, 3)) THEN 10 ELSE 0 END AS a
    FROM t JOIN p ON p.bracket = t.bracket, (VALUES (false), (true)) v(turned), LATERAL (SELECT CASE WHEN v.turned THEN t.away ELSE t.home END AS h, CASE WHEN v.turned THEN t.home ELSE t.away END AS a) q) WHERE h > 0 AND a > 0),
  b AS (SELECT *, row_number() OVER (PARTITION BY tie ORDER BY score DESC, winner IS NOT NULL, round, place, turned) AS k FROM s)
  SELECT tie, CASE WHEN turned THEN agg_away ELSE agg_home END AS aggregate_home, CASE WHEN turned THEN agg_home ELSE agg_away END AS aggregate_away, CAST(greatest(1, least(2, legs + 1)) AS INT) AS leg_number FROM b WHERE k = 1 AND agg_home IS NOT NULL""")
def J38_bracket_aggregate(t: Tables) -> DataFrame:
    n = lambda c, k: (F.col(c) % k).cast("int")
    pairs = t.part.filter("p_partkey < 60").select(
        (F.col("p_partkey") % 5).alias("bracket"), n("p_size", 4).alias("round"), F.col("p_partkey").alias("place"), F.col("p_name").alias("home"), F.lower("p_type").alias("away"), F.when(F.col("p_partkey") % 6 > 0, n("p_size", 3)).alias("agg_home"),
        n("p_size", 4).alias("agg_away"), n("p_partkey", 3).alias("legs"), F.when(F.col("p_partkey") % 2 == 0, "home").alias("winner"),
    )
    named = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x"), F.lower("p_type").alias("y"))
    own = t.orders.join(named, F.col("o_custkey") % 60 == F.col("k"))
    even = F.col("o_orderkey") % 2 == 0
    ties = own.select(F.col("o_orderkey").alias("tie"), (F.col("o_custkey") % 5).alias("bracket"), F.when(even, F.col("x")).otherwise(F.col("y")).alias("home"), F.when(even, F.col("y")).otherwise(F.col("x")).alias("away"))
    return live.bracket_aggregate(pairs, ties)
