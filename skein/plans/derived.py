"""Provider rows made of harness tables, as DataFrames and as the SQL that DuckDB twins begin with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.registry import Tables


def quoted(v) -> str:
    """A literal of SQL."""
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def pick(key: str, values: Sequence) -> Column:
    """The value whose turn it is for a whole number."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def picked(key: str, values: Sequence) -> str:
    return f"[{', '.join(map(quoted, values))}][{key} % {len(values)} + 1]"


def values(rows: Sequence[Sequence]) -> str:
    """Rows for VALUES."""
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


SPORTS = ("Soccer", "Basketball", "Tennis", "Hockey", "Cricket", "MMA", "Golf", "Chess")
STAGES = ("FIRST_HALF", "SECOND_HALF", "HALFTIME", "EXTRA_TIME_FIRST_HALF", "EXTRA_TIME_SECOND_HALF", "FINISHED")
TYPES = ("SCHEDULED", "LIVE", "FINISHED")

#: Feed events: an order is a game between the parts of its customer and of its own number.
FEED = f"""feed AS (
  SELECT o_orderkey AS rec, CASE WHEN o_orderkey % 50 <> 0 THEN 'e' || o_orderkey END AS EVENT_ID, h.p_name AS HOME_NAME, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE a.p_name END AS AWAY_NAME,
    upper(substr(h.p_name, 1, 3)) AS SHORTNAME_HOME, CASE WHEN o_orderkey % 5 <> 0 THEN upper(substr(a.p_name, 1, 3)) END AS SHORTNAME_AWAY,
    ['p' || h.p_partkey] AS HOME_PARTICIPANT_TEAM_ID, CASE WHEN o_orderkey % 7 <> 0 THEN ['p' || a.p_partkey, 'q' || a.p_partkey] END AS AWAY_PARTICIPANT_TEAM_ID,
    CASE WHEN o_orderkey % 11 <> 0 THEN epoch(o_orderdate)::BIGINT + (o_orderkey % 24) * 3600 END AS START_TIME, epoch(o_orderdate)::BIGINT + (o_orderkey % 24) * 3600 + 60 AS START_UTIME,
    {picked('o_orderkey', TYPES)} AS STAGE_TYPE, {picked('o_orderkey', STAGES)} AS STAGE, CAST(o_orderkey % 5 AS INT) AS HOME_SCORE_CURRENT, CAST(o_orderkey % 4 AS INT) AS AWAY_SCORE_CURRENT,
    {picked('o_custkey', SPORTS)} AS sport, o_custkey AS home_id, o_orderkey * 31 % 197 AS away_id, o_orderdate
  FROM orders JOIN part h ON h.p_partkey = o_custkey JOIN part a ON a.p_partkey = o_orderkey * 31 % 197)"""


def feed(t: Tables) -> DataFrame:
    part = lambda s: t.part.select(F.col("p_partkey").alias(f"{s}_id"), F.col("p_name").alias(f"{s}_name"))
    own = t.orders.withColumns({"home_id": F.col("o_custkey"), "away_id": F.col("o_orderkey") * 31 % 197}).join(part("home"), "home_id").join(part("away"), "away_id")
    r, name = lambda n: F.col("o_orderkey") % n, lambda c: F.concat(F.lit(c[0]), F.col(c[1:]).cast("string"))
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + r(24) * 3600
    return own.select(
        F.col("o_orderkey").alias("rec"), F.when(r(50) != 0, name("eo_orderkey")).alias("EVENT_ID"), F.col("home_name").alias("HOME_NAME"), F.when(r(17) == 0, "").otherwise(F.col("away_name")).alias("AWAY_NAME"),
        F.upper(F.substring("home_name", 1, 3)).alias("SHORTNAME_HOME"), F.when(r(5) != 0, F.upper(F.substring("away_name", 1, 3))).alias("SHORTNAME_AWAY"),
        F.array(name("phome_id")).alias("HOME_PARTICIPANT_TEAM_ID"), F.when(r(7) != 0, F.array(name("paway_id"), name("qaway_id"))).alias("AWAY_PARTICIPANT_TEAM_ID"),
        F.when(r(11) != 0, at).alias("START_TIME"), (at + 60).alias("START_UTIME"), pick("o_orderkey", TYPES).alias("STAGE_TYPE"), pick("o_orderkey", STAGES).alias("STAGE"),
        r(5).cast("int").alias("HOME_SCORE_CURRENT"), r(4).cast("int").alias("AWAY_SCORE_CURRENT"), pick("o_custkey", SPORTS).alias("sport"), "home_id", "away_id", "o_orderdate",
    )


#: Market events: a part is a market of two parts, with a title, a series and a ticker.
SEGMENTS = ("", ": Hits", ": Total Maps", ": Vegas", ": spreads", ": Spread", ": Game 3: Overtime", ": total games", ": Team Total", ": First Half: x", ": Both Teams to Score", ":Points")
LINKS = (" vs ", " at ", " v. ", " @ ")
SERIES = ("KXUCLGAME", "KXNBATOTAL", "KXATPMATCH", "KXNHL1H", "KXMLBF5", "KXCONMEBOLLIBGAME", "KXJOINLEAGUE", "kxfacupspread", "KXEPL", "")
MARKETS = f"""market AS (
  SELECT a.p_partkey AS rec, a.p_name || {picked('a.p_partkey', LINKS)} || b.p_name || {picked('a.p_partkey', SEGMENTS)} AS title, a.p_name AS first, b.p_name AS second,
    {picked('a.p_partkey', LINKS)} AS link, {picked('a.p_partkey', SERIES)} AS series, {picked('a.p_partkey', (*SPORTS, '', None))} AS sport, CASE WHEN a.p_partkey % 3 = 0 THEN 'fl' ELSE 'kalshi' END AS provider,
    date '2026-05-01' + CAST(a.p_partkey % 60 AS INT) AS day, upper(replace(a.p_name, ' ', '')) AS abbr_block, a.p_size AS size
  FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 7) % 200)"""


def markets(t: Tables) -> DataFrame:
    other = t.part.select(F.col("p_partkey").alias("o"), F.col("p_name").alias("second"))
    own = t.part.join(other, (F.col("p_partkey") + 7) % 200 == F.col("o"))
    return own.select(
        F.col("p_partkey").alias("rec"), F.concat("p_name", pick("p_partkey", LINKS), "second", pick("p_partkey", SEGMENTS)).alias("title"), F.col("p_name").alias("first"), "second",
        pick("p_partkey", LINKS).alias("link"), pick("p_partkey", SERIES).alias("series"), pick("p_partkey", (*SPORTS, "", None)).alias("sport"), F.when(F.col("p_partkey") % 3 == 0, "fl").otherwise("kalshi").alias("provider"),
        F.date_add(F.lit("2026-05-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).alias("day"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("abbr_block"), F.col("p_size").alias("size"),
    )


#: The normalised form of plain ASCII names.
NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
