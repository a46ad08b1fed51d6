"""§3 pipelines: the resolver and its daily measurement, bound to harness tables.

Parts give the teams (one for each name), orders the records; spellings vary by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import resolve
from skein.operators.measures import histogram
from skein.operators.storage import stored
from skein.plans.registry import Tables, query


def sport_of(c: str) -> Column:
    """A sport of clubs or, for every fourth, one of individuals."""
    return F.when(F.pmod(F.xxhash64(c), F.lit(4)) == 0, "tennis").otherwise("soccer")


def dimensions(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """records, teams, aliases, fixtures, competitions."""
    teams = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("team_id")).withColumn("sport", sport_of("name"))
    aliases = teams.filter(F.col("team_id") % 2 == 0).select(F.col("name").alias("alias"), "sport", "team_id")
    line = t.lineitem.filter("l_linenumber <= 2").groupBy("l_orderkey").agg(F.min("l_partkey").alias("h"), F.max("l_partkey").alias("a"))
    name = lambda k, c: t.part.select(F.col("p_partkey").alias(k), F.col("p_name").alias(c)).hint("merge")  # noqa: E731  (many rows in a small file: not for the driver)
    games = t.orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).join(name("h", "home"), "h").join(name("a", "away"), "a").filter("home <> away")
    kickoff = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    team = lambda c, i: teams.select(F.col("name").alias(c), F.col("team_id").alias(i))
    fixtures = games.filter("o_orderstatus <> 'P'").join(team("home", "home_id"), "home").join(team("away", "away_id"), "away")
    competition = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("c"), (F.col("o_orderkey") % 2).cast("string")))
    fixtures = fixtures.select(F.col("o_orderkey").alias("fixture_id"), "home_id", "away_id", kickoff.alias("fixture_at"), competition.alias("competition_id"))
    competitions = t.spark.createDataFrame([("KXEPL", "c0"), ("KXUCL", "c1")], "base string, competition_id string")
    r = F.col("o_orderkey") % 4
    spelled = F.when(r == 0, F.col("home")).when(r == 1, F.concat("home", F.lit(" fc"))).when(r == 2, F.regexp_replace("home", "^(.)(.)", "$1")).otherwise(F.lit("zzz qqq"))
    hint = F.get(F.array(*map(F.lit, ("KXEPLGAME", "kxucl", "KXNONE", None))), (F.col("o_custkey") % 4).cast("int"))
    records = games.select(
        F.col("o_orderkey").alias("rec"), F.when(F.col("o_orderkey") % 5 < 2, "kalshi").otherwise("fl").alias("provider"), sport_of("away").alias("sport"), spelled.alias("home"), "away",
        (kickoff + F.expr("INTERVAL 10 MINUTES")).alias("kickoff"), F.when(F.col("o_orderkey") % 13 == 0, 0.6).otherwise(1.0).alias("kickoff_confidence"), hint.alias("hint"),
    )
    return records, teams, aliases, fixtures, competitions


#: What was resolved, by application, folder and state of its files: the result, its log and the records, as stored tables.
_DONE: dict[tuple, tuple[DataFrame, DataFrame, DataFrame]] = {}


def _state(t: Tables) -> int:
    """A digest of the files that ``dimensions`` reads: their paths, lengths and times (their contents are not read)."""
    files = t.spark.read.format("binaryFile").load([f"{t.folder}/{n}.parquet" for n in ("orders", "lineitem", "part")])
    return files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0]


def resolved(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The resolver's result, log and records; it runs once for each state of a folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, _state(t))
    if key not in _DONE:
        records, *others = dimensions(t)
        final, log = resolve.resolve(records, *others)
        _DONE[key] = (stored(final, "final"), stored(log, "log"), records)
    return _DONE[key]


@query()
def R01_three_tier_resolver(t: Tables) -> DataFrame:
    return resolved(t)[0]


@query()
def R02_resolution_log(t: Tables) -> DataFrame:
    return resolved(t)[1]


@query()
def A53_daily_measurement(t: Tables) -> DataFrame:
    final, _, records = resolved(t)
    return resolve.capability(final, records)


@query()
def A42_dry_run_histogram(t: Tables) -> DataFrame:
    return histogram(resolved(t)[0], F.col("confidence"))
