"""Sources over landed files: JSON feeds, list files, expiring blobs, permissive validation."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.joins import latest
from skein.operators.storage import shared_path

# Field names of the sports feed.
EVENT = "EVENT_ID string, HOME_NAME string, AWAY_NAME string, SHORTNAME_HOME string, SHORTNAME_AWAY string, HOME_PARTICIPANT_TEAM_ID array<string>, AWAY_PARTICIPANT_TEAM_ID array<string>, START_TIME bigint, START_UTIME bigint, STAGE_TYPE string, STAGE string, HOME_SCORE_CURRENT int, AWAY_SCORE_CURRENT int"
TOURNAMENT = f"TOURNAMENT_STAGE_ID string, NAME string, NAME_PART_1 string, NAME_PART_2 string, COUNTRY_NAME string, EVENTS array<struct<{', '.join(f.replace(' ', ': ', 1) for f in EVENT.split(', '))}>>"


def json_feed(spark: SparkSession, path: str, schema: str = TOURNAMENT) -> DataFrame:
    """Landed JSON with a declared schema; what doesn't fit stays in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def land(df: DataFrame, label: str) -> str:
    """The folder of a table that is written as JSON files where feeds land."""
    path = shared_path(df.sparkSession, label)
    df.write.json(path)
    return path


def events_of(tournaments: DataFrame) -> DataFrame:
    """An event a row, with what it inherits from its tournament."""
    return tournaments.select("TOURNAMENT_STAGE_ID", F.col("NAME").alias("TOURNAMENT_NAME"), "COUNTRY_NAME", F.inline("EVENTS"))


def stages_of(leagues: DataFrame) -> DataFrame:
    """A stage a row, with its league (columns league, STAGES)."""
    return leagues.select("league", F.inline("STAGES"))


def requests(sports: DataFrame, days: int) -> DataFrame:
    """Every sport on every day from -days to days."""
    return sports.withColumn("day", F.explode(F.sequence(F.lit(-days), F.lit(days))))


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a pipe-delimited list, without comments and byte-order mark; the first of lines that differ in case alone."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    body = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    kept = lines.select("at", body.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    first = latest(kept.withColumn("key", F.lower("line")), ["key"], F.col("at"))
    return first.select("at", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("fields"))


def roster(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON roster that must fit its schema; a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def seeds(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A static table of a few rows."""
    return spark.createDataFrame(rows, schema)


def blob(table: DataFrame, key: str) -> DataFrame:
    """One keyed blob."""
    return table.filter(F.col("key") == key)


def validated(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``drift``: names of the rules that a record breaks (null counts as broken); records stay."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return records.withColumn("drift", F.array_compact(F.array(*broken)))


class _Number(str):
    """A JSON number as it is written."""


def _paths(text: str | None) -> list[tuple[str, list[str], str | None]]:
    """Each path of a JSON text with its types and its least plain value; what is no JSON has none."""
    try:
        todo = [("", json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number))] if text else []
    except (ValueError, RecursionError):
        return []
    types, samples = defaultdict(set), {}
    while todo:
        prefix, at = todo.pop()
        if isinstance(at, list):
            todo += [(f"{prefix}[]", v) for v in at if isinstance(v, dict | list)]
            continue
        for k, v in at.items() if isinstance(at, dict) else ():
            path = (f"{prefix}.{k}" if prefix else k).encode(errors="replace").decode()
            types[path] |= {kind for kind, t in (("object", dict), ("array", list), ("boolean", bool), ("number", _Number)) if isinstance(v, t)} or ({"string"} if isinstance(v, str) else set())
            if isinstance(v, dict | list):
                todo.append((path, v))
            elif v is not None:
                said = str(v if isinstance(v, str) else json.dumps(v)).encode(errors="replace").decode()
                samples[path] = min(said, samples.get(path, said))
    return [(path, sorted(t), samples.get(path)) for path, t in types.items()]


def key_inventory(records: DataFrame, json: str, *by: str) -> DataFrame:
    """Each path (``a.b``, ``[]`` at a list level, at any depth and over all elements) with its number of records, the types seen and the least plain value, for each of ``by``."""
    walk = F.udf(_paths, "array<struct<key: string, types: array<string>, sample: string>>", useArrow=True)
    each = records.select(*by, F.inline(walk(json)))
    return each.groupBy(*by, "key").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.min("sample").alias("sample"))


def ids_in(json: Column, field: str) -> Column:
    """all values of a string field at any depth of JSON text, in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(json, F.lit(rf'"{field}"\s*:\s*"([^"]*)"'), 1))


# Field names of the other feeds.
SCOREBOARD = "league string, events array<struct<id: string, status: struct<state: string, period: int, displayClock: string>, competitors: array<struct<homeAway: string, displayName: string, score: string>>>>"
TYPED = "events array<struct<id: long, status: struct<type: string, description: string>, homeTeam: struct<name: string>, awayTeam: struct<name: string>, homeScore: struct<current: int, aggregated: int>, awayScore: struct<current: int, aggregated: int>, roundInfo: struct<name: string>>>"
STATUSES = "events array<struct<idEvent: string, strHomeTeam: string, strAwayTeam: string, intHomeScore: string, intAwayScore: string, strStatus: string, strProgress: string, strLeague: string>>"


def scoreboard_events(feed: DataFrame) -> DataFrame:
    """Id, league, home, away, scores, state, period, clock of a scoreboard feed."""
    each = feed.select("league", F.inline("events"))
    side = lambda s: F.get(F.filter("competitors", lambda c: c["homeAway"] == s), F.lit(0))
    return each.select("id", "league", side("home")["displayName"].alias("home"), side("away")["displayName"].alias("away"), side("home")["score"].alias("home_score"), side("away")["score"].alias("away_score"), "status.state", "status.period", F.col("status.displayClock").alias("clock"))


def typed_events(feed: DataFrame) -> DataFrame:
    """Id, type, description, home, away, scores, aggregates and round of a feed with typed states."""
    return feed.select(F.inline("events")).select(
        "id", "status.type", "status.description", F.col("homeTeam.name").alias("home"), F.col("awayTeam.name").alias("away"), F.col("homeScore.current").alias("home_score"), F.col("awayScore.current").alias("away_score"),
        F.col("homeScore.aggregated").alias("home_agg"), F.col("awayScore.aggregated").alias("away_agg"), F.col("roundInfo.name").alias("round"),
    )


def status_events(feed: DataFrame) -> DataFrame:
    """Id, league, home, away, scores, status and progress of a feed with status texts."""
    return feed.select(F.inline("events")).select(
        F.col("idEvent").alias("id"), F.col("strLeague").alias("league"), F.col("strHomeTeam").alias("home"), F.col("strAwayTeam").alias("away"), F.col("intHomeScore").alias("home_score"), F.col("intAwayScore").alias("away_score"),
        F.col("strStatus").alias("status"), F.col("strProgress").alias("progress"),
    )


def details(wanted: DataFrame, known: DataFrame, id_: str) -> DataFrame:
    """Each wanted id's detail, looked up once however often it is wanted; ids without a detail are dropped."""
    return known.dropDuplicates([id_]).join(wanted.select(id_).distinct(), id_, "left_semi")


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first source, and of the second one for keys that the first has not."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))

