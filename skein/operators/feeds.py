"""Provider rows: signals, candidates, live rows, nested brackets, tables and line-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.grammar import minutes
from skein.functions.prices import to_cents
from skein.functions.text import normalize_name

CANDIDATE = "array<struct<raw: string, normalized: string, kind: string, weight: double>>"


def candidate(raw: Column, kind: str, weight: float) -> Column:
    return F.when(F.trim(raw) != "", F.struct(raw.alias("raw"), normalize_name(raw).alias("normalized"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight")))


def team_candidates(name: Column, short: Column, ids: Column) -> Column:
    """Participant ids (1.0), full name (0.9), short name (0.7); empty ones dropped."""
    of_ids = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.struct(x.alias("raw"), x.alias("normalized"), F.lit("id").alias("kind"), F.lit(1.0).alias("weight")))
    return F.concat(of_ids, F.array_compact(F.array(candidate(name, "name", 0.9), candidate(short, "short", 0.7))))


def best_normalized(candidates: Column) -> Column:
    """The first normalised form that isn't empty, by falling weight (equal weights keep their order)."""
    keyed = F.transform(candidates, lambda c, i: F.struct((-c["weight"]).alias("w"), i.alias("i"), c["normalized"].alias("n")))
    return F.get(F.filter(F.array_sort(keyed), lambda c: c["n"] != ""), F.lit(0))["n"]


def kickoff(start: Column, start_utime: Column) -> Column:
    """Epoch seconds, the first that is a number."""
    return F.timestamp_seconds(F.coalesce(start.try_cast("long"), start_utime.try_cast("long")))


def market_kickoff(exact: Column, date: Column, hhmm: Column) -> Column:
    """struct(at, confidence): exact 1.0, the ticker's time 0.85, 18:00 on its date 0.6, none 0.0."""
    timed = F.when(hhmm.isNotNull(), F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + minutes(hhmm) * 60))
    dated = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + 18 * 3600)
    confidence = F.when(exact.isNotNull(), 1.0).when(timed.isNotNull(), 0.85).when(dated.isNotNull(), 0.6).otherwise(0.0)
    return F.struct(F.coalesce(exact, timed, dated).alias("at"), confidence.alias("confidence"))


def signal(events: DataFrame) -> DataFrame:
    """Typed signals of feed events (columns of ``sources.files.EVENT``); events without id or either name are skipped."""
    side = lambda s: team_candidates(F.col(f"{s}_NAME"), F.col(f"SHORTNAME_{s}"), F.col(f"{s}_PARTICIPANT_TEAM_ID")).alias(f"{s.lower()}_candidates")
    ready = events.filter(F.col("EVENT_ID").isNotNull() & (F.trim("HOME_NAME") != "") & (F.trim("AWAY_NAME") != ""))
    return ready.select(F.col("EVENT_ID").alias("rec"), side("HOME"), side("AWAY"), kickoff(F.col("START_TIME"), F.col("START_UTIME")).alias("kickoff"))


def doubles_pair(sport: Column, home: Column, away: Column) -> Column:
    """A pair of players in a sport of individuals."""
    from skein.functions.text import INDIVIDUAL_SPORTS

    return F.lower(sport).isin(*INDIVIDUAL_SPORTS) & (F.contains(home, F.lit("/")) | F.contains(away, F.lit("/")))


def outcomes(records: Column) -> Column:
    """Array of struct(label, ticker, yes_bid, yes_ask, no_ask) in cents, ties last."""
    price = lambda o, compact, dollars: F.coalesce(o[compact], to_cents(o[dollars]))
    shown = F.transform(records, lambda o: F.struct(o["label"].alias("label"), o["ticker"].alias("ticker"), price(o, "_yb", "yes_bid_dollars").alias("yes_bid"), price(o, "_ya", "yes_ask_dollars").alias("yes_ask"), price(o, "_na", "no_ask_dollars").alias("no_ask")))
    tie = lambda o: F.lower(o["label"]).isin("tie", "draw")
    return F.concat(F.filter(shown, lambda o: ~tie(o)), F.filter(shown, tie))


def live_state(stage: Column) -> Column:
    """Live, final or scheduled."""
    s = F.upper(stage)
    return F.when(s.isin("LIVE", "IN"), "live").when(s.isin("FINISHED", "POST"), "final").otherwise("scheduled")


def counts_as_live(state: Column, kickoff_s: Column, now_s: Column) -> Column:
    """In play, or before it and within 30 minutes of the kickoff."""
    return (state == "in") | ((state == "pre") & F.abs(kickoff_s - now_s).between(0, 1800))


def live_rows(events: DataFrame) -> DataFrame:
    """Flat live rows of feed events."""
    return events.select(F.col("EVENT_ID").alias("id"), F.col("HOME_NAME").alias("home"), F.col("AWAY_NAME").alias("away"), live_state(F.col("STAGE_TYPE")).alias("state"), F.col("HOME_SCORE_CURRENT").alias("home_score"), F.col("AWAY_SCORE_CURRENT").alias("away_score"), F.coalesce("START_UTIME", "START_TIME").alias("kickoff_s"))


def overlay(records: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Records with live fields where there are some, else defaults."""
    joined = records.join(live, key, "left")
    return joined.withColumns({"state": F.coalesce("state", F.lit("scheduled")), "linked": F.col("home_score").isNotNull()})


def phrase_match(titles: DataFrame, games: DataFrame, whole: bool = True) -> DataFrame:
    """Each title's game of the sport whose home and away phrases both stand in it; the longest phrases win, then the smaller game.

    titles: rec, sport, title.  games: game, sport, home, away (arrays of phrases).  Phrases of
    three characters count, as whole words and two different ones, or (``whole`` false) anywhere.
    Titles meet games in lists of words or of three characters, not through all games of the sport.
    """
    plain = F.concat(F.lit(" "), normalize_name(F.col("title")), F.lit(" "))
    cut = F.split(F.trim("t"), " ") if whole else F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.substr("t", i, F.lit(3)))
    key = F.split_part("h", F.lit(" "), F.lit(1)) if whole else F.substring("h", 1, 3)
    held = lambda t, p: F.contains(t, F.concat(F.lit(" "), p, F.lit(" "))) if whole else F.contains(t, p)
    parts = titles.select("rec", "sport", plain.alias("t")).select("rec", "sport", "t", F.explode(F.array_distinct(cut)).alias("w"))
    homes = games.select("game", "sport", "away", F.explode("home").alias("h")).filter(F.length("h") >= 3).withColumn("w", key)
    near = parts.join(homes, ["sport", "w"]).filter(held(F.col("t"), F.col("h")))
    both = near.select("rec", "game", "h", F.explode("away").alias("a"), "t").filter((F.length("a") >= 3) & held(F.col("t"), F.col("a")))
    both = both.filter("a <> h") if whole else both
    best = both.groupBy("rec").agg(F.max(F.struct((F.length("h") + F.length("a")).alias("n"), (-F.col("game")).alias("g"))).alias("b"))
    return best.select("rec", (-F.col("b.g")).alias("game"))


def longest_alias(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """The sport of the longest alias that stands in a title between non-alphanumerics."""
    words = titles.select("rec", F.concat(F.lit(" "), normalize_name(F.col("title")), F.lit(" ")).alias("t"), F.explode(F.array_distinct(F.split(normalize_name(F.col("title")), " "))).alias("w"))
    known = aliases.select("alias", "sport", F.split_part("alias", F.lit(" "), F.lit(1)).alias("w"))
    hit = words.join(known, "w").filter(F.contains("t", F.concat(F.lit(" "), "alias", F.lit(" "))))
    return hit.groupBy("rec").agg(F.max_by("sport", F.struct(F.length("alias"), "alias", "sport")).alias("sport"))


def bracket_pairs(brackets: DataFrame) -> DataFrame:
    """Pairs of all rounds (columns id, rounds: array of struct(round, pairs: array of struct(home, away, home_agg, away_agg, winner))), later rounds first."""
    pairs = brackets.select("id", F.inline("rounds")).select("id", "round", F.posexplode("pairs").alias("place", "pair"))
    return pairs.select("id", "round", "place", "pair.*").orderBy("id", F.col("round").desc(), "place")


def aggregate_of(pairs: DataFrame, ties: DataFrame) -> DataFrame:
    """Each tie's (tie, home, away) aggregate in either orientation; straight before turned, undecided before decided, later round first."""
    turned = pairs.select("id", "round", "place", F.col("away").alias("home"), F.col("home").alias("away"), F.col("away_agg").alias("home_agg"), F.col("home_agg").alias("away_agg"), "winner")
    both = pairs.select(turned.columns).withColumn("turn", F.lit(0)).unionByName(turned.withColumn("turn", F.lit(1)))
    from skein.operators.joins import latest

    found = ties.join(both, ["home", "away"])
    return latest(found, ["tie"], F.col("turn"), F.col("winner").isNotNull(), F.col("round").desc(), F.col("place")).select("tie", "home_agg", "away_agg")


def standings(tables: DataFrame) -> DataFrame:
    """a row for each team of each group (columns id, groups: array of struct(group, rows: array of struct(rank, team_id, team, points)))."""
    return tables.select("id", F.inline("groups")).select("id", "group", F.inline("rows"))


def lineups(rows: DataFrame) -> DataFrame:
    """Players of both layouts (formation lines or a flat list), goalkeepers last, then by rating and name."""
    flat = F.coalesce(F.col("players"), F.flatten("lines"))
    return rows.select("id", "side", F.inline(flat)).orderBy("id", "side", F.col("position") == "GK", F.col("rating").desc(), "name")


def incidents(rows: DataFrame, text: str = "text") -> DataFrame:
    """incidents with a category by what their text says; the first that fits."""
    t = F.lower(F.col(text))
    has = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(t, x))
    return rows.withColumn("category", F.when(has("own goal"), "own_goal").when(has("goal"), "goal").when(has("yellow", "red card"), "card").when(has("substitution"), "substitution").when(has("var"), "var").otherwise("other"))


def added_time(rows: DataFrame) -> DataFrame:
    """The first added time that each half's commentary names (columns id, half, at, text)."""
    from skein.operators.joins import latest

    m = F.regexp_extract(F.lower("text"), r"(\d+) minutes? of (?:added|stoppage) time", 1)
    return latest(rows.withColumn("minutes", F.nullif(m, F.lit("")).cast("int")).filter("minutes is not null"), ["id", "half"], F.col("at")).select("id", "half", "minutes")


def compact_label(sport: Column, period: Column, clock: Column) -> Column:
    """the short live label of a sport."""
    return F.when(sport == "soccer", F.concat(F.floor(clock / 60).cast("string"), F.lit("'"))).when(sport == "basketball", F.concat(F.lit("Q"), period.cast("string"))).when(sport == "hockey", F.concat(F.lit("P"), period.cast("string"))).otherwise(F.lit("LIVE"))


def series_summary(text: Column) -> Column:
    """struct(team, verb, score) of ``X leads series 2-1`` and the like."""
    p = r"(?i)^(.*?)\s*(leads|wins|won|tied)\s*(?:the )?series\s*(?:at )?(\d+-\d+)"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("team"), F.lower(F.regexp_extract(text, p, 2)).alias("verb"), F.regexp_extract(text, p, 3).alias("score")))


def orientations(home: Column, away: Column) -> Column:
    """All home with all away aliases, in both orders, distinct and sorted."""
    pairs = lambda x, y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.concat(a, b))))
    return F.array_sort(F.array_distinct(F.concat(pairs(home, away), pairs(away, home))))


def outcome_side(label: Column, home: Column, away: Column) -> Column:
    """The side that shares more tokens with the label; tie for a draw's label; null where both share as many."""
    h, a = F.size(F.array_intersect(label, home)), F.size(F.array_intersect(label, away))
    return F.when(F.arrays_overlap(label, F.array(F.lit("tie"), F.lit("draw"))), "tie").when(h > a, "home").when(a > h, "away")


def order_book(levels: Column) -> Column:
    """struct(price in cents, quantity) of levels that are pairs of strings."""
    return F.transform(F.filter(levels, lambda x: F.size(x) >= 2), lambda x: F.struct(F.bround(x[0].try_cast("double") * 100).cast("int").alias("price"), x[1].try_cast("double").alias("quantity")))


def trade(side: Column, yes_price: Column, no_price: Column, count: Column) -> DataFrame:
    """struct(side, cents, cost) of a trade; prices above 1 are cents."""
    unit = lambda p: F.when(p > 1, p / 100).otherwise(p)
    price = F.when(side == "yes", unit(yes_price)).otherwise(unit(no_price))
    return F.struct(F.upper(side).alias("side"), F.bround(price * 100).cast("int").alias("cents"), F.bround(price * count, 2).alias("cost"))


# Labels of an outcome without a winner.
TIE_WORDS = ("tie", "draw", "no winner", "no result")


def label_tokens(c: Column) -> Column:
    """Distinct runs of three letters or digits or more, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3))


def label_side(label: Column, home: Column, away: Column) -> Column:
    """Home, away or tie by the tokens that a label shares with each side's names (arrays); null where neither or both share as many."""
    own = lambda names: F.array_distinct(F.flatten(F.transform(names, label_tokens)))
    h, a = F.size(F.array_intersect(label_tokens(label), own(home))), F.size(F.array_intersect(label_tokens(label), own(away)))
    return F.when(F.lower(F.trim(label)).isin(*TIE_WORDS), "tie").when(h > a, "home").when(a > h, "away")


def winner_layer(records: DataFrame, kind: str = "winner") -> DataFrame:
    """market, side and outcome id of each label of winner markets (columns fixture, home, away: names, labels); labels that tell no side give no row."""
    from skein.functions import domain

    each = records.withColumn("label", F.explode("labels")).withColumn("side", label_side(F.col("label"), F.col("home"), F.col("away"))).filter("side is not null")
    made = each.withColumn("market", domain.market_key(F.col("fixture"), F.lit(kind), F.create_map().cast("map<string,string>")))
    return made.withColumn("outcome", domain.outcome_key(F.col("market"), F.col("side")))


# Types of markets by the kind of a ticker's identity.
MARKET_TYPES = (("per_fixture", "winner"), ("per_leg", "leg_winner"), ("outright", "outright"), ("series", "series"), ("tournament", "tournament"))


def market_type(kind: Column) -> Column:
    """The market type of a kind; null for tickers that were not understood."""
    from skein.functions.domain import lookup

    return lookup(MARKET_TYPES, kind)


def market_signal(records: DataFrame) -> DataFrame:
    """P10: rec, home, away, abbr_block, day, time of market events of one fixture (columns rec, title, event_ticker, series_ticker); outrights, series and prop markets give none."""
    from skein.functions.domain import prop_suffix
    from skein.functions.grammar import after_series, is_outright, split_suffix, split_title, with_identity

    told = records.filter(F.trim(F.coalesce("event_ticker", F.lit(""))) != "")
    once = lambda *cs: F.inline(F.array(F.struct(*cs)))  # noqa: E731  long expressions are computed once for each row
    told = told.select("rec", "title", once(after_series(F.col("event_ticker"), F.col("series_ticker")).alias("rest"), split_suffix(F.col("series_ticker"))["base"].alias("base")))
    known = with_identity(told, F.col("rest"), is_outright(F.col("base")))
    fixture = known.filter((F.col("i.kind") == "per_fixture") & ~prop_suffix(F.col("title"))).withColumn("s", split_title(F.col("title")))
    return fixture.select("rec", "s.home", "s.away", "i.abbr_block", F.col("i.date").alias("day"), "i.time")


def feed_identity(sport: Column, start: Column, home: Column, away: Column) -> Column:
    """struct(day, hhmm, orientations) of a feed event: its UTC day and time, and both orders of its abbreviations in all their forms."""
    from skein.functions.domain import abbreviations

    at = F.timestamp_seconds(start)
    both = F.when(home.isNotNull() & away.isNotNull(), orientations(abbreviations(sport, home), abbreviations(sport, away)))
    return F.struct(F.to_date(at).alias("day"), F.date_format(at, "HHmm").alias("hhmm"), both.alias("orientations"))


def game_tickers(records: DataFrame) -> DataFrame:
    """``records`` (ticker) with ``game``: the ticker of the same fixture whose series ends in GAME (of several the smallest), else their own."""
    t = F.upper("ticker")
    series, fixture = F.substring_index(t, "-", 1), F.regexp_extract(t, "^[^-]*-(.*)$", 1)
    games = records.filter(series.endswith("GAME") & (fixture != "")).groupBy(fixture.alias("_fixture")).agg(F.min(t).alias("_game"))
    own = records.withColumns({"_own": fixture, "_is": series.endswith("GAME")})
    found = own.join(games, (F.col("_own") == F.col("_fixture")) & (F.col("_own") != ""), "left")
    return found.withColumn("game", F.when(F.col("_is"), F.upper("ticker")).otherwise(F.coalesce("_game", F.upper("ticker")))).drop("_own", "_is", "_fixture", "_game")


def seed_rows(events: DataFrame) -> DataFrame:
    """kind, id of all teams, competitions and fixtures of feed events (with sport, competition and day), each once; events without id or either name give none."""
    from skein.functions import domain
    from skein.functions.text import slug

    ready = events.filter(F.col("EVENT_ID").isNotNull() & (F.trim("HOME_NAME") != "") & (F.trim("AWAY_NAME") != ""))
    e = ready.select("sport", "day", slug(F.col("HOME_NAME")).alias("h"), slug(F.col("AWAY_NAME")).alias("a"), slug(F.col("competition")).alias("c"))
    row = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.alias("id"))
    own = lambda kind, c: row(kind, domain.canonical_id(kind, F.col("sport"), F.col(c)))
    fixture = row("fixture", domain.fixture_key(F.col("sport"), F.col("day"), F.col("h"), F.col("a"), F.lit("")))
    return e.select(F.inline(F.array(own("team", "h"), own("team", "a"), own("competition", "c"), fixture))).distinct()
