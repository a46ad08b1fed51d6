"""Live state: rows of the feeds, clocks, labels, phrases and brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.domain import lookup, soccer_minute
from skein.functions.text import fold_accents
from skein.operators.joins import latest

# Stages of the feed by state, their periods and labels.
LIVE_STAGES = (
    "LIVE", "FIRST_HALF", "SECOND_HALF", "FIRST_SET", "SECOND_SET", "THIRD_SET", "FOURTH_SET", "FIFTH_SET", "FIRST_PERIOD", "SECOND_PERIOD", "THIRD_PERIOD", "OVERTIME", "FIRST_QUARTER", "SECOND_QUARTER",
    "THIRD_QUARTER", "FOURTH_QUARTER", "HALFTIME", "INNING", "BREAK_TIME", "AWAITING_EXTRA_TIME", "EXTRA_TIME_FIRST_HALF", "EXTRA_TIME_SECOND_HALF", "AWAITING_PENALTIES", "PENALTIES",
)
FINISHED_STAGES = ("FINISHED", "AFTER_PENALTIES", "AFTER_EXTRA_TIME", "AWARDED", "ABANDONED", "CANCELLED", "RETIRED", "WALKOVER", "POSTPONED")
STAGE_PERIODS = (
    ("FIRST_HALF", 1), ("SECOND_HALF", 2), ("FIRST_PERIOD", 1), ("SECOND_PERIOD", 2), ("THIRD_PERIOD", 3), ("OVERTIME", 4), ("FIRST_QUARTER", 1), ("SECOND_QUARTER", 2), ("THIRD_QUARTER", 3), ("FOURTH_QUARTER", 4),
)
STAGE_LABELS = (
    ("FIRST_HALF", "1st Half"), ("SECOND_HALF", "2nd Half"), ("HALFTIME", "Halftime"), ("FIRST_PERIOD", "1st Period"), ("SECOND_PERIOD", "2nd Period"), ("THIRD_PERIOD", "3rd Period"), ("OVERTIME", "Overtime"),
    ("FIRST_QUARTER", "Q1"), ("SECOND_QUARTER", "Q2"), ("THIRD_QUARTER", "Q3"), ("FOURTH_QUARTER", "Q4"), ("FIRST_SET", "Set 1"), ("SECOND_SET", "Set 2"), ("THIRD_SET", "Set 3"), ("FOURTH_SET", "Set 4"),
    ("FIFTH_SET", "Set 5"), ("BREAK_TIME", "Break"), ("PENALTIES", "Penalties"),
)
# Parts of another feed's status texts that mean not begun, and over.
NOT_BEGUN = ("not started", "postponed", "cancelled", "tbd")
OVER = ("ft", "full time", "finished", "final", "ended", "match finished", "after extra time", "aet", "pen.", "penalty shootout")


def stage_state(stage_type: Column, stage: Column) -> Column:
    """In, post or pre."""
    known = lambda xs: F.coalesce(F.upper(stage_type).isin(*xs), F.lit(False)) | F.coalesce(F.upper(stage).isin(*xs), F.lit(False))
    return F.when(known(LIVE_STAGES), "in").when(known(FINISHED_STAGES), "post").otherwise("pre")


def normalized_state(state: Column) -> Column:
    """In, post and others as live, final and scheduled."""
    return F.when(state == "in", "live").when(state == "post", "final").otherwise("scheduled")


def display_clock(sport: Column, state: Column, stage: Column, game_time: Column, elapsed: Column) -> Column:
    """The feed's own clock, else a soccer period's minute, else the stage's label."""
    given = F.when(~F.coalesce(game_time, F.lit("")).isin("-1", "0", "", "None"), game_time)
    label = F.coalesce(lookup(STAGE_LABELS, stage), F.initcap(F.replace(stage, F.lit("_"), F.lit(" "))))
    minute = F.when((sport == "Soccer") & (state == "in"), soccer_minute(stage, elapsed))
    return F.when(given.isNotNull(), F.when(sport == "Soccer", F.concat(given, F.lit("'"))).otherwise(given)).when(minute.isNotNull(), minute).when(state == "in", label).when(state == "post", "FT").otherwise("")


def feed_rows(events: DataFrame) -> DataFrame:
    """P20: live rows of feed events (with sport, GAME_TIME and elapsed, the seconds since the stage began)."""
    stage = F.upper(F.coalesce("STAGE", "STAGE_TYPE"))
    named = events.withColumns({"_stage": stage, "state": stage_state(F.col("STAGE_TYPE"), stage)})
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[ *]+$", "")
    short = lambda s, c: F.coalesce(s, F.upper(F.substring(clean(c), 1, 3)))
    half = F.col("_stage") == "HALFTIME"
    return named.select(
        F.col("EVENT_ID").alias("id"), "sport", clean(F.col("HOME_NAME")).alias("home"), clean(F.col("AWAY_NAME")).alias("away"), short("SHORTNAME_HOME", F.col("HOME_NAME")).alias("home_abbr"), short("SHORTNAME_AWAY", F.col("AWAY_NAME")).alias("away_abbr"),
        F.coalesce(F.col("HOME_SCORE_CURRENT").cast("string"), F.lit("")).alias("home_score"), F.coalesce(F.col("AWAY_SCORE_CURRENT").cast("string"), F.lit("")).alias("away_score"), "state",
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STAGE_PERIODS for x in p]), F.col("_stage")), F.lit(0)).alias("period"), half.alias("is_halftime"), ((F.col("state") == "in") & ~half).alias("clock_running"),
        display_clock(F.col("sport"), F.col("state"), F.col("_stage"), F.col("GAME_TIME"), F.col("elapsed")).alias("display_clock"), (F.coalesce("START_UTIME", "START_TIME", F.lit(0)) * 1000).alias("kickoff_ms"),
    )


def status_rows(events: DataFrame) -> DataFrame:
    """Live rows of a feed that has a status text (columns id, sport, status, progress, home, away, home_score, away_score); games not begun, or without a name, give none."""
    low = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    ready = events.filter((low != "") & ~has(NOT_BEGUN) & (F.trim("home") != "") & (F.trim("away") != ""))
    minute = F.regexp_extract(F.coalesce("progress", F.lit("")), r"^\s*(\d+)", 1)
    half = F.when((F.col("sport") != "Soccer") | (minute == ""), 0).when(F.contains(low, F.lit("1h")) | F.contains(low, F.lit("first half")), 1).when(F.contains(low, F.lit("2h")) | F.contains(low, F.lit("second half")), 2).otherwise(0)
    abbr = lambda c: F.upper(F.substring(F.split_part(F.trim(c), F.lit(" "), F.lit(1)), 1, 3))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ready.select(
        "id", "sport", F.trim("home").alias("home"), F.trim("away").alias("away"), abbr("home").alias("home_abbr"), abbr("away").alias("away_abbr"), said("home_score").alias("home_score"), said("away_score").alias("away_score"),
        F.when(has(OVER), "post").otherwise("in").alias("state"), half.alias("period"), F.when(half > 0, F.concat(minute.cast("int").cast("string"), F.lit("'"))).otherwise("").alias("display_clock"), F.trim("status").alias("detail"),
    )


def typed_rows(events: DataFrame) -> DataFrame:
    """Live rows of a feed with typed states (columns id, sport, type, description, home, away, home_score, away_score, home_agg, away_agg, round, elapsed): clock, leg and aggregate."""
    state = F.when(F.col("type") == "inprogress", "in").when(F.col("type") == "finished", "post")
    ready = events.withColumn("state", state).filter(F.col("state").isNotNull() & (F.trim("home") != "") & (F.trim("away") != ""))
    low, rnd = F.lower(F.trim(F.coalesce("description", F.lit("")))), F.lower(F.trim(F.coalesce("round", F.lit(""))))
    soccer = F.col("sport") == "Soccer"
    any_of = lambda t, *ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w))
    period = F.when(~soccer, 0).when(any_of(low, "1st half", "first half"), 1).when(any_of(low, "2nd half", "second half"), 2).otherwise(0)
    minute = F.greatest(F.lit(1), F.floor(F.col("elapsed") / 60).cast("int")) + F.when(period == 2, 45).otherwise(0)
    leg = F.when(soccer & any_of(rnd, "2nd leg", "second leg"), 2).when(soccer & any_of(rnd, "1st leg", "first leg"), 1)
    two = soccer & ((F.col("home_agg").isNotNull() & F.col("away_agg").isNotNull()) | leg.isNotNull())
    return ready.select(
        "id", "sport", "state", F.trim("home").alias("home"), F.trim("away").alias("away"), period.alias("period"), F.when((period > 0) & (F.col("elapsed") >= 0), F.concat(minute.cast("string"), F.lit("'"))).otherwise("").alias("display_clock"),
        two.alias("is_two_leg"), F.when(two, F.col("home_agg")).alias("aggregate_home"), F.when(two, F.col("away_agg")).alias("aggregate_away"), leg.alias("leg_number"),
    )


def label_of(home: Column, home_score: Column, away: Column, away_score: Column) -> Column:
    """``BOS 3 - NYR 2``; empty without a score."""
    none = (home_score == "") & (away_score == "")
    return F.when(none, "").otherwise(F.concat_ws(" ", home, home_score, F.lit("-"), away, away_score))


def cricket_label(home: Column, home_runs: Column, home_wickets: Column, home_overs: Column, away: Column, away_runs: Column, away_wickets: Column, away_overs: Column) -> Column:
    """``MI 243/5 (20) - SRH 249/4 (18.4)``; wickets and overs only where there are some."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    part = lambda n, r, w, o: F.concat(n, F.lit(" "), r, F.when(there(w), F.concat(F.lit("/"), w)).otherwise(""), F.when(there(o), F.concat(F.lit(" ("), o, F.lit(")"))).otherwise(""))
    return F.when((home_runs == "") & (away_runs == ""), "").otherwise(F.concat(part(home, home_runs, home_wickets, home_overs), F.lit(" - "), part(away, away_runs, away_wickets, away_overs)))


def series_of(notice: Column, home: Column, away: Column) -> Column:
    """struct(home_wins, away_wins, summary) of ``X leads series 2-1``, ``Series tied 1-1`` or ``X wins series 4-2``; null where a notice says none of these."""
    def named(verb: str) -> Column:
        p = rf"(?i)(.+?)\s+{verb}\s+series\s+(\d+)\s*[-:]\s*(\d+)"
        who, most, least = F.lower(fold_accents(F.regexp_extract(notice, p, 1))), F.regexp_extract(notice, p, 2).cast("int"), F.regexp_extract(notice, p, 3).cast("int")
        same = lambda t: (t != "") & (F.contains(t, who) | F.contains(who, t))
        h, a = same(F.lower(fold_accents(home))), same(F.lower(fold_accents(away)))
        wins = F.struct(F.when(h, most).when(a, least).alias("home_wins"), F.when(h, least).when(a, most).alias("away_wins"), summary.alias("summary"))
        return F.when(notice.rlike(p), wins)

    summary = F.trim(F.regexp_replace(notice, r"\.+$", ""))
    t = r"(?i)series\s+tied\s+(\d+)\s*[-:]\s*(\d+)"
    tied = F.when(notice.rlike(t), F.struct(F.regexp_extract(notice, t, 1).cast("int").alias("home_wins"), F.regexp_extract(notice, t, 2).cast("int").alias("away_wins"), summary.alias("summary")))
    return F.coalesce(named("leads"), tied, named("wins?"))


def added_time(comments: DataFrame) -> DataFrame:
    """Id, half, minutes: the first added time that comments of class ``time`` name at 45 or 90 (columns id, at: order, class, minute, text)."""
    m = F.regexp_extract("text", r"(?i)(?:minimum of\s+)?(\d+)\s*min\.?\s*of\s*(?:stoppage-time|added time)", 1)
    half = F.when(F.col("minute").startswith("45"), 1).when(F.col("minute").startswith("90"), 2)
    found = comments.filter(F.lower("class") == "time").withColumns({"minutes": F.nullif(m, F.lit("")).cast("int"), "half": half}).filter("minutes is not null and half is not null")
    return latest(found, ["id", "half"], F.col("at")).select("id", "half", "minutes")


def phrases(name: Column) -> Column:
    """the name without accents and parentheses, its words, and its first and last two, each of three characters or more; the longest first."""
    whole = F.trim(F.lower(fold_accents(F.regexp_replace(name, "[()]", ""))))
    words = F.filter(F.split(whole, r"\s+"), lambda w: w != "")
    two = F.when(F.size(words) >= 2, F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, -2, 2), " "))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(F.array_distinct(F.concat(F.array(whole), words, two)), lambda p: F.length(p) >= 3)
    return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])


# Letters that also go as two.
DIGRAPHS = (("ø", "oe"), ("ö", "oe"), ("ü", "ue"), ("ä", "ae"), ("å", "aa"), ("æ", "ae"))


def spelled(name: Column) -> Column:
    """the plain form of a name and the one with letters written as two, distinct."""
    low = F.lower(name)
    wide = low
    for letter, two in DIGRAPHS:
        wide = F.replace(wide, F.lit(letter), F.lit(two))
    return F.array_distinct(F.array(F.trim(fold_accents(low)), F.trim(fold_accents(wide))))


def alias_group(names: DataFrame, groups: DataFrame) -> DataFrame:
    """id, group of each name (columns id, name): the group that has it as an alias, else the first one with an alias that the name holds, or that holds the name, as whole words.

    ``groups``: group, alias.  Names meet aliases in lists of single words.
    """
    word = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    n, g = names.select("id", "name", word("name").alias("w")), groups.select("group", "alias", word("alias").alias("w"))
    near = n.join(g, "w").filter(F.contains(pad("name"), pad("alias")) | F.contains(pad("alias"), pad("name")))
    return near.groupBy("id").agg(F.min(F.struct(F.col("name") != F.col("alias"), "group")).alias("b")).select("id", "b.group")


def bracket_score(name: Column, title: Column) -> Column:
    """How well a bracket's name fits a title's: 100 holds it, 30 has its initials, 50 holds its first word, 10 its first three letters, 0 none."""
    full, n = F.lower(title), F.lower(name)
    key = F.split_part(full, F.lit(" "), F.lit(1))
    words = F.filter(F.split(F.regexp_replace(n, r"[-_.]", " "), r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 2, w).otherwise(F.substring(w, 1, 1))), "")
    short = F.length(full).between(2, 4) & full.rlike("^[a-z0-9]+$") & (full == initials)
    first = (key != full) & (F.length(key) >= 4) & F.contains(n, key)
    three = F.substring(F.when(key != "", key).otherwise(full), 1, 3)
    return F.when((full == "") | (n == ""), 0).when(F.contains(n, full), 100).when(short, 30).when(first, 50).when((F.length(three) >= 3) & F.contains(n, three), 10).otherwise(0)


def bracket_aggregate(pairs: DataFrame, ties: DataFrame) -> DataFrame:
    """Tie, aggregate_home, aggregate_away, leg_number of the best pair of each tie's bracket, in the tie's orientation.

    pairs: bracket, round, place, home, away, agg_home, agg_away, legs, winner.  ties: tie, bracket,
    home, away.  A pair must fit on both sides, straight or turned; the higher sum wins, then a pair
    without a winner, then the earlier place.  A pair without an aggregate gives none.  Ties of equal bracket and
    names are scored once.
    """
    p = pairs.select("bracket", "round", "place", "agg_home", "agg_away", "legs", "winner", F.col("home").alias("ph"), F.col("away").alias("pa"))
    met = ties.select("bracket", "home", "away").distinct().join(p, "bracket")
    fit = lambda a, b: bracket_score(F.col(a), F.col(b))
    both = F.explode(F.array(F.struct(F.lit(False).alias("turned"), fit("ph", "home").alias("h"), fit("pa", "away").alias("a")), F.struct(F.lit(True).alias("turned"), fit("ph", "away").alias("h"), fit("pa", "home").alias("a"))))
    scored = met.withColumn("o", both).filter("o.h > 0 and o.a > 0")
    order = (-(F.col("o.h") + F.col("o.a"))), F.col("winner").isNotNull(), F.col("round"), F.col("place"), F.col("o.turned")
    found = ties.join(latest(scored, ["bracket", "home", "away"], *order), ["bracket", "home", "away"])
    best = latest(found, ["tie"], *order).filter("agg_home is not null and agg_away is not null")
    side = lambda x, y: F.when(F.col("o.turned"), F.col(y)).otherwise(F.col(x))
    return best.select("tie", side("agg_home", "agg_away").alias("aggregate_home"), side("agg_away", "agg_home").alias("aggregate_away"), F.greatest(F.lit(1), F.least(F.lit(2), F.col("legs") + 1)).alias("leg_number"))


def first_given(rows: DataFrame, others: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """``rows`` whose null ``wanted`` columns are filled from ``others`` of the key."""
    more = others.select(key, *[F.col(c).alias(f"_{c}") for c in wanted])
    return rows.join(more, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in wanted}).drop(*[f"_{c}" for c in wanted])


def contract(records: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Key and the fixed fields of live state with their defaults; a record without a live row keeps the defaults alone."""
    given = {"state": F.lit(""), "display_clock": F.lit(""), "period": F.lit(0), "clock_running": F.lit(True), "is_two_leg": F.lit(False), "aggregate_home": None, "aggregate_away": None, "leg_number": None, "source": F.lit("")}
    joined = records.select(key).join(live, key, "left")
    return joined.select(key, *[(F.col(c) if v is None else F.coalesce(c, v)).alias(c) for c, v in given.items()])


def aggregate_lookup(ties: DataFrame, results: DataFrame) -> DataFrame:
    """Tie, aggregate_home, aggregate_away of the first result whose names hold, or are held by, a tie's (tie, x, y), in either orientation.

    results: result (their order), home, away, home_agg, away_agg.  Names meet in lists of three characters; ties of
    equal names are looked up once.
    """
    own, ties = ties, ties.filter("x is not null and y is not null").groupBy("x", "y").agg(F.min("tie").alias("tie"))
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3)))))
    held = lambda a, b: F.contains(a, b) | F.contains(b, a)
    side = F.inline(F.array(F.struct(F.lit(False).alias("turned"), F.col("home").alias("h"), F.col("away").alias("a"), F.col("home_agg").alias("hs"), F.col("away_agg").alias("as")), F.struct(F.lit(True).alias("turned"), F.col("away").alias("h"), F.col("home").alias("a"), F.col("away_agg").alias("hs"), F.col("home_agg").alias("as"))))
    r = results.select("result", side)
    pairs = ties.select("tie", grams("x").alias("g")).join(r.select("result", "turned", grams("h").alias("g")), "g").select("tie", "result", "turned").distinct()
    both = pairs.join(ties, "tie").join(r, ["result", "turned"]).filter(held(F.col("x"), F.col("h")) & held(F.col("y"), F.col("a")))
    best = latest(both, ["tie"], F.col("result"), F.col("turned"))
    found = own.join(best.select("x", "y", "result", "turned", "hs", "as"), ["x", "y"])
    return latest(found, ["tie"], F.col("result"), F.col("turned")).select("tie", F.col("hs").alias("aggregate_home"), F.col("as").alias("aggregate_away"))
