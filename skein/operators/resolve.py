"""The three-tier resolver: provider records to fixtures, each tier on what the one before left.

records: rec, sport, home, away, kickoff, and where there are any provider (``fl``),
kickoff_confidence (1) and hint (a market's series).  teams: team_id, sport, name.  aliases:
alias (normalised), sport, team_id.  fixtures: fixture_id, home_id, away_id, fixture_at, and
competition_id.  competitions: base (of a series, upper case), competition_id.

A tier's rows: rec, tier, fixture_id, confidence, reason, fail_reason, candidates (what a review
is offered, best first) and path (how the fixture's competition relates to the record's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import domain
from skein.functions.grammar import split_suffix
from skein.functions.prices import band
from skein.functions.similarity import edit_ratio, token_set_ratio
from skein.functions.text import INDIVIDUAL_SPORTS, initials_compatible, normalize_name, structural_name, structural_tokens, surname_readings
from skein.operators.joins import latest, micros, similarity_policy, trigram_top, within
from skein.operators.storage import stored

# Thresholds and score parts of the tiers.
TOKEN_SET_THRESHOLD, EDIT_THRESHOLD = 0.78, 0.85
STRICT_CONFIDENCE, KICKOFF_CONFIDENCE = 0.98, 0.85
ALIAS_ANCHOR, ALIAS_CORROBORATION, ALIAS_DRIFT = 0.50, 0.20, 1800
FUZZY_ANCHOR, FUZZY_CORROBORATION, FUZZY_DRIFT = 0.40, 0.30, 3600
REMAINDER_THRESHOLD, INITIALS_BONUS = 0.85, 0.30
TRIGRAM_FLOOR, TRIGRAM_TOP = 0.30, 3

_IDS = "array<long>"


def complete(records: DataFrame) -> DataFrame:
    """Records with the columns that they may lack."""
    given = {"provider": F.lit("fl"), "kickoff_confidence": F.lit(1.0), "hint": F.lit(None).cast("string")}
    return records.withColumns({c: v for c, v in given.items() if c not in records.columns})


def sides(records: DataFrame) -> DataFrame:
    """A row for each side: rec, side, sport, kickoff, name."""
    side = lambda n: F.struct(F.lit(n).alias("side"), F.col(n).alias("name"))
    return records.select("rec", "sport", "kickoff", F.explode(F.array(side("home"), side("away"))).alias("s")).select("rec", "sport", "kickoff", "s.side", "s.name")


def two_sides(found: DataFrame, columns: list[str]) -> DataFrame:
    """rec with home_ and away_ columns of what each side found (null without)."""
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    return found.groupBy("rec").agg(*[pick(s, c) for s in ("home", "away") for c in columns])


def fixture_of(pairs: DataFrame, fixtures: DataFrame, seconds: int) -> DataFrame:
    """Rec, fixture_id, fixture_competition, turned: the nearest fixture of (home_id, away_id) within the drift.

    Swapped sides count only where the straight ones miss.  Where pairs have a competition_id, a
    fixture must have the same or none.  Pairs of equal ids, kickoff and competition are looked up once, and of
    fixtures that are equal in these the smallest id alone, so copies on both sides form no products.
    """
    none = F.lit(None).cast("string")
    fx = fixtures.select("home_id", "away_id", "fixture_id", "fixture_at", (F.col("competition_id") if "competition_id" in fixtures.columns else none).alias("fixture_competition"))
    fx = fx.groupBy("home_id", "away_id", "fixture_at", "fixture_competition").agg(F.min("fixture_id").alias("fixture_id"))
    p = (pairs if "competition_id" in pairs.columns else pairs.withColumn("competition_id", none)).select("rec", "home_id", "away_id", "kickoff", "competition_id")
    asked = p.select("home_id", "away_id", "kickoff", "competition_id").distinct().select("*", F.col("home_id").alias("_x"), F.col("away_id").alias("_y"))
    turned = asked.withColumns({"home_id": F.col("away_id"), "away_id": F.col("home_id")})
    near = lambda d, r: within(d, fx, ["home_id", "away_id"], "kickoff", "fixture_at", seconds).withColumn("turned", F.lit(r))
    fits = F.col("competition_id").isNull() | F.col("fixture_competition").isNull() | (F.col("competition_id") == F.col("fixture_competition"))
    order = F.col("turned"), F.abs(micros(F.col("kickoff")) - micros(F.col("fixture_at"))), F.col("fixture_id")
    both = near(asked, False).unionByName(near(turned, True)).filter(fits)
    best = latest(both, ["_x", "_y", "kickoff", "competition_id"], *order).select("_x", "_y", F.col("kickoff").alias("_at"), F.col("competition_id").alias("_c"), "fixture_id", "fixture_at", "fixture_competition", "turned")
    same = (F.col("home_id") == F.col("_x")) & (F.col("away_id") == F.col("_y")) & (F.col("kickoff") == F.col("_at")) & F.col("competition_id").eqNullSafe(F.col("_c"))
    return latest(p.join(best, same), ["rec"], *order).select("rec", "fixture_id", "fixture_competition", "turned")


def competition_of(records: DataFrame, competitions: DataFrame | None) -> DataFrame:
    """Records with competition_id and gate: ``explicit``, ``no_hint`` or ``unresolvable``.

    The feed goes by sport alone.  A market's hint is looked up as it is, then without a market's
    suffix; of several competitions with one base the largest id counts.
    """
    hint = F.upper(F.trim(F.coalesce("hint", F.lit(""))))
    none = F.lit(None).cast("string")
    if competitions is None:
        return records.withColumns({"competition_id": none, "gate": F.lit("no_hint")})
    known = competitions.groupBy("base").agg(F.max("competition_id").alias("id"))
    side = lambda n: known.select(F.col("base").alias(f"_{n}"), F.col("id").alias(f"_{n}_id"))
    asked = records.withColumns({"_whole": F.when((F.col("provider") == "kalshi") & (hint != ""), hint)}).withColumn("_part", split_suffix(F.col("_whole"))["base"])
    found = asked.join(side("w"), F.col("_whole") == F.col("_w"), "left").join(side("p"), F.col("_part") == F.col("_p"), "left").withColumn("competition_id", F.coalesce("_w_id", "_p_id"))
    gate = F.when(F.col("_whole").isNull(), "no_hint").when(F.col("competition_id").isNull(), "unresolvable").otherwise("explicit")
    return found.withColumn("gate", gate).drop("_whole", "_part", "_w", "_p", "_w_id", "_p_id")


def competition_path(provider: Column, gate: Column, created: Column, competition: Column) -> Column:
    """How a fixture's competition relates to the record's; null where nothing is to be told."""
    feed = F.when(created, F.when(competition.isNull(), "created_null_comp_fixture").otherwise("created_with_comp_fixture"))
    feed = feed.when(competition.isNull(), "matched_null_comp_fixture").otherwise("matched_existing_comp_fixture")
    return F.when((provider == "kalshi") & (gate == "explicit") & competition.isNull() & ~created, "linked_to_null_comp_fixture").when(provider == "fl", feed)


def strict_tier(records: DataFrame, aliases: DataFrame, fixtures: DataFrame, competitions: DataFrame | None = None) -> DataFrame:
    """gates in order (kickoff, sport, aliases of one team each, competition), then the nearest fixture within 30 minutes, or a new one: confidence 0.98.

    A new fixture's id is a hash of its teams and kickoff, so records that agree in these share it.
    """
    index = aliases.groupBy("alias", "sport").agg(F.min("team_id").alias("low"), F.max("team_id").alias("high"))
    side = sides(records).withColumn("alias", normalize_name(F.col("name"))).join(index, ["alias", "sport"], "left")
    both = two_sides(side.withColumn("id", F.when(F.col("low") == F.col("high"), F.col("low"))), ["id"])
    gated = competition_of(records.join(both, "rec", "left"), competitions)
    gated = gated.join(aliases.select("sport", F.lit(True).alias("_sport")).distinct(), "sport", "left")
    fail = (
        F.when(F.coalesce("kickoff_confidence", F.lit(0.0)) < KICKOFF_CONFIDENCE, "kickoff_confidence_below_threshold").when(F.col("kickoff").isNull(), "kickoff_at_missing")
        .when(F.col("_sport").isNull(), "sport_not_classified").when(F.col("home_id").isNull() | F.col("away_id").isNull(), "alias_resolution_incomplete")
        .when(F.col("home_id") == F.col("away_id"), "home_and_away_same_team").when(F.col("gate") == "unresolvable", "kalshi_competition_unresolvable")
    )
    gated = stored(gated.withColumn("fail_reason", fail).drop("_sport"), "gated")
    found = gated.join(fixture_of(gated.filter("fail_reason is null"), fixtures, ALIAS_DRIFT), "rec", "left")
    kind = fixtures.schema["fixture_id"].dataType.simpleString()
    key = F.xxhash64("home_id", "away_id", "kickoff") if kind == "bigint" else F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("home_id", "away_id", "kickoff")]), 256)
    created = F.col("fail_reason").isNull() & F.col("fixture_id").isNull()
    competition = F.when(created, F.col("competition_id")).otherwise(F.col("fixture_competition"))
    path = F.when(F.col("fail_reason").isNull(), competition_path(F.col("provider"), F.col("gate"), created, competition))
    ok = F.col("fail_reason").isNull()
    return found.select(
        "rec", F.lit("strict").alias("tier"), F.when(ok, F.coalesce("fixture_id", key)).alias("fixture_id"), F.when(ok, STRICT_CONFIDENCE).otherwise(0.0).alias("confidence"),
        F.when(ok, "strict").otherwise("no_match").alias("reason"), "fail_reason", F.array().cast(_IDS).alias("candidates"), path.alias("path"),
    )


# ---- similar names


def _sorted(name: Column, distinct: bool = False) -> Column:
    tokens = structural_tokens(name)
    return F.array_join(F.array_sort(F.array_distinct(tokens) if distinct else tokens), " ")


def _bigrams(s: Column) -> Column:
    """Distinct bigrams; blanks at both ends make them independent of the order of tokens."""
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) + 1), lambda i: F.substr(padded, i, F.lit(2))))


def _pairs_by_bigrams(n: DataFrame, c: DataFrame, threshold: float) -> DataFrame:
    """Pairs that an edit ratio of the threshold or above may have.

    At that ratio t at most 4 (1 - t) / (2 - t) of a string's length in bigrams is lost to the other, so
    one bigram more than that, the rarest ones of the teams first, has a common one; lengths differ by
    t / (2 - t) at most.
    """
    from skein.operators.joins import _prefix, dealt, rare_first, token_counts

    lost = 4 * (1 - threshold) / (2 - threshold)
    side = lambda d: d.select("id", "sport", F.length("s").alias("len"), _bigrams(F.col("s")).alias("g"))
    a, b = side(n), side(c)
    counts = token_counts(a.select("sport", "g").unionByName(b.select("sport", "g")), "g", ["sport"])

    def first(d: DataFrame) -> DataFrame:
        ranked = rare_first(d, "id", "g", ["sport"], counts).join(d.select("id", "len"), "id")
        return _prefix(ranked, F.floor(F.col("len") * lost + 1e-9) + 1).select("id", "sport", "len", "token", "list")

    x, y = first(a), first(b).select(F.col("id").alias("team_id"), "sport", F.col("len").alias("m"), "token", "list")
    near = (F.col("m") * threshold <= F.col("len") * (2 - threshold)) & (F.col("len") * threshold <= F.col("m") * (2 - threshold))
    return dealt(x, y, ["sport", "token"]).filter(near).select("id", "team_id")


def _pairs_by_tokens(n: DataFrame, c: DataFrame, threshold: float) -> DataFrame:
    """Pairs that a token-set ratio may join through common tokens.

    There the common tokens make up t / (2 - t) of one side at least, so that side's tokens, the
    rarest first and as many as reach beyond the rest of its length, hold a common one.
    """
    from skein.operators.joins import dealt

    rest = 1 - threshold / (2 - threshold)
    tokens = lambda d: d.select("id", "sport", F.length("s").alias("len"), F.explode(F.array_distinct(F.split("s", " "))).alias("token"))
    a, b = tokens(n), tokens(c)
    counts = a.select("sport", "token").unionByName(b.select("sport", "token")).groupBy("sport", "token").agg(F.count("*").alias("list"))

    def first(d: DataFrame) -> DataFrame:
        ranked = d.join(counts, ["sport", "token"]).groupBy("id", "sport", "len").agg(F.array_sort(F.collect_list(F.struct("list", "token"))).alias("r"))
        before = lambda i: F.aggregate(F.slice("r", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x["token"]) + 1)
        kept = F.filter(F.transform("r", lambda x, i: F.when(before(i) <= F.col("len") * rest + 1, x)), lambda x: x.isNotNull())
        return ranked.select("id", "sport", F.inline(kept))

    whole = lambda d: d.select("id", "sport", "token").join(counts, ["sport", "token"])
    named = lambda d: d.select(F.col("id").alias("team_id"), "sport", "token", "list")
    met = dealt(first(a), named(whole(b)), ["sport", "token"]).unionByName(dealt(whole(a), named(first(b)), ["sport", "token"]))
    return met.select("id", "team_id")


def team_scores(names: DataFrame, teams: DataFrame, ratio, threshold: float, sets: bool = False) -> DataFrame:
    """Name, sport, team_id, score of all teams of the sport at the threshold or above.

    Different names meet teams in lists of their rarest bigrams (and, for the token-set ratio
    (``sets``), of their rarest tokens); these lose no pair at the threshold.  Ids alone are paired;
    strings are joined back to be scored.
    """
    n = names.select("name", "sport").distinct().withColumn("s", _sorted(F.col("name"), sets)).filter(F.col("s") != "").withColumn("id", F.xxhash64("name", "sport"))
    c = teams.select(F.col("team_id").alias("id"), "sport", _sorted(F.col("name"), sets).alias("s")).filter(F.col("s") != "")
    pairs = _pairs_by_bigrams(n, c, threshold)
    if sets:
        pairs = pairs.unionByName(_pairs_by_tokens(n, c, threshold))
    both = pairs.distinct().join(n, "id").join(c.select(F.col("id").alias("team_id"), F.col("s").alias("t")), "team_id")
    return both.withColumn("score", ratio("s", "t")).filter(F.col("score") >= threshold).select("name", "sport", "team_id", "score")


# ---- personal names


def surname_index(teams: DataFrame) -> DataFrame:
    """Sport, surname, team_id, others: teams of individuals under each reading of their surname."""
    named = teams.filter(F.lower("sport").isin(*INDIVIDUAL_SPORTS)).select("sport", "team_id", structural_name(F.col("name"), F.col("sport")).alias("s")).filter("s is not null")
    whole = F.concat("s.others", F.array("s.surname"))
    keys = F.when(F.col("s.path") == "personal_initial", F.array("s.surname")).otherwise(surname_readings(whole))
    return named.select("sport", "team_id", "s.others", F.explode(keys).alias("surname"))


def personal_matches(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Name, sport, state, target, ids, quality of names of individuals with a known surname; several teams collide.

    Quality is the larger of 0.30 where initials agree and 0.20 to 0.30 for a token-set ratio of the
    other tokens from 0.85 on.
    """
    n = names.filter(F.lower("sport").isin(*INDIVIDUAL_SPORTS)).select("name", "sport").distinct().withColumn("s", structural_name(F.col("name"), F.col("sport")))
    n = n.filter("s.surname <> ''").select("name", "sport", "s.surname", F.col("s.others").alias("own"))
    met = n.join(surname_index(teams), ["sport", "surname"])
    found = met.groupBy("name", "sport").agg(F.array_sort(F.collect_set("team_id")).alias("ids"), F.any_value("own").alias("own"), F.any_value("others").alias("others"))
    a, b = F.array_join("own", " "), F.array_join("others", " ")
    scored = found.withColumn("r", F.when((a != "") & (b != ""), token_set_ratio(a, b)))
    by_ratio = F.when(F.col("r") >= REMAINDER_THRESHOLD, 0.20 + (F.col("r") - REMAINDER_THRESHOLD) / (1 - REMAINDER_THRESHOLD) * 0.10).otherwise(0.0)
    quality = F.greatest(F.when(initials_compatible(F.col("own"), F.col("others")), INITIALS_BONUS).otherwise(0.0), by_ratio)
    one = F.size("ids") == 1
    return scored.select("name", "sport", F.when(one, "match").otherwise("collision").alias("state"), F.when(one, F.get("ids", F.lit(0))).alias("target"), "ids", F.when(one, quality).otherwise(0.0).alias("quality"))


# ---- the scored tiers


def _matched(names: DataFrame, teams: DataFrame, tier: str) -> DataFrame:
    """name, sport, state, target, ids, score (the quality that counts for the confidence) of names that match or collide."""
    alias = tier == "alias"
    ratio, threshold = (token_set_ratio, TOKEN_SET_THRESHOLD) if alias else (edit_ratio, EDIT_THRESHOLD)
    clubs = names.filter(~F.lower("sport").isin(*INDIVIDUAL_SPORTS))
    scored = stored(team_scores(clubs, teams, ratio, threshold, alias), "scores").withColumn("who", F.struct("name", "sport"))
    found = similarity_policy(scored, "who", "team_id", "score", threshold).select("who.name", "who.sport", "state", "target", "ids", "score")
    if alias:
        return found
    quality = 0.10 + (F.col("score") - threshold) / (1 - threshold) * 0.20
    return found.withColumn("score", quality).unionByName(personal_matches(names, teams).withColumnRenamed("quality", "score"))


def _scored_tier(records: DataFrame, teams: DataFrame, fixtures: DataFrame, tier: str) -> DataFrame:
    alias = tier == "alias"
    anchor, bonus, drift = (ALIAS_ANCHOR, ALIAS_CORROBORATION, ALIAS_DRIFT) if alias else (FUZZY_ANCHOR, FUZZY_CORROBORATION, FUZZY_DRIFT)
    sports = teams.select("sport", F.lit(True).alias("_sport")).distinct()
    individual = F.lower(F.coalesce("sport", F.lit(""))).isin(*INDIVIDUAL_SPORTS)
    empty = lambda c: F.size(F.coalesce(structural_tokens(F.col(c)), F.array().cast("array<string>"))) == 0
    gate = (
        F.when(F.col("_sport").isNull(), "sport_not_classified").when(F.lit(alias) & individual, "deferred_to_2d").when(F.col("kickoff").isNull(), "kickoff_at_missing")
        .when(empty("home") | empty("away"), "structural_normalize_failed")
    )
    gated = stored(records.join(sports, "sport", "left").withColumn("gate", gate).drop("_sport"), "gated")
    each = sides(gated.filter("gate is null"))
    side = each.join(stored(_matched(each, teams, tier), "matches"), ["name", "sport"], "left").withColumnRenamed("target", "id")
    both = stored(gated.join(two_sides(side, ["id", "state", "score", "ids"]), "rec", "left"), "sides")
    known = both.filter("home_id is not null and away_id is not null")
    found = both.join(fixture_of(known, fixtures, drift).drop("turned", "fixture_competition"), "rec", "left")

    failed = lambda s: F.col(f"{s}_state").isNull()
    nothing, one = failed("home") & failed("away"), failed("home") != failed("away")
    excluded = domain.routing_excluded(F.col("provider"), F.col("home"), F.col("away"))
    lone = one & F.coalesce("home_id", "away_id").isNull()
    collided = (F.col("home_state") == "collision") | (F.col("away_state") == "collision")
    mean = (F.col("home_score") + F.col("away_score")) / 2
    part = F.lit(0.20) + (mean - TOKEN_SET_THRESHOLD) / (1 - TOKEN_SET_THRESHOLD) * 0.10 if alias else mean
    total = F.bround(F.lit(anchor) + part + F.when(F.col("fixture_id").isNotNull(), bonus).otherwise(0.0), 4)
    told = band(total)
    missed = (told == "auto_apply") & F.col("fixture_id").isNull()
    resemblance = f"{tier}_no_team_resemblance"
    lost = nothing | one if alias else nothing | (one & excluded)
    fail = (
        F.when(F.col("gate").isNotNull(), F.col("gate")).when(lost, resemblance).when(F.lit(not alias) & lone, "fuzzy_collision_no_anchor").when(one | collided, None)
        .when(missed, f"{tier}_no_existing_fixture").when(told == "no_match", "below_review_threshold")
    )
    reason = F.when(fail.isNotNull(), "no_match").when(one | collided, "review_queue").when(told == "auto_apply", tier).otherwise(told)
    none = F.array().cast(_IDS)
    own = lambda s: F.coalesce(F.col(f"{s}_ids").cast(_IDS), none)
    offered = F.when(one, F.array(F.coalesce("home_id", "away_id")).cast(_IDS)).when(collided, F.concat(own("home"), own("away"))).otherwise(F.array("home_id", "away_id").cast(_IDS))
    done = found.withColumns({"fail_reason": fail, "reason": reason, "_one": one})
    done = stored(
        done.select(
            "rec", "sport", "_one", F.when(failed("home"), F.col("home")).otherwise(F.col("away")).alias("_name"), F.when(F.col("reason") == tier, F.col("fixture_id")).alias("fixture_id"),
            F.when(F.col("gate").isNotNull() | one | nothing | collided, 0.0).otherwise(total).alias("confidence"), "reason", "fail_reason", F.when(F.col("reason") == "review_queue", offered).otherwise(none).alias("candidates"),
        ),
        "scored",
    )
    asked = done.filter((F.col("reason") == "review_queue") & F.col("_one")).select("sport", F.col("_name").alias("name")).distinct().withColumn("nid", F.xxhash64("name", "sport"))
    near = trigram_top(asked, teams, "nid", "name", "team_id", "name", TRIGRAM_FLOOR, TRIGRAM_TOP, ["sport"])
    more = near.groupBy("lid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rid"))), lambda x: x["rid"].cast("long")).alias("more"))  # TRIGRAM_TOP at most
    whole = done.withColumn("lid", F.when((F.col("reason") == "review_queue") & F.col("_one"), F.xxhash64("_name", "sport"))).join(more, "lid", "left")
    return whole.select("rec", F.lit(tier).alias("tier"), "fixture_id", "confidence", "reason", "fail_reason", F.concat("candidates", F.coalesce("more", none)).alias("candidates"), F.lit(None).cast("string").alias("path"))


def alias_tier(records: DataFrame, teams: DataFrame, fixtures: DataFrame) -> DataFrame:
    """token-set similarity at 0.78; 0.50, 0.20 to 0.30 for quality, 0.20 for a fixture within 30 minutes; sports of individuals are left to the next tier."""
    return _scored_tier(complete(records), teams, fixtures, "alias")


def fuzzy_tier(records: DataFrame, teams: DataFrame, fixtures: DataFrame) -> DataFrame:
    """edit ratio at 0.85, or surnames of individuals; 0.40, up to 0.30 for quality, 0.30 for a fixture within an hour.

    Where one side alone fails, the record goes to review with the other side's team and the failed
    name's three nearest teams, unless a prop market's name shows or the other side collides.
    """
    return _scored_tier(complete(records), teams, fixtures, "fuzzy")


def resolve(records: DataFrame, teams: DataFrame, aliases: DataFrame, fixtures: DataFrame, competitions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """the final result of each record, and a log row for each tier that was tried.

    A tier's result is final unless it is no_match; the last one's always is.
    """
    log, left = None, stored(complete(records), "records")
    teams, aliases, fixtures = stored(teams, "teams"), stored(aliases, "aliases"), stored(fixtures, "fixtures")
    for step in (lambda r: strict_tier(r, aliases, fixtures, competitions), lambda r: alias_tier(r, teams, fixtures), lambda r: fuzzy_tier(r, teams, fixtures)):
        tried = stored(step(left), "tier")
        log = tried if log is None else log.unionByName(tried)
        left = left.join(tried.filter("reason <> 'no_match'").select("rec").hint("merge"), "rec", "left_anti")  # a file of few bytes may have many rows
    rank = F.when(F.col("reason") != "no_match", 0).otherwise(1)
    order = F.when(F.col("tier") == "strict", 0).when(F.col("tier") == "alias", 1).otherwise(2)
    final = latest(log, ["rec"], rank, F.when(rank == 0, order).otherwise(-order))
    return final, log


def capability(final: DataFrame, records: DataFrame) -> DataFrame:
    """Counts by reason for each sport, and the share that was linked."""
    joined = final.join(records.select("rec", "sport"), "rec")
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in ("strict", "alias", "fuzzy", "review_queue", "no_match")]
    return joined.groupBy("sport").agg(*counts, (F.count_if(F.col("reason").isin("strict", "alias", "fuzzy")) / F.count("*")).alias("rate"))
