"""Domain rules over provider rows made of harness tables; twins state the rules anew in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import domain, grammar
from skein.operators import feeds, joins, review
from skein.plans.derived import FEED, MARKETS, SPORTS, feed, markets, pick, picked, quoted, values
from skein.plans.registry import Tables, query

_SEG = f"[{', '.join(map(quoted, domain.PROP_SEGMENTS))}]"
_SUF = f"[{', '.join(quoted(s.lower()) for s in domain.PROP_SUFFIXES)}]"
_PROP_TITLE = "(contains(title, ':') AND list_contains({seg}, trim(list_extract(string_split(title, ':'), -1))))".format(seg=_SEG)


def _prop_name(c: str) -> str:
    return f"(list_contains({_SEG}, {c}) OR (contains({c}, ':') AND list_contains({_SEG}, trim(substr({c}, instr({c}, ':') + 1)))))"


@query(f"""WITH {MARKETS} SELECT rec, CASE WHEN provider = 'fl' THEN 'head_to_head' WHEN trim(coalesce(sport, '')) = '' THEN 'non_sport_filtered_out' WHEN {_PROP_TITLE} THEN 'prop_market_filtered_out' ELSE 'head_to_head' END AS scope FROM market""")
def P03_scope_classifier(t: Tables) -> DataFrame:
    return markets(t).select("rec", domain.scope(F.col("provider"), F.col("sport"), F.col("title")).alias("scope"))


@query(f"WITH {MARKETS} SELECT rec, {_PROP_TITLE} AS is_prop FROM market")
def P04_prop_titles(t: Tables) -> DataFrame:
    return markets(t).select("rec", domain.prop_title(F.col("title")).alias("is_prop"))


@query(f"WITH {MARKETS} SELECT rec, {_prop_name('name')} AS is_prop FROM (SELECT rec, CASE rec % 3 WHEN 0 THEN 'Overtime' ELSE title END AS name FROM market)")
def P05_prop_names(t: Tables) -> DataFrame:
    name = F.when(F.col("rec") % 3 == 0, "Overtime").otherwise(F.col("title"))
    return markets(t).select("rec", domain.prop_name(name).alias("is_prop"))


@query(f"WITH {MARKETS} SELECT rec, contains(title, ': ') AND list_contains({_SUF}, lower(trim(list_extract(string_split(title, ': '), -1)))) AS is_prop FROM market")
def P06_prop_suffixes(t: Tables) -> DataFrame:
    return markets(t).select("rec", domain.prop_suffix(F.col("title")).alias("is_prop"))


@query(f"WITH {MARKETS} SELECT rec, provider = 'kalshi' AND ({_prop_name('first')} OR {_prop_name('tail')}) AS excluded FROM (SELECT rec, provider, first, second || substr(title, length(first || link || second) + 1) AS tail FROM market)")
def P07_provider_gate(t: Tables) -> DataFrame:
    tail = F.concat("second", F.substr("title", F.length(F.concat("first", "link", "second")) + 1))
    return markets(t).select("rec", domain.routing_excluded(F.col("provider"), F.col("first"), tail).alias("excluded"))


@query(f"""WITH {FEED} SELECT rec FROM (SELECT rec, sport, CASE rec % 4 WHEN 0 THEN HOME_NAME || '/x' ELSE HOME_NAME END AS h FROM feed) WHERE lower(sport) IN ('tennis', 'mma', 'boxing', 'golf', 'snooker', 'darts') AND contains(h, '/')""")
def P08_doubles_pairs(t: Tables) -> DataFrame:
    home = F.when(F.col("rec") % 4 == 0, F.concat("HOME_NAME", F.lit("/x"))).otherwise(F.col("HOME_NAME"))
    return feed(t).filter(feeds.doubles_pair(F.col("sport"), home, F.col("AWAY_NAME"))).select("rec")


# ---- rule tables

_KINDS = ("", "Totals", "First Half Winner", "Points", "Method of Victory", "Arsenal Total Wins", "Playoff Win Total: NY", "Total Maps", "Spread", "Set 1 Winner", "nothing")
_SUFFIXES = ("GAME", "TOTAL", "1H", "", "MATCH", "SPREAD", "F5")
_ASKED = f"""asked AS (SELECT p_partkey AS rec, {picked('p_partkey', (*SPORTS, 'Football', 'Esports', 'Baseball'))} AS sport, {picked('p_partkey', _SUFFIXES)} AS suffix, {picked('p_partkey // 7', _KINDS)} AS market_type, p_size % 14 AS n FROM part)"""
_RULES = f"""rules(sport, suffix, market_type, least, most, kind, has_tie, by_team) AS (VALUES {values(domain.SHAPES)}),
parts(place, sport, part, least, most, kind) AS (VALUES {values([(i, *r) for i, r in enumerate(domain.SHAPE_FRAGMENTS)])}),
shaped AS (
  SELECT rec, n, coalesce(a.kind, b.kind, c.kind, (SELECT arg_min(kind, place) FROM parts f WHERE f.sport = q.sport AND (ends_with(q.market_type, part) OR starts_with(q.market_type, part)))) AS kind,
    coalesce(a.least, b.least, c.least, (SELECT arg_min(least, place) FROM parts f WHERE f.sport = q.sport AND (ends_with(q.market_type, part) OR starts_with(q.market_type, part)))) AS least,
    coalesce(a.most, b.most, c.most, (SELECT arg_min(most, place) FROM parts f WHERE f.sport = q.sport AND (ends_with(q.market_type, part) OR starts_with(q.market_type, part)))) AS most,
    coalesce(a.has_tie, b.has_tie, c.has_tie, false) AS has_tie
  FROM asked q LEFT JOIN rules a ON a.sport = q.sport AND a.suffix = q.suffix AND a.market_type = q.market_type
  LEFT JOIN rules b ON b.sport = q.sport AND b.suffix = '' AND b.market_type = q.market_type LEFT JOIN rules c ON c.sport = q.sport AND c.suffix = q.suffix AND c.market_type = '')"""


def _asked(t: Tables) -> DataFrame:
    own = t.part.withColumn("seventh", F.floor(F.col("p_partkey") / 7))
    return own.select(F.col("p_partkey").alias("rec"), pick("p_partkey", (*SPORTS, "Football", "Esports", "Baseball")).alias("sport"), pick("p_partkey", _SUFFIXES).alias("suffix"), pick("seventh", _KINDS).alias("market_type"), (F.col("p_size") % 14).alias("n"))


@query(f"WITH {_ASKED}, {_RULES} SELECT rec, kind, CAST(least AS INT) AS least, CAST(most AS INT) AS most FROM shaped")
def P17_rule_lookup(t: Tables) -> DataFrame:
    return domain.shape_for(_asked(t)).select("rec", "shape.kind", "shape.least", "shape.most")


@query(f"SELECT DISTINCT sport, suffix, market_type FROM (VALUES {values(domain.SHAPES)}) r(sport, suffix, market_type, a, b, c, d, e)")
def P18_known_buckets(t: Tables) -> DataFrame:
    return domain.shapes(t.spark).select("sport", "suffix", "market_type").distinct()


@query(f"""WITH {_ASKED}, {_RULES}, o AS (SELECT rec, n, kind, least, most, has_tie, list_transform(range(0, n), lambda i: CASE WHEN i % 5 = 1 THEN 'Tie' ELSE 'o' || i END) AS labels FROM shaped)
  SELECT rec, CASE WHEN has_tie THEN list_concat(list_filter(labels, lambda x: x <> 'Tie'), list_filter(labels, lambda x: x = 'Tie')) ELSE labels END AS labels, kind IS NULL OR n BETWEEN least AND most AS validates,
    CASE WHEN kind IS NULL THEN 'unknown shape' WHEN n BETWEEN least AND most THEN NULL WHEN least = most THEN 'outcome count ' || n || ' != expected ' || least ELSE 'outcome count ' || n || ' not in [' || least || ', ' || most || ']' END AS warning FROM o""")
def P16_outcome_shapes(t: Tables) -> DataFrame:
    label = lambda i: F.struct(F.when(i % 5 == 1, "Tie").otherwise(F.concat(F.lit("o"), i.cast("string"))).alias("label"))
    made = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), label)).otherwise(F.array().cast("array<struct<label: string>>"))
    s = domain.shaped(made, F.col("shape"))
    return domain.shape_for(_asked(t)).select("rec", s.alias("s")).select("rec", F.col("s.outcomes.label").alias("labels"), "s.validates", "s.warning")


_REASONS = ("alias_no_team_resemblance", "fuzzy_no_team_resemblance", "alias_no_existing_fixture", "fuzzy_no_existing_fixture", "below_review_threshold")


@query(f"""SELECT event_id, CASE r WHEN 'alias_no_team_resemblance' THEN 'no team name matched (alias tier — no fuzzy fallback for this sport)' WHEN 'fuzzy_no_team_resemblance' THEN 'no team name matched (fuzzy tier — alias tier also failed)'
  WHEN 'alias_no_existing_fixture' THEN 'teams matched, but no fixture in sp.fixtures for them' WHEN 'fuzzy_no_existing_fixture' THEN 'teams matched (fuzzy), but no fixture in sp.fixtures for them' ELSE r END AS gloss
  FROM (SELECT event_id, {picked('event_id', _REASONS)} AS r FROM events)""")
def P29_reason_gloss(t: Tables) -> DataFrame:
    return t.events.select("event_id", domain.gloss(pick("event_id", _REASONS)).alias("gloss"))


@query("""SELECT day, list_filter([CASE WHEN crashes > 5 THEN 'crashes' END, CASE WHEN n >= 100 AND applied / n < 0.6 THEN 'coverage' END, CASE WHEN p95 > 300000 THEN 'latency' END], lambda x: x IS NOT NULL) AS halts
  FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type IN ('click', 'view')) AS applied, count(*) FILTER (event_type = 'error') AS crashes, max(value) * 2000 AS p95 FROM events GROUP BY 1)""")
def P31_pass_halts(t: Tables) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), n("click", "view").alias("applied"), n("error").alias("crashes"), (F.max("value") * 2000).alias("p95"))
    return days.select("day", domain.pass_halts(F.col("n"), F.col("applied"), F.col("crashes"), F.col("p95")).alias("halts"))


@query("""SELECT o_custkey, list_filter([CASE WHEN m > 0 AND n > 5 * m THEN 'candidates' END, CASE WHEN ms > 5000 THEN 'latency' END, CASE WHEN n > 50000 THEN 'limit' END], lambda x: x IS NOT NULL) AS halts
  FROM (SELECT o_custkey, CAST(sum(o_totalprice) / 20 AS BIGINT) AS n, max(o_totalprice) / 80 AS ms, CASE WHEN o_custkey % 3 > 0 THEN avg(o_totalprice) / 20 END AS m FROM orders GROUP BY o_custkey)""")
def P32_reselection_halts(t: Tables) -> DataFrame:
    """Prices are added up as decimals, so that no order of rows changes a sum that stands at a bound."""
    total = F.sum(F.col("o_totalprice").cast("decimal(28,10)")).cast("double")
    mean = F.when(F.col("o_custkey") % 3 > 0, total / F.count("o_totalprice") / 20)
    g = t.orders.groupBy("o_custkey").agg(F.rint(total / 20).cast("long").alias("n"), (F.max("o_totalprice") / 80).alias("ms"), mean.alias("m"))
    return g.select("o_custkey", domain.reselection_halts(F.col("n"), F.col("ms"), F.col("m")).alias("halts"))


@query(f"WITH {MARKETS} SELECT rec, {' OR '.join(f'starts_with(upper(series), {quoted(p)})' for p in domain.CUP_PREFIXES)} AS is_cup FROM market")
def P34_cup_series(t: Tables) -> DataFrame:
    return markets(t).select("rec", domain.cup_series(F.col("series")).alias("is_cup"))


_SOURCES = ("espn", "fl", "sportsdb", "sofascore")
_PLACES = values([(s, x, i) for s, xs in domain.SOURCE_PRIORITY.items() for i, x in enumerate(xs)])


@query(f"""WITH {FEED}, has AS (SELECT rec, sport, unnest(list_filter([CASE WHEN rec % 2 = 0 THEN 'espn' END, CASE WHEN rec % 3 <> 0 THEN 'fl' END, 'sportsdb', CASE WHEN rec % 5 = 0 THEN 'sofascore' END], lambda x: x IS NOT NULL)) AS source FROM feed)
  SELECT rec, arg_min(h.source, place) AS source FROM has h JOIN (VALUES {_PLACES}) p(sport, source, place) ON p.sport = h.sport AND p.source = h.source GROUP BY rec""")
def J36_priority_coalesce(t: Tables) -> DataFrame:
    r = lambda n: F.col("rec") % n
    there = F.array_compact(F.array(F.when(r(2) == 0, "espn"), F.when(r(3) != 0, "fl"), F.lit("sportsdb"), F.when(r(5) == 0, "sofascore")))
    has = feed(t).select("rec", "sport", F.explode(there).alias("source")).withColumn("place", domain.source_rank(F.col("sport"), F.col("source")))
    return has.filter("place is not null").groupBy("rec").agg(F.min_by("source", "place").alias("source"))


# ---- teams

_NAMES = ("", " U21", " U-19 X", " Espoirs", " II", " B", " BC", " Jr.", " Women", " Féminines", " W", " Damen", " BW", " reserve")


@query(f"""SELECT p_partkey, regexp_matches(n, '(?i)\\bU[-\\s]?(1[5-9]|2[0-4])\\b') OR regexp_matches(n, '(?i)\\b(espoirs?|reserves?|juniors?|jr\\.?)\\b') OR regexp_matches(n, '(?i)\\b(II|B)\\s*$') AS reserve,
  regexp_matches(n, '(?i)\\bW\\s*$') OR regexp_matches(strip_accents(lower(n)), '\\b(women|womens|woman|ladies|femenino|femenina|femminile|feminin|feminins|feminines|damen|kobiet|kobiety)\\b') AS gender
  FROM (SELECT p_partkey, p_name || {picked('p_partkey', _NAMES)} AS n FROM part)""")
def F16_marker_families(t: Tables) -> DataFrame:
    name = F.concat("p_name", pick("p_partkey", _NAMES))
    return t.part.select("p_partkey", domain.reserve_marker(name).alias("reserve"), domain.gender_marker(name).alias("gender"))


_TEAM_TOKENS = """team AS (SELECT p_partkey AS id, p_brand AS grp, list_sort(list_distinct(string_split(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type || ' ' || p_name END, ' '))) AS t, p_partkey % 9 = 0 AS marked FROM part),
n AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01' GROUP BY 1),
cls AS (SELECT *, min(id) OVER (PARTITION BY grp, marked, t{by}) AS class FROM (SELECT team.*, coalesce(n.n, 0) AS n FROM team LEFT JOIN n USING (id))), rep AS (SELECT * FROM cls WHERE id = class),
pair AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, a.grp FROM rep a JOIN rep b ON a.grp = b.grp AND a.id < b.id AND a.marked = b.marked WHERE len(a.t) <> len(b.t) AND (list_has_all(a.t, b.t) OR list_has_all(b.t, a.t)))"""


def _teams(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", F.lower("p_type"), "p_name", F.when(F.col("p_partkey") % 9 == 0, "W"))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.array_distinct(F.split(F.concat_ws(" ", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")), "p_name"), " ")).alias("tokens"), domain.entity_marker(name).alias("marked"))


def _played(t: Tables) -> DataFrame:
    """Teams with their number of fixtures."""
    n = t.orders.filter(F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return _teams(t).join(n, "id", "left").na.fill(0, ["n"])


def _team_classes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Teams with their class, and pairs of classes with both sides' fixtures: equal names with equally many fixtures are one class."""
    return joins.subset_classes(_played(t), "id", "tokens", ["grp", "marked"], ("n",))


@query(f"WITH {_TEAM_TOKENS.format(by='')} SELECT 'pair' AS kind, a, b FROM pair UNION ALL SELECT 'member', id, class FROM cls")
def J47_subset_pairs(t: Tables) -> DataFrame:
    """Pairs of classes of equal names, and each team's class.  Pairs of which one side alone has a marker of reserves or women are none."""
    members, pairs = joins.subset_classes(_teams(t), "id", "tokens", ["grp", "marked"])
    return joins.with_members(pairs.select("a", "b"), members, "id")


@query(f"""WITH {_TEAM_TOKENS.format(by=', n > 0')} SELECT 'pair' AS kind, a, b, CASE WHEN (na > 0) <> (nb > 0) THEN 'ALIAS-LINK' ELSE 'MERGE-REQUIRED' END AS classification,
    CASE WHEN na > 0 AND nb = 0 THEN a WHEN nb > 0 AND na = 0 THEN b END AS winner, CASE WHEN na > 0 AND nb = 0 THEN b WHEN nb > 0 AND na = 0 THEN a END AS phantom
  FROM pair UNION ALL SELECT 'member', id, class, NULL, NULL, NULL FROM cls""")
def F17_fragmentation_verdict(t: Tables) -> DataFrame:
    """Pairs of classes of equal names that all have fixtures or all have none, and each team's class; a winner and a phantom stand for their classes."""
    members, pairs = joins.subset_classes(_played(t).withColumn("n", (F.col("n") > 0).cast("int")), "id", "tokens", ["grp", "marked"], ("n",))
    v = domain.fragmentation_verdict(F.col("a"), F.col("b"), F.col("n_a"), F.col("n_b"))
    return joins.with_members(pairs.select("a", "b", v.alias("v")).select("a", "b", "v.*"), members, "id")


_ABBRS = ("ATM", "ALW", "XYZ", "LAK", "PSG", "GS", "ARE", "NYK", "IND", "LAL")


@query(f"""SELECT p_partkey, list_sort(list_append(CASE sport || ' ' || abbr WHEN 'Soccer ATM' THEN ['AMI'] WHEN 'Soccer ALW' THEN ['ALR', 'ARE', 'ARB'] WHEN 'Soccer ARE' THEN ['ALW', 'ALR', 'ARB'] WHEN 'Soccer PSG' THEN ['PAR'] WHEN 'Soccer IND' THEN ['IDA']
    WHEN 'Basketball LAK' THEN ['LAL'] WHEN 'Basketball GS' THEN ['GSW'] WHEN 'Basketball NYK' THEN ['NY'] ELSE [] END, abbr)) AS abbrs
  FROM (SELECT p_partkey, {picked('p_partkey // 3', ('Soccer', 'Basketball', 'Golf'))} AS sport, {picked('p_partkey', _ABBRS)} AS abbr FROM part)""")
def F19_alias_expansion(t: Tables) -> DataFrame:
    own = t.part.withColumn("third", F.floor(F.col("p_partkey") / 3))
    return own.select("p_partkey", domain.abbreviations(pick("third", ("Soccer", "Basketball", "Golf")), pick("p_partkey", _ABBRS)).alias("abbrs"))


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH {FEED}, f AS (SELECT rec, sport, {_SLUG.format('HOME_NAME')} AS h, {_SLUG.format('AWAY_NAME')} AS a, CAST(o_orderdate AS DATE) AS day, CASE WHEN rec % 3 = 0 THEN '1930' ELSE '' END AS hhmm, rec % 4 AS line FROM feed),
  k AS (SELECT rec, 'team:' || lower(sport) || ':' || h AS team, 'fixture:' || lower(sport) || ':' || day || CASE WHEN hhmm <> '' THEN ':' || hhmm ELSE '' END || ':' || h || '-vs-' || a AS fixture, line FROM f),
  m AS (SELECT *, 'market:' || substr(fixture, 9) || ':total' || CASE WHEN line > 0 THEN ':' || substr(md5('line=home;threshold=' || line), 1, 8) ELSE '' END AS market FROM k)
  SELECT rec, team, fixture, market, 'outcome:' || market || ':over-2-5' AS outcome FROM m""")
def F29_canonical_ids(t: Tables) -> DataFrame:
    f = feed(t).select("rec", "sport", domain.slug(F.col("HOME_NAME")).alias("h"), domain.slug(F.col("AWAY_NAME")).alias("a"), F.to_date("o_orderdate").alias("day"), (F.col("rec") % 4).alias("line"))
    hhmm = F.when(F.col("rec") % 3 == 0, "1930").otherwise("")
    params = F.when(F.col("line") > 0, F.create_map(F.lit("threshold"), F.col("line").cast("string"), F.lit("line"), F.lit("home"))).otherwise(F.create_map().cast("map<string,string>"))
    ids = f.select("rec", "line", domain.canonical_id("team", F.col("sport"), F.col("h")).alias("team"), domain.fixture_key(F.col("sport"), F.col("day"), F.col("h"), F.col("a"), hhmm).alias("fixture"))
    with_market = ids.withColumn("market", domain.market_key(F.col("fixture"), F.lit("total"), params))
    return with_market.select("rec", "team", "fixture", "market", domain.outcome_key(F.col("market"), F.lit("Over 2.5")).alias("outcome"))


_COMPETITIONS = ("England: Premier League", "UEFA champions league", "NZ NBL Showdown", "Wnba Finals", "Unknown Cup", "J. League 2", "Big Bash T20", None, "Serie A Femminile", "FIBA Cup")


@query(f"""WITH q AS (SELECT event_id, ts, {picked('event_id', _COMPETITIONS)} AS competition, {picked('event_id // 10', SPORTS)} AS sport FROM events),
  z AS (SELECT event_id, ts, CASE competition WHEN 'England: Premier League' THEN 'Europe/London' WHEN 'UEFA champions league' THEN 'Europe/London' WHEN 'NZ NBL Showdown' THEN 'Pacific/Auckland' WHEN 'Wnba Finals' THEN 'America/New_York'
      WHEN 'J. League 2' THEN 'Asia/Tokyo' WHEN 'Big Bash T20' THEN 'Australia/Sydney' WHEN 'Serie A Femminile' THEN 'Europe/Rome' WHEN 'FIBA Cup' THEN 'Europe/Geneva'
      ELSE CASE sport WHEN 'Soccer' THEN 'Europe/London' WHEN 'Cricket' THEN 'Asia/Kolkata' WHEN 'Tennis' THEN 'UTC' WHEN 'Chess' THEN 'UTC' ELSE 'America/New_York' END END AS zone FROM q)
  SELECT event_id, zone, CAST(timezone(CASE zone WHEN 'Europe/Geneva' THEN 'Europe/Zurich' ELSE zone END, to_timestamp(floor(epoch(ts)))) AS DATE) AS local_date FROM z""")
def F39_competition_zone(t: Tables) -> DataFrame:
    own = t.events.withColumn("tenth", F.floor(F.col("event_id") / 10)).select("event_id", "ts", domain.competition_zone(pick("event_id", _COMPETITIONS), pick("tenth", SPORTS)).alias("zone"))
    return own.select("event_id", "zone", domain.local_date(F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("zone")).alias("local_date"))


@query("""SELECT event_id, CASE WHEN m > e THEN e || '+' || (m - e) || '''' ELSE m || '''' END AS minute FROM (SELECT event_id, e, greatest(s + 1, s + s2) AS m FROM
  (SELECT event_id, p.s, p.e, CAST(event_id * 37 % 4200 // 60 AS INT) AS s2 FROM events LEFT JOIN (VALUES (0, 0, 45), (1, 45, 90), (3, 90, 105), (4, 105, 120)) p(k, s, e) ON p.k = event_id % 6))""")
def F45_soccer_minute(t: Tables) -> DataFrame:
    from skein.plans.derived import STAGES

    return t.events.select("event_id", domain.soccer_minute(pick("event_id", STAGES), F.col("event_id") * 37 % 4200).alias("minute"))


_COUNTRIES = (" Germany ", "UAE", "Great Britain", "Atlantis", "south korea", "", None, "Czechia")


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'DEU' WHEN 1 THEN 'UAE' WHEN 2 THEN 'GBR' WHEN 4 THEN 'KOR' WHEN 7 THEN 'CZE' END AS iso FROM part")
def F59_country_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", domain.iso3(pick("p_partkey", _COUNTRIES)).alias("iso"))


_STAGE_NAMES = ("Main", "Group A", "Play Offs", "Quarter-finals", "Qualifying round", "Preliminary", "Knockout stage", "League phase", "", "Clausura", "Round of 16", "Regular Season", "Play In")


@query(f"""SELECT p_partkey, CASE WHEN s IN ('Main', 'Group A', 'League phase', 'Regular Season') THEN 100 WHEN s IN ('Play Offs', 'Quarter-finals', 'Knockout stage', 'Round of 16', 'Play In') THEN 5 WHEN s IN ('Qualifying round', 'Preliminary') THEN 15 WHEN s = '' THEN 25 ELSE 50 END AS roster,
  CASE WHEN s IN ('Quarter-finals', 'Knockout stage', 'Round of 16') THEN 50 WHEN s IN ('Group A', 'League phase') THEN 40 WHEN s = 'Play Offs' THEN 35 WHEN s IN ('Qualifying round', 'Preliminary') THEN 10 ELSE 25 END AS bracket
  FROM (SELECT p_partkey, {picked('p_partkey', _STAGE_NAMES)} AS s FROM part)""")
def F60_stage_ranks(t: Tables) -> DataFrame:
    name = pick("p_partkey", _STAGE_NAMES)
    return t.part.select("p_partkey", domain.roster_stage_rank(name).alias("roster"), domain.bracket_stage_rank(name).alias("bracket"))


# ---- markets

_TIES = "('tie', 'draw', 'no winner', 'no result')"


@query(f"""WITH {FEED}, o AS (SELECT rec, HOME_NAME AS home, AWAY_NAME AS away, unnest([HOME_NAME || ' win', AWAY_NAME, 'Tie', 'someone']) AS label, unnest([1, 2, 3, 4]) AS n FROM feed),
  s AS (SELECT rec, n, lower(label) IN {_TIES} AS tie, len(list_intersect(list_filter(string_split(lower(label), ' '), lambda x: length(x) >= 3), list_filter(string_split(home, ' '), lambda x: length(x) >= 3))) AS h,
    len(list_intersect(list_filter(string_split(lower(label), ' '), lambda x: length(x) >= 3), list_filter(string_split(away, ' '), lambda x: length(x) >= 3))) AS a FROM o)
  SELECT rec, n, CASE WHEN tie THEN 'tie' WHEN h > a THEN 'home' WHEN a > h THEN 'away' END AS side FROM s""")
def J66_outcome_sides(t: Tables) -> DataFrame:
    labels = F.array(F.concat("HOME_NAME", F.lit(" win")), F.col("AWAY_NAME"), F.lit("Tie"), F.lit("someone"))
    each = feed(t).select("rec", "HOME_NAME", "AWAY_NAME", F.posexplode(labels).alias("n", "label"))
    return each.select("rec", (F.col("n") + 1).alias("n"), feeds.label_side(F.col("label"), F.array("HOME_NAME"), F.array("AWAY_NAME")).alias("side"))


@query(f"""WITH {FEED}, o AS (SELECT rec, HOME_NAME AS home, AWAY_NAME AS away, unnest([HOME_NAME || ' win', AWAY_NAME, 'Draw']) AS label, 'fixture:' || lower(sport) || ':' || CAST(o_orderdate AS DATE) || ':' || {_SLUG.format('HOME_NAME')} || '-vs-' || {_SLUG.format('AWAY_NAME')} AS fx FROM feed WHERE AWAY_NAME <> ''),
  s AS (SELECT rec, label, 'market:' || substr(fx, 9) || ':winner' AS market, lower(label) IN {_TIES} AS tie, len(list_intersect(list_filter(string_split(lower(label), ' '), lambda x: length(x) >= 3), list_filter(string_split(home, ' '), lambda x: length(x) >= 3))) AS h,
    len(list_intersect(list_filter(string_split(lower(label), ' '), lambda x: length(x) >= 3), list_filter(string_split(away, ' '), lambda x: length(x) >= 3))) AS a FROM o),
  x AS (SELECT rec, label, market, CASE WHEN tie THEN 'tie' WHEN h > a THEN 'home' WHEN a > h THEN 'away' END AS side FROM s)
  SELECT rec, label, market, side, 'outcome:' || market || ':' || side AS outcome FROM x WHERE side IS NOT NULL""")
def F34_market_layer(t: Tables) -> DataFrame:
    """Markets and outcomes of winner records; labels that tell no side give no outcome."""
    f = feed(t).filter("AWAY_NAME <> ''")
    fixture = domain.fixture_key(F.col("sport"), F.to_date("o_orderdate"), domain.slug(F.col("HOME_NAME")), domain.slug(F.col("AWAY_NAME")), F.lit(""))
    labels = F.array(F.concat("HOME_NAME", F.lit(" win")), F.col("AWAY_NAME"), F.lit("Draw"))
    records = f.select("rec", fixture.alias("fixture"), F.array("HOME_NAME").alias("home"), F.array("AWAY_NAME").alias("away"), labels.alias("labels"))
    return feeds.winner_layer(records).select("rec", "label", "market", "side", "outcome")


@query("""SELECT p.p_partkey, CASE WHEN bool_or(e.team <> p.p_size) THEN 'colliding' WHEN bool_or(e.team = p.p_size) THEN 'same_team' ELSE 'clean' END AS verdict
  FROM part p LEFT JOIN (SELECT p_name, p_size AS team FROM part WHERE p_partkey % 5 = 0 AND p_size NOT IN (3, 4, 5)) e ON e.p_name = p.p_name AND p.p_partkey % 3 = 0 GROUP BY p.p_partkey""")
def J52_collision_audit(t: Tables) -> DataFrame:
    """Proposals of names that others hold collide; teams that are to go (3, 4, 5) hold nothing any more."""
    proposed = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("alias"), F.col("p_size").alias("team"))
    existing = t.part.filter("p_partkey % 5 = 0").select(F.col("p_name").alias("alias"), F.col("p_size").alias("team"))
    return review.audit_aliases(proposed, existing, t.spark.createDataFrame([(3,), (4,), (5,)], "team int")).select(F.col("id").alias("p_partkey"), "verdict")


@query(f"""WITH {MARKETS} SELECT rec, base, ends_with(upper(series), 'GAME') AND length(series) > 4 OR ends_with(upper(series), 'MATCH') AND length(series) > 5 AS winner FROM
  (SELECT rec, series, regexp_replace(upper(series), '^(.+?)(SPREAD|TOTAL|MATCH|GAME|1H|F5)$', '\\1') AS base FROM market)""")
def P36_winner_markets(t: Tables) -> DataFrame:
    s = grammar.split_suffix(F.col("series"))
    return markets(t).select("rec", s.alias("s")).select("rec", "s.base", F.col("s.suffix").isin("GAME", "MATCH").alias("winner"))


@query(f"WITH {MARKETS} SELECT rec, upper(series) LIKE 'KXJOIN%' AS outright FROM market")
def P35_outright_series(t: Tables) -> DataFrame:
    return markets(t).select("rec", grammar.is_outright(F.col("series")).alias("outright"))
