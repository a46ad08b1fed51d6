"""§2.7 scalar kernels over the harness tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import grammar, prices, text
from skein.functions.similarity import edit_ratio, token_set_ratio
from skein.operators import mutations
from skein.plans.registry import Tables, query


_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM} AS name FROM documents")
def F01_normalize_name(t: Tables) -> DataFrame:
    """Documents stand in for names."""
    return t.documents.select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@query("""SELECT p_partkey, list_filter(string_split(lower(p_name) || ' jr', ' '), lambda x: x NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS others FROM part""")
def F02_structural_team(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" (B) Jr"))
    return t.part.select("p_partkey", text.structural_name(name, F.lit("soccer"))["others"].alias("others"))


@query("""SELECT p_partkey, CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) = 2 AND length(w[2]) <= 2 THEN w[1] ELSE w[-1] END AS surname,
  CASE WHEN len(w) = 1 THEN 'personal_single' WHEN len(w) = 2 AND length(w[2]) <= 2 THEN 'personal_initial' WHEN len(w) = 2 THEN 'personal_two_token' ELSE 'personal_multi' END AS path
  FROM (SELECT p_partkey, string_split(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) || ' m' ELSE 'carlos ' || p_name END, ' ') AS w FROM part)""")
def F03_surname_rule(t: Tables) -> DataFrame:
    r = F.col("p_partkey") % 3
    name = F.when(r == 0, F.col("p_name")).when(r == 1, F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" M."))).otherwise(F.concat(F.lit("Carlos "), "p_name"))
    s = text.structural_name(name, F.lit("Tennis"))
    return t.part.select("p_partkey", s["surname"].alias("surname"), s["path"].alias("path"))


def series() -> Column:
    return F.concat(F.lit("KX"), F.upper(F.substring("p_type", 1, 3)), F.element_at(F.array(*map(F.lit, ("GAME", "TOTAL", "1H", "MAP", "", "WINS-WSH"))), (F.col("p_partkey") % 6 + 1).cast("int")))

_SERIES = "'KX' || upper(substr(p_type, 1, 3)) || ['GAME', 'TOTAL', '1H', 'MAP', '', 'WINS-WSH'][p_partkey % 6 + 1]"


@query(f"SELECT p_partkey, regexp_extract(s, '^(.+?)(GAME|TOTAL|1H|MAP)?$', 1) AS base, regexp_extract(s, '^(.+?)(GAME|TOTAL|1H|MAP)?$', 2) AS suffix FROM (SELECT p_partkey, {_SERIES} AS s FROM part)")
def F04_strip_suffix(t: Tables) -> DataFrame:
    s = grammar.split_suffix(series())
    return t.part.select("p_partkey", s["base"].alias("base"), s["suffix"].alias("suffix"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'per_fixture' WHEN 1 THEN 'per_fixture' WHEN 2 THEN 'per_leg' ELSE 'series' END AS kind,
  CASE WHEN o_orderkey % 4 < 3 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) END AS date,
  CASE WHEN o_orderkey % 4 = 1 THEN '1930' END AS time, CASE o_orderkey % 4 WHEN 3 THEN 'BOSNYK' ELSE 'ARSATM' END AS abbr_block,
  CASE WHEN o_orderkey % 4 = 2 THEN 2 END AS leg_n FROM orders""")
def F05_ticker_identity(t: Tables) -> DataFrame:
    day = F.upper(F.date_format("o_orderdate", "yyMMMdd"))
    r = F.col("o_orderkey") % 4
    suffix = F.when(r == 0, F.concat(day, F.lit("ARSATM"))).when(r == 1, F.concat(day, F.lit("1930ARSATM"))).when(r == 2, F.concat(day, F.lit("ARSATM-2"))).otherwise("26BOSNYKR1")
    i = grammar.identity(F.col("suffix"), F.lit(False))
    return t.orders.select("o_orderkey", suffix.alias("suffix")).select("o_orderkey", i.alias("i")).select("o_orderkey", "i.kind", "i.date", "i.time", "i.abbr_block", "i.leg_n")


@query(f"SELECT p_partkey, '26MAY07' || upper(replace(p_name, ' ', '')) AS rest FROM (SELECT p_partkey, {_SERIES} AS s, p_name FROM part)")
def F06_after_series(t: Tables) -> DataFrame:
    event = F.concat(series(), F.lit("-26MAY07"), F.replace("p_name", F.lit(" "), F.lit("")))
    return t.part.select("p_partkey", grammar.after_series(event, series()).alias("rest"))


@query(None)
def F07_edit_ratio(t: Tables) -> DataFrame:
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return t.part.join(other, "p_partkey").select("p_partkey", edit_ratio("p_name", "next").alias("ratio"))


@query(None)
def F08_token_set_ratio(t: Tables) -> DataFrame:
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return t.part.join(other, "p_partkey").select("p_partkey", token_set_ratio("p_name", "next").alias("ratio"))


@query("SELECT event_id, 0.20::DOUBLE + (value / 100 - 0.85::DOUBLE) / (1 - 0.85::DOUBLE) * 0.10::DOUBLE AS contribution FROM events")
def F09_linear_contribution(t: Tables) -> DataFrame:
    return t.events.select("event_id", prices.linear_contribution(F.col("value") / 100, 0.85).alias("contribution"))


_TRI = "list_distinct(flatten(list_transform(string_split({}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""SELECT p_partkey, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity
  FROM (SELECT p_partkey, {_TRI.format("p_name")} AS a, {_TRI.format("lower(p_type) || ' ' || p_name")} AS b FROM part)""")
def F10_trigram_similarity(t: Tables) -> DataFrame:
    a, b = text.trigrams(F.col("p_name")), text.trigrams(F.concat_ws(" ", "p_type", "p_name"))
    return t.part.select("p_partkey", text.jaccard(a, b).alias("similarity"))


@query("""SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score
  FROM (SELECT p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4)) AS a, list_distinct(list_filter(string_split(lower(p_type) || ' ' || p_name, ' '), lambda x: length(x) >= 4)) AS b FROM part)""")
def F11_title_overlap(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.jaccard(text.tokens(F.col("p_name"), 4), text.tokens(F.concat_ws(" ", "p_type", "p_name"), 4)).alias("score"))


@query("SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'small')) AS kept FROM part")
def F12_distinctive_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.distinctive(F.col("p_name"), ["red", "small"]).alias("kept"))


@query("SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS digest FROM events")
def F27_payload_hash(t: Tables) -> DataFrame:
    return t.events.select("event_id", mutations.payload_hash(F.col("event_type"), F.col("user_id")).alias("digest"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def F28_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("SELECT p_name, max_by(p_partkey, (p_size, -p_partkey)) AS p_partkey FROM part GROUP BY p_name")
def F30_method_priority(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("p_partkey"))


@query("""SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE p_name END AS home, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE p_type END AS away FROM part""")
def F36_title_parse(t: Tables) -> DataFrame:
    title = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, " vs ").otherwise(" at "), "p_name")
    s = grammar.parse_title(title)
    return t.part.select("p_partkey", s["home"].alias("home"), s["away"].alias("away"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS at FROM orders")
def F37_iso_to_epoch(t: Tables) -> DataFrame:
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.orders.select("o_orderkey", F.unix_timestamp(F.try_to_timestamp(iso)).alias("at"))


@query("SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events")
def F38_minutes_of_day(t: Tables) -> DataFrame:
    return t.events.select("event_id", grammar.minutes(F.date_format("ts", "HHmm")).cast("long").alias("m"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS INT) WHEN event_id % 3 = 1 THEN CAST(round_even(CAST(CAST(value AS VARCHAR) AS DOUBLE) * 100, 0) AS INT) END AS cents FROM events")
def F40_to_cents(t: Tables) -> DataFrame:
    r = F.col("event_id") % 3
    said = F.when(r == 0, F.col("event_id").cast("string")).when(r == 1, F.col("value").cast("decimal(18,6)").cast("string")).otherwise("n/a")
    return t.events.select("event_id", prices.to_cents(said).alias("cents"))


@query("""SELECT event_id, 100 - bid AS no_ask, CASE WHEN abs(100 - last - bid) < abs(last - bid) THEN 100 - last ELSE last END AS last_price
  FROM (SELECT event_id, CAST(user_id % 100 AS BIGINT) AS bid, CAST(event_id % 100 AS BIGINT) AS last FROM events)""")
def F41_tick_normalise(t: Tables) -> DataFrame:
    bid, last = F.col("user_id") % 100, F.col("event_id") % 100
    return t.events.select("event_id", prices.complement(F.lit(None).cast("long"), bid).alias("no_ask"), prices.yes_side(last, bid).alias("last_price"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 90) * 60 + 30 ELSE (event_id % 90) * 60 END AS seconds FROM events")
def F44_clock_seconds(t: Tables) -> DataFrame:
    m = (F.col("event_id") % 90).cast("string")
    return t.events.select("event_id", prices.clock_seconds(F.when(F.col("event_id") % 2 == 0, F.concat(m, F.lit(":30"))).otherwise(F.concat(m, F.lit("'")))).cast("long").alias("seconds"))


@query("SELECT p_partkey, split_part(p_brand || '-' || p_name, '-', 1) AS series FROM part")
def F63_series_of_ticker(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.substring_index(F.concat_ws("-", "p_brand", "p_name"), "-", 1).alias("series"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def F64_json_access(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, (epoch_us(ts) - 1704067200000000) // 1000000 AS since, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day FROM events")
def F65_epoch_and_trunc(t: Tables) -> DataFrame:
    since = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1_000_000).cast("long")
    return t.events.select("event_id", since.alias("since"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.to_date("ts").alias("day"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def F66_iso_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def F67_pair_order(t: Tables) -> DataFrame:
    return t.lineitem.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("SELECT o_orderkey, unnest(range(CAST(o_orderkey % 4 AS INT))) AS pos FROM orders")
def F68_json_array_elements(t: Tables) -> DataFrame:
    j = F.to_json(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("o_orderkey") % 4))
    return t.orders.select("o_orderkey", F.posexplode(F.from_json(j, "array<int>")).alias("pos", "v")).select("o_orderkey", F.col("pos").cast("long").alias("pos"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation")
def F69_json_build(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("j"))


@query("SELECT doc_id FROM documents WHERE strip_accents(lower(text)) LIKE '%eau%'")
def F70_accent_free_match(t: Tables) -> DataFrame:
    return t.documents.filter(F.contains(F.lower(text.fold_accents(F.col("text"))), F.lit("eau"))).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%gear'")
def F71_like_any(t: Tables) -> DataFrame:
    return t.part.filter("p_name LIKE ANY ('red%', '%gear')").select("p_partkey")


@query("SELECT o_orderkey, list_filter([md5(CAST(o_custkey AS VARCHAR)), 'x'], lambda x: regexp_full_match(x, '[0-9a-f]{32}')) AS ids FROM orders")
def F74_id_list_parse(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.filter(F.array(F.md5(F.col("o_custkey").cast("string")), F.lit("x")), lambda x: x.rlike("^[0-9a-f]{32}$")).alias("ids"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 31 THEN make_date(2026, 5, p_size) END AS d FROM part")
def F76_short_date(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", grammar.short_date(F.lit("26"), F.lit("MAY"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("d"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: length(x) >= 3))) AS t FROM part")
def F78_token_set(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_sort(text.tokens(F.concat_ws(" ", "p_name", "p_type"), 3)).alias("t"))
