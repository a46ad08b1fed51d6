"""§2.4 aggregations and §2.5 windows over the harness tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.prices import cohort_size, safe_rate
from skein.operators import joins, measures
from skein.plans.registry import Tables, query

def tier() -> Column:
    return F.when(F.col("event_type") == "purchase", "strict").when(F.col("event_type") == "signup", "alias").when(F.col("event_type") == "click", "fuzzy").otherwise("no_match")

_TIER = "CASE event_type WHEN 'purchase' THEN 'strict' WHEN 'signup' THEN 'alias' WHEN 'click' THEN 'fuzzy' ELSE 'no_match' END"
def day() -> Column:
    return F.to_date("ts").alias("day")

def cents() -> Column:
    return F.bround(F.col("value") * 100).cast("long")

_CENTS = "CAST(round_even(value * 100, 0) AS BIGINT)"
def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")

_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query(f"""SELECT user_id, count(*) AS n, count(*) FILTER (tier = 'strict') AS n_strict, count(*) FILTER (tier = 'alias') AS n_alias,
  count(*) FILTER (tier = 'fuzzy') AS n_fuzzy, count(*) FILTER (tier IN ('strict', 'alias', 'fuzzy')) / count(*) AS rate
  FROM (SELECT user_id, {_TIER} AS tier FROM events) GROUP BY user_id""")
def A01_tier_rates(t: Tables) -> DataFrame:
    return measures.tier_rates(t.events, "user_id", tier(), ["strict", "alias", "fuzzy"], ["strict", "alias", "fuzzy"])


@query(f"""SELECT event_type, count(*) AS depth, median({_CENTS}) AS median_cents, list_sort(list({_CENTS}))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS INT)] AS p95_cents,
  count(*) FILTER (ts < TIMESTAMP '2024-01-15') / count(*) AS abandoned FROM events GROUP BY event_type""")
def A02_queue_metrics(t: Tables) -> DataFrame:
    old = F.count_if(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    depth = t.events.groupBy("event_type").agg(F.count("*").alias("depth"), F.median(cents()).alias("median_cents"), safe_rate(old, F.count("*")).alias("abandoned"))
    return depth.join(measures.value_at_rank(t.events.select("event_type", cents().alias("p95_cents")), ["event_type"], "p95_cents", measures.nearest_place(0.95)), "event_type")


@query("SELECT coalesce(event_type, 'total') AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def A03_volume_with_total(t: Tables) -> DataFrame:
    return measures.volume_with_total(t.events, "event_type")


@query("""WITH b(bucket, lo, hi) AS (VALUES ('0.00-0.50', 0.0, 0.5), ('0.50-0.70', 0.5, 0.7), ('0.70-0.85', 0.7, 0.85), ('0.85-0.95', 0.85, 0.95), ('0.95-1.00', 0.95, 1.01)),
  s AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS s FROM events WHERE value IS NOT NULL)
  SELECT bucket, count(s) AS n FROM b LEFT JOIN s ON s >= lo::DOUBLE AND s < hi::DOUBLE GROUP BY bucket""")
def A04_confidence_histogram(t: Tables) -> DataFrame:
    return measures.histogram(t.events, F.col("value") / 100)


@query(f"SELECT user_id, list_sort(list({_CENTS}))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS INT)] AS p95 FROM events GROUP BY user_id")
def A05_nearest_rank(t: Tables) -> DataFrame:
    return measures.value_at_rank(t.events.select("user_id", cents().alias("p95")), ["user_id"], "p95", measures.nearest_place(0.95))


@query(f"SELECT user_id, list_sort(list({_CENTS}))[greatest(1, CAST(floor(count(*) * 0.95) AS INT))] AS p95 FROM events GROUP BY user_id")
def A06_run_latency_rank(t: Tables) -> DataFrame:
    return measures.value_at_rank(t.events.select("user_id", cents().alias("p95")), ["user_id"], "p95", measures.low_place(0.95))


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 0.0 ELSE count(*) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'F') END AS ratio FROM orders GROUP BY o_custkey")
def A07_safe_rate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(safe_rate(F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderstatus") == "F")).alias("ratio"))


_DIFF = """WITH old AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE event_id % 3 <> 0 AND user_id % 7 <> 0 GROUP BY user_id),
  new AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE event_id % 3 <> 1 AND user_id % 5 <> 0 GROUP BY user_id),
  b AS (SELECT user_id, CASE WHEN new.s IS NULL THEN 'legacy_only' WHEN old.s IS NULL THEN 'new_only' WHEN old.s = new.s THEN 'identical'
    WHEN list_has_all(old.s, new.s) THEN 'legacy_superset' WHEN list_has_all(new.s, old.s) THEN 'new_superset' ELSE 'mixed' END AS bucket FROM old FULL JOIN new USING (user_id))"""


def _diff(t: Tables) -> DataFrame:
    old = t.events.filter("event_id % 3 <> 0 and user_id % 7 <> 0")
    new = t.events.filter("event_id % 3 <> 1 and user_id % 5 <> 0")
    return measures.pairing_diff(old, new, "user_id", "event_type")


@query(f"{_DIFF} SELECT bucket, CASE WHEN user_id % 2 = 0 THEN 'cohort' ELSE 'rest' END AS cohort, count(*) AS n FROM b GROUP BY ALL")
def A08_pairing_diff_by_cohort(t: Tables) -> DataFrame:
    return _diff(t).groupBy("bucket", F.when(F.col("user_id") % 2 == 0, "cohort").otherwise("rest").alias("cohort")).agg(F.count("*").alias("n"))


@query(f"{_DIFF} SELECT bucket, count(*) AS n, list_sort(list(user_id))[1:30] AS samples FROM b GROUP BY bucket")
def A09_diff_sum_with_samples(t: Tables) -> DataFrame:
    first = joins.top(_diff(t), ["bucket"], 30, F.col("user_id"))
    counts = _diff(t).groupBy("bucket").agg(F.count("*").alias("n"))
    return counts.join(first.groupBy("bucket").agg(F.array_sort(F.collect_list("user_id")).alias("samples")), "bucket")


@query(f"{_DIFF} SELECT user_id, CASE WHEN bucket IN ('legacy_superset', 'new_superset') THEN 'mixed' ELSE bucket END AS bucket FROM b")
def A10_four_bucket_diff(t: Tables) -> DataFrame:
    return _diff(t).withColumn("bucket", F.when(F.col("bucket").endswith("superset"), "mixed").otherwise(F.col("bucket")))


@query(f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum({_K}) AS BIGINT) AS k_sum, sum({_K}) / nullif(count(*), 0) AS k_rate FROM events GROUP BY 1")
def A11_daily_rate(t: Tables) -> DataFrame:
    return t.events.groupBy(day()).agg(F.count("*").alias("n"), F.sum(k()).alias("k_sum"), F.try_divide(F.sum(k()), F.nullif(F.count("*"), F.lit(0))).alias("k_rate"))


@query(f"SELECT CAST(ts AS DATE) AS day, max({_CENTS}) AS max_cents, CAST(round_even(sum({_CENTS}) / count({_CENTS}), 0) AS BIGINT) AS avg_cents, count(*) AS n FROM events GROUP BY 1")
def A12_daily_latency(t: Tables) -> DataFrame:
    return t.events.groupBy(day()).agg(F.max(cents()).alias("max_cents"), F.bround(F.sum(cents()) / F.count(cents())).cast("long").alias("avg_cents"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3")
def A13_having(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3")


@query(f"SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events WHERE {_K} > 50")
def A14_scalar_on_json(t: Tables) -> DataFrame:
    return t.events.filter(k() > 50).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM events
  WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' GROUP BY event_type""")
def A15_seven_day_summary(t: Tables) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    week = t.events.filter((F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-17")))
    return week.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_ts"))


@query("""SELECT event_type, count(*) FILTER (value > 50) AS big, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type""")
def A16_filtered_and_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("big"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("most"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 4")
def A17_distinct_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).filter("n >= 4")


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY l_orderkey")
def A18_distinct_arrays(t: Tables) -> DataFrame:
    return measures.pairing_sets(t.lineitem, "l_orderkey", "l_suppkey", "suppliers")


@query("""SELECT p_brand, count(DISTINCT p_type) AS n_types, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def A19_claim_audit(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count_distinct("p_type").alias("n_types"), F.array_sort(F.collect_set("p_size")).alias("sizes")).filter("n_types > 1")


@query("SELECT DISTINCT coalesce(nullif(event_type, 'view'), 'other') AS kind, user_id % 10 AS shard FROM events")
def A20_distinct_coalesce(t: Tables) -> DataFrame:
    return t.events.select(F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("other")).alias("kind"), (F.col("user_id") % 10).alias("shard")).distinct()


@query(f"SELECT sum({_K}) / count({_K}) AS mean_k FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'")
def A21_trailing_mean(t: Tables) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.events.filter((F.col("event_type") == "click") & (F.col("ts") >= at("2024-01-10")) & (F.col("ts") < at("2024-01-17"))).agg((F.sum(k()) / F.count(k())).alias("mean_k"))


@query("SELECT depth, count(*) AS records FROM (SELECT o_custkey, count(*) AS depth FROM orders GROUP BY o_custkey) GROUP BY depth")
def A22_two_level(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("records"))


@query(f"SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum({_K}) AS BIGINT) AS k, CAST(sum(CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS even FROM events GROUP BY ALL")
def A23_json_counters(t: Tables) -> DataFrame:
    return t.events.groupBy(day(), "event_type").agg(F.sum(k()).alias("k"), F.sum(F.when(k() % 2 == 0, 1).otherwise(0)).alias("even"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 50")
def A24_top_fifty(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(50)


@query("""SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS with_order
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY n_nationkey""")
def A25_coverage(t: Tables) -> DataFrame:
    per = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("k"))
    joined = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"), F.count("o_custkey").alias("with_order"))


@query("SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT l_orderkey, l_returnflag, len(list(l_linenumber)) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def A26_array_lengths(t: Tables) -> DataFrame:
    packed = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.to_json(F.collect_list("l_linenumber")).alias("j"))
    return packed.groupBy("l_returnflag").agg(F.sum(F.json_array_length("j").cast("long")).alias("lines"))


@query("SELECT CASE WHEN value IS NULL THEN 'none' WHEN value < 20 THEN 'low' ELSE 'pass' END AS gate, count(*) AS n FROM events GROUP BY 1")
def A27_gate_distribution(t: Tables) -> DataFrame:
    gate = F.when(F.col("value").isNull(), "none").when(F.col("value") < 20, "low").otherwise("pass")
    return t.events.groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def A28_growth(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT 'orders' AS source, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders UNION ALL SELECT 'events', min(ts), max(ts) FROM events")
def A29_freshness(t: Tables) -> DataFrame:
    span = lambda d, n, c: d.agg(F.min(c).alias("first_ts"), F.max(c).alias("last_ts")).select(F.lit(n).alias("source"), "first_ts", "last_ts")
    return span(t.orders, "orders", "o_orderdate").unionByName(span(t.events, "events", "ts"))


@query("SELECT count(*) AS n, count(*) - count(value) AS null_values, count(DISTINCT user_id) AS users FROM events")
def A30_table_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("null_values"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, 100.0 * count(*) FILTER (value > 90) / count(*) AS pct FROM events GROUP BY event_type")
def A31_false_positive_pct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg((100.0 * F.count_if(F.col("value") > 90) / F.count("*")).alias("pct"))


@query("SELECT date_trunc('week', ts)::DATE AS week, count(*) FILTER (event_type = 'error') / count(*) AS rate, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def A32_weekly_rate(t: Tables) -> DataFrame:
    week = F.trunc("ts", "week").alias("week")
    return t.events.groupBy(week).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("rate"), F.count_distinct("user_id").alias("users"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id IN (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-05' AND event_type = 'error') GROUP BY event_type""")
def A33_effect_after(t: Tables) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    hit = t.events.filter((F.col("ts") < at("2024-01-05")) & (F.col("event_type") == "error")).select("user_id")
    return t.events.filter(F.col("ts") >= at("2024-01-15")).join(hit, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND p_size > 25")
def A34_attributable_count(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation.filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.lineitem.join(t.part.filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).agg(F.count("*").alias("n"))


@query("SELECT split_part(p_type, ' ', 1) AS series, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, series LIMIT 20")
def A35_top_series(t: Tables) -> DataFrame:
    return t.part.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("series")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "series").limit(20)


@query("SELECT user_id, event_type, count(*) AS n, max(value) AS best, list_sort(list(DISTINCT event_id))[1:3] AS examples FROM events GROUP BY ALL")
def A37_candidate_buckets(t: Tables) -> DataFrame:
    keys = ["user_id", "event_type"]
    three = joins.top(t.events.select(*keys, "event_id").distinct(), keys, 3, F.col("event_id")).groupBy(*keys).agg(F.array_sort(F.collect_list("event_id")).alias("examples"))
    return t.events.groupBy(*keys).agg(F.count("*").alias("n"), F.max("value").alias("best")).join(three, keys)


@query("""SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1, 2""")
def A38_unordered_pairs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("SELECT n_regionkey, list_sort(list(n_name)) AS nations FROM nation GROUP BY n_regionkey ORDER BY n_regionkey")
def A39_sorted_groups(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations")).orderBy("n_regionkey")


@query("""SELECT CASE WHEN value / 100 >= 0.85 THEN 'auto_apply' WHEN value / 100 >= 0.7 THEN 'review_queue' ELSE 'no_match' END AS bucket,
  CASE WHEN value / 100 - 0.2 >= 0.85 THEN 'auto_apply' WHEN value / 100 - 0.2 >= 0.7 THEN 'review_queue' ELSE 'no_match' END AS counterfactual, count(*) AS n FROM events GROUP BY ALL""")
def A41_dry_run_buckets(t: Tables) -> DataFrame:
    from skein.functions.prices import band

    c = F.col("value") / 100
    return t.events.groupBy(band(c).alias("bucket"), band(c - 0.2).alias("counterfactual")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS keys, count(*) FILTER (n > 1) AS ambiguous FROM (SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name)")
def A43_alias_index_stats(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count_distinct("p_brand").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("ambiguous"))


@query("SELECT event_type, count(*) AS n, list_sort(list(event_id))[1:3] AS first3 FROM events GROUP BY event_type")
def A44_notification_summary(t: Tables) -> DataFrame:
    first = joins.top(t.events, ["event_type"], 3, F.col("event_id")).groupBy("event_type").agg(F.array_sort(F.collect_list("event_id")).alias("first3"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).join(first, "event_type")


@query(f"SELECT event_type, sum({_K} * n) / sum(n) AS weighted FROM (SELECT event_type, props, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def A47_weighted_average(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", "props").agg(F.count("*").alias("n"))
    return g.groupBy("event_type").agg((F.sum(k() * F.col("n")) / F.sum("n")).alias("weighted"))


@query("SELECT p_brand, 100.0 * count(*) FILTER (p_size <= 25) / count(*) AS pct FROM part GROUP BY p_brand")
def A49_coverage_pct(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg((100.0 * F.count_if(F.col("p_size") <= 25) / F.count("*")).alias("pct"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def A50_name_union(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).distinct()


@query("""SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events GROUP BY user_id""")
def A51_ordered_dedupe(t: Tables) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "event_id"))), lambda e: e["event_type"])
    return t.events.groupBy("user_id").agg(F.array_distinct(rows).alias("kinds"))


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def A52_side_breakdown(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return t.nation.select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0)


@query("SELECT unnest(string_split(p_name, ' ')) AS form, count(*) AS n FROM part GROUP BY 1")
def A54_reference_index(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
  SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM d""")
def W01_lag_delta(t: Tables) -> DataFrame:
    d = t.events.groupBy("event_type", day()).agg(F.count("*").alias("n"))
    return d.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day")))


@query("SELECT user_id, event_type, count(*) AS n, CAST(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS pct FROM events GROUP BY user_id, event_type")
def W02_share_of_group(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))


@query("SELECT event_type, count(*) AS n, CAST(100.0 * count(*) / sum(count(*)) OVER () AS DOUBLE) AS pct FROM events GROUP BY event_type")
def W03_share_of_total(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, ts FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def W04_latest_per_key(t: Tables) -> DataFrame:
    return joins.latest(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc())


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, event_id DESC")
def W05_latest_by_id(t: Tables) -> DataFrame:
    return joins.latest(t.events.select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id").desc())


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def W06_earliest_per_key(t: Tables) -> DataFrame:
    return joins.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def W07_pagination(t: Tables) -> DataFrame:
    page = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50)
    return page.join(F.broadcast(t.orders.agg(F.count("*").alias("total"))), F.lit(True))


@query("SELECT event_id, value, ts FROM events WHERE event_type = 'error' ORDER BY value DESC, ts, event_id LIMIT 1")
def W08_next_pending(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").select("event_id", "value", "ts").orderBy(F.col("value").desc(), "ts", "event_id").limit(1)


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 7) GROUP BY event_type")
def W09_latest_runs(t: Tables) -> DataFrame:
    days = t.events.select(day()).distinct().orderBy(F.col("day").desc()).limit(7)
    return t.events.withColumn("day", F.to_date("ts")).join(days, "day", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, c_name FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) e LEFT JOIN customer ON c_custkey = user_id")
def W10_newest_sample(t: Tables) -> DataFrame:
    newest = t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)
    return newest.join(t.customer, F.col("c_custkey") == F.col("user_id"), "left").select("event_id", "c_name")


@query("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 100")
def W11_multi_key_sort(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size", "p_name").orderBy(F.col("p_size").desc(), "p_name", "p_partkey").limit(100)


@query("SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM part ORDER BY p_brand, p_size, p_retailprice DESC, length(p_name) DESC, p_partkey")
def W12_canonical_pick(t: Tables) -> DataFrame:
    return joins.latest(t.part, ["p_brand"], F.col("p_size"), F.col("p_retailprice").desc(), F.length("p_name").desc(), F.col("p_partkey")).select("p_brand", "p_partkey")


@query("SELECT o_custkey, list_sort(list(o_orderkey))[1:5] AS page, count(*) AS total, count(*) > 5 AS has_more FROM orders GROUP BY o_custkey")
def W13_slice_with_total(t: Tables) -> DataFrame:
    keys = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.slice(keys, 1, 5).alias("page"), F.count("*").alias("total"), (F.count("*") > 5).alias("has_more"))


@query("SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 30")
def W14_hash_cohort(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(30)


@query("SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= 30")
def W15_examples_per_bucket(t: Tables) -> DataFrame:
    return joins.top(t.events.select("event_type", "event_id"), ["event_type"], 30, F.col("event_id"))


@query("SELECT event_id FROM events ORDER BY (event_type = 'error'), value DESC, event_id LIMIT 25")
def W16_expression_order(t: Tables) -> DataFrame:
    return t.events.orderBy(F.col("event_type") == "error", F.col("value").desc(), "event_id").limit(25).select("event_id")


@query("SELECT l_orderkey, list_reverse(list_sort(list(l_linenumber))) AS rounds FROM lineitem GROUP BY l_orderkey")
def W17_rounds_descending(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber"), asc=False).alias("rounds"))


@query("""SELECT user_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'first ' || event_type ELSE 'later' END AS role FROM events""")
def W18_first_match_roles(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return t.events.select("user_id", "event_id", F.when(n == 1, F.concat(F.lit("first "), "event_type")).otherwise("later").alias("role"))


@query("SELECT DISTINCT ON (p_name) p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def W19_dedupe_keep_first(t: Tables) -> DataFrame:
    return joins.latest(t.part.select("p_name", "p_partkey"), ["p_name"], F.col("p_partkey"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def W20_last_row_per_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("""SELECT least(greatest(CAST(round_even(n * 12 / 100, 0) AS BIGINT), 20), n) AS size FROM (SELECT count(*) AS n FROM customer)""")
def F61_cohort_size(t: Tables) -> DataFrame:
    return t.customer.agg(F.count("*").alias("n")).select(cohort_size(F.col("n"), 12, 20).alias("size"))
