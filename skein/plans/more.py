"""Further inventory rows over the harness tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.registry_rows import alias_priority, entity_versions
from skein.plans.registry import Tables, query


@query("SELECT c_custkey, count(o_orderkey) > 0 AS has_data FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def P26_has_data(t: Tables) -> DataFrame:
    nested = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    joined = t.customer.join(nested, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", (F.size(F.coalesce("keys", F.array().cast("array<bigint>"))) > 0).alias("has_data"))


@query("SELECT o_custkey, list_sort(list(o_orderkey))[1] AS anchor, list_sort(list(o_orderkey))[2:] AS candidates FROM orders GROUP BY o_custkey")
def P47_anchor_and_candidates(t: Tables) -> DataFrame:
    keys = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(keys.alias("k")).select("o_custkey", F.get("k", F.lit(0)).alias("anchor"), F.slice("k", F.lit(2), F.greatest(F.size("k") - 1, F.lit(0))).alias("candidates"))


@query("""SELECT w.name, count(n_nationkey) > 0 AS matched FROM (VALUES ('france'), ('GERMANY'), ('nation_3'), ('nowhere')) w(name) LEFT JOIN nation ON lower(n_name) = lower(w.name) GROUP BY w.name""")
def J56_case_insensitive_filter(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("france",), ("GERMANY",), ("nation_3",), ("nowhere",)], "name string")
    return wanted.join(t.nation, F.lower("n_name") == F.lower("name"), "left").groupBy("name").agg((F.count("n_nationkey") > 0).alias("matched"))


@query("""SELECT a.l_orderkey FROM (SELECT l_orderkey, min(l_partkey % 100) AS h, max(l_suppkey) AS w FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, max(l_suppkey) AS h, min(l_partkey % 100) AS w FROM lineitem GROUP BY 1) b ON a.l_orderkey = b.l_orderkey AND a.h = b.w AND a.w = b.h AND a.h <> a.w""")
def J59_inversions(t: Tables) -> DataFrame:
    sides = t.lineitem.groupBy("l_orderkey").agg(F.min(F.col("l_partkey") % 100).alias("h"), F.max("l_suppkey").alias("w"))
    other = sides.select("l_orderkey", F.col("w").alias("h2"), F.col("h").alias("w2"))
    return sides.join(other, "l_orderkey").filter("h = w2 and w = h2 and h <> w").select("l_orderkey")


@query("""SELECT p_name, CASE WHEN n = 1 AND o = 0 THEN 'single_alias' WHEN n = 1 THEN 'single_with_use' ELSE 'several' END AS dependency FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) LEFT JOIN (SELECT p_name AS k, count(*) AS o FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) ON k = p_name""")
def J60_single_alias_dependency(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_name").agg(F.count("*").alias("n"))
    o = t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_name").agg(F.count("*").alias("o"))
    kind = F.when((F.col("n") == 1) & (F.col("o") == 0), "single_alias").when(F.col("n") == 1, "single_with_use").otherwise("several")
    return n.join(o, "p_name", "left").select("p_name", kind.alias("dependency"))


@query("""SELECT l_orderkey, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing FROM (SELECT l_orderkey, list(DISTINCT l_partkey) AS a, list(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1) WHERE b IS NOT NULL""")
def J61_missing_side(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("b")).filter("size(b) > 0")
    return g.select("l_orderkey", F.array_sort(F.array_except("a", "b")).alias("missing"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY user_id")
def J71_pairing_maps(t: Tables) -> DataFrame:
    linked = t.events.join(t.orders, F.col("o_custkey") == F.col("user_id"), "left_semi")
    return linked.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("""SELECT n_nationkey, count(c_custkey) AS customers, count(c_custkey) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS linked FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def A40_league_pipeline_counts(t: Tables) -> DataFrame:
    used = t.orders.select(F.col("o_custkey").alias("used")).distinct()
    c = t.customer.join(used, F.col("used") == F.col("c_custkey"), "left")
    return t.nation.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"), F.count("used").alias("linked"))


@query("""SELECT user_id, count(*) FILTER (was IS NOT NULL AND was <> event_type) AS changes, count(*) AS probes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) GROUP BY user_id""")
def A58_probe_changes(t: Tables) -> DataFrame:
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.withColumn("was", was).groupBy("user_id").agg(F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("event_type"))).alias("changes"), F.count("*").alias("probes"))


@query("SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def U03_union_by_name(t: Tables) -> DataFrame:
    n = lambda d, s: d.agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), "n")
    return n(t.customer, "customer").unionByName(n(t.supplier, "supplier"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_has_all(['A', 'R'], list(DISTINCT l_returnflag))")
def U10_subset_test(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return s.filter(F.size(F.array_except("s", F.array(F.lit("A"), F.lit("R")))) == 0).select("l_orderkey")


@query("SELECT p_name, max_by(p_partkey, (p_size, -p_partkey)) AS target, count(*) AS claims FROM part GROUP BY p_name")
def F31_alias_registry(t: Tables) -> DataFrame:
    return alias_priority(t.part, "p_name", "p_partkey", F.col("p_size"), F.col("p_partkey"))


@query("""SELECT user_id, 1 + count(*) FILTER (was IS NOT NULL AND was <> event_type) AS version FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) GROUP BY user_id""")
def F32_entity_versions(t: Tables) -> DataFrame:
    return entity_versions(t.events, "user_id", "event_id", "event_type")


@query("SELECT o_orderkey, list(l_returnflag || ':' || l_quantity ORDER BY l_linenumber, l_returnflag, l_quantity) AS stats FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def F56_grouped_stats(t: Tables) -> DataFrame:
    row = F.struct("l_linenumber", "l_returnflag", "l_quantity")
    g = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select("o_orderkey", F.transform("r", lambda x: F.concat_ws(":", x["l_returnflag"], x["l_quantity"].cast("string"))).alias("stats"))


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) * 60 / (SELECT count(*) FROM nation) AS delay, CASE WHEN n_regionkey = 1 THEN 5 ELSE 30 END AS cadence FROM nation")
def F73_stagger(t: Tables) -> DataFrame:
    n = t.nation.agg(F.count("*").alias("n"))
    return t.nation.join(F.broadcast(n), F.lit(True)).select("n_nationkey", (F.col("n_nationkey").cast("double") * 60 / F.col("n")).alias("delay"), F.when(F.col("n_regionkey") == 1, 5).otherwise(30).alias("cadence"))


