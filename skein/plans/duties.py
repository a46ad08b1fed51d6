"""Guards, configuration and locks over harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import duties
from skein.operators.storage import shared_path
from skein.plans.derived import pick, picked
from skein.plans.registry import Tables, query

_URLS = ("postgres://u:p@db.neon.tech/x?sslmode=require&channel_binding=require", "postgresql://u@h:5/x?a=1&sslmode=disable", "postgresql://u@a.supabase.com/x", "postgresql+asyncpg://u@h/x?a=1", "", None)
_CLEAN = ("postgresql+asyncpg://u:p@db.neon.tech/x", "postgresql+asyncpg://u@h:5/x?a=1", "postgresql+asyncpg://u@a.supabase.com/x", "postgresql+asyncpg://u@h/x?a=1", "", "")


@query(f"SELECT event_id, {picked('event_id', _CLEAN)} AS url, {picked('event_id', ('require', None, 'require', None, None, None))} AS ssl FROM events")
def F75_connection_urls(t: Tables) -> DataFrame:
    return t.events.select("event_id", duties.connection(pick("event_id", _URLS)).alias("c")).select("event_id", "c.*")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 6 = 3 THEN 0 ELSE 3 END AS code, CASE WHEN event_id % 7 = 0 THEN 'bypassed' WHEN event_id % 6 = 0 THEN 'expectations not set' WHEN event_id % 6 = 1 THEN 'url not set' WHEN event_id % 6 = 2 THEN 'other database' WHEN event_id % 6 = 3 THEN 'ok' ELSE 'other host' END AS message FROM events")
def P39_endpoint_guard(t: Tables) -> DataFrame:
    r = F.col("event_id") % 6
    g = duties.endpoint_guard(F.when(r == 1, "").when(r == 3, "postgresql://u@ep-one.host/x").otherwise("postgresql://u@elsewhere/x"), F.when(r == 2, "test").otherwise("prod"), F.lit("prod"), F.when(r == 0, "").otherwise("ep-one"), F.col("event_id") % 7 == 0)
    return t.events.select("event_id", g.alias("g")).select("event_id", "g.*")


@query("SELECT c_custkey AS key, coalesce(v, 'd') AS value, CASE WHEN v IS NULL THEN 'fallback' ELSE 'database' END AS source FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def F81_config_fallback(t: Tables) -> DataFrame:
    settings = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("at"))
    return duties.configured(settings, t.customer.select(F.col("c_custkey").alias("key"), F.lit("d").alias("value")))


@query("SELECT 0 AS before, count(*) AS after FROM events")
def K21_create_if_missing(t: Tables) -> DataFrame:
    """A table is made once; what was appended since is still there when it is asked for again."""
    path, schema = shared_path(t.spark, "ensured"), "event_id long, event_type string"
    before = duties.ensure_table(t.spark, path, schema).agg(F.count("*").cast("int").alias("before"))
    empty = before.first()["before"]
    t.events.select("event_id", "event_type").write.mode("append").parquet(path)
    return duties.ensure_table(t.spark, path, schema).agg(F.lit(empty).alias("before"), F.count("*").alias("after"))


_ALIVE = "SELECT event_type, user_id FROM events GROUP BY ALL HAVING epoch(TIMESTAMP '2024-01-31')::BIGINT - epoch(date_trunc('second', max(ts)))::BIGINT <= 259200"


@query(f"SELECT event_type, min(user_id) AS user_id FROM ({_ALIVE}) GROUP BY 1")
def T19_lock_holders(t: Tables) -> DataFrame:
    return duties.holders(t.events, "event_type", "user_id", "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 259200)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def T20_orphan_locks(t: Tables) -> DataFrame:
    return duties.orphans(t.orders.select("o_orderkey", "o_custkey"), t.events.filter("event_type = 'signup'").select(F.col("user_id").alias("o_custkey")), "o_custkey")


@query(f"SELECT event_id FROM events JOIN (SELECT event_type, min(user_id) AS user_id FROM ({_ALIVE}) GROUP BY 1) USING (event_type, user_id)")
def T27_guarded_loops(t: Tables) -> DataFrame:
    return duties.guarded(t.events, T19_lock_holders(t.spark, t.folder), "event_type", "user_id").select("event_id")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch(date_trunc('second', ts))::BIGINT // 21600 ORDER BY ts) = 1")
def T21_save_gates(t: Tables) -> DataFrame:
    return duties.gated(t.events, "user_id", "ts", 21600).select("event_id")
