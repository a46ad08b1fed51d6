"""The flagship query: each user's latest event of a kind and the nearest view within a drift, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import joins
from skein.plans.registry import Tables, query


@query("""WITH l AS (SELECT DISTINCT ON (user_id, event_type) event_id AS l_id, user_id, event_type, ts AS l_ts FROM events WHERE event_type <> 'view' ORDER BY user_id, event_type, ts DESC, event_id DESC),
  v AS (SELECT event_id AS v_id, user_id, ts AS v_ts FROM events WHERE event_type = 'view'),
  n AS (SELECT l_id, event_type, l_ts, v_ts, row_number() OVER (PARTITION BY l_id ORDER BY abs(epoch_us(l_ts) - epoch_us(v_ts)), v_id) AS k FROM l JOIN v USING (user_id) WHERE abs(epoch_us(l_ts) - epoch_us(v_ts)) <= 21600000000)
  SELECT event_type, count(*) AS n, count(*) FILTER (v_ts <= l_ts) AS before, max(l_ts) AS last_ts FROM n WHERE k = 1 GROUP BY event_type""")
def flagship_nearest_view(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    last = joins.latest(e.filter("event_type <> 'view'"), ["user_id", "event_type"], F.col("ts").desc(), F.col("event_id").desc())
    last = last.select(F.col("event_id").alias("l_id"), "user_id", "event_type", F.col("ts").alias("l_ts"))
    views = e.filter("event_type = 'view'").select(F.col("event_id").alias("v_id"), "user_id", F.col("ts").alias("v_ts"))
    near = joins.nearest_within(last, views, ["user_id"], "l_id", "l_ts", "v_id", "v_ts", 21600)
    return near.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("v_ts") <= F.col("l_ts")).alias("before"), F.max("l_ts").alias("last_ts"))
