"""What keeps a deployment in order, as operations on tables: guards, configuration, holders of locks, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.joins import latest


def endpoint_guard(url: Column, database: Column, expected_name: Column, expected_host: Column, allowed: Column) -> Column:
    """struct(code, message): 0 where a job may run, 3 and why where it may not; an override comes first."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    host = F.regexp_extract(url, r"^[a-z+]+://(?:[^@/]*@)?([^:/?]+)", 1)
    why = (
        F.when(F.coalesce(allowed, F.lit(False)), "bypassed").when(none(expected_name) | none(expected_host), "expectations not set").when(none(url), "url not set")
        .when(~F.coalesce(database == expected_name, F.lit(False)), "other database").when(~F.contains(host, expected_host), "other host").otherwise("ok")
    )
    return F.struct(F.when(why.isin("bypassed", "ok"), 0).otherwise(3).alias("code"), why.alias("message"))


def connection(url: Column) -> Column:
    """struct(url, ssl): the asynchronous driver's scheme, without the parameters that it does not know; hosts of two providers ask for encryption by themselves."""
    scheme = F.regexp_replace(F.coalesce(url, F.lit("")), "^postgres(ql)?://", "postgresql+asyncpg://")
    mode = F.nullif(F.regexp_extract(scheme, r"[?&]sslmode=([^&]*)", 1), F.lit(""))
    asks = scheme.rlike(r"^[^?]*@[^/?]*(neon\.tech|supabase\.co)")
    bare = F.regexp_replace(F.regexp_replace(scheme, r"([?&])(?:sslmode|channel_binding)=[^&]*", "$1"), r"([?&])&+", "$1")
    clean = F.regexp_replace(F.regexp_replace(bare, r"\?&+", "?"), "[?&]+$", "")
    return F.struct(clean.alias("url"), F.when(mode == "disable", None).when(mode.isNotNull(), mode).when(asks, "require").alias("ssl"))


def configured(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value, source of each default: the newest setting of its key (columns key, value, at), else the default's own."""
    newest = latest(settings, ["key"], F.col("at").desc()).select("key", F.col("value").alias("_set"))
    joined = defaults.join(newest, "key", "left")
    return joined.select("key", F.coalesce("_set", "value").alias("value"), F.when(F.col("_set").isNull(), "fallback").otherwise("database").alias("source"))


def ensure_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; an empty one is made where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def holders(beats: DataFrame, lock: str, holder: str, at: str, now: Column, seconds: int) -> DataFrame:
    """The holder of each lock: of those that gave a sign of life within the time, the smallest."""
    alive = beats.groupBy(lock, holder).agg(F.max(at).alias("seen")).filter(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("seen").cast("timestamp")) <= seconds)
    return alive.groupBy(lock).agg(F.min(holder).alias(holder))


def orphans(locks: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Locks whose session is gone."""
    return locks.join(sessions.select(key).distinct(), key, "left_anti")


def guarded(work: DataFrame, held: DataFrame, lock: str, holder: str) -> DataFrame:
    """Rows of work that their lock's holder does."""
    return work.join(held, [lock, holder], "left_semi")


def gated(writes: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Of a key's writes the first in each span of time (whole spans, counted from the epoch)."""
    return latest(writes.withColumn("_span", F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / seconds)), [key, "_span"], F.col(at)).drop("_span")
