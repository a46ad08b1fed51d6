"""Keyed merges as whole new versions of a table; what the reference does in transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_hash(*columns: Column) -> Column:
    """SHA-256 of compact JSON with keys in the given (sorted) order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def classified_merge(previous: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """The next version, with ``action``: insert, update, unchanged or kept (not in the batch).

    A null key is a key like others, and equal digests, two nulls too, mean no change.
    """
    old = previous.withColumn("__was", F.lit(True))
    new = incoming.select(*[F.col(c).alias(f"_{c}") for c in incoming.columns], F.lit(True).alias("__is"))
    both = old.join(new, F.col(key).eqNullSafe(F.col(f"_{key}")), "full")
    action = F.when(F.col("__was").isNull(), "insert").when(F.col("__is").isNull(), "kept").when(F.col(digest).eqNullSafe(F.col(f"_{digest}")), "unchanged").otherwise("update")
    use_new = F.col("action").isin("insert", "update")
    return both.withColumn("action", action).select(*[F.when(use_new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in previous.columns], "action")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks, one for each key (the smallest row)."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else rows.select(*keys).distinct()
    return one.join(table.select(*keys), keys, "left_anti")


def update_where(table: DataFrame, changes: DataFrame, key: str, columns: list[str], allowed: Column) -> DataFrame:
    """``columns`` replaced by those of ``changes`` in rows where ``allowed`` holds."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    hit = allowed & F.col("_key").isNotNull()
    joined = table.join(new, F.col(key) == F.col("_key"), "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def merge_mapping(clusters: DataFrame, rows: DataFrame, id_: str, *order: Column) -> DataFrame:
    """Id, canonical: each cluster's first row in the given order stands for the others.

    ``clusters``: node, root.
    """
    from skein.operators.joins import latest

    members = clusters.join(rows, clusters["node"] == rows[id_])
    canonical = latest(members, ["root"], *order).select("root", F.col("node").alias("canonical"))
    return clusters.join(canonical, "root").select(F.col("node").alias(id_), "canonical")


def repoint(table: DataFrame, mapping: DataFrame, column: str, id_: str) -> DataFrame:
    """A foreign key moved to the canonical ids."""
    m = mapping.select(F.col(id_).alias("_id"), "canonical")
    return table.join(m, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("canonical", column)).drop("_id", "canonical")


def replace_partition(table: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Rows of the sources that ``rows`` has are replaced as a whole."""
    return table.join(rows.select(column).distinct(), column, "left_anti").unionByName(rows)


def unexpired(table: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that haven't expired."""
    return table.filter(F.col(expires) >= now)


def patch_maps(table: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """A shallow merge of map columns; the patch wins."""
    p = patches.select(F.col(key).alias("_key"), F.col(column).alias("_patch"))
    old, new = F.col(column), F.col("_patch")
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return table.join(p, F.col(key) == F.col("_key"), "left").withColumn(column, F.when(new.isNull(), old).when(old.isNull(), new).otherwise(merged)).drop("_key", "_patch")


def add_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (alias, team_id) with ``outcome``: present (the team has it), conflict (another one has), added.

    Equal wishes are one; of several teams that want a free alias at once the smallest gets it.
    """
    held = aliases.select("alias", "team_id").distinct()
    asked = wanted.select("alias", "team_id").distinct()
    first = asked.groupBy("alias").agg(F.min("team_id").alias("first"))
    taken = held.select("alias", F.lit(True).alias("taken")).distinct()
    both = asked.join(first, "alias").join(taken, "alias", "left").join(held.withColumn("own", F.lit(True)), ["alias", "team_id"], "left")
    free = F.col("taken").isNull()
    outcome = F.when(free & (F.col("team_id") == F.col("first")), "added").when(free, "conflict").when(F.col("own"), "present").otherwise("conflict")
    return both.select("alias", "team_id", outcome.alias("outcome"))


def expiring(rows: DataFrame, created: str, days: int = 30) -> DataFrame:
    """Rows with the time at which they expire."""
    return rows.withColumn("expires_at", F.col(created) + F.make_dt_interval(F.lit(days)))


def unreported(reports: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """New reports of days that have none yet."""
    return new.join(reports.select(day), day, "left_anti")


def chunks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with the number of the chunk of ``size`` in which they are written."""
    from skein.operators.joins import numbered

    return numbered(rows, key).withColumn("chunk", F.floor(F.col("number") / size)).drop("number")


def bootstrap(seeds: DataFrame, teams: DataFrame) -> DataFrame:
    """``seeds`` (name, country) with ``action``: SKIP (known with a country), BACKFILL (known without), INSERT.

    teams: name, country.  Names are compared as they are normalised by the caller.
    """
    known = teams.groupBy("name").agg(F.max("country").alias("known"), F.count("*").alias("n"))
    found = seeds.join(known, "name", "left")
    return found.withColumn("action", F.when(F.col("n").isNull(), "INSERT").when(F.col("known").isNull(), "BACKFILL").otherwise("SKIP")).drop("known", "n")

