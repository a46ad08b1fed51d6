"""Keyed tables that streams write: hash-gated upserts, committed together, each batch once.

A table lies in buckets by the hash of its key.  A batch reads keys and digests of the buckets it touches,
rewrites those alone in which a row changed, and then writes one manifest that names the files of all tables:
before it nothing has changed, after it everything has.  The manifest has the batch's number, so a batch that
comes again changes nothing.  Files that no manifest of interest names are removed by ``vacuum``.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.mutations import payload_hash
from skein.operators.storage import shared_path, stored

#: Fixed value: seconds for which an unchanged row's ``seen`` may be behind.
BUMP_AFTER = 3600
#: Counts of batches that a manifest keeps, the newest.
KEPT = 1000


@dataclass
class Table:
    """keys; schema: all columns, with ``seen`` and ``changed`` (timestamps) and ``digest``."""

    keys: list[str]
    schema: str


@dataclass
class Incoming:
    """A batch's rows of one table: what ``fields`` a row has; of rows with one key the last by ``seq`` counts."""

    rows: DataFrame
    fields: list[str]
    seq: str


class KeyedStore:
    def __init__(self, spark: SparkSession, tables: dict[str, Table], folder: str | None = None, buckets: int = 64):
        self.spark, self.tables, self.buckets = spark, tables, buckets
        self.folder = folder or shared_path(spark, "keyed")
        self.schemas = {n: spark.createDataFrame([], x.schema).schema for n, x in tables.items()}

    # -- the manifest

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._files()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """Of the version that counts: its number, the batch that made it, files by table and bucket, and counts of all batches' actions."""
        versions = self._versions()
        if not versions:
            return {"version": -1, "batch": -1, "tables": {n: {} for n in self.tables}, "history": []}
        text = self.spark.read.text(f"{self.folder}/versions/{versions[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        path, fs = self._files()
        at = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(path, n)
        own, final = at(f".{uuid.uuid4().hex}"), at(f"{manifest['version']}.json")
        out = fs.create(own)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(final) or not fs.rename(own, final):
            fs.delete(own, False)
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    # -- reading

    def _read(self, manifest: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        files = [f for b, f in manifest["tables"][name].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schemas[name]).parquet(*files) if files else self.spark.createDataFrame([], self.schemas[name])

    def read(self, name: str) -> DataFrame:
        """The table as the last commit left it."""
        return self._read(self.manifest(), name)

    def history(self) -> DataFrame:
        """batch, table, action, n: what each batch did."""
        return self.spark.createDataFrame([tuple(h) for h in self.manifest()["history"]], "batch long, table string, action string, n long")

    # -- writing

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(self.tables[name].keys[0]), F.lit(self.buckets)).cast("int")

    def _classified(self, before: dict, name: str, new: Incoming, now: datetime.datetime, bump_after: int) -> DataFrame:
        """The last row of each key with its bucket, digest and action; of the table only keys, digests and times are read."""
        keys = self.tables[name].keys
        row = F.max_by(F.struct(*new.fields), F.struct(F.col(new.seq))).alias("_row")
        last = new.rows.groupBy(*keys).agg(row).select(*keys, "_row.*").withColumns({"digest": payload_hash(*map(F.col, sorted(new.fields))), "bucket": self._bucket(name)})
        last = stored(last, f"{name}-batch")
        touched = [r[0] for r in last.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._read(before, name, touched).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("digest").alias("_digest"), F.col("seen").alias("_seen"), F.lit(True).alias("_had"))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        stale = F.unix_micros("_seen") < F.unix_micros(F.lit(now)) - bump_after * 1_000_000
        action = F.when(F.col("_had").isNull(), "insert").when(~F.col("digest").eqNullSafe(F.col("_digest")), "update").when(stale, "bumped").otherwise("unchanged")
        found = last.join(old, same, "left").select(*last.columns, action.alias("action"))
        return stored(found, f"{name}-actions")

    def _next(self, before: dict, name: str, acts: DataFrame, fields: list[str], now: datetime.datetime) -> tuple[DataFrame, list[int]]:
        """New rows of the buckets that change."""
        keys = self.tables[name].keys
        dirty = [r[0] for r in acts.filter("action <> 'unchanged'").select("bucket").distinct().collect()]
        hit = acts.filter(F.col("action").isin("update", "bumped")).select(*[F.col(c).alias(f"_{c}") for c in [*keys, *fields, "digest", "action"]])
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        updated, at = F.coalesce(F.col("_action") == "update", F.lit(False)), F.lit(now)
        old = self._read(before, name, dirty).join(hit, same, "left")
        changes = {c: F.when(updated, F.col(f"_{c}")).otherwise(F.col(c)) for c in [*fields, "digest"]}
        changes |= {"changed": F.when(updated, at).otherwise(F.col("changed")), "seen": F.when(F.col("_action").isNotNull(), at).otherwise(F.col("seen"))}
        old = old.withColumns(changes).select(*self.schemas[name].names)
        added = acts.filter("action = 'insert'").withColumns({"seen": at, "changed": at}).select(*self.schemas[name].names)
        return old.unionByName(added).withColumn("bucket", self._bucket(name)), dirty

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by bucket; of a large bucket (adaptive execution) several tasks get a part each, and small ones share a task."""
        return rows.hint("rebalance", F.col("bucket"))

    def upsert(self, batch: int, now: datetime.datetime, changes: dict[str, Incoming], bump_after: int = BUMP_AFTER) -> DataFrame:
        """Writes a batch's rows into their tables, all or none; gives batch, table, action, n. A batch that was committed before does nothing."""
        before = self.manifest()
        if before["batch"] < batch:
            after = {"version": before["version"] + 1, "batch": batch, "tables": {n: dict(f) for n, f in before["tables"].items()}, "history": list(before["history"])}
            for name, new in changes.items():
                acts = self._classified(before, name, new, now, bump_after)
                after["history"] += [[batch, name, r["action"], r["count"]] for r in acts.groupBy("action").count().collect()]
                rows, dirty = self._next(before, name, acts, new.fields, now)
                if dirty:
                    path = f"{self.folder}/{name}/{after['version']}-{uuid.uuid4().hex}"
                    self.dealt(rows).write.partitionBy("bucket").parquet(path)
                    after["tables"][name] |= {str(b): f"{path}/bucket={b}" for b in dirty}
            after["history"] = after["history"][-KEPT:]
            self._commit(after)
        return self.history().filter(F.col("batch") == batch)

    def vacuum(self) -> int:
        """Deletes files that the last version does not name; gives how many folders went. No reader may hold an older version."""
        now, (path, fs) = self.manifest(), self._files()
        at = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        named, gone = {at(f).toUri().getPath() for files in now["tables"].values() for f in files.values()}, 0
        for name in self.tables:
            if fs.exists(at(f"{self.folder}/{name}")):
                for version in fs.listStatus(at(f"{self.folder}/{name}")):
                    for bucket in fs.listStatus(version.getPath()):
                        if bucket.isDirectory() and bucket.getPath().toUri().getPath() not in named:
                            gone += bool(fs.delete(bucket.getPath(), True))
        for v in self._versions()[:-1]:
            fs.delete(at(f"{self.folder}/versions/{v}.json"), False)
        return gone


def events_and_outcomes(spark: SparkSession, event: str, outcome: str, folder: str | None = None, buckets: int = 8) -> KeyedStore:
    """A store of events and of their outcomes, both in buckets by event (``game``)."""
    rest = "seen timestamp, changed timestamp, digest string"
    named = T._parse_datatype_string(outcome).names[0]
    return KeyedStore(spark, {"events": Table(["game"], f"game long, {event}, {rest}"), "outcomes": Table(["game", named], f"game long, {outcome}, {rest}")}, folder, buckets)


def upsert_events(store: KeyedStore, batch: int, now: datetime.datetime, records: DataFrame, fields: list[str], outcome_keys: list[str], outcome_fields: list[str]) -> DataFrame:
    """Records (game, ``fields``, outcomes: an array of structs) into both tables of a store, all or none; of equal outcomes the last counts."""
    records = stored(records.select("game", *fields, "outcomes"), "records")
    outcomes = records.select("game", F.posexplode("outcomes").alias("place", "o")).select("game", "place", *[F.col(f"o.{c}").alias(c) for c in [*outcome_keys, *outcome_fields]])
    whole = {"events": Incoming(records.select("game", *fields), fields, "game"), "outcomes": Incoming(outcomes, outcome_fields, "place")}
    return store.upsert(batch, now, whole)
