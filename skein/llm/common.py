"""What the operators of this subpackage share: shared storage, hashing of words, hot-key helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without that setting a local session gets a folder of its own; on a cluster, where a local
    folder is another one on each machine, it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (where or _OWN.setdefault(spark.sparkContext.applicationId, f"{tempfile.gettempdir()}/skein-{uuid.uuid4().hex}")).rstrip("/")


#: For local sessions without the setting: a folder for each application.
_OWN: dict[str, str] = {}
#: Tables that the innermost ``scratch`` made.
_SCOPES: list[list[tuple[DataFrame, str]]] = [[]]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Session settings (dots as double underscores) that hold inside."""
    named = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: a lost executor costs only the tasks it ran, and what partition
    ids or sampled ranges decided stays decided.  Nothing reads the shuffle files of the write
    again, so Spark removes them when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _SCOPES[-1].append((found, path))
    if len(_SCOPES) == 1:
        del _SCOPES[0][:-64]  # results stay for their readers; no more than the last are known
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables of ``store()`` that no later step reads."""
    for df in frames:
        for scope in _SCOPES:
            for at, (made, path) in enumerate(scope):
                if made is df:
                    _delete(df.sparkSession, path)
                    del scope[at]
                    break


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored inside are deleted at the end, but for those given to the function that this yields."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append([])
    try:
        yield keep
    finally:
        for made, path in _SCOPES.pop():
            if any(made is k for k in kept):
                _SCOPES[-1].append((made, path))
            else:
                _delete(spark, path)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m"):
    """Python tasks that run inside get batches of at most ``rows`` rows and some ``size``, which bounds their memory."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__execution__arrow__maxBytesPerBatch=size)


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, shares: int = 10_000) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, of which ``right`` has each once, with the rows that it has in ``left`` (``many``).

    Keys with a ten-thousandth of all ``total`` rows or more, of which there are ten thousand at
    most, are broadcast; the others are joined by a shuffle in which none of them is hot.
    """
    hot = right.filter(F.col("many") >= max(64, total // shares))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col("many") < max(64, total // shares)), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for each row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; a text that is all ASCII takes the fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of ``separators`` (inside of a character class); none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


#: Separators of the word classes that the contracts name.
SPACES = r"\x20\x09-\x0D"
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
