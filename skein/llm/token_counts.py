"""Token counts from the exact histogram of encoded lengths.

Documents are aggregated by their encoded length; one row for each different length is
all that is kept of them.  Suffix sums over this histogram answer exactly, for every
context limit, how many documents exceed it and how many tokens remain after truncation,
and likewise totals and quantiles.

Defined cases: a null or empty text has no tokens, so only the end id (where one is
added); an empty table gives an empty histogram; repeated rows each count; equal lengths are
one row, so there are no ties; a very long text is encoded on its own, whole; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import small_batches, store
from skein.llm.tokens import chunks, encoder, tokenizer_path

#: Lengths of one block of the suffix sums; blocks are summed first.
BLOCK = 1024


def _lengths(kind: str, path: str, extra: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(kind, path)
        for b in batches:
            lengths = [e.encode(texts, counts_only=True)[2] + extra for _, texts in chunks(b.column(0))]
            length, n = np.unique(np.concatenate([np.zeros(0, np.int64), *lengths]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["length", "n_docs"])

    return counted


def histogram(docs: DataFrame, text: str = "text", kind: str = "byte", tokenizer: str | None = None, end_ids: int = 1) -> DataFrame:
    """length, n_docs: each different number of tokens (``end_ids`` included) and the documents that have it."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    each = docs.select(F.col(text).alias("text")).mapInArrow(_lengths(kind, path, end_ids), "length long, n_docs long")
    return each.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for the context limit ``length``, what suffix sums tell.

    n_longer: documents above the limit; tokens_upto: tokens of documents within it;
    tokens_kept: all tokens after truncation to it; n_upto: documents within it.
    """
    block = F.floor(F.col("length") / BLOCK).alias("block")
    h = hist.select("*", block, (F.col("length") * F.col("n_docs")).alias("tokens"))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("block", zero(F.sum("block_docs").over(after)).alias("docs_after"), zero(F.sum("block_docs").over(before)).alias("docs_before"), zero(F.sum("block_tokens").over(before)).alias("tokens_before"))
    within = Window.partitionBy("block").orderBy("length")
    above = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = h.join(sums, "block").select(
        "length",
        "n_docs",
        (zero(F.sum("n_docs").over(above)) + F.col("docs_after")).alias("n_longer"),
        (F.sum("n_docs").over(within) + F.col("docs_before")).alias("n_upto"),
        (F.sum("tokens").over(within) + F.col("tokens_before")).alias("tokens_upto"),
    )
    return found.withColumn("tokens_kept", F.col("tokens_upto") + F.col("length") * F.col("n_longer"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, tokens_kept: all tokens after truncation to each limit, of ``suffix_sums()``; null if empty."""
    found = lambda x: F.max(F.when(F.col("length") <= x, F.struct("length", "n_longer", "tokens_upto")))
    row = sums.agg(F.sum("n_docs").alias("n"), *[found(x).alias(f"at{i}") for i, x in enumerate(limits)])
    kept = [F.coalesce(F.col(f"at{i}.tokens_upto") + x * F.col(f"at{i}.n_longer"), x * F.col("n")) for i, x in enumerate(limits)]
    pairs = F.array(*[F.struct(F.lit(x).alias("limit"), k.alias("tokens_kept")) for x, k in zip(limits, kept, strict=True)])
    return row.select(F.inline(pairs))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, ``length``: the smallest length that at least the share ``q`` of all documents do not exceed; null if empty."""
    share = F.col("n_upto") / (F.col("n_upto") + F.col("n_longer"))
    return sums.filter(share >= q).agg(F.min("length").alias("length"))


def report(docs: DataFrame) -> DataFrame:
    """``suffix_sums`` of the whole table, a row for each different length; texts are encoded once."""
    with small_batches(docs.sparkSession):
        hist = store(histogram(docs), "length-histogram")
    return suffix_sums(hist)
