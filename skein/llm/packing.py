"""Packing into fixed-length sequences as a cutting-stock problem.

1. Each document is encoded whole, the end id is added, and the ids are cut into full
   pieces of ``CAPACITY`` and a remainder.  One pass writes a row for each piece.
2. Piece lengths are counted in units of ``UNIT`` tokens (rounded up): a histogram of at
   most CAPACITY / UNIT rows, whatever the corpus.
3. Column generation solves the linear program over patterns of this histogram (how many
   pieces of each size a sequence takes); a knapsack by dynamic programming prices new
   patterns by the dual prices until none improves.  Multiplicities are rounded down, and
   first-fit decreasing places the few pieces that remain.
4. Pieces of one size are ranked; ranks are dealt to the slots of the rounded patterns.
   Ranks come from counters in each partition and offsets of the partitions, so a size that
   a third of all documents share is no group.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an
empty table gives no rows.  A sequence is padded to CAPACITY unless its length is a power
of two.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import small_batches, store
from skein.llm.linear import inverse as invert
from skein.llm.tokens import chunks, encoder, tokenizer_path

CAPACITY = 2048
UNIT = 8
END_ID = 1
#: Most rounds of column generation; every round leaves a valid plan.
ROUNDS = 3000


def _cut(path: str, capacity: int, unit: int):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, part = encoder("byte", path), np.zeros(-(-capacity // unit) + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for at, texts in chunks(b.column("text")):
                ids, starts, counts = e.encode(texts)
                n = counts + 1
                many = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), many)
                begin = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, n[doc] - begin)
                last = begin + length == n[doc]
                raw, first = memoryview(ids.astype("<u4", copy=False).tobytes()), 4 * (starts[doc] + begin)
                crcs = [zlib.crc32(end, zlib.crc32(raw[i:j])) if x else zlib.crc32(raw[i:j]) for i, j, x in zip(first.tolist(), (first + 4 * (length - last)).tolist(), last.tolist(), strict=True)]
                size = -(-length // unit)
                order = np.argsort(size, kind="stable")
                before = np.concatenate([[0], np.cumsum(np.bincount(size, minlength=len(seen)))])[size[order]]
                nth = np.empty(len(size), np.int64)
                nth[order] = seen[size[order]] + np.arange(len(size)) - before
                seen += np.bincount(size, minlength=len(seen))
                columns = [begin, length, np.array(crcs, np.int64), n[doc], size, np.full(len(doc), part), nth]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "nth"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at + doc)), *map(pa.array, columns)], names=names)

    return pieces


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, size (units), and its place among those of its size in its partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(
        _cut(tokenizer or tokenizer_path("byte_bpe_50k.json"), capacity, unit),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, size long, part long, nth long",
    )
    with small_batches(docs.sparkSession):
        return store(made, "pieces")


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total price: an unbounded knapsack."""
    worth = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        worth[c] = worth[c - 1]
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            gain = prices[:fits] + worth[c - sizes[:fits]]
            i = int(gain.argmax())
            if gain[i] > worth[c] + 1e-12:
                worth[c], taken[c] = gain[i], i
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return worth[capacity], pattern


def _first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: fillings by first fit decreasing, each used until it exhausts a size, which it then stands for."""
    n = len(sizes)
    patterns, x, left = np.diag((capacity // sizes).astype(float)), np.zeros(n), demand.astype(float)
    while (left > 0).any():
        p, room = np.zeros(n), capacity
        for i in np.flatnonzero(left > 0)[::-1].tolist():
            p[i] = room // sizes[i]
            room -= int(p[i] * sizes[i])
        used = np.flatnonzero(p)
        times = left[used] / p[used]
        out = int(used[times.argmin()])
        patterns[:, out], x[out] = p, times.min()
        left[used] = np.maximum(0, left[used] - times.min() * p[used])
        left[out] = 0
    return patterns, x


#: A dual bound proves the plan to be within this share of the optimum when generation ends.
GAP = 1e-4


def generate_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional multiplicities: the linear program's optimum by column generation.

    ``sizes`` ascend.  The revised simplex method swaps one pattern of the basis each round.
    """
    patterns, x = _first_patterns(sizes, demand, capacity)
    inverse = invert(patterns)
    for turn in range(rounds):
        value, new = _best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + GAP:
            break
        step = (inverse * new).sum(axis=1)  # too small for threads
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(0, x - ratio[out] * step)
        x[out] = ratio[out]
        patterns[:, out] = new
        if turn % 200 == 199:
            inverse = invert(patterns)  # clears rounding errors
        else:
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
    return patterns, x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: count) with whole multiplicities that take every piece exactly once."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    patterns, x = generate_patterns(sizes, demand.astype(float), capacity)
    chosen, left = [], demand.copy()
    for j in np.argsort(-x, kind="stable").tolist():
        p = np.rint(patterns[:, j]).astype(np.int64)
        times = min(int(x[j] + 1e-6), int((left[p > 0] // p[p > 0]).min()))
        if times > 0:
            chosen.append(({int(s): int(k) for s, k in zip(sizes, p, strict=True) if k}, times))
            left -= times * p
    while left.any():  # first-fit decreasing, as often as the same filling fits
        p, room = np.zeros_like(left), capacity
        for i in range(len(sizes) - 1, -1, -1):
            p[i] = min(left[i], room // sizes[i])
            room -= int(p[i] * sizes[i])
        times = int((left[p > 0] // p[p > 0]).min())
        chosen.append(({int(s): int(k) for s, k in zip(sizes, p, strict=True) if k}, times))
        left -= times * p
    return chosen


def _runs(chosen: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By size: rows (first rank, pieces in a pattern, first sequence, first slot), by rank."""
    rank, runs, sequence = Counter(), {}, 0
    for pattern, times in chosen:
        slot = 0
        for size in sorted(pattern, reverse=True):
            runs.setdefault(size, []).append((rank[size], pattern[size], sequence, slot))
            rank[size] += pattern[size] * times
            slot += pattern[size]
        sequence += times
    return {s: np.array(r, dtype=np.int64) for s, r in runs.items()}


def _deal(runs: dict[int, np.ndarray]):
    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, slot = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for size, at in b.groupby("size").indices.items():
                table, rank = runs[size], b["rank"].to_numpy()[at]
                first, many, seq, place = table[np.searchsorted(table[:, 0], rank, side="right") - 1].T
                sequence[at], slot[at] = seq + (rank - first) // many, place + (rank - first) % many
            yield b[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=sequence, slot=slot)

    return dealt


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Contract rows, one for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType
    pieces = cut(docs.withColumn("doc_id", F.col("doc_id").cast("string")), tokenizer, capacity, unit)
    counts = store(pieces.groupBy("size", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # capacity / unit rows at most
    runs = _runs(plan(histogram, capacity // unit))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["size", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "rank").mapInPandas(_deal(runs), schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset")
    return placed.select(F.col("doc_id").cast(kind).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding (tokens that fill sequences up; none at a power of two)."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.bit_count("used") == 1
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("used"))).alias("padding"))
