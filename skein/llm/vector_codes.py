"""Vector codes: each of 16 parts of a vector becomes the number of its nearest codebook entry.

Components become integers, so distances are exact and ties go to the lower index.  An assignment is an
exponion search: it starts at the part's previous entry, and as an entry at least as near as that one can
be at most twice its distance away from it, only those entries are scanned that stand first in its list of
entries sorted by distance, up to four times the squared distance.  Codebooks are small: what goes to the
driver is a sum and a count for each entry, whatever the number of rows.

Each round is a pass over a stored table of vectors and codes.  Integers are 64 bits wide where distances
fit, and Python's otherwise.

Defined cases: null vectors and those with null or non-finite components are dropped; rows with one vec_id
each count, ordered by their vectors; null vec_ids come last among those that begin the codebooks; with
fewer than 64 rows codebooks have as many entries; equal labels are summed together, nulls as one label;
an empty table gives no rows; vectors of no components have code 0; lengths that differ, or that 16 does
not divide, are an error, and so is an error that no long can hold; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are worked on at once.
ROWS = 2048
#: A label with this share of all rows, or one row in as many, is joined by a broadcast (at most this many are).
SHARES = 10_000


@dataclass
class Codebooks:
    """entries: [part, entry, component], and for each entry all others by (distance, index) behind itself."""

    entries: np.ndarray

    def __post_init__(self):
        parts, k, _ = self.entries.shape
        between = self.entries[:, :, None] - self.entries[:, None]
        gaps = (between * between).sum(axis=3)
        gaps[:, np.arange(k), np.arange(k)] = -1  # itself comes first
        self.neighbours = np.argsort(gaps, axis=2, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.neighbours, axis=2)

    def assign(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entries and squared distances of ``vectors`` [row, part, component], and how many entries were looked at."""
        n, parts, width = vectors.shape
        flat, part, first = vectors.reshape(n * parts, width), np.tile(np.arange(parts), n), start.reshape(-1).astype(np.int64)

        def distance(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
            away = flat[rows] - self.entries[part[rows], entry]
            return (away * away).sum(axis=1)

        live = np.arange(n * parts)
        least, found, looked = distance(live, first), first.copy(), n * parts
        radius = least * 4
        for r in range(1, self.entries.shape[1]):
            live = live[self.gaps[part[live], first[live], r] <= radius[live]]
            if not len(live):
                break
            entry = self.neighbours[part[live], first[live], r]
            far = distance(live, entry)
            looked += len(live)
            better = (far < least[live]) | ((far == least[live]) & (entry < found[live]))
            least[live[better]], found[live[better]] = far[better], entry[better]
        return found.reshape(n, parts), least.reshape(n, parts), looked

    def digest(self) -> str:
        """Of all entries' components, decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """True where a vector is whole: not null, and no component null, NaN or infinite."""
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(whole(x), F.lit(False))), F.lit(False))


def _integers(vectors: pa.Array, width: int, wide: bool) -> np.ndarray:
    """[row, part, component]: floors of the components times ``SCALE``."""
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    whole = np.array([int(x) for x in scaled.tolist()], object) if wide else scaled.astype(np.int64)
    return whole.reshape(len(vectors), PARTS, width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)


def _assigned(books: Codebooks, width: int, wide: bool):
    """Rows with their code anew, and the squared distances summed over parts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found, far, _ = books.assign(_integers(b.column("vector"), width, wide), _codes(b.column("code")))
            raw = found.astype(np.uint8)
            error = pa.array([int(x) for x in far.sum(axis=1).tolist()], pa.int64())  # too large for a long: an error
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("vector"), pa.array([r.tobytes() for r in raw], pa.binary()), error], names=["vec_id", "label", "vector", "code", "error"])

    return rows


def _summed(entries: int, width: int, wide: bool):
    """For each task: the sums of components and the counts of each part's entries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, entries, width), object if wide else np.int64)
        counts = np.zeros((PARTS, entries), np.int64)
        for b in _slices(batches):
            vectors, codes = _integers(b.column("vector"), width, wide), _codes(b.column("code"))
            for part in range(PARTS):
                np.add.at(sums[part], codes[:, part], vectors[:, part])
                counts[part] += np.bincount(codes[:, part], minlength=entries)
        part, entry = np.nonzero(counts)
        text = [",".join(map(str, row)) for row in sums[part, entry].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(text, pa.string())], names=["part", "entry", "n", "sums"])

    return rows


def _renewed(coded: DataFrame, books: Codebooks, wide: bool) -> Codebooks:
    """Codebooks whose entries are their parts' floored means; those without parts stay."""
    _, entries, width = books.entries.shape
    each = coded.select("vector", "code").mapInArrow(_summed(entries, width, wide), "part long, entry long, n long, sums string")
    if width:
        each = each.select("part", "entry", "n", F.posexplode(F.split("sums", ",")).alias("position", "sum"))
    else:
        each = each.select("part", "entry", "n", F.lit(0).alias("position"), F.lit("0").alias("sum"))
    renewed = books.entries.copy()
    for part, entry, position, n, total in each.groupBy("part", "entry", "position").agg(F.sum("n"), F.sum(F.col("sum").cast("decimal(38,0)"))).collect():
        if width:  # one row for each component of the codebooks, which are small
            renewed[part, entry, position] = int(total) // n
    return Codebooks(renewed)


def fit(kept: DataFrame) -> tuple[DataFrame | None, Codebooks | None, bool]:
    """The stored rows with the codes of the last round (the start of the final assignment), the codebooks, and whether integers are Python's."""
    size, top = F.size("vector"), F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    shortest, longest, most = kept.agg(F.min(size), F.max(size), F.max(top)).first()
    if shortest is None:
        return None, None, False
    if shortest != longest or longest % PARTS:
        raise ValueError(f"vectors have {shortest} to {longest} components; a number that {PARTS} divides, the same for all, is needed")
    width = longest // PARTS
    wide = 16 * (float(most) * SCALE + 1) ** 2 * max(1, longest) >= 2.0**62
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()
    books = Codebooks(_integers(first.column("vector").combine_chunks(), width, wide).transpose(1, 0, 2).copy())
    coded, schema = kept.withColumns({"code": F.lit(bytes(PARTS)), "error": F.lit(0).cast("long")}), kept.schema.add("code", "binary").add("error", "long")
    for _ in range(ROUNDS):
        before, coded = coded, store(coded.mapInArrow(_assigned(books, width, wide), schema), "vector-codes")
        discard(before)
        books = _renewed(coded, books, wide)
    return coded, books, wide


def compress(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (binary, a byte a part), error of each whole vector; and the codebooks."""
    kept = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(finite(F.col("vector")))
    coded, books, wide = fit(kept)
    if coded is None:
        return kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    final = store(coded.mapInArrow(_assigned(books, books.entries.shape[2], wide), coded.schema).drop("vector"), "vector-codes")
    discard(coded)
    return final, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows with its label, nulls together.

    Sums are made before rows meet them; labels of many rows, of which there are few, are broadcast, so
    no task gets all rows of one.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("many"))
    total = coded.count()
    hot = sums.filter(F.col("many") >= max(64, total // SHARES))
    met = coded["label"].eqNullSafe(F.col("of"))
    cold = coded.join(F.broadcast(hot.select("of")), met, "left_anti").join(sums.filter(F.col("many") < max(64, total // SHARES)), met)
    return coded.join(F.broadcast(hot), met).unionByName(cold).drop("of", "many")


def report(embeddings: DataFrame) -> DataFrame:
    """Contract rows: vec_id, code in hex digits, error, label_error, and the digest of all final entries."""
    coded, books = compress(embeddings)
    digest = books.digest() if books else hashlib.sha256().hexdigest()
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
