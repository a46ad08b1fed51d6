"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each document becomes a vector of statistics of its whole text.  Random Fourier features
approximate a Gaussian kernel over the standardised statistics.  Tasks sum their part of
the normal equations, by fold; the driver gets one matrix a fold, whatever the corpus.
Ridge weights of all but one fold score that fold; these scores, counted in bins, calibrate
by isotonic regression; the weights of all folds score every document.

Labels come only from rows outside of the held-out third.  Defined cases: a null text is
an empty one and is scored too; a null doc_id counts as an empty string; repeated labels
each count, null ones do not; without labels every score is 0.5; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import small_batches, store
from skein.llm.linear import inverse, isotonic

#: Statistics of a text, in the order of ``statistics``.
NAMES = (
    "log_chars", "log_words", "word_mean", "word_sd", "distinct_words", "short_words", "longest_word", "upper", "digits", "dots", "bangs", "symbols",
    "bars", "blanks", "other_ascii", "beyond_ascii", "log_lines", "line_words", "distinct_lines", "entropy", "capital_words", "bare_marks",
)
FEATURES = 256
WIDTH = 4.0
RIDGE = 1.0
FOLDS = 4
BINS = 2048
SEED = 7
#: Tasks that sum the normal equations at most; each ships some 2 MB.
TASKS = 512


def _bytes_in(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars])


_UPPER, _DIGITS = np.arange(65, 91), np.arange(48, 58)
_DOTS, _BANGS, _SYMBOLS, _BARS, _BLANKS = map(_bytes_in, (".,;:", "!?", "#*$%&<>", "|", " \t\n\r"))
_OTHER = np.setdiff1d(np.arange(33, 127), np.concatenate([_UPPER, np.arange(97, 123), _DIGITS, _DOTS, _BANGS, _SYMBOLS, _BARS]))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    text = text or ""
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(count.sum()))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    w = max(1, len(words))
    share = lambda at: float(count[at].sum()) / n
    p = count[count > 0] / n
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()), len(set(words)) / w**0.75, float((sizes <= 3).mean()), float(np.log1p(sizes.max())),
        share(_UPPER), share(_DIGITS), share(_DOTS), share(_BANGS), share(_SYMBOLS), share(_BARS), share(_BLANKS), share(_OTHER), float(count[128:].sum()) / n,
        float(np.log1p(len(lines))), float(np.log1p(len(words) / max(1, len(lines)))), len(set(lines)) / max(1, len(lines)), float(-(p * np.log(p)).sum()),
        sum(map(str.isupper, words)) / w, sum(not x.isalnum() for x in words) / w,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for b in batches:
        found = [statistics(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, type=kind)], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each row of ``docs``, stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        return store(docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, x array<double>"), "text-statistics")


def held_out(doc_id: Column) -> Column:
    """True for the third that no label may come from."""
    return _crc(doc_id) % 3 == 1


def _crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.kernel(x) @ self.weights, 0, 1)
        return np.clip(0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * raw, 0, 1)


def _part_sums(model: Model):
    """Rows of the normal equations by fold, summed over a task: fold, row, values (the last one is the target's)."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = FEATURES + 1
        total = np.zeros((FOLDS, n, n + 1))
        for b in batches:
            z, y, fold = model.kernel(np.stack(b["x"].to_list())), b["quality"].to_numpy(float), b["fold"].to_numpy()
            for k in np.unique(fold):
                own = z[fold == k]
                total[k] += own.T @ np.hstack([own, y[fold == k][:, None]])
        for k in range(FOLDS):
            if total[k, -1, -2]:
                yield pd.DataFrame({"fold": k, "row": np.arange(n), "part": 0, "values": list(total[k])})

    return summed


def _sum_vectors(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(*key, np.sum(np.stack(group["values"].to_list()), axis=0))], columns=["fold", "row", "part", "values"])


def _fold_bins(model: Model, by_fold: np.ndarray):
    """Bins of the scores that the other folds' weights give: bin, n, good."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = (model.kernel(np.stack(b["x"].to_list())) * by_fold[b["fold"].to_numpy()]).sum(axis=1)
            at = np.minimum(BINS - 1, (np.clip(raw, 0, 1) * BINS).astype(int))
            yield pd.DataFrame({"bin": at, "n": 1, "good": b["quality"]}).groupby("bin", as_index=False).sum()

    return binned


def fit(found: DataFrame, labels: DataFrame) -> Model | None:
    """A model from ``features()`` and labels (doc_id, quality); None without labels."""
    crc = _crc(F.col("doc_id"))
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    train = store(found.join(known, "doc_id").select("x", F.col("quality").cast("double").alias("quality"), (F.floor(crc / 3) % FOLDS).cast("int").alias("fold")), "labelled")
    parts = [f(F.get("x", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    row = train.agg(F.count("*").alias("n"), *parts).first()
    if not row["n"]:
        return None
    rng = np.random.default_rng(SEED)
    mean = np.array([row[f"avg{i}"] for i in range(len(NAMES))])
    scale = np.maximum(1e-6, np.array([row[f"stddev_pop{i}"] for i in range(len(NAMES))]))
    turn, shift = rng.normal(0, 1 / WIDTH, (len(NAMES), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    empty = np.zeros(0)
    model = Model(mean, scale, turn, shift, empty, empty, empty)

    schema = "fold long, row long, part long, values array<double>"
    sums = train.coalesce(TASKS).mapInPandas(_part_sums(model), schema).withColumn("part", F.spark_partition_id().cast("long") % 64)
    for _ in range(2):  # first in 64 groups, then all
        sums = sums.groupBy("fold", "row", "part").applyInPandas(_sum_vectors, schema).withColumn("part", F.lit(0).cast("long"))
    total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for r in sums.collect():  # FOLDS * (FEATURES + 1) rows
        total[r["fold"], r["row"]] = r["values"]
    own = RIDGE * np.eye(FEATURES + 1)
    own[-1, -1] = 1e-6
    solve = lambda t: (inverse(t[:, :-1] + own) * t[:, -1]).sum(axis=1)
    whole = total.sum(axis=0)
    by_fold = np.stack([solve(whole - t) for t in total])
    bins = train.mapInPandas(_fold_bins(model, by_fold), "bin long, n long, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rows = sorted((r["bin"], r["n"], r["good"]) for r in bins.collect())  # BINS rows at most
    at, n, good = map(np.array, zip(*rows, strict=True))
    return Model(mean, scale, turn, shift, solve(whole), (at + 0.5) / BINS, isotonic(good / n, n.astype(float)))


def _scored(model: Model | None):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(NAMES))
            score = model.score(x) if model else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return scored


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted."""
    found = features(docs)
    model = fit(found, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = found.mapInArrow(_scored(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_of(doc_id) -> int:
    """What ``held_out`` takes the remainder of, in Python."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
