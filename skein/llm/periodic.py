"""All runs (maximal repetitions) of word sequences, by Lyndon roots under two orders.

A run of period q is a longest stretch in which words q apart are identical.  Scanning from right to
left with a stack, the longest Lyndon word at each place ends before the next smaller suffix; under an
order of the words or its reverse, each run has a root among them (the runs theorem).  Suffixes are
compared by their first words, and where these are equal by the length of their longest common extension:
a binary search over rolling hashes, whose answer is verified word by word, so no hash decides a result.
Extensions of a root to both sides give its run.  No suffix array is built.

A batch's sequences are scanned one behind another, with a separator smaller than all words between them;
work is in proportion to words, but for comparisons of equal ones, which take logarithmic time.

Defined cases: null or no words have no runs and collapse to an empty text; equal words tie in both orders
and are told apart by what follows; a null word is a word of its own kind and collapses to an empty one;
a very long text is a group of its own, held whole; repeated rows are judged each; an empty table stays
empty; columns of any name stay, and a result's name that exists already is an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import SPACES, let, split_words

#: Words that are scanned at once (a longer text is scanned alone).
GROUP = 150_000
#: The hash: polynomials modulo a Mersenne prime.
PRIME = (1 << 61) - 1
BASE = 1_099_511_628_211_003
#: Words that are compared one by one before hashes are asked.
DIRECT = 8

RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))


def _times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """a * b modulo ``PRIME``, in unsigned 64 bits."""
    low, b = np.uint64((1 << 31) - 1), np.asarray(b, np.uint64)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a1 * b0 + a0 * b1
    total = (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    total = (total & np.uint64(PRIME)) + (total >> np.uint64(61))
    return np.where(total >= PRIME, total - np.uint64(PRIME), total)


@functools.lru_cache(2)
def _powers(doublings: int) -> np.ndarray:
    """``BASE`` to the powers below two to the ``doublings``."""
    found = np.ones(1, np.uint64)
    for k in range(doublings):
        found = np.concatenate([found, _times(found, pow(BASE, 1 << k, PRIME))])
    return found


class Sequence:
    """Words as positive numbers, 0 between texts and at both ends, with hashes made on first use."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.int32)
        self.listed: list[int] = self.words.tolist()
        self.raw = self.words.tobytes()
        self.seen: dict[int, tuple[int, int]] = {}

    @functools.cached_property
    def hashes(self) -> tuple[list[int], list[int]]:
        """Sums of words times powers before each place, and the powers."""
        n = len(self.words)
        powers = _powers(max(1, n.bit_length()))
        terms = _times(self.words.astype(np.uint64), powers[:n])
        high, low = np.cumsum(terms >> np.uint64(31)) % np.uint64(PRIME), np.cumsum(terms & np.uint64((1 << 31) - 1)) % np.uint64(PRIME)
        sums = (_times(high, 1 << 31) + low) % np.uint64(PRIME)
        return [0, *sums.tolist()], powers.tolist()

    def same(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j are identical, looked at directly."""
        return self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]

    def _search(self, i: int, j: int, start: int, most: int, back: bool) -> int:
        """The largest number of words, of ``start`` to ``most``, over which hashes agree: doubling, then halving."""
        sums, powers = self.hashes
        shift = powers[j - i]

        def agree(n: int) -> bool:
            a, b = (i - n, j - n) if back else (i, j)
            return ((sums[a + n] - sums[a]) * shift - sums[b + n] + sums[b]) % PRIME == 0

        good, step = start, max(8, start)
        while good + step <= most and agree(good + step):
            good += step
            step *= 2
        bad = min(most, good + step) + 1
        if bad > most and good < most and agree(most):
            return most
        bad = min(bad, most)
        while bad - good > 1:
            middle = (good + bad) // 2
            good, bad = (middle, bad) if agree(middle) else (good, middle)
        return good

    def ahead(self, i: int, j: int) -> int:
        """Words from i on that are identical with those from j on (i < j, both in one text)."""
        w, k = self.listed, 0
        while k < DIRECT:
            if w[i + k] != w[j + k] or not w[j + k]:
                return k
            k += 1
        gap = j - i
        at, known = self.seen.get(gap, (0, 0))
        if i < at <= i + 2 * gap + DIRECT and self.same(i, j, at - i):  # what was verified for this distance just before
            n = at - i + known
        else:
            n = self._search(i, j, k, len(w) - j - 1, False)
            if not self.same(i, j, n) or (w[i + n] == w[j + n] and w[j + n]):
                n = self._direct(i, j)
        self.seen[gap] = (i, n)
        return n

    def behind(self, i: int, j: int) -> int:
        """Words before i that are identical with those before j, going left (i < j, both in one text)."""
        w, k = self.listed, 0
        while k < DIRECT:
            if w[i - 1 - k] != w[j - 1 - k] or not w[i - 1 - k]:
                return k
            k += 1
        n = self._search(i, j, k, i - 1, True)
        if not self.same(i - n, j - n, n) or (w[i - 1 - n] == w[j - 1 - n] and w[i - 1 - n]):
            n = k
            while w[i - 1 - n] == w[j - 1 - n] and w[i - 1 - n]:
                n += 1
        return n

    def _direct(self, i: int, j: int) -> int:
        """``ahead`` by the words alone, for when hashes were wrong."""
        a, b = self.words[i : i + len(self.words) - j], self.words[j:]
        return int(np.argmax((a != b) | (b == 0)))

    def next_smaller(self, order: list[int]) -> list[int]:
        """For each place the next suffix that is smaller, when words are ranked by ``order`` (0 for separators)."""
        following = [0] * len(order)
        for i in range(len(order) - 2, 0, -1):
            own = order[i]
            if own:
                j = i + 1
                while True:
                    other = order[j]
                    if other < own:
                        break
                    if other == own:
                        n = self.ahead(i, j)
                        if order[j + n] < order[i + n]:
                            break
                    j = following[j]
                following[i] = j
        return following

    def roots(self) -> Iterator[tuple[int, int]]:
        """Places and lengths of Lyndon roots that their text repeats at least twice more: one for each row of equal ones."""
        w, n = self.words, len(self.words)
        top = int(w.max(initial=0)) + 1
        for order in (w, np.where(w > 0, top - w, 0)):
            following = np.array(self.next_smaller(order.tolist()), np.int64)
            at = np.flatnonzero(following)
            length = following[at] - at
            fits = at + 3 * length < n
            at, length = at[fits], length[fits]
            again = (w[at] == w[at + length]) & (w[at] == w[at + 2 * length])
            at, length = at[again], length[again]
            kept = [self.same(i, i + q, 2 * q) for i, q in zip(at.tolist(), length.tolist(), strict=True)]
            at, length = at[kept], length[kept]
            known = set(zip(at.tolist(), length.tolist(), strict=True))
            yield from ((i, q) for i, q in known if (i - q, q) not in known)

    def runs(self, least: int, times: int) -> list[tuple[int, int, int]]:
        """start, length, period of all runs of ``least`` words and ``times`` periods (3 or more) at least, sorted."""
        if times < 3:
            raise ValueError("roots are looked for in runs of three periods or more")
        found = set()
        for i, q in self.roots():
            n = q + self.ahead(i, i + q)
            before = self.behind(i, i + q)
            if n + before >= max(least, times * q):
                found.add((i - before, n + before, q))
        return sorted(found, key=lambda r: (r[0], r[2]))


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``GROUP`` words."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + GROUP, side="right")))
        yield start, stop
        start = stop


def _found(lists: pa.ListArray, least: int, times: int) -> tuple[pa.Array, pa.Array]:
    """For each list of words its runs, and its text without repeated periods."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten(), "")
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kept = np.ones(len(ids), bool)
    rows: list[tuple[int, int, int, int]] = []
    for a, b in _groups(sizes):
        own = sizes[a:b]
        base = int(starts[a])
        words = np.zeros(int(own.sum()) + len(own) + 1, np.int64)
        places = np.arange(int(own.sum())) + np.repeat(np.arange(1, len(own) + 1), own)  # one separator before each text
        words[places] = ids[base : base + len(places)]
        first = starts[a:b] - base + np.arange(1, len(own) + 1)
        for at, n, q in Sequence(words).runs(least, times):
            doc = int(np.searchsorted(first, at, side="right")) - 1
            start = at - int(first[doc])
            rows.append((a + doc, start, n, q))
            kept[starts[a + doc] + start + q : starts[a + doc] + start + n] = False
    table = np.array(rows, np.int64).reshape(-1, 4)
    counts = np.bincount(table[:, 0], minlength=len(sizes))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(table[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"]))
    before = np.concatenate([[0], np.cumsum(kept)])
    left = flat if kept.all() else flat.filter(pa.array(kept))
    cuts = pa.array(before[np.concatenate([[0], ends])].astype(np.int32))
    return runs, pc.binary_join(pa.ListArray.from_arrays(cuts, left), " ")


def find(docs: DataFrame, words: str = "words", runs: str = "runs", collapsed: str = "collapsed", least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with the runs of ``words`` (array of start, length, period) and, for ``words``, the text that keeps each run's first period alone."""
    taken = {c.lower() for c in docs.columns if c != words}
    if {runs.lower(), collapsed.lower()} & taken:
        raise ValueError(f"a column {runs!r} or {collapsed!r} exists already; name others for the results")
    place = docs.columns.index(words)
    kept = [i for i in range(len(docs.columns)) if i != place]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, text = _found(b.column(place), least, times)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), found, text], names=[*(b.schema.names[i] for i in kept), runs, collapsed])

    return docs.mapInArrow(rows, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(runs, RUN), T.StructField(collapsed, T.StringType())]))


def planted(words: Column, doc_id: Column) -> Column:
    """The contract's repetitions: in a tenth of the documents, words from a place on repeat the p words there."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        copies = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when((h % 10 == 0) & (n > 0), F.concat(F.slice(w, F.lit(1), a), F.slice(copies, F.lit(1), n - a))).otherwise(w)

    return let(words, repeated)


def report(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    found = find(docs.select("doc_id", planted(split_words(F.col("text"), SPACES), F.col("doc_id")).alias("words")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.least")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
