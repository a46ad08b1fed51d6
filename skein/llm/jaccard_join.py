"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct 5-word shingles of whole texts.  Documents with one set form a class,
which is handled once.  Tokens are put in a global order, frequent ones last; two sets that
link share a token among the first ones (the prefix) of each.

Index lists hold the sets whose prefix has a token.  Two sets that link are looked for at the
first token that they have in common: up to there they share nothing, so each set's rest
bounds the other's length (``hi``).  Only sets whose token stands early can meet sets as long
as themselves, and a list without such a set is dropped.  A list is cut into blocks by length
and position; a probing set skips all blocks whose bounds rule out a link.

Answers come in rounds.  In each, some sets of every list probe it (a few at first, then
more, at last all), and only for sets of other components.  So the first answers of a set
serve all sets that are highly similar to it: they are in its component already, and its
overlaps bound theirs (an overlap differs by at most the elements that one set has and the
other lacks), which decides further pairs without looking at the sets.  What is left is
verified on whole sets.  When all members of all lists have probed, no link between
components is left: the components are exact.

The order comes from a sketch of ``2 ** SKETCH_BITS`` counts over all documents, kept as
logarithms that no corpus saturates; it only decides how short lists are, never the result.

Defined cases: texts that are null or without words have an empty set and link with
nothing; a shorter text than a shingle is one shingle; equal texts link; component_id is
the smallest doc_id that is reachable (null where all are null); rows with one doc_id are
judged each by its own text; other columns, whatever their names, are ignored; an empty table
gives no rows.  A very long text is hashed in segments; its set of hashes is held whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import discard, join_hot, scratch, small_batches, store
from skein.llm.graph import components

SHINGLE = 5
SKETCH_BITS = 22
#: Sets that probe a list in the first round; each round takes ``GROWTH`` times as many.
FIRST, GROWTH = 6, 8
#: Positions of one block of an index list.
BLOCK = 16


# ---- shingles

#: Bytes of text that are hashed at once.
SEGMENT = 1 << 18
_FACTOR, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte (A-Z as a-z), and which bytes are blank."""
    value = np.random.default_rng(20_240_801).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return value, blank


_VALUE, _BLANK = _tables()


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    both = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(SEGMENT, x, np.uint64)
        row[0] = 1
        both.append(np.multiply.accumulate(row))
    return both[0], both[1]


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of some ``SEGMENT`` bytes at blanks (a longer word is cut in itself; its hash goes on over the cut)."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + SEGMENT)
        if stop < len(data):
            near = np.flatnonzero(_BLANK[data[max(start, stop - 4096) : stop]])
            if not len(near):
                near = np.flatnonzero(_BLANK[data[start:stop]])
                stop = start + int(near[-1]) + 1 if len(near) else stop
            else:
                stop = max(start, stop - 4096) + int(near[-1]) + 1
        yield start, stop
        start = stop


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one text, A-Z lower-cased: polynomials in the bytes, from differences of running sums."""
    power, back = _powers()
    found, held, width = [], np.zeros(1, np.uint64), 0  # of a word that the segments' ends cut: its sum and its bytes so far
    for start, stop in _segments(data):
        part = data[start:stop]
        word = ~_BLANK[part]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[part] * power[: len(part)])])
        h = (total[end] - total[begin]) * back[begin]
        goes_on = bool(width) and len(begin) > 0 and begin[0] == 0
        if goes_on:
            h[:1] = held + h[:1] * np.uint64(pow(_BASE, width, 1 << 64))
        elif width:
            h = np.concatenate([held, h])
        if len(end) and end[-1] == len(part) and stop < len(data):
            width = (width if goes_on and len(begin) == 1 else 0) + int(end[-1] - begin[-1])
            held, h = h[-1:], h[:-1]
        else:
            width = 0
        found.append(h)
    h = np.concatenate(found + [held] * bool(width)) if found else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTOR)
    return h ^ (h >> np.uint64(29))


def _set(h: np.ndarray) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the words ``h``."""
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(SHINGLE, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(_FACTOR) + h[k : len(h) - width + 1 + k]
        total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of each text; short texts are hashed together."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT // 2, side="right")) - 1)
        if stop == at + 1:
            yield _set(_word_hashes(data[offsets[at] : offsets[stop]]))
        else:
            sizes = np.diff(offsets[at : stop + 1])
            shifted = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)  # a blank after each text
            inside = np.ones(len(shifted), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            shifted[inside] = data[offsets[at] : offsets[stop]]
            word = ~_BLANK[shifted]
            begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
            cuts = np.searchsorted(begins, np.cumsum(sizes + 1))
            yield from map(_set, np.split(_word_hashes(shifted), cuts[:-1]))
        at = stop
    del texts, data
    pa.default_memory_pool().release_unused()  # what Arrow keeps of a batch would stay with the worker


def _prefix_length(n: int) -> int:
    return n + (-4 * n // 5) + 1


def links_at(o: str, n: str, m: str) -> str:
    """SQL: sets of ``n`` and ``m`` elements with ``o`` in common link at 0.8."""
    return f"9 * ({o}) >= 4 * ({n} + {m})"


# ---- order


def _count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, cells = np.zeros(1 << SKETCH_BITS, np.int64), (1 << SKETCH_BITS) - 1
    held: list[np.ndarray] = []
    n = 0

    def add() -> None:
        nonlocal total
        if held:
            np.add.at(total, np.concatenate(held), 1)
            held.clear()

    for b in batches:
        for found in shingle_sets(b.column("text")):
            held.append(found & cells)
            n += len(found)
            if n > 1 << 18:
                add()
                n = 0
    add()
    if total.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(_CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS)), pa.array(parts, pa.binary())], names=["chunk", "counts"])


_CHUNKS = 256


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b["chunk"], b["counts"], strict=True):
            counts = np.frombuffer(zlib.decompress(x), np.int64)
            total[c] = total[c] + counts if c in total else counts
    if total:
        yield pd.DataFrame({"chunk": list(total), "counts": [_steps(x).tobytes() for x in total.values()]})


def _steps(counts: np.ndarray) -> np.ndarray:
    """Counts as steps of a logarithm: one by one at first, then by a share of 0.07 %, up to 2 ** 63."""
    return np.minimum(65535, np.rint(np.log2(1 + counts.astype(float)) * 1024)).astype(np.uint16)


def frequencies(docs: DataFrame) -> np.ndarray:
    """Counts of the sketch's cells over all documents, as ``_steps``."""
    schema = "chunk long, counts binary"
    summed = docs.select("text").mapInArrow(_count_part, schema).repartition("chunk").mapInPandas(_add, schema).collect()  # 2 ** SKETCH_BITS counts in all
    counts = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.uint16)
    for r in summed:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.uint16)
    return counts.ravel()


def _keyed(order: np.ndarray):
    """doc_id, text_hash, node (128 bits of the set), n, prefix: the tokens of the rarest cells."""
    cells = (1 << SKETCH_BITS) - 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prefixes = [], [], []
            for s in shingle_sets(b.column("text")):
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefixes.append(s[np.argsort(order[s & cells], kind="stable")[: _prefix_length(len(s))]] if len(s) else s)
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "n", "prefix"])

    return keyed


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(shingle_sets(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


# ---- index lists


def _lists(classes: DataFrame) -> DataFrame:
    """Entries of index lists in which two sets may link: token, id, n, hi, band, block, m (sets in the list), u (a fixed random number of the set).

    ``hi``: the most elements that a set may have to link with this one, where the token is the first that both have:
    n - at elements are left from it on, so 9 (n - at) >= 4 (n + other).  A set is in a list once, and in as many lists as
    its prefix has tokens, so no list has a large part of all entries.
    """
    entries = classes.select("id", "n", F.posexplode("prefix").alias("at", "token")).select("token", "id", "n", F.expr("(5 * n - 9 * at) div 4").alias("hi"))
    whole = Window.partitionBy("token")
    listed = entries.select("*", F.count("*").over(whole).alias("m"), F.max(F.col("hi") >= F.col("n")).over(whole).alias("early")).filter("m > 1 and early")
    u = F.expr("(xxhash64(id) & 4503599627370495L) / 4503599627370496D")
    at = F.expr("(5 * n - 4 * hi) div 9")
    return listed.select("token", "id", "n", "hi", F.floor(F.log(1.25, F.col("n"))).alias("band"), F.floor(at / BLOCK).alias("block"), "m", u.alias("u"))


def _candidates(entries: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs a < b of different components with a common token, where one probes in this round.

    ``entries`` have comp besides the columns of ``_lists``.
    """
    entries = entries.filter(F.col("m") > low)  # the others have probed in full
    if low:
        open_ = entries.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        entries = entries.join(open_, "token", "left_semi")
    place = F.col("u") * F.col("m")
    probes = entries.filter((place >= low) & (place < high)).select("token", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("hi").alias("ph"), F.col("comp").alias("pc"))
    blocks = entries.groupBy("token", "band", "block").agg(F.min("n").alias("n0"), F.max("hi").alias("h1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    asked = probes.join(blocks, "token").filter("n0 <= ph and pn <= h1 and (c0 <> pc or c1 <> pc)").select("token", "band", "block", "p", "pn", "ph", "pc")
    found = asked.join(entries, ["token", "band", "block"]).filter("n <= ph and pn <= hi and comp <> pc")
    return found.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()


def _decided(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that the overlaps of a similar set don't rule out.

    ``known``: x, y, o, nx, ny in both directions.  Of a's most similar set L with a known overlap with b:
    |a & b| <= |L & b| + |a - L| and <= |L & a| + |b - L|.
    """
    best = known.groupBy("x").agg(F.max_by("y", F.struct("o", "y")).alias("l"), F.max_by(F.struct("o", "nx"), F.struct("o", "y")).alias("s"))
    best = best.select(F.col("x").alias("a"), "l", F.col("s.o").alias("oa"), F.col("s.nx").alias("na"))
    other = known.select(F.col("x").alias("l"), F.col("y").alias("b"), F.col("o").alias("ob"), F.col("ny").alias("nb"))
    bound = pairs.join(best, "a", "left").join(other, ["l", "b"], "left")
    most = "least(ob + na - oa, oa + nb - ob)"
    return bound.filter(f"ob is null or {links_at(most, 'na', 'nb')}").select("a", "b")


def _near(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """a, b, na, nb of the pairs that their prefixes don't rule out.

    Common elements up to the end of either prefix are common to both prefixes; beyond it
    there are no more than that set has left.
    """
    side = lambda s: active.select(F.col("id").alias(s), F.col("prefix").alias(f"p{s}"), F.col("n").alias(f"n{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = "greatest(na - size(pa), nb - size(pb))"
    return both.filter(links_at(f"size(array_intersect(pa, pb)) + {rest}", "na", "nb")).select("a", "b", "na", "nb")


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, o: the overlaps of whole sets."""
    whole = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"s{s}"))
    both = near.join(whole("a"), "a").join(whole("b"), "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))


#: Sets whose texts are picked out by a broadcast of their ids (some 50 bytes each); beyond, the join shuffles.
BROADCAST_SETS = 200_000


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set of the wanted classes (id), from the text of one document each."""
    picked = store(classes.join(wanted, "id").select("id", "node", F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "picked")
    keys = F.broadcast(picked) if picked.count() <= BROADCAST_SETS else picked
    texts = docs.join(keys.select("d", "t").distinct(), docs["doc_id"].eqNullSafe(F.col("d")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("t")), "left_semi")
    made = texts.select("text").mapInArrow(_node_sets, "node binary, set array<long>")
    named = made.join(keys, "node").select("id", "set")
    return named.dropDuplicates(["id"])


# ---- long lists, block against block

#: Sets in a list above which its sets are compared in blocks and no pairs are written.
LONG = 200
#: Most sets and most elements of a block, on average.
BLOCK_SETS, BLOCK_ELEMENTS = 256, 400_000


def _block_links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of two blocks (or within one), as many as tie them together.

    The overlaps of one set with all others follow from those of the set before it: only the
    elements that one has and the other lacks are looked up.
    """
    sets = [np.asarray(x, np.int64) for x in rows["set"]]
    comp, side, n = rows["comp"].to_numpy(), rows["side"].to_numpy(), np.array([len(x) for x in sets])
    others = np.flatnonzero(side == side.max())
    tokens = np.concatenate([sets[i] for i in others])
    order = np.argsort(tokens, kind="stable")
    tokens, where = tokens[order], np.repeat(np.arange(len(others)), n[others])[order]
    cuts = np.flatnonzero(np.diff(tokens, prepend=tokens[0] - 1 if len(tokens) else 0))
    index = dict(zip(tokens[cuts].tolist(), np.split(where, cuts[1:]), strict=True))
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    links, before, counts = [], np.zeros(0, np.int64), np.zeros(len(others), np.int64)
    for p in np.flatnonzero(side == side.min()).tolist():
        gone, new = np.setdiff1d(before, sets[p], assume_unique=True), np.setdiff1d(sets[p], before, assume_unique=True)
        if len(gone) + len(new) > len(sets[p]):
            counts[:], gone, new = 0, gone[:0], sets[p]
        for t in gone.tolist():
            if t in index:
                counts[index[t]] -= 1
        for t in new.tolist():
            if t in index:
                counts[index[t]] += 1
        before = sets[p]
        for x in others[np.flatnonzero(9 * counts >= 4 * (n[p] + n[others]))].tolist():
            a, b = find(comp[p]), find(comp[x])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((max(a, b), min(a, b)))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _long_list_links(entries: DataFrame, labels: DataFrame, sets_of) -> DataFrame:
    """Links (a, b: components) between all sets that have a long list in common.

    Blocks whose bounds in every common list rule out a link are skipped.  Sets are cut into blocks near their smallest token in such a list, so near copies come
    together; each two blocks with a list in common are compared in one task of bounded size.
    """
    open_ = entries.join(labels, "id")
    several = open_.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
    listed = store(entries.join(several, "token", "left_semi").select("token", "id", "n", "hi", "u"), "long-lists")
    nodes = listed.groupBy("id", "n", "u").agg(F.min(F.xxhash64("token")).alias("s"))
    total = nodes.count()
    part = F.floor((F.col("s") / F.lit(2.0**64) + 0.5) * max(1, -(-total // BLOCK_SETS))).alias("part")
    nodes = nodes.select("id", "n", "u", part)
    sizes = nodes.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).alias("subs"))
    block = F.concat_ws(".", F.col("part").cast("string"), F.floor(F.col("u") * F.col("subs")).cast("string")).alias("blk")
    placed = store(nodes.join(sizes, "part").select("id", block), "blocks")
    met = store(listed.join(placed, "id").groupBy("token", "blk").agg(F.min("n").alias("n0"), F.max("hi").alias("h1")), "met")
    also = met.select("token", F.col("blk").alias("other"), F.col("n0").alias("on"), F.col("h1").alias("oh"))
    pairs = met.join(also, "token").filter("blk <= other and n0 <= oh and on <= h1").select("blk", "other").distinct()
    named = placed.join(labels, "id").join(sets_of(placed.select("id")), "id").select("id", "comp", "set", "blk")
    each = pairs.select("blk", "other", F.explode(F.array_distinct(F.array(F.struct(F.col("blk").alias("b"), F.lit(0).alias("side")), F.struct(F.col("other").alias("b"), F.when(F.col("blk") == F.col("other"), 0).otherwise(1).alias("side"))))).alias("m"))
    rows = each.select("blk", "other", "m.side", F.col("m.b").alias("b")).join(named.withColumnRenamed("blk", "b"), "b").select("blk", "other", "side", "comp", "set")
    return rows.groupBy("blk", "other").applyInPandas(_block_links, "a long, b long")


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's class (doc_id, text_hash, node, n), and node, root of the classes that link with others."""
    with small_batches(docs.sparkSession), scratch(docs.sparkSession) as keep:
        rows, roots = _link_classes(docs.select("doc_id", "text"))
        return keep(rows), keep(roots)


def _link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    order = frequencies(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    full = store(own.mapInArrow(_keyed(order), f"doc_id {kind}, text_hash long, node binary, n long, prefix array<long>"), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("r")
    named = full.filter("n > 0").groupBy("node").agg(first, F.min("prefix").alias("prefix")).select("node", "r.doc_id", "r.text_hash", "r.n", "prefix")
    classes = store(named.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = store(full.drop("prefix"), "rows")
    discard(full)
    entries = store(_lists(classes), "lists")
    active = store(classes.join(entries.select("id").distinct(), "id", "left_semi").select("id", "n", "prefix"), "active")

    labels = store(active.select("id", F.col("id").alias("comp")), "labels")
    known = sets = None

    def whole(wanted: DataFrame) -> DataFrame:
        """The sets that are there, after those that were missing are made."""
        nonlocal sets
        new = store(_sets_of(docs, classes, wanted if sets is None else wanted.join(sets, "id", "left_anti")), "whole-sets")
        sets = new if sets is None else sets.unionByName(new)
        return sets

    def merge(links: DataFrame) -> DataFrame:
        """Labels after links (a, b) between components."""
        if links.isEmpty():
            return labels
        merged = components(links)
        moved = labels.join(merged.select(F.col("node").alias("comp"), "root"), "comp", "left")
        return store(moved.select("id", F.coalesce("root", "comp").alias("comp")), "labels")

    longest, low, high = entries.agg(F.max("m")).first()[0] or 0, 0, FIRST
    while low < min(longest, LONG):
        lists = entries.filter((F.col("m") > low) & (F.col("m") <= LONG)) if low else entries
        named = lists.join(labels, "id") if low else lists.withColumn("comp", F.col("id"))
        pairs = asked = store(_candidates(named, low, high), "pairs")
        if known is not None:
            tested = known.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            pairs = _decided(pairs.join(tested, ["a", "b"], "left_anti"), known)
        near = store(_near(pairs, active), "near")
        discard(asked)
        found = store(_verified(near, whole(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())), "overlaps")
        discard(near)
        both = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "o", F.col("na").alias("nx"), F.col("nb").alias("ny"))
        both = both.unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("y"), "o", F.col("nb").alias("nx"), F.col("na").alias("ny")))
        known = both if known is None else known.unionByName(both)
        of = lambda s: labels.select(F.col("id").alias(s), F.col("comp").alias(f"c{s}"))  # noqa: E731, B023
        links = found.filter(links_at("o", "na", "nb")).select("a", "b").join(of("a"), "a").join(of("b"), "b")
        labels = merge(store(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links"))
        if low == 0 and longest > LONG:
            labels = merge(store(_long_list_links(entries.filter(F.col("m") > LONG), labels, whole), "links"))
        low, high = high, high * GROWTH
    roots = labels.filter("id <> comp").unionByName(labels.filter("id <> comp").select(F.col("comp").alias("id"), "comp").distinct())
    return rows, store(classes.select("node", "id").join(roots, "id").select("node", F.col("comp").alias("root")), "roots")


def assigned(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (a name of the component, null for empty sets), component_id for each row of ``docs``.

    Rows are first aggregated to classes, and classes to components; what a class has is then
    joined to its rows, for the few classes of very many rows by a broadcast.
    """
    rows, roots = link_classes(docs)
    classes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    named = store(classes.join(roots, "node", "left").withColumn("root", F.coalesce(F.col("root").cast("string"), F.hex("node"))), "named")
    linked = named.join(roots.select("node"), "node", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    total = named.agg(F.sum("many"), F.count("*")).first()
    whole = join_hot(linked.drop("many"), least, "root", total[1] or 0).select("node", "component_id")
    each = store(named.join(whole.withColumnRenamed("component_id", "c"), "node", "left").select("node", "root", F.coalesce("c", "least").alias("component_id"), "many"), "components")
    found = join_hot(rows.filter("n > 0"), each, "node", total[0] or 0)
    found = found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", "component_id")
    return found.unionByName(rows.filter("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("string").alias("root"), F.col("doc_id").alias("component_id")))


def report(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_shingles, component_id."""
    return assigned(docs).drop("text_hash", "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (of equal ids the smallest hash, then one row).

    Texts that are null or without words are components of their own and stay.  Equal rows of (doc_id, text) are one
    document: one of them stays, the one with the smallest hash of all its columns.
    """
    found = store(assigned(docs.select("doc_id", "text")), "assigned")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    linked = found.filter("n_shingles > 0").groupBy("root").agg(first.alias("r")).select("r.doc_id", "r.text_hash")
    empty = found.filter("n_shingles = 0").select("doc_id", "text_hash").distinct()
    stays = linked.unionByName(empty).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = [F.col("row.doc_id").eqNullSafe(F.col("doc_id")), F.xxhash64("row.text").eqNullSafe(F.col("text_hash"))]
    kept = whole.join(stays, key, "left_semi")
    if not found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        kept = kept.groupBy(F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("t")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
