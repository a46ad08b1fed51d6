"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions alone).

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one
window).  Its tokens are its shingles of ``SHINGLE`` words.  A first pass counts, for every
item shingle, its occurrences in all documents (an aggregate, nothing else leaves the
scan).  A window occurs only where all its shingles do, so in the order of rarity its
necessary prefix is its rarest shingle alone; a window with a shingle that no document has
is dropped.  A second pass joins the positions of the documents with these prefix shingles
alone.  Each hit fixes the one place where the window would lie; places outside of the
document are dropped (position and length), and at the others the words of the window, as
many as the item's window has, are compared one by one with the document's.

Positions carry the document's key and a hash; words are looked at again in the documents
that have candidates only.  All candidates of a document are verified in one row, which is
bounded by the document's own length (a window of each size can begin at each word).

Defined cases: null texts have no words and hit nothing; an item without words is no
item; a null item_id counts as an empty string; equal item_ids are one item; repeated
rows are judged alike, and rows with one doc_id each by its own text; very long texts take
time in proportion to their length; empty tables give no rows or no hits; other columns,
whatever their names, are ignored by ``report`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skein.llm.common import NOT_WORD, lower_ascii, scratch, split_words, store

WINDOW = 13
SHINGLE = 5
#: Item shingles (some 50 bytes each) or prefix windows (some 300) that are sent to all tasks; beyond, the join shuffles.
BROADCAST_SHINGLES, BROADCAST_WINDOWS = 500_000, 200_000
#: Documents with candidates whose keys (some 40 bytes each) are sent to all tasks; beyond, the join shuffles.
BROADCAST_DOCS = 1_000_000


def words_of(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)


def item_windows(items: DataFrame) -> DataFrame:
    """The different windows: window (a number), words, n (words in it), k (words of its shingles), item_ids."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(WINDOW)))).alias("words"))
    each = each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
    return each.select(F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), "item_ids")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _positions(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys``, at, h of all shingles of ``k`` words in ``hashes`` (hashes of words).

    The array is zipped with itself, shifted, so each row gets the words of one shingle and
    no more; the outer form keeps Spark from computing the words once more for a filter.
    """
    shifted = [F.slice("hashes", F.lit(j + 1), F.size("hashes")).alias(f"w{j}") for j in range(k)]
    each = rows.select(*keys, F.posexplode_outer(F.arrays_zip(*shifted)).alias("at", "g"))
    return each.filter(F.col(f"g.w{k - 1}").isNotNull()).select(*keys, "at", F.xxhash64(*[F.col(f"g.w{j}") for j in range(k)]).alias("h"))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hashed(words_of(F.col("text"))).alias("hashes"))


def _none(docs: DataFrame) -> DataFrame:
    none = F.lit(0)
    return docs.select(_key(docs), none.alias("start"), none.alias("n"), F.lit(0).cast("long").alias("window")).filter(F.lit(False))


def _key(docs: DataFrame) -> Column:
    """What tells documents apart: null ids are equal ones in it."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key")


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """key (doc_id, text_hash), start, n, window: every occurrence of an item window (``item_windows``, stored) in a document."""
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # SHINGLE values at most
    if not lengths:
        return _none(docs)
    union = lambda make: reduce(DataFrame.unionByName, map(make, lengths))
    hashed = windows.select("window", "k", _hashed(F.col("words")).alias("hashes"))
    shingles = store(union(lambda k: _positions(hashed.filter(F.col("k") == k), ["window"], k).withColumn("k", F.lit(k))), "item-shingles")

    keys = store(shingles.select("k", "h").distinct(), "shingle-set")
    small = keys.count() <= BROADCAST_SHINGLES

    def counted(k: int) -> DataFrame:
        own, wanted = _positions(_own(docs), [], k).select("h"), keys.filter(F.col("k") == k).select("h")
        if small:
            return own.join(F.broadcast(wanted), "h").groupBy("h").agg(F.count("*").alias("df")).withColumn("k", F.lit(k))
        return own.groupBy("h").agg(F.count("*").alias("df")).join(wanted, "h").withColumn("k", F.lit(k))

    rarity = store(union(counted), "rarity")
    ranked = shingles.join(rarity, ["h", "k"], "left")
    first = ranked.groupBy("window", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("p"))
    prefix = first.filter("p.df > 0").select("window", "k", F.col("p.h").alias("h"), F.col("p.at").alias("shift"))
    prefix = store(prefix.join(windows.select("window", "n", "words"), "window"), "prefix")

    few = prefix.count() <= BROADCAST_WINDOWS

    def placed(k: int) -> DataFrame:
        own, wanted = _positions(_own(docs), ["doc_id", "text_hash"], k), prefix.filter(F.col("k") == k).drop("k")
        found = own.join(F.broadcast(wanted) if few else wanted, "h").withColumn("start", F.col("at") - F.col("shift")).filter("start >= 0")
        return found.select(F.struct("doc_id", "text_hash").alias("key"), "start", "n", "window", "words")

    places = union(placed).groupBy("key", "start", "window").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    asked = store(places.groupBy("key").agg(F.collect_list(F.struct("start", "n", "window", "words")).alias("places")), "places")
    named = docs.select(_key(docs), "text")
    wanted = asked.select("key")
    texts = named.join(F.broadcast(wanted) if asked.count() <= BROADCAST_DOCS else wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = texts.select("key", words_of(F.col("text")).alias("w")).join(asked, "key")
    same = F.filter("places", lambda p: F.slice(F.col("w"), p["start"] + 1, p["n"]) == p["words"])
    return both.select("key", F.inline(F.transform(same, lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["window"].alias("window")))))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judged(docs, items).drop("text_hash")


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's rows and text_hash (xxhash64 of the text), one for each row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        windows = keep(store(item_windows(items), "windows"))
        found = keep(store(hits(docs, windows), "hits"))
    order = Window.partitionBy("key").orderBy("start", "n")
    end = F.col("start") + F.col("n")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = found.select("key", "start", "n").distinct()
    new = places.select("key", F.greatest(F.lit(0), end - F.greatest("start", before)).alias("new"))
    covered = new.groupBy("key").agg(F.sum("new").alias("n_hit"), F.lit(None).cast("array<string>").alias("ids"))
    ids = found.select("key", "window").distinct().join(windows.select("window", F.explode("item_ids").alias("i")), "window").select("key", "i").distinct()
    ids = ids.groupBy("key").agg(F.lit(0).cast("long").alias("n_hit"), F.array_sort(F.collect_list("i")).alias("ids"))
    per_doc = covered.unionByName(ids).groupBy("key").agg(F.sum("n_hit").alias("n_hit"), F.max("ids").alias("ids"))
    own = docs.select(_key(docs), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    both = own.join(per_doc, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return both.select(
        "key.doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "key.text_hash",
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; the columns stay."""
    own = docs.select("doc_id", "text")
    bad = judged(own, items).filter("contaminated").select(F.struct("doc_id", "text_hash").alias("bad")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = whole.join(bad, F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash")) == F.col("bad"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
