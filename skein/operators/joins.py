"""Joins that the built-in ones compose: nearest in time, bands, cascades, similarity, pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import trigrams


def micros(c: Column) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(c.cast("timestamp"))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys and times at most ``seconds`` apart (both ends included).

    Times are cut into buckets of that width: a row meets its own bucket and its two
    neighbours, so a hot key is dealt over its buckets and no pair outside of them is formed.
    ``right`` keeps its own names, which must differ from ``left``'s but for the keys.
    """
    width = max(1, seconds) * 1_000_000
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(micros(F.col(right_time)) / width)))
    r = right.withColumn("_bucket", near).select(*[F.col(k).alias(f"_{k}") for k in keys], "_bucket", *[c for c in right.columns if c not in keys])
    l = left.withColumn("_own", F.floor(micros(F.col(left_time)) / width))  # noqa: E741
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_own") == F.col("_bucket"), F.abs(micros(F.col(left_time)) - micros(F.col(right_time))) <= width]
    return l.join(r, reduce(Column.__and__, same), how).drop("_own", "_bucket", *[f"_{k}" for k in keys])


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_time: str, right_id: str, right_time: str, seconds: int) -> DataFrame:
    """For each left row the nearest right one within the drift; of ties the smallest id."""
    gap = F.abs(micros(F.col(left_time)) - micros(F.col(right_time)))
    first = Window.partitionBy(left_id).orderBy(gap, right_id)
    return within(left, right, keys, left_time, right_time, seconds).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (which must be total)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with their place as ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, from 0 in the given order (which must be total).

    Rows are dealt by ranges and counted in each; only the partitions' counts meet in one task.
    """
    from skein.operators.storage import stored

    within_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), within_part.alias("_at")), "numbered")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn("number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def cascade(left: DataFrame, key: str, passes: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """Passes (name, confidence, rows with ``key`` and ``target``) in order; the first one that has a key decides it.

    Of several targets in one pass the smallest counts.
    """
    named = [p.select(key, "target", F.lit(i).alias("_pass"), F.lit(name).alias("method"), F.lit(conf).alias("confidence")) for i, (name, conf, p) in enumerate(passes)]
    best = reduce(DataFrame.unionByName, named).groupBy(key).agg(F.min(F.struct("_pass", "target", "method", "confidence")).alias("b"))
    return left.join(best.select(key, "b.target", "b.method", "b.confidence"), key, "left")


def sole_remaining(left: DataFrame, right: DataFrame, day: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of days on which exactly one row of either side is left."""
    one = lambda d, i: d.groupBy(day).agg(F.count("*").alias("n"), F.min(i).alias(i)).filter("n = 1").select(day, i)
    return one(left, left_id).join(one(right, right_id), day)


def first_hit(candidates: DataFrame, index: DataFrame, record: str, weight: str, key: str) -> DataFrame:
    """Each record's candidates by falling weight (ties by key): the first key that the index has decides.

    ``index``: key, ids (distinct).  An ambiguous key ends the search without a result: id is null.
    """
    hit = candidates.join(index, key)
    best = latest(hit, [record], F.col(weight).desc(), F.col(key))
    return best.select(record, F.col(key).alias("hit"), F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("id"))


def similarity_policy(scored: DataFrame, record: str, candidate: str, score: str, threshold: float) -> DataFrame:
    """State of each record: none, match (one above the threshold or one exact), or collision; ``ids``: all above it, the best first."""
    good = scored.filter(F.col(score) >= threshold)
    found = good.groupBy(record).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(score) >= 1.0).alias("exact"),
        F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(candidate).alias("id")))).alias("all"),
        F.max(score).alias("score"),
    )
    sole = (F.col("n") == 1) | (F.col("exact") == 1)
    ids = F.transform("all", lambda x: x["id"])
    return found.select(record, F.when(sole, "match").otherwise("collision").alias("state"), F.when(sole, F.get(ids, F.lit(0))).alias("target"), "score", F.col("n").alias("n_above"), ids.alias("ids"))


#: Rows of one list that meet in a task; longer lists are dealt over several.
LIST = 2000


def rare_first(df: DataFrame, id_: str, tokens: str, group: list[str] | None = None, common: DataFrame | None = None) -> DataFrame:
    """id, group, tokens, lists: each row's distinct tokens, those first that the fewest rows of the group have (of equal ones the smaller), and those numbers of rows.

    A row's own tokens are all that is gathered.  ``common``: counts (group, token, n) to rank
    by, where two tables must agree on one order.
    """
    group = group or []
    each = df.select(id_, *group, F.explode(F.array_distinct(tokens)).alias("token"))
    counts = common if common is not None else token_counts(df, tokens, group)
    ranked = each.join(counts, [*group, "token"]).groupBy(id_, *group).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("r"))
    return ranked.select(id_, *group, F.col("r.token").alias("tokens"), F.col("r.n").alias("lists"))


def token_counts(df: DataFrame, tokens: str, group: list[str] | None = None) -> DataFrame:
    """group, token, n: the rows that have each token."""
    return df.select(*(group or []), F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*(group or []), "token").agg(F.count("*").alias("n"))


def _prefix(ranked: DataFrame, length: Column) -> DataFrame:
    """The first ``length`` (a Column of n, the number of tokens) tokens of each row, a row each, with the length of the token's ``list``."""
    first = lambda c: F.slice(c, F.lit(1), F.greatest(F.lit(1), F.least(F.size("tokens"), length)).cast("int"))
    kept = F.arrays_zip(first("tokens").alias("token"), first("lists").alias("list"))
    return ranked.withColumn("n", F.size("tokens")).select("*", F.inline(kept))


def _at_least(share: float) -> Column:
    """The prefix in which sets of n elements that overlap by ``share`` of n or more have a common element with any such partner."""
    return F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1


def dealt(left: DataFrame, right: DataFrame, keys: list[str], limit: int = LIST) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, of which both have the length of the key's ``list``.

    The left rows of a list longer than ``limit`` are dealt over parts, each of which gets the right ones,
    so a hot key is the work of many tasks.
    """
    parts = F.ceil(F.col("list") / limit).cast("long")
    l = left.withColumn("_part", F.pmod(F.xxhash64(*[c for c in left.columns if c not in (*keys, "list")]), parts)).drop("list")  # noqa: E741
    r = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("list")
    return l.join(r, [*keys, "_part"]).drop("_part")


def same_sets(df: DataFrame, id_: str, tokens: str, group: list[str] | None = None) -> DataFrame:
    """id, group, tokens, class: rows with equal sets (none empty) are a class, named by its smallest id."""
    group = group or []
    sets = df.select(id_, *group, F.array_sort(F.array_distinct(tokens)).alias("tokens")).filter(F.size("tokens") > 0)
    return sets.join(sets.groupBy(*group, "tokens").agg(F.min(id_).alias("class")), [*group, "tokens"])


def jaccard_pairs(df: DataFrame, id_: str, tokens: str, threshold: float, group: list[str] | None = None) -> DataFrame:
    """A < b, shared, n_a, n_b of rows of one group whose tokens' Jaccard similarity reaches the threshold.

    Rows meet in the lists of their rarest tokens alone (as many as the threshold makes
    necessary), so a token that most rows have forms no pairs; overlaps are counted for the rest.
    Equal rows are all paired: where there may be many, take ``jaccard_classes``.
    """
    group = group or []
    ranked = rare_first(df, id_, tokens, group)
    sets = ranked.select(id_, "tokens")
    p = _prefix(ranked.withColumn("n", F.size("tokens")), _at_least(threshold)).select(F.col(id_).alias("a"), *group, "token", "n", "list")
    met = dealt(p, p.select(F.col("a").alias("b"), *group, "token", F.col("n").alias("m"), "list"), [*group, "token"])
    pairs = met.filter((F.col("a") < F.col("b")) & (F.col("n") * threshold <= F.col("m")) & (F.col("m") * threshold <= F.col("n"))).select("a", "b").distinct()
    side = lambda s: sets.select(F.col(id_).alias(s), F.col("tokens").alias(f"t_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("t_a", "t_b")).alias("shared"), F.size("t_a").alias("n_a"), F.size("t_b").alias("n_b"))
    return counted.filter(F.col("shared") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("shared")))


def jaccard_classes(df: DataFrame, id_: str, tokens: str, threshold: float, group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """J50 without expanding copies: members (id, class, size, n_links) and pairs of classes (as of ``jaccard_pairs``).

    Rows of one group with equal sets are a class, handled once; n_links are the rows other than itself that
    a row links with, its copies included.
    """
    group = group or []
    members = same_sets(df, id_, tokens, group)
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    pairs = jaccard_pairs(members.filter(F.col(id_) == F.col("class")).select("class", *group, "tokens").dropDuplicates(["class"]), "class", "tokens", threshold, group)
    side = lambda x, y: pairs.select(F.col(x).alias("class"), F.col(y).alias("other"))
    linked = side("a", "b").unionByName(side("b", "a")).join(sizes.select(F.col("class").alias("other"), "size"), "other").groupBy("class").agg(F.sum("size").alias("linked"))
    found = members.select(id_, "class").join(sizes, "class").join(linked, "class", "left")
    return found.select(id_, "class", "size", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), pairs


def subset_pairs(df: DataFrame, id_: str, tokens: str, group: list[str] | None = None) -> DataFrame:
    """A < b, narrower, broader of rows of one group of which one's tokens are a part of the other's, not all.

    All of the narrower row's tokens must be in the broader one, so it is looked up by its
    rarest token alone; ids meet, and tokens are joined to the pairs.
    """
    group = group or []
    ranked = rare_first(df, id_, tokens, group)
    each = _prefix(ranked, F.size("tokens")).select(F.col(id_).alias("broader"), *group, "token", "list", F.col("n").alias("m"))
    small = _prefix(ranked, F.lit(1)).select(F.col(id_).alias("narrower"), *group, "token", "list", "n")
    met = dealt(small, each, [*group, "token"]).filter("n < m").select("narrower", "broader")
    side = lambda s, t: ranked.select(F.col(id_).alias(s), F.col("tokens").alias(t))
    both = met.join(side("narrower", "few"), "narrower").join(side("broader", "many"), "broader").filter(F.size(F.array_except("few", "many")) == 0)
    return both.select(F.least("narrower", "broader").alias("a"), F.greatest("narrower", "broader").alias("b"), "narrower", "broader")


def subset_classes(df: DataFrame, id_: str, tokens: str, group: list[str], apart: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """J47 without expanding copies: members (id, class, group) and pairs of classes (as of ``subset_pairs``).

    Rows of one group with equal sets, and equal values of ``apart``, are a class, named by its smallest id and
    handled once; the pairs have those values of both sides (as ``x_a`` and ``x_b``).
    """
    members = same_sets(df, id_, tokens, [*group, *apart])
    first = members.filter(F.col(id_) == F.col("class")).dropDuplicates(["class"])
    pairs = subset_pairs(first.select("class", *group, "tokens"), "class", "tokens", group)
    for s in ("a", "b") if apart else ():
        pairs = pairs.join(first.select(F.col("class").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in apart]), s)
    return members.select(id_, "class", *group), pairs


def with_members(pairs: DataFrame, members: DataFrame, id_: str) -> DataFrame:
    """One table of both: rows of kind ``pair`` (a, b and what else ``pairs`` has) and of kind ``member`` (a: the row, b: its class)."""
    own = members.select(F.lit("member").alias("kind"), F.col(id_).alias("a"), F.col("class").alias("b"))
    return pairs.select(F.lit("pair").alias("kind"), "*").unionByName(own, allowMissingColumns=True)


def trigram_top(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, least: float, n: int, group: list[str] | None = None) -> DataFrame:
    """The ``n`` most similar right rows (of the same group) for each left one by trigram similarity, from ``least`` on.

    Each different text is compared once.  Texts meet in the lists of those trigrams, the rarest ones of the
    right side first, of which one must be common at that similarity, if their numbers of trigrams allow it.
    Of a right text's rows the ``n`` smallest can be among the best.
    """
    group = group or []
    rows = lambda d, i, t, p: d.select(F.col(i).alias(f"{p}id"), *group, F.col(t).alias(f"{p}text"))
    left_rows, right_rows = rows(left, left_id, left_text, "l"), top(rows(right, right_id, right_text, "r"), [*group, "rtext"], n, F.col("rid")).drop("rank")
    side = lambda d, p: d.select(*group, f"{p}text").distinct().select(F.xxhash64(*group, f"{p}text").alias(f"{p}key"), "*", trigrams(F.col(f"{p}text")).alias("grams"))
    l, r = side(left_rows, "l"), side(right_rows, "r")  # noqa: E741
    counts = token_counts(l.select(*group, "grams").unionByName(r.select(*group, "grams")), "grams", group)
    rl, rr = rare_first(l, "lkey", "grams", group, counts), rare_first(r, "rkey", "grams", group, counts)
    first = lambda d, i: _prefix(d.withColumn("n", F.size("tokens")), _at_least(least)).select(i, *group, "token", "list", F.col("n").alias(f"{i}_n"))
    met = dealt(first(rl, "lkey"), first(rr, "rkey"), [*group, "token"])
    pairs = met.filter((F.col("lkey_n") * least <= F.col("rkey_n")) & (F.col("rkey_n") * least <= F.col("lkey_n"))).select("lkey", "rkey").distinct()
    both = pairs.join(rl.select("lkey", F.col("tokens").alias("x")), "lkey").join(rr.select("rkey", F.col("tokens").alias("y")), "rkey")
    o = F.size(F.array_intersect("x", "y"))
    scored = both.select("lkey", "rkey", (o / (F.size("x") + F.size("y") - o)).alias("score")).filter(F.col("score") >= least)
    named = scored.join(r.select("rkey", *group, "rtext"), "rkey").join(right_rows, [*group, "rtext"]).select("lkey", "rid", "score")
    best = top(named, ["lkey"], n, F.col("score").desc(), F.col("rid"))
    return best.join(l.select("lkey", *group, "ltext"), "lkey").join(left_rows, [*group, "ltext"]).select("lid", "rid", "score", "rank")


#: Rows of members whose pairs one task counts.
PART = 500_000


def collision_pairs(members: DataFrame, group: str, member: str, least: int, small: int = 1000) -> DataFrame:
    """Pairs a < b of members that come together in at least ``least`` different groups.

    Groups of up to ``small`` members are paired and counted.  Larger ones, of which there are
    few, never are: members meet in all but the ``least - 1`` largest of their large groups (two
    that share ``least`` of them meet in one of these), and for the pairs so found and those of
    the small groups the common large groups are counted by a join.  Tasks become more as the rows
    do, so none counts the pairs of more than about ``PART``.
    """
    m = members.select(F.col(group).alias("token"), F.col(member).alias("id"))
    parts = max(1, -(-m.count() // PART))
    m = m.repartition(parts, "token").distinct()
    sizes = m.groupBy("token").agg(F.count("*").alias("size"))
    own, large = m.join(sizes.filter(F.col("size") <= small).select("token"), "token"), m.join(sizes.filter(F.col("size") > small), "token")
    named = lambda d, s: d.select(F.col("id").alias(s), "token")
    near = named(own, "a").join(named(own, "b"), "token").filter("a < b").select("a", "b", F.lit(1).cast("long").alias("n"))
    often = large.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    ranked = large.join(often, "id").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("size", "token")))
    p = ranked.filter(F.col("at") <= F.col("n") - (least - 1))
    met = named(p, "a").join(named(p, "b"), "token").filter("a < b").select("a", "b", F.lit(0).cast("long").alias("n")).distinct()
    pairs = near.unionByName(met).repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = pairs.select("a", "b").join(named(large, "a"), "a").join(named(large, "b"), ["b", "token"]).groupBy("a", "b").agg(F.count("*").alias("more"))
    found = pairs.join(both, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("more", F.lit(0))).alias("shared"))
    return found.filter(F.col("shared") >= least)


def greedy_band(events: DataFrame, records: DataFrame, keys: list[str], order: str, record: str, event_time: str, record_time: str, seconds: int) -> DataFrame:
    """Each record goes to the first event (by ``order``) within the band; an event takes all of its records."""
    return latest(within(records, events, keys, record_time, event_time, seconds), [record], F.col(order))


def fill_missing(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` taken from the right side."""
    r = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return left.join(r, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def title_pairs(records: DataFrame, games: DataFrame, floor: float = 0.5, seconds: int = 1800) -> DataFrame:
    """Rec, game, score: the game whose names fit a title's two names best, above the floor and within the time.

    records: rec, at, first, second.  games: game, game_at, home, away.  A score is the mean
    Jaccard similarity of both names' tokens in the better orientation, in which both must share
    some.  Each different name is compared once; one of a pair's two names must reach the floor by itself, so
    a record meets the games at nearby times by the names that are so near to one of its own, and
    the other name decides.  Of equal scores the smaller game counts.
    """
    from skein.functions.text import jaccard, title_tokens

    names = lambda d, x, y, n: d.select(F.col(x).alias(n)).union(d.select(y)).distinct().withColumn(f"{n}_t", title_tokens(F.col(n)))
    said, known = names(records, "first", "second", "said"), names(games, "home", "away", "known")
    tokens = lambda d, n: d.select(n, F.explode(f"{n}_t").alias("token"))
    met = tokens(said, "said").join(tokens(known, "known"), "token").select("said", "known").distinct()
    near = met.join(said, "said").join(known, "known").select("said", "known", jaccard(F.col("said_t"), F.col("known_t")).alias("j")).filter("j > 0")
    strong, any_ = near.filter(F.col("j") >= floor), near.select(F.col("said").alias("other"), F.col("known").alias("beside"), F.col("j").alias("k"))
    way = lambda p, q: F.struct(F.col(p).alias("said"), F.col(q).alias("other"))
    asked = records.select("rec", "at", F.explode(F.array(way("first", "second"), way("second", "first"))).alias("w")).select("rec", "at", "w.*").join(strong, "said").drop("said")
    side = lambda p, q: F.struct(F.col(p).alias("known"), F.col(q).alias("beside"))
    offered = games.select("game", "game_at", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("game", "game_at", "s.known", "s.beside")
    both = within(asked, offered, ["known"], "at", "game_at", seconds).join(any_, ["other", "beside"])
    scored = both.select("rec", "game", ((F.col("j") + F.col("k")) / 2).alias("score")).filter(F.col("score") > floor)
    best = scored.groupBy("rec").agg(F.min(F.struct((-F.col("score")).alias("s"), "game")).alias("b"))
    return best.select("rec", F.col("b.game").alias("game"), (-F.col("b.s")).alias("score"))


def band_pipeline(events: DataFrame, records: DataFrame, keys: list[str], order: str, event: str, record: str, event_time: str, record_time: str, seconds: int) -> DataFrame:
    """Counter, n: events, records, paired records, events with and records without a partner after ``greedy_band``."""
    paired = greedy_band(events, records, keys, order, record, event_time, record_time, seconds).select(record, event)
    one = lambda n, d: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("counter"), "n")
    parts = [one("events", events), one("records", records), one("paired", paired), one("events_paired", paired.select(event).distinct()), one("unpaired", records.join(paired, record, "left_anti"))]
    return reduce(DataFrame.unionByName, parts)
