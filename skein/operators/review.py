"""The review queue: shaping, guards, approvals, rollbacks and duplicate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import components
from skein.functions.text import format_match, name_format, normalize_name
from skein.operators.joins import collision_pairs, latest, top

# The reference's fields of a log row's detail, and how many rows it mines.
NAME_KEYS = ("home_provider_normalized", "away_provider_normalized", "home_provider_raw", "away_provider_raw", "home_canonical", "away_canonical", "home_name", "away_name", "home", "away")
COUNTRY_KEYS = ("home_country", "away_country", "country", "country_name", "tournament_country", "league_country", "home_country_name", "away_country_name")
MINED = 50_000


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page numbers from 1, sizes 1 to 200; out-of-range values are moved into range."""
    size = min(200, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def unit_or_none(text: str | None) -> float | None:
    """A number from 0 to 1, or none."""
    try:
        value = float(text or "")
    except ValueError:
        return None
    return value if 0 <= value <= 1 else None


def display_confidence(confidence: Column, collision: Column) -> Column:
    """Two decimals, or ``(collision)`` where a collision left no confidence."""
    return F.when(collision & (confidence == 0), "(collision)").otherwise(F.printf(F.lit("%.2f"), confidence))


def failed_title(provider: Column, title: Column, home: Column, away: Column) -> Column:
    """A market's title, or a feed event's names with ``?`` for a missing one; null without any."""
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    some = (F.coalesce(home, F.lit("")) != "") | (F.coalesce(away, F.lit("")) != "")
    return F.when((provider == "kalshi") & (F.coalesce(title, F.lit("")) != ""), title).when((provider == "fl") & some, F.concat(said(home), F.lit(" vs "), said(away)))


def first_given(*names: Column) -> Column:
    """the first that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def parsed_name(provider: Column, normalized: Column, canonical: Column, feed_name: Column) -> Column:
    """A side's name: the provider's normalised one, the canonical one, or a feed event's own."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(normalized), given(canonical), F.when(provider == "fl", given(F.trim(feed_name))))


def candidate_set(text: Column) -> Column:
    """struct(provider, id) of ``provider:id,...``; parts of another shape are dropped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[^:]+:.+$"))
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).alias("provider"), F.regexp_replace(x, "^[^:]+:", "").alias("id")))


def approval_error(submitted: Column, asymmetric: Column, collision: Column, colliding: Column, default: Column) -> Column:
    """Null where the submitted id may be approved, else why not.

    A failed side's candidates (``asymmetric``, null where there are none) come first, then a
    collision's; otherwise it must be the default, if there is one.
    """
    failed = F.when(F.size(asymmetric) == 0, "no candidates").when(~F.array_contains(asymmetric, submitted), "not a candidate of the failed side")
    clash = F.when(~F.coalesce(F.array_contains(colliding, submitted), F.lit(False)), "not among the colliding")
    return F.when(asymmetric.isNotNull(), failed).when(collision, clash).when(default.isNotNull() & (submitted != default), "not the single candidate")


def approve(queue: DataFrame, fixtures: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next queue, the records that are linked, the new aliases.

    queue: rec, status, home_name, away_name.  approvals: rec, home_id, away_id, kickoff.
    Only pending rows are approved (another writer's win leaves them as they are).
    """
    ready = approvals.join(queue.filter("status = 'pending'"), "rec")
    known = ready.join(fixtures, ["home_id", "away_id", "kickoff"], "left")
    linked = known.withColumn("fixture_id", F.coalesce("fixture_id", F.substring(F.sha2(F.concat_ws("|", F.col("home_id").cast("string"), F.col("away_id").cast("string"), F.col("kickoff").cast("string")), 256), 1, 32)))
    closed = queue.join(linked.select("rec", F.lit(True).alias("done")), "rec", "left")
    queue = closed.withColumn("status", F.when(F.col("done"), "approved").otherwise(F.col("status"))).drop("done")
    side = lambda s: F.struct(F.col(f"{s}_name").alias("alias"), F.col(f"{s}_id").alias("team_id"))
    aliases = linked.select(F.explode(F.array(side("home"), side("away"))).alias("a")).select("a.*").filter("alias is not null").distinct()
    return queue, linked.select("rec", "fixture_id"), aliases


def reject(queue: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pending rows rejected, with a counter."""
    hit = queue.join(rejected.select("rec", F.lit(True).alias("hit")).distinct(), "rec", "left")
    yes = F.coalesce("hit", F.lit(False)) & (F.col("status") == "pending")
    return hit.withColumns({"rejection_count": F.col("rejection_count") + F.when(yes, 1).otherwise(0), "status": F.when(yes, "rejected").otherwise(F.col("status"))}).drop("hit")


def duplicate_clusters(members: DataFrame, record: str, team: str, least: int, largest: int) -> DataFrame:
    """Clusters (node, root) of teams that collide in ``least`` records; those larger than ``largest`` are left out."""
    pairs = collision_pairs(members, record, team, least)
    found = components(pairs)
    small = found.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") <= largest)
    return found.join(small.select("root"), "root", "left_semi")


def merge_groups(clusters: DataFrame, teams: DataFrame) -> DataFrame:
    """Canonical, dupe of clusters (node, root) in which just one full and one short name (``name_format``) name the same person.

    teams: id, name, created_at, aliases.  The older team stays, then the one with more aliases, then the longer name.
    """
    named = clusters.join(teams, clusters["node"] == teams["id"]).withColumn("kind", name_format(F.col("name"))).filter(F.col("kind") != "unclassified")
    one = named.groupBy("root").agg(F.count_if(F.col("kind") == "class_f").alias("f"), F.count_if(F.col("kind") == "class_s").alias("s")).filter("f = 1 and s = 1").select("root")
    rows = named.join(one, "root", "left_semi")
    row = lambda k: rows.filter(F.col("kind") == k).select("root", F.struct("created_at", (-F.col("aliases")).alias("a"), (-F.length("name")).alias("l"), "id", "name").alias(k))
    both = row("class_f").join(row("class_s"), "root").filter(format_match(F.col("class_f.name"), F.col("class_s.name")))
    return both.select(F.least("class_f", "class_s")["id"].alias("canonical"), F.greatest("class_f", "class_s")["id"].alias("dupe"))


def moving_aliases(groups: DataFrame, holders: DataFrame, lists: DataFrame) -> DataFrame:
    """Dupe, aliases: how many different aliases of a duplicate's lists the canonical team's lists don't have (``groups``: canonical, dupe).

    holders: team_id, list; a team has the aliases of all of its lists.  lists: list, alias.  Lists that many teams
    share are compared once for each different pair of holdings, not for each team.
    """
    held = holders.groupBy("team_id").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    side = lambda who, name: held.select(F.col("team_id").alias(who), F.col("lists").alias(name))
    none = F.coalesce("theirs", F.array().cast(held.schema["lists"].dataType))
    met = groups.select("canonical", "dupe").join(side("dupe", "own"), "dupe").join(side("canonical", "theirs"), "canonical", "left").withColumn("theirs", none).withColumn("case", F.struct("own", "theirs"))
    cases = met.select("case").distinct()
    of = lambda field: cases.select("case", F.explode(f"case.{field}").alias("list")).join(lists, "list").select("case", "alias").distinct()
    counted = of("own").join(of("theirs"), ["case", "alias"], "left_anti").groupBy("case").agg(F.count("*").alias("aliases"))
    return met.join(counted, "case").select("dupe", "aliases")


def phase_report(clusters: DataFrame, teams: DataFrame, aliases: DataFrame, fixtures: DataFrame, queue: DataFrame, only: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """The dry run of a merge phase: section, canonical, dupe, aliases, fixtures, queued, names.

    A ``merge_group`` (``merge_groups``) has the duplicate's aliases that the canonical team lacks, its fixtures and
    its rows in the queue (team_id, status; pending ones); a ``skipped`` cluster has its number of members as
    ``dupe``, its root as ``canonical`` and the names of its first 20 members by id.  With ``only``, one canonical's group;
    ValueError if there is none.  With ``lists`` (list, alias) the ``aliases`` are a team's lists (team_id, list).
    """
    groups = merge_groups(clusters, teams)
    merged = clusters.join(groups.select(F.col("dupe").alias("node")), "node", "left_semi").select("root")
    skipped = clusters.join(merged, "root", "left_anti").join(teams.select(F.col("id").alias("node"), "name"), "node", "left")
    if only is not None:
        groups = groups.filter(F.col("canonical") == only)
        if groups.isEmpty():
            raise ValueError(f"no merge group has the canonical team {only}")
    if lists is None:
        held = aliases.select(F.col("team_id").alias("canonical"), "alias").distinct()
        moving = aliases.select(F.col("team_id").alias("dupe"), "alias").distinct().join(groups, "dupe").join(held, ["canonical", "alias"], "left_anti").groupBy("dupe").agg(F.count("*").alias("aliases"))
    else:
        moving = moving_aliases(groups, aliases, lists)
    sides = fixtures.select("fixture_id", F.explode(F.array("home_id", "away_id")).alias("dupe")).distinct().groupBy("dupe").agg(F.count("*").alias("fixtures"))
    waits = queue.filter("status = 'pending'").groupBy(F.col("team_id").alias("dupe")).agg(F.count("*").alias("queued"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    done = groups.join(moving, "dupe", "left").join(sides, "dupe", "left").join(waits, "dupe", "left")
    done = done.select(F.lit("merge_group").alias("section"), "canonical", "dupe", zero("aliases"), zero("fixtures"), zero("queued"), F.lit(None).cast("array<string>").alias("names"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("node", "name"))), lambda x: F.coalesce(x["name"], x["node"].cast("string")))
    shown = top(skipped, ["root"], 20, F.col("node")).groupBy("root").agg(names.alias("names"))
    left = skipped.groupBy("root").agg(F.count("*").alias("dupe")).join(shown, "root")
    return done.unionByName(left.select(F.lit("skipped").alias("section"), F.col("root").alias("canonical"), "dupe", *[F.lit(None).cast("long").alias(c) for c in ("aliases", "fixtures", "queued")], "names"))


def pre_state(mapping: DataFrame, aliases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """What a merge changes, before it: for each duplicate its aliases and fixtures (sorted arrays)."""
    dup = mapping.filter("id <> canonical")
    a = aliases.groupBy(F.col("team_id").alias("id")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    sides = fixtures.select(F.explode(F.array("home_id", "away_id")).alias("id"), "fixture_id")
    f = sides.groupBy("id").agg(F.array_sort(F.collect_set("fixture_id")).alias("fixtures"))
    return dup.join(a, "id", "left").join(f, "id", "left")


def move_aliases(aliases: DataFrame, mapping: DataFrame) -> DataFrame:
    """Aliases of duplicates go to the canonical team unless it has them already."""
    m = mapping.select(F.col("id").alias("team_id"), "canonical")
    moved = aliases.join(m, "team_id", "left").select("alias", F.coalesce("canonical", "team_id").alias("team_id"))
    return moved.distinct()


def rollback(aliases: DataFrame, state: DataFrame) -> DataFrame:
    """Aliases of merged teams back to where they were; others stay.

    Aliases that came to the canonical team since the merge are no part of the state, so they stay too.
    """
    old = state.select(F.col("id").alias("team_id"), "canonical", F.explode("aliases").alias("alias"))
    kept = aliases.join(old.select("alias", F.col("canonical").alias("team_id")), ["alias", "team_id"], "left_anti")
    return kept.unionByName(old.select("alias", "team_id")).distinct()


def transition_guard(rows: DataFrame, key: str, seq: str, status: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose status may not follow the key's previous one."""
    from pyspark.sql import Window

    was = F.lag(status).over(Window.partitionBy(key).orderBy(seq))
    ok = F.concat_ws(">", was, status).isin(*[f"{a}>{b}" for a, b in allowed])
    return rows.withColumn("was", was).filter(F.col("was").isNotNull() & ~ok)


def reconcile(incoming: DataFrame, known: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """Id, team_id, basis: known teams whose distinctive tokens equal, or are a part or the whole of, an incoming team's.

    incoming: id, name.  known: team_id, known_name.  Teams that differ in a marker of reserves or
    women don't meet.  Tokens are looked up in lists; generic ones have none.  Each different name is compared once.
    """
    from skein.functions.domain import entity_marker
    from skein.functions.text import distinctive

    side = lambda d, n, p: d.select(n).distinct().select(n, distinctive(F.col(n), list(generic)).alias(f"{p}t"), entity_marker(F.col(n)).alias("marked"))
    a, b = side(incoming, "name", "a"), side(known, "known_name", "b")
    met = a.withColumn("token", F.explode("at")).join(b.withColumn("token", F.explode("bt")), ["token", "marked"]).select("name", "known_name", "at", "bt").distinct()
    less, more = F.size(F.array_except("at", "bt")), F.size(F.array_except("bt", "at"))
    return met.withColumn("basis", F.when((less == 0) & (more == 0), "exact-distinctive").when((less == 0) | (more == 0), "subset-distinctive")).filter("basis is not null").select("name", "known_name", "basis").join(known.select("team_id", "known_name"), "known_name").join(incoming.select("id", "name"), "name").select("id", "team_id", "basis")


def classify_teams(incoming: DataFrame, known: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """Id, action, matches: SKIP (the name is known, with a country), BACKFILL (known without one), BACKFILL-CANDIDATE (reconciled only), INSERT.

    incoming: id, name.  known: team_id, known_name, country.  Of several teams of one name the smallest id decides.
    """
    key = incoming.withColumn("key", normalize_name(F.col("name")))
    same = known.withColumn("key", normalize_name(F.col("known_name"))).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("team_id", "country")).alias("t"))
    found = key.join(same, "key", "left")
    names = found.filter("n is null").select(F.col("name").alias("id"), "name").distinct()
    near = reconcile(names, known, generic).groupBy(F.col("id").alias("name")).agg(F.count("*").alias("near"))
    done = found.join(near, "name", "left")
    empty = F.coalesce(F.col("key"), F.lit("")) == ""
    action = F.when(empty, "SKIP").when(F.col("n").isNotNull(), F.when(F.coalesce("t.country", F.lit("")) != "", "SKIP").otherwise("BACKFILL")).when(F.col("near") > 0, "BACKFILL-CANDIDATE").otherwise("INSERT")
    return done.select("id", action.alias("action"), F.coalesce("n", "near", F.lit(0)).alias("matches"))


def search_stage(stages: DataFrame, hints: DataFrame) -> DataFrame:
    """Hint, stage of the best stage for each hint (columns hint): the league's name equal (100), holding the hint (80) or held by it (60), then the stage's rank, then the smaller stage.

    stages: stage, league, stage_name.
    """
    from skein.functions.domain import bracket_stage_rank

    scored = _by_league(stages, hints).withColumn("rank", bracket_stage_rank(F.col("stage_name")))
    return latest(scored, ["hint"], F.col("score").desc(), F.col("rank").desc(), F.col("stage")).select("hint", "stage", "score")


def all_stages(stages: DataFrame, hints: DataFrame) -> DataFrame:
    """Hint, stage: all stages of a league of that name; without one, of leagues whose name holds the hint or is held by it."""
    scored = _by_league(stages, hints)
    exact = scored.filter("score = 100")
    return exact.unionByName(scored.join(exact.select("hint").distinct(), "hint", "left_anti")).select("hint", "stage")


def _runs(name: Column, sizes: tuple[int, ...]) -> Column:
    """The different runs of so many characters in a name."""
    of = lambda k: F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - (k - 1)), lambda i: F.substr(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


def holding(whole: DataFrame, part: DataFrame) -> DataFrame:
    """whole, part: the names that hold a part anywhere (columns whole, part; each name once).

    A part is looked up by that of its runs of three characters (the part itself if it is shorter) that the fewest
    names have, so it meets few names; without characters it is in all.
    """
    blank = F.array(F.lit(""))
    runs = whole.select("whole", F.explode(F.concat(_runs(F.col("whole"), (1, 2, 3)), blank)).alias("run"))
    own = F.when(F.length("part") >= 3, _runs(F.col("part"), (3,))).otherwise(F.array("part"))
    asked = part.select("part", F.explode(own).alias("run"))
    lengths = runs.join(asked.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    rarest = asked.join(lengths, "run").groupBy("part").agg(F.min(F.struct("n", "run")).alias("r")).select("part", "r.run")
    return runs.join(rarest, "run").filter(F.contains("whole", "part")).select("whole", "part")


def _by_league(stages: DataFrame, hints: DataFrame) -> DataFrame:
    """Stages and hints with the score of the league's name; different names and hints meet once."""
    league, h = F.lower(F.trim("league")), F.lower(F.trim("hint"))
    leagues, asked = stages.filter(F.trim("league") != "").select(league.alias("_l")).distinct(), hints.filter("hint is not null").select(h.alias("_h")).distinct()
    there = holding(leagues.select(F.col("_l").alias("whole")), asked.select(F.col("_h").alias("part"))).select(F.col("whole").alias("_l"), F.col("part").alias("_h"))
    back = holding(asked.select(F.col("_h").alias("whole")), leagues.select(F.col("_l").alias("part"))).select(F.col("part").alias("_l"), F.col("whole").alias("_h"))
    score = F.when(F.col("_l") == F.col("_h"), 100).when(F.contains("_l", "_h"), 80).otherwise(60)
    met = there.unionByName(back).distinct().withColumn("score", score)
    return stages.withColumn("_l", league).join(met, "_l").join(hints.withColumn("_h", h), "_h").drop("_l", "_h")


def markdown(rows: list, columns: list[str], title: str) -> str:
    """A table of a small report that was collected."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *(f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows)]
    return "\n".join(lines) + "\n"


def mine_failures(log: DataFrame, sport: str, since: Column, number: str = "reason_detail") -> DataFrame:
    """Raw, normalized and country_hint of each provider name in a sport's newest failures since a time (columns reason_detail, reason_code, decided_at).

    Of failures of one time those with the greater ``number`` (a column of the log) are the newer ones.
    """
    detail = log.withColumn("detail", F.try_parse_json("reason_detail"))
    field = lambda key: F.try_variant_get("detail", f"$.{key}", "variant")
    said = lambda key: F.when(F.schema_of_variant(field(key)) == "STRING", F.regexp_replace(F.try_variant_get("detail", f"$.{key}", "string"), r"^\s+|\s+$", ""))
    failed = detail.filter((F.try_variant_get("detail", "$.sport", "string") == sport) & F.col("reason_code").isin("no_match", "review_queue") & (F.col("decided_at") >= since))
    newest = failed.orderBy(F.col("decided_at").desc(), F.col(number).desc()).limit(MINED)
    hint = F.coalesce(*[F.nullif(said(k), F.lit("")) for k in COUNTRY_KEYS], F.lit(""))
    names = newest.select(F.explode(F.array(*[said(k) for k in NAME_KEYS])).alias("raw"), hint.alias("country_hint"))
    return names.select("raw", normalize_name(F.col("raw")).alias("normalized"), "country_hint").filter("normalized <> ''")


def suggested(failed: DataFrame, teams: DataFrame, floor: float = 0.30, top_n: int = 3) -> tuple[DataFrame, DataFrame]:
    """The state of each failed record, and its sides' nearest teams (rec, side, team_id, rank).

    failed: rec, sport, home, away (parsed names, null where unknown).  teams: team_id, sport, name.
    States: unclassified (no sport), no_parsed_names, no_good_candidates, ok.
    """
    from skein.operators.joins import trigram_top

    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("name"))
    each = failed.filter(F.col("sport").isNotNull()).select("rec", "sport", F.inline(F.array(side("home"), side("away")))).filter(F.coalesce("name", F.lit("")) != "").withColumn("nid", F.xxhash64("sport", "name"))
    names = each.select("nid", "sport", "name").distinct()
    near = trigram_top(names, teams, "nid", "name", "team_id", "name", floor, top_n, ["sport"])
    offered = each.join(near, each["nid"] == near["lid"]).select("rec", "side", F.col("rid").alias("team_id"), "rank")
    known, good = each.select("rec", F.lit(True).alias("named")).distinct(), offered.select("rec", F.lit(True).alias("good")).distinct()
    state = F.when(F.col("sport").isNull(), "unclassified").when(F.col("named").isNull(), "no_parsed_names").when(F.col("good").isNull(), "no_good_candidates").otherwise("ok")
    return failed.join(known, "rec", "left").join(good, "rec", "left").select("rec", state.alias("state")), offered


def best_reference(failures: DataFrame, roster: DataFrame, threshold: float, generic: tuple[str, ...], country: str = "") -> DataFrame:
    """Alias, team_id, score, reference, n, raw of each failure's best reference, by the token-set ratio of distinctive tokens.

    failures: raw, normalized, country_hint; those that hint at another country are left out.
    roster: team_id, reference.  Of equal scores the smaller reference and team count.
    """
    from skein.functions.similarity import token_set_ratio
    from skein.functions.text import distinctive
    from skein.operators.resolve import team_scores

    here = F.coalesce(F.nullif(F.trim("country_hint"), F.lit("")), F.lit(country))
    asked = failures.filter(F.contains(F.lower(here), F.lit(country.strip().lower()))) if country.strip() else failures
    bare = lambda c: F.array_join(F.array_sort(distinctive(c, list(generic))), " ")
    names = asked.select(bare(F.col("normalized")).alias("name"), F.lit("").alias("sport")).filter("name <> ''").distinct()
    refs = roster.select("team_id", "reference", bare(F.col("reference")).alias("name"), F.lit("").alias("sport")).filter("name <> ''").withColumn("rid", F.xxhash64("team_id", "reference"))
    scored = team_scores(names, refs.select(F.col("rid").alias("team_id"), "sport", "name"), token_set_ratio, threshold, True).select("name", F.col("team_id").alias("rid"), "score")
    best = latest(scored.join(refs.select("rid", "team_id", "reference"), "rid"), ["name"], F.col("score").desc(), F.col("reference"), F.col("team_id"))
    met = asked.withColumn("name", bare(F.col("normalized"))).join(best, "name")
    return met.groupBy(F.col("normalized").alias("alias"), "team_id").agg(F.max("score").alias("score"), F.max_by("reference", "score").alias("reference"), F.count("*").alias("n"), F.min("raw").alias("raw"))


def three_way(candidates: DataFrame, audited: DataFrame) -> DataFrame:
    """Candidates (id) by what an audit (id, verdict) says: safe, known or colliding."""
    return candidates.join(audited.select("id", "verdict"), "id").withColumn("split", F.when(F.col("verdict") == "clean", "safe").when(F.col("verdict") == "same_team", "known").otherwise("colliding")).drop("verdict")


def latest_versions(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """The latest log row of each (provider, record) of ``pairs``."""
    mine = log.join(pairs, ["provider", "record"], "left_semi")
    return latest(mine, ["provider", "record"], F.col("decided_at").desc(), F.col("id").desc())


def audit_aliases(proposed: DataFrame, existing: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``proposed`` (id, alias, team) with ``verdict``: colliding where another team holds the alias, same_team where only the own one does, else clean.

    ``existing``: alias, team.  Aliases of ``excluded`` teams (about to be deleted) count as free.
    """
    held = existing.join(excluded, "team", "left_anti") if excluded is not None else existing
    owners = held.select("alias", F.col("team").alias("owner")).distinct().groupBy("alias").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    other = (F.col("low") != F.col("team")) | (F.col("high") != F.col("team"))
    return proposed.join(owners, "alias", "left").withColumn("verdict", F.when(F.col("low").isNull(), "clean").when(other, "colliding").otherwise("same_team")).drop("low", "high")
