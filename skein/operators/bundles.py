"""Reports as files: a line is a row, Spark orders the lines by ranges and writes a folder for each bundle and file.

Lines have bundle, file, section, rank, by, line.  A bundle of any size is dealt over tasks: its part
files, in the order of their names, are the file.  No report passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.storage import shared_path, stored

_ORDER = ("bundle", "file", "section", "rank", "by", "line")
# What a team, a pair and a proposed alias can be classed as, in the order of the reports.
ACTIONS = ("INSERT", "BACKFILL", "BACKFILL-CANDIDATE", "SKIP")
PAIRS = ("ALIAS-LINK", "MERGE-REQUIRED")
VERDICTS = ("clean", "same_team", "colliding")


def bundle_name(name: Column) -> Column:
    """A bundle's name; null and empty ones are ``Unknown``."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Unknown"))


def _cell(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit("-"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in cells]), F.lit(" |"))


def _json(*fields: str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def line(file: str, section: int, said: Column, rank: Column | None = None, by: Column | None = None, when: Column | None = None) -> Column:
    """A line of ``file`` (null where ``when`` isn't true); sections, then ``rank`` and ``by``, give the order."""
    rank, by = F.lit(0) if rank is None else rank, F.lit("") if by is None else by
    made = F.struct(F.lit(file).alias("file"), F.lit(section).alias("section"), rank.cast("double").alias("rank"), F.coalesce(by.cast("string"), F.lit("")).alias("by"), said.alias("line"))
    return made if when is None else F.when(when, made)


def heading(file: str, section: int, *said: Column | str, when: Column | None = None) -> list[Column]:
    """Several lines in the order given; texts are literals."""
    return [line(file, section, F.lit(x) if isinstance(x, str) else x, F.lit(i), when=when) for i, x in enumerate(said)]


def table(file: str, section: int, title: str, columns: dict[str, Column], some: Column, rank: Column | None = None, by: Column | None = None, when: Column | None = None) -> tuple[list[Column], Column]:
    """A titled table: the lines around it, for a bundle that has ``some`` of its rows, and the line of a row."""
    around = [*heading(file, section, f"## {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", when=some), line(file, section + 2, F.lit(""), when=some)]
    return around, line(file, section + 1, _row(*columns.values()), rank, by, when)


def emit(rows: DataFrame, said: list[Column]) -> DataFrame:
    """All lines of each row in one pass over ``rows``."""
    return rows.select("bundle", F.inline(F.array_compact(F.array(*said))))


def write_lines(parts: list[DataFrame], label: str) -> str:
    """The folder under which each (bundle, file) is written in the lines' order."""
    said = reduce(DataFrame.unionByName, parts)
    path = shared_path(said.sparkSession, label)
    said.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("bundle", "file", "line").write.partitionBy("bundle", "file").text(path)
    return path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """bundle, file, line of written lines; ``part``, ``start`` and ``at`` give their order within a file."""
    read = spark.read.schema("line string, bundle string, file string").text(path)
    return read.select("bundle", "file", "line", F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


# ---- K17


def phantoms(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """bundle, phantom, winner: each phantom with the smallest winner of its pairs; of pairs of classes all ``members`` (bundle, id, class) of a phantom's."""
    going = pairs.filter("phantom is not null").groupBy("bundle", "phantom").agg(F.min("winner").alias("winner"))
    if members is None:
        return going
    return going.join(members.withColumnRenamed("class", "phantom"), ["bundle", "phantom"]).select("bundle", F.col("id").alias("phantom"), "winner")


def index(teams: DataFrame, pairs: DataFrame, proposals: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A row for each bundle: its teams by action, pairs by class, proposed aliases by verdict, phantoms to release.

    teams: bundle, id, name, country, action.  pairs: bundle, anchor, partner, n_anchor, n_partner, classification,
    winner, phantom.  proposals: bundle, alias, team, verdict.  A phantom of several pairs counts once.  With ``members``
    (bundle, id, class) the pairs are those of classes, which they stand for.
    """
    count = lambda df, kind: df.groupBy("bundle", F.col(kind).alias("what")).agg(F.count("*").alias("n"))
    going = phantoms(pairs, members).groupBy("bundle", F.lit("phantom").alias("what")).agg(F.count("*").alias("n"))
    counted = count(teams, "action").unionByName(count(pairs, "classification")).unionByName(count(proposals, "verdict")).unionByName(going)
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    names = {x: x.lower().replace("-", "_") for x in (*ACTIONS, *PAIRS, *VERDICTS)} | {"phantom": "phantoms"}
    return counted.groupBy("bundle").agg(*[of(x).alias(name) for x, name in names.items()])


def league_bundles(summary: DataFrame, teams: DataFrame, pairs: DataFrame, proposals: DataFrame, members: DataFrame | None = None) -> list[DataFrame]:
    """The lines of each bundle's files: classification, fragmentation, audited aliases, phantoms to release, and a seed of the teams to insert.

    ``summary`` is ``index`` of the others.  With ``members`` a file says the class of each team.  A file has the tables that have rows; without any it says how many there are.
    """
    n = lambda label, field: F.concat(F.lit(f"- {label}: "), F.col(field).cast("string"))
    title = lambda what: F.concat(F.lit("# "), F.col("bundle"), F.lit(f": {what}"))
    order = lambda *by: F.concat_ws("\0", *[F.col(c).cast("string") for c in by])
    field = lambda kind: kind.lower().replace("-", "_")

    top = heading("classification.md", 0, title("classification"), "", *[n(a, field(a)) for a in ACTIONS], "")
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    around, team = table("classification.md", 1, "Teams", {c if c != "action" else "class": F.col(c) for c in ("action", "id", "name", "country")}, reduce(Column.__or__, [F.col(field(a)) > 0 for a in ACTIONS]), place, order("name", "id"))
    of_teams = [team, line("seed.jsonl", 0, _json("id", "name", "country"), by=order("name", "id"), when=F.col("action") == "INSERT")]

    top += [*around, *heading("fragmentation.md", 0, title("fragmentation"), "", *[n(p, field(p)) for p in PAIRS], "")]
    sides, of_pairs = {"anchor": F.col("anchor"), "fixtures": F.col("n_anchor"), "partner": F.col("partner"), "partner's fixtures": F.col("n_partner")}, []
    for i, (kind, more) in enumerate(zip(PAIRS, ({"winner": F.col("winner"), "phantom": F.col("phantom")}, {}), strict=True)):
        around, pair = table("fragmentation.md", 1 + 3 * i, kind, sides | more, F.col(field(kind)) > 0, by=order("anchor", "partner"), when=F.col("classification") == kind)
        top, of_pairs = [*top, *around], [*of_pairs, pair]

    top += heading("aliases_audited.md", 0, title("aliases"), "", *[n(v, v) for v in VERDICTS], "")
    of_proposals = []
    for i, v in enumerate(VERDICTS):
        around, alias = table("aliases_audited.md", 1 + 3 * i, v, {"alias": F.col("alias"), "team": F.col("team")}, F.col(v) > 0, by=order("alias", "team"), when=F.col("verdict") == v)
        top, of_proposals = [*top, *around], [*of_proposals, alias]

    top += heading("phantom_release.md", 0, title("phantoms to release"), "", n("phantoms", "phantoms"), "")
    around, phantom = table("phantom_release.md", 1, "Release first, then add the clean aliases", {"phantom": F.col("phantom"), "winner": F.col("winner")}, F.col("phantoms") > 0, by=F.col("phantom"))
    of_members = [] if members is None else [emit(members, [line("team_classes.jsonl", 0, _json("id", "class"), by=order("class", "id"))])]
    return [emit(summary, top + around), emit(teams, of_teams), emit(pairs, of_pairs), emit(proposals, of_proposals), emit(phantoms(pairs, members), [phantom]), *of_members]


def write_bundles(teams: DataFrame, pairs: DataFrame, proposals: DataFrame, members: DataFrame | None = None) -> str:
    """All bundles' files and the index, written in one go; null and empty bundle names are ``Unknown``."""
    named = [stored(df.withColumn("bundle", bundle_name(F.col("bundle"))), "bundled") for df in (teams, pairs, proposals, *([] if members is None else [members]))]
    summary = stored(index(*named), "index")
    return write_lines([*league_bundles(summary, *named), *index_lines(summary)], "bundles")


def index_lines(summary: DataFrame) -> list[DataFrame]:
    """The index of all bundles, as a table and as JSON lines, in the bundle ``all``."""
    counts = [c for c in summary.columns if c != "bundle"]
    rows = summary.select(F.col("bundle").alias("league"), *counts, F.lit("all").alias("bundle"))
    total = rows.groupBy("bundle").agg(F.count("*").alias("leagues"), *[F.sum(c).alias(c) for c in counts])
    n = lambda c: F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))
    around, league = table("index.md", 1, "Leagues", {c: F.col(c) for c in ("league", *counts)}, F.lit(True), by=F.col("league"))
    top = heading("index.md", 0, "# Index", "", *[n(c) for c in ("leagues", *counts)], "")
    return [emit(total, top + around), emit(rows, [league, line("index.jsonl", 0, _json("league", *counts), by=F.col("league"))])]


def enumeration(stages: DataFrame) -> list[DataFrame]:
    """The catalogue of leagues by country, those without one (or ``Unknown``) last, with how many stages each has, and a JSON line for each stage.

    stages: country, league, stage_id, stage.  A stage named twice in a league counts once, by its smallest name.
    """
    each = stages.groupBy(bundle_name(F.col("country")).alias("country"), "league", "stage_id").agg(F.min("stage").alias("stage")).withColumn("bundle", F.lit("all"))
    each = stored(each, "stages")
    leagues = each.groupBy("bundle", "country", "league").agg(F.count("*").alias("stages"))
    total = leagues.groupBy("bundle").agg(F.count("*").alias("leagues"), F.sum("stages").alias("stages"))
    last, name = F.when(F.lower("country") == "unknown", 1).otherwise(0), F.concat_ws("\0", F.lower("country"), F.lower("league"))
    n = lambda c: F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))
    around, league = table("enumeration.md", 1, "By country", {c: F.col(c) for c in ("country", "league", "stages")}, F.lit(True), last, name)
    top = heading("enumeration.md", 0, "# Leagues", "", n("leagues"), n("stages"), "")
    of_stage = line("enumeration.jsonl", 0, _json("country", "league", "stage_id", "stage"), last, F.concat_ws("\0", name, F.col("stage_id").cast("string")))
    return [emit(total, top + around), emit(leagues, [league]), emit(each, [of_stage])]


# ---- K16


def harvest(candidates: DataFrame) -> list[DataFrame]:
    """Each bundle's harvest: candidates by verdict with the most frequent first, and all of them as JSON lines.

    candidates: bundle, alias, raw, team, reference, n (occurrences), score, verdict (clean, same_team, colliding).
    """
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    summary = candidates.groupBy("bundle").agg(F.count("*").alias("all"), F.sum("n").alias("occurrences"), *[of(v) for v in VERDICTS])
    n = lambda label: F.concat(F.lit(f"- {label}: "), F.col(label).cast("string"))
    top = heading("harvest_report.md", 0, F.concat(F.lit("# "), F.col("bundle"), F.lit(": alias harvest")), "", n("all"), n("occurrences"), *[n(v) for v in VERDICTS], "")
    columns = {"occ": F.col("n"), "alias": F.col("alias"), "example": F.col("raw"), "team": F.col("team"), "reference": F.col("reference"), "conf": F.format_string("%.2f", F.col("score"))}
    order = F.concat_ws("\0", "alias", F.col("team").cast("string"))
    found = [line("harvest_candidates.jsonl", 0, _json("verdict", "alias", "raw", "team", "reference", "n"), -F.col("n"), order)]
    for i, v in enumerate(VERDICTS):
        around, row = table("harvest_report.md", 1 + 3 * i, v, columns, F.col(v) > 0, -F.col("n"), order, F.col("verdict") == v)
        top, found = [*top, *around], [*found, row]
    return [emit(summary, top), emit(candidates, found)]
