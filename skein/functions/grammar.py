"""Ticker grammar: ordered patterns over the part of a ticker after its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Market suffixes, in the order in which they are tried.
KNOWN_SUFFIXES = (
    "TCORNERS", "CORNERS", "ADVANCE", "BTTS", "TOTALMAPS", "SETWINNER", "SPREAD", "TOTAL", "MATCH", "GAME", "HALFTIME", "OVERTIME",
    "1H", "2H", "1Q", "2Q", "3Q", "4Q", "F5", "RFI", "MAP", "FIGHT", "DISTANCE", "ROUNDS", "VICROUND", "MOV", "MOF", "OUTRIGHT",
)
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Series that are outrights although their tickers look like fixtures.
OUTRIGHT_PREFIXES = (
    "KXJOIN", "KXNEXTTEAM", "KXNEXTMANAGER", "KXMANAGERSOUT", "KXCOACHOUT", "KXCOACHONDATE", "KXMLBTRADE", "KXNFLTRADE", "KXSOCCERTRANSFER",
    "KXF1RETIRE", "KXARODGRETIRE", "KXKELCERETIRE", "KXLBJRETIRE", "KXPERSONUNRETIRE", "KXSOCCERPLAY", "KXPLAYWC", "KXPGACURRY", "KXPGATIGER",
    "KXSCOTTIESLAM", "KXLAMINEYAMAL", "KXBRYSONCOURSERECORDS", "KXFURYJOSHUA", "KXFLOYDTYSONFIGHT", "KXMCGREGORFIGHTNEXT", "KXCALCFO", "KXSORONDO",
    "KXGRANDSLAMJ", "KXGRANDSLAM", "KXNYKCOACH", "KXCARDPRESENCE", "KXSPORTSOWNERLBJ", "KXNBAATTEND", "KXSHAI20PTREC", "KXNBA2KCOVER", "KXNDJOINCONF",
    "KXDONATEMRBEAST", "KXCOVEREA", "KXPGAMAJORWIN", "KX1STHOMEGAME", "KXRELOCATION", "KXNBASEATTLE", "KXSONICS", "KXCITYNBA", "KXNBATEAM",
    "KXFIFAUSPULL", "KXWCIRAN", "KXWCLOCATION", "KXWCMESSIRONALDO", "KXWCROUND", "KXWCSQUAD", "KXWCGROUP", "KXSTARTINGQB", "KXNBARETURN",
    "KXNBADRAFT", "KXNFLDRAFT", "KXNBAPLAYOFF", "KXMLBTB", "KXMLBHR", "KXMLBHRR", "KXNBASTL", "KXEUROVISIONISRAELBAN", "KXPIZZASCORE",
    "KXCOLLEGEGAMEDAYGUEST", "KXWSOPENTRANTS", "KXQUADRUPLEDOUBLE", "KXARSENALCUPS", "KXPAVIAPRESEASON", "KXMLSJOIN", "KXRANKLISTFF", "KXOWGRRANK",
    "KXCHESSFIDERATING", "KXLIVOCCUR", "KXWNBADELAY", "KXWNBAGAMESPLAYED", "KXWNBADRAFT", "KXMARMAD", "KXNCAAMBNEXTCOACH", "KXSTEPHDEAL",
)
OUTRIGHT_PARTS = ("MENTION",)

_DATE = r"(\d{2})([A-Z]{3})(\d{2})"
FIELDS = ("kind", "date", "time", "abbr_block", "leg_n", "handle", "year", "round_n")


def split_suffix(series: Column) -> Column:
    """struct(base, suffix); the first known suffix that ends the series and leaves something of it."""
    s = F.upper(F.coalesce(series, F.lit("")))
    hit = F.coalesce(*[F.when(s.endswith(x) & (F.length(s) > len(x)), F.lit(x)) for x in KNOWN_SUFFIXES], F.lit(""))
    return F.struct(F.substring(s, F.lit(1), F.length(s) - F.length(hit)).alias("base"), hit.alias("suffix"))


def after_series(event: Column, series: Column) -> Column:
    """what follows the series (or a known suffix glued to it) and a dash; else what follows the first dash."""
    e, s = F.upper(F.coalesce(event, F.lit(""))), F.upper(F.coalesce(series, F.lit("")))
    rest = F.when((s != "") & e.startswith(s), F.substr(e, F.length(s) + 1))
    glued = F.coalesce(*[F.when(rest.startswith(f"{x}-"), F.substr(rest, F.lit(len(x) + 2))) for x in KNOWN_SUFFIXES])
    plain = F.when(F.instr(e, "-") > 0, F.substr(e, F.instr(e, "-") + 1)).otherwise(e)
    return F.coalesce(F.when(rest.startswith("-"), F.substr(rest, F.lit(2))), glued, plain)


def is_outright(base: Column) -> Column:
    """A series that begins with an outright's prefix or has an outright's part."""
    s = F.upper(F.coalesce(base, F.lit("")))
    return s.rlike(f"^({'|'.join(OUTRIGHT_PREFIXES)})") | s.rlike("|".join(OUTRIGHT_PARTS))


def ticker(event: Column, series: Column) -> Column:
    """the identity of an event of a series (both are computed columns, so keep them small)."""
    return identity(after_series(event, series), is_outright(split_suffix(series)["base"]))


def short_date(yy: Column, mmm: Column, dd: Column) -> Column:
    """``26 MAY 07`` as a date of this century; null where there is none."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(mmm))
    return F.try_to_date(F.when(month > 0, F.concat(F.lit("20"), yy, F.lpad(month.cast("string"), 2, "0"), dd)), "yyyyMMdd")


def identity(suffix: Column, outright: Column) -> Column:
    """the first pattern that fits (and whose date exists), as a struct of FIELDS."""

    def fit(pattern: str, names: str, kind: str) -> Column:
        part = {n: F.regexp_extract(suffix, pattern, i + 1) for i, n in enumerate(names.split())}
        date = short_date(part["yy"], part["mmm"], part["dd"]) if "yy" in part and "mmm" in part else F.lit(None).cast("date")
        given = {"kind": F.lit(kind), "date": date} | {n: part[n] for n in ("time", "abbr_block", "handle") if n in part}
        given |= {n: part[n].cast("int") for n in ("leg_n", "year", "round_n") if n in part}
        empty = {n: F.lit(None).cast("int" if n in ("leg_n", "year", "round_n") else "date" if n == "date" else "string") for n in FIELDS}
        found = suffix.rlike(pattern)
        return F.when(found & date.isNotNull() if "mmm" in part else found, F.struct(*[c.alias(n) for n, c in (empty | given).items()]))

    def both(kind: str) -> list[Column]:
        year = [(r"^(\d{4})$", "year"), (r"^(\d{1,3})$", "year"), (r"^(\d{2,4})([A-Z][A-Z0-9]*)$", "year handle"), (r"^([A-Z][A-Z0-9]*?)(\d{2,4})$", "handle year"), (r"^([A-Z][A-Z0-9]*)$", "handle")]
        return [fit(p, n, kind if "handle" in n else "outright") for p, n in year]

    future = [
        fit(rf"^{_DATE}([A-Z0-9]+)$", "yy mmm dd handle", "outright"),
        fit(rf"^{_DATE}(\d{{4}})([A-Z0-9]+?)$", "yy mmm dd time handle", "outright"),
        fit(rf"^{_DATE}$", "yy mmm dd", "outright"),
        *both("outright"),
        fit("^", "", "outright"),
    ]
    other = [
        fit(rf"^{_DATE}(\d{{4}})([A-Z0-9]+?)-(\d+)$", "yy mmm dd time abbr_block leg_n", "per_leg"),
        fit(rf"^{_DATE}([A-Z0-9]+?)-(\d+)$", "yy mmm dd abbr_block leg_n", "per_leg"),
        fit(rf"^{_DATE}(\d{{4}})([A-Z0-9]+?)$", "yy mmm dd time abbr_block", "per_fixture"),
        fit(rf"^{_DATE}([A-Z0-9]+)$", "yy mmm dd abbr_block", "per_fixture"),
        fit(r"^(\d{2})([A-Z][A-Z0-9]*?)R(\d+)$", "year abbr_block round_n", "series"),
        fit(rf"^{_DATE}$", "yy mmm dd", "outright"),
        *both("tournament"),
        fit("^", "", "unparsed"),
    ]
    return F.when(outright, F.coalesce(*future)).otherwise(F.coalesce(*other))


def with_identity(df: DataFrame, suffix: Column, outright: Column) -> DataFrame:
    """``df`` with ``i``, the identity of a ticker's suffix, computed once for each row however many of its fields are read."""
    return df.select("*", F.inline(F.array(F.struct(identity(suffix, outright).alias("i")))))


def minutes(hhmm: Column) -> Column:
    """minutes of the day."""
    return F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 3, 2).cast("int")


def parse_title(title: Column) -> Column:
    """struct(home, away): ``A vs B``, ``A at B`` (which swaps), ``Will A beat B``, ``A - B``."""
    patterns = ((r"(?i)^(.+?)\s+(?:vs\.?|v\.?)\s+(.+?)\??$", 1, 2), (r"(?i)^(.+?)\s+(?:at|@)\s+(.+?)\??$", 2, 1), (r"(?i)^will\s+(.+?)\s+beat\s+(.+?)\??$", 1, 2), (r"^(.+?)\s+[-–]\s+(.+?)$", 1, 2))
    return F.coalesce(*[F.when(title.rlike(p), F.struct(F.trim(F.regexp_extract(title, p, h)).alias("home"), F.trim(F.regexp_extract(title, p, a)).alias("away"))) for p, h, a in patterns])


def split_title(title: Column) -> Column:
    """struct(home, away) around the first ``vs``, ``v``, ``at`` or ``@``; the last two put the home side second."""
    p = r"(?is)^(.*?)\s+(vs\.?|v\.?|@|at)\s+(.*)$"
    part = lambda i: F.trim(F.regexp_extract(title, p, i))
    turned = F.lower(part(2)).isin("at", "@")
    return F.when(title.rlike(p), F.struct(F.when(turned, part(3)).otherwise(part(1)).alias("home"), F.when(turned, part(1)).otherwise(part(3)).alias("away")))


def parent_identity(identity: Column) -> Column:
    """A leg's identity as its fixture's; others as they are."""
    leg = identity["kind"] == "per_leg"
    fields = [F.when(leg, F.lit("per_fixture") if n == "kind" else F.lit(None)).otherwise(identity[n]).alias(n) if n in ("kind", "leg_n") else identity[n].alias(n) for n in FIELDS]
    return F.when(identity.isNotNull(), F.struct(*fields))
