from __future__ import annotations

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from skein.functions import grammar, prices, text
from skein.functions.similarity import indel, token_set


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(column.alias("v")).first().v if given else spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("event, series, outright, kind, fields", [
    ("KXUCLGAME-26MAY05ARSATM", "KXUCLGAME", False, "per_fixture", {"date": dt.date(2026, 5, 5), "abbr_block": "ARSATM"}),
    ("KXMLBGAME-26MAY051930NYYBOS", "KXMLB", False, "per_fixture", {"time": "1930", "abbr_block": "NYYBOS"}),
    ("KXDOTA2MAP-26MAY05LIQSPI-2", "KXDOTA2MAP", False, "per_leg", {"leg_n": 2, "abbr_block": "LIQSPI"}),
    ("KXNBASERIES-26BOSNYKR1", "KXNBASERIES", False, "series", {"year": 26, "round_n": 1}),
    ("KXIPL-26", "KXIPL", False, "outright", {"year": 26}),
    ("KXPGA-PGC26", "KXPGA", False, "tournament", {"handle": "PGC", "year": 26}),
    ("KXJOINCLUB-26OCT02RODRYGO", "KXJOINCLUB", True, "outright", {"handle": "RODRYGO", "date": dt.date(2026, 10, 2)}),
    ("KXUCLGAME-26FEB30ARSATM", "KXUCLGAME", False, "tournament", {"date": None}),
    ("KXUCL-?", "KXUCL", False, "unparsed", {}),
])
def test_identity(spark, event, series, outright, kind, fields):
    rest = grammar.after_series(F.lit(event), F.lit(series))
    found = spark.range(1).select(rest.alias("s")).select(grammar.identity(F.col("s"), F.lit(outright)).alias("i")).first().i
    assert found.kind == kind
    for k, v in fields.items():
        assert found[k] == v


def test_outright_series(spark):
    for series, want in {"KXJOINCLUB": True, "KXFOXMENTION": True, "KXUCLGAME": False, "": False, None: False}.items():
        assert value(spark, grammar.is_outright(F.lit(series).cast("string"))) is want
    found = value(spark, grammar.ticker(F.lit("KXMLBHR-26MAY05JUDGE"), F.lit("KXMLBHR")))
    assert (found.kind, found.handle) == ("outright", "JUDGE")


def test_suffix_order(spark):
    for series, want in {"KXEPLGAME": ("KXEPL", "GAME"), "KXUCLTCORNERS": ("KXUCL", "TCORNERS"), "GAME": ("GAME", ""), "KXNBA1H": ("KXNBA", "1H"), None: ("", "")}.items():
        assert tuple(value(spark, grammar.split_suffix(F.lit(series).cast("string")))) == want


def test_names(spark):
    for raw, want in {"Atlético  Madrid!": "atletico madrid", "São_Paulo 04": "sao_paulo 04", "": ""}.items():
        assert value(spark, text.normalize_name(F.lit(raw))) == want
    s = value(spark, text.structural_name(F.lit("Kecmanović M. (SRB)"), F.lit("Tennis")))
    assert (s.path, s.surname, s.others) == ("personal_initial", "kecmanovic", ["m"])
    s = value(spark, text.structural_name(F.lit("Carlos Alcaraz Garfia Jr"), F.lit("tennis")))
    assert (s.path, s.surname, s.others) == ("personal_multi", "garfia", ["carlos", "alcaraz"])
    assert value(spark, text.structural_name(F.lit(" ( )"), F.lit("soccer"))) is None
    assert value(spark, text.trigrams(F.lit("cat"))) == ["  c", " ca", "cat", "at "]
    assert value(spark, text.surname_readings(F.split(F.lit("ana maria de la cruz"), " "))) == ["cruz", "la cruz", "la"]
    assert value(spark, text.initials_compatible(F.split(F.lit("j p"), " "), F.split(F.lit("juan pedro"), " "))) is True
    assert value(spark, text.initials_compatible(F.split(F.lit("x"), " "), F.split(F.lit("juan"), " "))) is False


def test_prices(spark):
    for said, want in {"0.4200": 42, "42": 42, "0.145": 14, " ": None, "x": None}.items():
        assert value(spark, prices.to_cents(F.lit(said))) == want
    assert value(spark, prices.nearest_rank(F.array(*map(F.lit, [5, 1, 9, 3])), 0.5)) == 5
    assert value(spark, prices.low_rank(F.array(*map(F.lit, range(1, 21))), 0.95)) == 19
    assert value(spark, prices.clock_seconds(F.lit("12:34"))) == 754
    assert value(spark, grammar.parse_title(F.lit("Will Arsenal beat Atletico?"))).away == "Atletico"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarities():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in "xy")
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a and b else float(a == b)
        assert indel(a, b) == pytest.approx(want)
        assert indel(a, b) >= SequenceMatcher(None, a, b, autojunk=False).ratio() - 1e-9
    assert token_set("real sociedad", "real sociedad ii") == 1.0
    assert token_set("real madrid", "") == 0.0
    assert token_set("manchester united", "manchester city") < 1
