"""Paginated feeds and dated buckets."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skein.operators import dated_index
from skein.sources.pages import page_rows, read_pages, sport_counts


@pytest.fixture
def feed(tmp_path):
    def land(pages):
        for i, page in enumerate(pages, 1):
            (tmp_path / f"p{i}.json").write_text(page if isinstance(page, str) else json.dumps(page))
        return f"file://{tmp_path}/p{{page}}.json"

    return land


def page(*sports, **more):
    return {"data": [{"_sport": s} if s else {"sport": "x y"} for s in sports], **more}


def counts(spark, template, **options):
    return {r.sport: r.n for r in sport_counts(read_pages(spark, template, gap=0, **options)).collect()}


def test_the_page_that_says_so_is_the_last(spark, feed):
    assert counts(spark, feed([page("a", "", has_more=True), {"events": [{"sport": "b"}, {"sport": ""}, {}], "next": "u"}, page("a"), page("c", next=1)])) == {"A": 2, "X_Y": 1, "B": 1}


def test_empty_and_broken_pages_end_a_feed(spark, feed):
    assert counts(spark, feed([page("a", has_more=True), {"data": []}, page("b")])) == {"A": 1}
    assert counts(spark, feed([page("a", has_more=True), "no json", page("b")])) == {"A": 1}
    assert counts(spark, feed([page("a", has_more=True), "[1]", page("b")])) == {"A": 1}
    assert counts(spark, feed(["{}"])) == {}


def test_no_more_pages_than_the_cap(spark, feed):
    template = feed([page("a", has_more=True) for _ in range(130)])
    assert counts(spark, template) == {"A": 100} and counts(spark, template, cap=7) == {"A": 7} and counts(spark, template, cap=900) == {"A": 100}


def test_attempts_are_repeated(monkeypatch):
    said = iter([OSError("down"), b"{", json.dumps(page("a")).encode()])

    def fetched(*_):
        found = next(said)
        if isinstance(found, Exception):
            raise found
        return found

    monkeypatch.setattr("skein.sources.pages._fetch", fetched)
    assert [r[3] for r in page_rows("p{page}", 1, 3, 0)] == [False]


def test_an_index_is_neither_shuffled_nor_left_incomplete(spark):
    records = spark.range(400).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 3571).alias("seconds"))
    probes = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("probe"), (F.col("id") * 7013).alias("at"))
    index = dated_index.build(records, "k", "seconds", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = dated_index.within(index, probes, "k", "seconds", "at", 100_000)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        want = records.join(probes, "k").filter("abs(seconds - at) <= 100000").select("id", "probe")
        got = pairs.select("id", "probe")
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
