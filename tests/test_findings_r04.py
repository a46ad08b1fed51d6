"""What the review of round 4 found, on inputs that showed it."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from skein.sources import pages
from tests.test_findings_r03 import compared


def test_all_events_are_on_pages_that_are_counted(spark, tmp_path):
    """More than a hundred pages; ids that are null, equal, below 0 or leave gaps."""
    kinds = ["click", "view", "purchase", "error", None]
    ids = [*range(5700), *range(90_000, 90_300), *[None] * 120, *[7] * 80, *range(-60, 0)]
    rows, said = compared(spark, tmp_path, "S26_paginated_counts", events=spark.createDataFrame([(e, kinds[i % 5]) for i, e in enumerate(ids)], "event_id long, event_type string"))
    assert said == "" and dict(map(tuple, rows)) == {"ICE_HOCKEY": 1252, "GOLF": 1252, "PURCHASE": 1252}
    rows, said = compared(spark, tmp_path, "S26_paginated_counts", events=spark.createDataFrame([], "event_id long, event_type string"))
    assert said == "" and rows == []


def test_a_landed_feed_is_read_as_a_whole_up_to_its_end(spark, tmp_path):
    """Pages of several folders, each read once; one that is not there, or a folder that is not, ends the feed."""
    rows = spark.range(6100).select("id", F.lit("a b").alias("sport"), (F.floor(F.col("id") / 2) + 1).cast("int").alias("page"))
    land = lambda name, df: pages.land_pages(df, "page", f"file://{tmp_path}/{name}")
    counted = lambda template: [r.n for r in pages.sport_counts(pages.read_pages(spark, template, whole=True)).collect()]
    whole = land("whole", rows)
    found = pages.read_pages(spark, whole, whole=True).groupBy("page").agg(F.count("*").alias("n"), F.min("place").alias("a"), F.max("place").alias("z"))
    assert found.count() == 3050 and found.filter("n <> 2 or a <> 0 or z <> 1").count() == 0
    for page in (1, 999, 1000, 1999, 2000, 2345):
        assert sum(counted(land(f"without{page}", rows.filter(F.col("page") != page)))) == 2 * (page - 1)
    shutil.rmtree(tmp_path / "whole" / "shelf=1")
    assert counted(whole) == [2 * 999]
    with pytest.raises(Exception, match="landed feed"):
        pages.read_pages(spark, f"file://{tmp_path}/p{{page}}.json", whole=True)
