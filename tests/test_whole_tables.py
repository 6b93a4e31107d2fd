"""Queries that cover whole tables, whatever selection would be cheaper."""

import pytest
from pyspark.sql import functions as F

from fieldglass import registry
from fieldglass.plans import teams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["frozen_scoring", "price_comparison"])
def test_every_line_is_scored(spark, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert registry.queries()[name](spark, SF).count() == lines.count() > lines.where("l_quantity in (49, 50)").count()


def test_fingerprint_follows_every_event(spark, tmp_path):
    events = spark.range(2500).select(F.col("id").alias("event_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("event_type"), (F.col("id") / 7).alias("value"), (F.col("id") % 40).alias("user_id"))
    prints = []
    for k, changed in enumerate([-1, 2439]):  # an event of user 39
        events.withColumn("value", F.when(F.col("event_id") == changed, -5.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/{k}/events.parquet")
        prints.append({r.event_type: r.fingerprint for r in registry.queries()["vector_fingerprint"](spark, f"{tmp_path}/{k}").collect()})
    assert prints[0]["t0"] == prints[1]["t0"] and prints[0]["t1"] != prints[1]["t1"]


def test_islands_hold_every_season_and_show_gaps(spark, monkeypatch):
    rows = [("M", 1, s, opp) for s, opp in ((1995, 3), (1996, 4), (1997, 6), (1999, 5), (2000, 3))]
    monkeypatch.setattr(teams, "long", lambda spark, d: spark.createDataFrame(rows, "Gender string, TeamID int, Season int, OppID int"))
    got = sorted(tuple(r) for r in registry.queries()["tenure_islands"](spark, "").collect())
    assert got == [("M", 1, 1995, 1997, 3), ("M", 1, 1999, 2000, 2)]
