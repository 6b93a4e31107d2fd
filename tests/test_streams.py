"""Streamed ratings equal the batch fold, whatever the order of arrival within the watermark."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import ratings
from fieldglass.streaming import elo_by_day

SCHEMA = "Gender string, Season int, DayNum int, WTeamID int, LTeamID int, WScore int, LScore int, WLoc string, at timestamp"


def test_streamed_elo_equals_the_batch_fold(spark, tmp_path):
    rng, rows = random.Random(6), []
    for g in "MW":
        for season in (2001, 2003):
            for day in sorted(rng.sample(range(1, 100), 12)):
                for _ in range(rng.randint(1, 3)):
                    a, b = rng.sample(range(1, 6), 2)
                    loser = rng.randint(40, 70)
                    rows.append((g, season, day, a, b, loser + rng.randint(1, 30), loser, rng.choice("HAN"), dt.datetime(season, 1, 1, rng.randint(0, 23)) + dt.timedelta(days=day)))
    rows.sort(key=lambda r: (r[-1] + dt.timedelta(hours=rng.randint(-40, 0))))  # some days arrive after later ones
    rows += [(g, 2010, 1, 1, 2, 50, 40, "N", dt.datetime(2010, 1, 2)) for g in "MW"]  # closes the days before
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:04d}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = elo_by_day(stream, "Gender", "at", "3 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out")
    days = {(r.Gender, r.Season, r.DayNum, r.TeamID) for r in got.collect()}
    assert days == {(r[0], r[1], r[2], t) for r in rows[:-2] for t in r[3:5]} and len(days) == got.count()
    last = {(r.Gender, r.Season, r.TeamID): r.s for r in got.groupBy("Gender", "Season", "TeamID").agg(F.max(F.struct("DayNum", "elo", "elo_mov")).alias("s")).collect()}
    want = {(r.Gender, r.Season, r.TeamID): r for r in ratings.elo(spark.createDataFrame(rows[:-2], SCHEMA)).collect()}
    assert last.keys() == want.keys()
    for k, w in want.items():
        assert last[k].elo == pytest.approx(w.elo, abs=1e-9) and last[k].elo_mov == pytest.approx(w.elo_mov, abs=1e-9)
