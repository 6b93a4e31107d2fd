"""Contracts of evaluation games and choices, variants, systems, the bank's statistics, deals of a feature, event logs, lookups
of streams and generated leagues."""

import datetime as dt
import hashlib
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import bank, boosting, contracts, evaluate, systems
from fieldglass.sources import synthetic
from fieldglass.store import EventLog
from fieldglass.streaming import as_of_static


def test_evaluation_games_break_each_rule(spark):
    good = [("M", 2015, 140, "2015_1101_1102", 1), ("W", 2016, 133, "2016_3101_3102", 0)]
    bad = {
        "null": ("M", 2015, None, "2015_1101_1103", 1), "season": ("M", 2020, 140, "2020_1101_1103", 1), "day": ("M", 2015, 132, "2015_1101_1104", 1), "population": ("X", 2015, 140, "2015_1101_1105", 1),
        "outcome": ("M", 2015, 140, "2015_1101_1106", 2), "id": ("M", 2015, 140, "2015_11_1107", 1), "season of id": ("M", 2015, 140, "2016_1101_1108", 1), "order": ("M", 2015, 140, "2015_1110_1109", 1),
    }
    df = spark.createDataFrame([*good, *bad.values(), good[0]], "Gender string, Season int, DayNum int, ID string, y int")
    got = sorted((r.rule, r.ID) for r in contracts.evaluation_games(df, 2013, 2021, [2020]).collect())
    assert got == sorted([*((k, v[3]) for k, v in bad.items()), ("repeated", good[0][3])])
    assert contracts.evaluation_games(df.limit(0), 2013, 2021).count() == 0


def test_choices_use_earlier_seasons_only(spark):
    rows = [("a", 2015, 2014, 2), ("a", 2016, 2016, 3), ("b", 2015, 2014, 1), ("b", 2016, None, 2), ("c", 2015, 2013, 2), ("c", 2015, 2014, 2)]
    df = spark.createDataFrame(rows, "route string, Season int, history_last_season int, history_seasons int")
    got = sorted(tuple(r) for r in contracts.selection_history(df, ["route"]).collect())
    assert got == [("a", 2016, "later season"), ("b", 2015, "too few seasons"), ("b", 2016, "unknown history"), ("c", 2015, "repeated")]


def test_variants_are_walked_forward_each_by_itself(spark):
    rng = random.Random(1)
    rows = [(s, i, x := rng.gauss(0, 1), int(x + rng.gauss(0, 1) > 0)) for s in (2001, 2002) for i in range(60)]
    df = spark.createDataFrame(rows, "Season int, i int, x double, y int")
    how = {"a": {"rounds": 1, "depth": 1}, "b": {"rounds": 2, "depth": 2, "rate": 0.5}}
    got = {(r.variant, r.i): r.p for r in boosting.walk_forward_variants(df, ["x"], "Season", how).collect()}
    assert len(got) == 120
    for name, kw in how.items():
        assert {r.i: r.p for r in boosting.walk_forward_boosted(df, ["x"], "Season", **kw).collect()} == {i: p for (v, i), p in got.items() if v == name}


def test_systems_stand_beside_their_consensus(spark):
    now = spark.createDataFrame([("A", 1, 0.9), ("B", 1, 0.5), ("new", 1, 0.7), ("A", 2, 1.0)], "SystemName string, TeamID int, rating double")
    before = spark.createDataFrame([("A", 1, 0.6), ("B", 9, 0.1)], "SystemName string, TeamID int, rating double")
    vocabulary = spark.createDataFrame([("A",), ("B",), ("gone",)], "SystemName string")
    t = systems.system_features(now, vocabulary, {7: before})
    got = {(r.TeamID, r.SystemName): r for r in t.collect()}
    assert set(got) == {(i, s) for i in (1, 2) for s in ("A", "B", "gone")}
    one = got[1, "A"]  # the consensus counts the system outside the vocabulary
    assert one.deviation == pytest.approx(0.2) and one.change_7 == pytest.approx(0.3) and one.logit_deviation == pytest.approx(np.log(9) - np.log(7 / 3)) and one.available == 1
    assert got[2, "A"].logit == pytest.approx(np.log(99)) and got[1, "gone"].available == 0 and got[1, "gone"].level is None and got[1, "B"].change_7 is None
    wide = {r.TeamID: r for r in systems.pivoted(t, "level").collect()}
    assert wide[1].asDict() == {"TeamID": 1, "level_A": 0.9, "level_B": 0.5, "level_gone": None}
    assert systems.pivoted(t.limit(0), "level").columns == ["TeamID"]


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_statistics_are_those_of_pandas(n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 6)), 2)
    x[:, 1], x[:, 2] = np.nan, 0.1
    x[rng.random(n) < 0.4, 3] = np.nan
    got = dict(zip(bank.STATS, bank.statistics(x, bank.STATS), strict=True))
    p = pd.DataFrame(x)
    want = {"mean": p.mean(), "median": p.median(), "std": p.std(), "min": p.min(), "max": p.max(), "count": p.count(), "skew": p.skew().where(p.nunique() > 1), "iqr": p.quantile(0.75) - p.quantile(0.25)}
    want |= {f"q{q}": p.quantile(q / 100) for q in (10, 25, 75, 90)}
    assert all(np.allclose(got[k], v.to_numpy(float), equal_nan=True) for k, v in want.items())


def test_trends_are_those_of_days():
    day = np.array([1, 1, 5, 70, 80, 95, 100])
    x = np.column_stack([np.arange(7.0), [1, 3, np.nan, 2, np.nan, 5, 4], np.full(7, np.nan)])
    got = bank.trends(day, x, 100)
    d = pd.DataFrame(x).groupby(day).mean()
    for j in range(2):
        y = d[j].dropna()
        mean = lambda lo, hi, j=j: d[j][(d.index > lo) & (d.index <= hi)].mean()
        recent, middle, early = mean(70, 999), mean(40, 70), mean(-1, 40)
        want = [np.polyfit(y.index, y, 1)[0], recent - middle, recent - 2 * middle + early, d[j].diff().abs().mean(), d[j][d.index >= d.index.to_numpy().mean()].std()]
        assert np.allclose(got[:, j], want)
    assert np.isnan(got[:, 2]).all()


def test_bank_follows_whole_teams_over_batches(spark):
    rng, names = np.random.default_rng(4), list(bank.SIGNALS)
    rows = [("M", 2001, t, int(rng.integers(1, 9)), int(rng.integers(1, 120)), i, int(rng.integers(-1, 2)), *map(float, rng.normal(size=32))) for i, t in enumerate(rng.integers(1, 6, 80).tolist())]
    df = spark.createDataFrame(rows, "Gender string, Season int, TeamID int, OppID int, DayNum int, GameNo int, home int, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.TeamID, r.context, r.signal): r for r in bank.windows(df, 120).collect()}
    p = pd.DataFrame(rows, columns=df.columns)
    last = p.sort_values(["DayNum", "OppID", "GameNo"]).groupby("TeamID").tail(7)
    for context, part in {"season": p, "last7games": last, "last30days": p[p.DayNum > 90], "last60days": p[p.DayNum > 60]}.items():
        for team, own in part.groupby("TeamID"):
            assert got[team, context, "win"]["count"] == len(own) and got[team, context, "margin"].q25 == pytest.approx(own.margin.quantile(0.25))
    assert {r.context for r in bank.venues(df).collect()} == set(bank.VENUES)
    assert bank.windows(df.limit(0), 120).count() == 0


def test_a_dealt_feature_raises_the_loss_as_by_hand(spark):
    rng = random.Random(5)
    rows = [(i // 2, i % 2, rng.gauss(0, 1), rng.gauss(0, 1), int(rng.random() < 0.5)) for i in range(40)]
    rows.append(rows[0])  # a repeated row
    model = {"a": (2.0, 1.5), "b": (1.0, -0.5)}
    df = spark.createDataFrame(rows, "k int, line int, a double, b double, y int").repartition(3)
    got = {r.feature: r for r in evaluate.permutation_importance(df, model, "y", ["k", "line", "a", "b"], 2).collect()}
    ordered = sorted(rows, key=lambda r: r[:4])
    p = lambda a, b: 1 / (1 + np.exp(-(a / 2 * 1.5 - b * 0.5)))
    base = np.mean([(p(a, b) - y) ** 2 for _, _, a, b, y in ordered])
    for f in model:
        rise = []
        for k in (1, 2):
            dealt = sorted(range(len(ordered)), key=lambda n: (hashlib.sha256(f"{f}:{k}:{ordered[n][0]}:{ordered[n][1]}".encode()).hexdigest(), n))
            x = [ordered[n][2 if f == "a" else 3] for n in dealt]
            rise.append(np.mean([(p(v if f == "a" else a, v if f == "b" else b) - y) ** 2 for v, (_, _, a, b, y) in zip(x, ordered, strict=True)]) - base)
        assert got[f].repeats == 2 and got[f].importance == pytest.approx(np.mean(rise), abs=1e-12)


def test_events_of_threads_are_all_kept_in_order(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/events")
    threads = [threading.Thread(target=lambda t=t: [log.emit("step", thread=t, n=n) for n in range(3)]) for t in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = log.table().collect()
    assert len(rows) == 9 and {(r.thread, r.n) for r in rows} == {(t, n) for t in range(3) for n in range(3)}
    assert all(r.elapsed >= 0 and r.peak_bytes > 0 for r in rows) and [p.name for p in sorted((tmp_path / "events").glob("*.jsonl"))][-1].endswith("00000008.jsonl")


def test_streamed_lookups_equal_the_batch_form(spark, tmp_path):
    from fieldglass.operators.joins import as_of

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    obs = spark.createDataFrame([("a", at(1), 1.0), ("a", at(5), 2.0), ("b", at(3), 9.0)], "team string, ts timestamp, rating double")
    asked = [(1, "a", at(0)), (2, "a", at(1)), (3, "a", at(9)), (4, "b", at(4)), (5, "c", at(4)), (6, "a", at(4))]
    schema = "id int, team string, at timestamp"
    for k, part in enumerate([asked[3:], asked[:3]]):  # the second file is late
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = as_of_static(stream, obs, ["team"], "at", "ts", ["rating"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.id, r.seen, r.rating) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.id, r.seen, r.rating) for r in as_of(spark.createDataFrame(asked, schema), obs, ["team"], "at", "ts", ["rating"]).collect()}
    assert got == want and len(got) == 6


def test_scheduled_leagues_are_round_robins(spark):
    teams = spark.createDataFrame([(0, p, 100 + p) for p in range(6)] + [(1, p, 200 + p) for p in range(5)], "league int, place int, team int")
    rows = synthetic.scheduled(teams, 6).collect()
    for league, n in ((0, 6), (1, 5)):
        own = [r for r in rows if r.league == league]
        assert len({frozenset((r.home, r.away)) for r in own}) == len(own) == n * (n - 1) // 2
        for day in range(5):
            met = [t for r in own if r.Round == day for t in (r.home, r.away)]
            assert len(met) == len(set(met))


def test_unfitted_forecasts_follow_from_hashes(spark):
    g = spark.createDataFrame([(2001, 5, 1, 2), (2001, 6, 2, 3)], "Season int, GameNo long, Team1ID int, Team2ID int")
    u = lambda *x: int(hashlib.sha256(":".join(map(str, x)).encode()).hexdigest()[:12], 16) / 2**48
    for r in synthetic.unfitted_forecasts(g).withColumn("one", F.lit(1)).collect():
        a, b = 1300 + 400 * u(7, 2001, r.Team1ID), 1300 + 400 * u(7, 2001, r.Team2ID)
        assert r.p == pytest.approx(1 / (1 + 10 ** ((b - a) / 400))) and r.y == int(u(7, "y", 2001, r.GameNo) < r.p)
