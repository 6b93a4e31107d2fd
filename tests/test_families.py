"""Goldens and planted cases of the families: history, bank, contracts, official files, store, ratings, folds."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass import sinks, store
from fieldglass.operators import bank, contracts, history, models, ratings
from fieldglass.operators.joins import ContractError
from fieldglass.sources import official, synthetic

TEAMS = "Gender string, Season int, TeamID int, seed int, rank int"


def test_target_history_goldens(spark):
    rows = [("M", s, t, seed, r) for s in range(2013, 2018) for t, seed, r in ((1, 1, 9), (2, 16, 0), (3, 8, 5))]
    rows = [("M", 2014, 1, 16, 0) if r[:3] == ("M", 2014, 1) else r for r in rows]  # a team whose category drifts
    teams = spark.createDataFrame(rows, TEAMS)
    results = spark.createDataFrame([("M", 2013, 1, 1), ("M", 2013, 2, 0)], "Gender string, Season int, TeamID int, win int")
    got = {c: {(r.Season, r.TeamID): r for r in history.encode_history(teams.withColumn("team", F.col("TeamID")), results, c).collect()} for c in ("team", "seed", "rank")}
    assert got["team"][2013, 1].mean == 0.5 and got["team"][2013, 1].support == 0
    assert [got["team"][2014, t].mean for t in (1, 2, 3)] == pytest.approx([11 / 21, 10 / 21, 0.5])
    assert [got[c][2014, 1].mean for c in ("team", "seed", "rank")] == pytest.approx([11 / 21, 10 / 21, 10 / 21])
    w = 0.5 ** (1 / 3)
    assert got["team"][2015, 1].mean == pytest.approx((w + 10) / (w + 20))
    unknown = history.encode_history(teams.withColumn("seed", F.lit(None).cast("int")), results, "seed").first()
    assert unknown["mean"] is None and unknown.support is None


def test_resume_golden(spark):
    games = [("M", 2021, 10, 1, 2, 10, 1, 1), ("M", 2021, 10, 2, 1, -10, 0, -1), ("M", 2021, 20, 1, 3, 30, 1, 0), ("M", 2021, 20, 3, 1, -30, 0, 0), ("M", 2021, 120, 1, 4, -1, 0, -1), ("M", 2021, 120, 4, 1, 1, 1, 1)]
    rows = spark.createDataFrame(games, "Gender string, Season int, DayNum int, TeamID int, OppID int, margin int, win int, home int")
    seeds = spark.createDataFrame([("M", 2021, 2, 1), ("M", 2021, 3, 9)], "Gender string, Season int, TeamID int, seed int")
    r = history.resume(rows, seeds, 132).where("TeamID = 1").first()
    assert (r.quality_wins, r.elite_wins, r.seeded_wins) == (10, 1, 2)
    assert r.quality_win_rate == pytest.approx(20 / 30.25) and r.elite_win_rate == pytest.approx(3.5 / 6)
    assert r.quality_margin == pytest.approx((60 + 120 - 0.25) / 30.25) and r.bad_loss_rate == pytest.approx(3.5 / 6) and r.late_quality_wins == 0 and r.away_quality_wins == 4


def test_ranking_snapshot_goldens(spark):
    rows = [(s, day, t, rank) for s in "AB" for day in (70, 100, 124, 130) for t, rank in ((1001, 1), (1002, 50), (1003, 100)) if not (s == "A" and day == 130 and t == 1003)]
    rows += [(s, 133, t, 200 - t % 10) for s in "AB" for t in (1001, 1002, 1003)]  # after the cutoff
    df = spark.createDataFrame(rows, "SystemName string, RankingDayNum int, TeamID int, OrdinalRank int")
    panel = {(r.SystemName, r.TeamID): r.rating for r in history.ranking_panel(df, 132).collect()}
    assert panel["A", 1002] == 0 and panel["B", 1002] == pytest.approx(50 / 99) and ("A", 1003) not in panel
    got = {r.TeamID: r for r in history.ranking_snapshot(df, 132).collect()}
    assert got[1001].move1 == 0 and got[1003].coverage == 0.5 and got[1001].age == 2 and got[1001].top25 == 1.0 and got[1003].disagreement is None


def test_bank_registry_and_wide_layout(spark):
    names = [r[0] for r in bank.registry()]
    assert len(names) == len(set(names)) == 2944 and len(bank.SIGNALS) == 32
    cells = spark.createDataFrame([("M", 2001, 1, 3, [2.5]), ("M", 2001, 1, 7, [None, 4.0]), ("M", 2001, 2, 0, [1.0]), ("M", 2001, 2, 2000, [9.0])], "Gender string, Season int, TeamID int, place int, values array<double>")
    t = {r.TeamID: r for r in bank.wide(cells, [(n, i) for i, n in enumerate(names[:10])]).collect()}
    assert t[1][names[3]] == 2.5 and t[1][names[7]] is None and t[1][names[8]] == 4.0 and t[2][names[0]] == 1.0 and t[2][names[3]] is None and len(t[1]) == 13


def test_elo_streams_populations_and_seasons(spark):
    games = [("M", 2001, 10, 1, 2, 80, 70, "H"), ("M", 2001, 10, 3, 1, 75, 70, "N"), ("M", 2001, 120, 2, 1, 71, 70, "A"), ("M", 2003, 5, 2, 3, 90, 60, "N"), ("W", 2001, 3, 7, 8, 60, 50, "N"), ("M", 2001, 140, 1, 2, 99, 1, "N")]
    df = spark.createDataFrame(games, "Gender string, Season int, DayNum int, WTeamID int, LTeamID int, WScore int, LScore int, WLoc string")
    got = {(r.Gender, r.Season, r.TeamID): r for r in ratings.elo(df.repartition(4)).collect()}
    gain = lambda a, b, edge: 20 * (1 - 1 / (1 + 10 ** (-(a - b + edge) / 400)))
    first, second = gain(1500, 1500, 60), gain(1500, 1500, 0)
    one, two = 1500 + first - second, 1500 - first
    last = gain(two, one, -60)
    assert got["M", 2001, 1].elo == pytest.approx(one - last) and got["M", 2001, 1].elo_change == pytest.approx(-last)
    assert got["M", 2003, 2].elo == pytest.approx(1500 + 0.65**2 * (two + last - 1500) + gain(1500 + 0.65**2 * (two + last - 1500), 1500 + 0.65**2 * (second), 0))
    assert set(got) == {("M", 2001, 1), ("M", 2001, 2), ("M", 2001, 3), ("M", 2003, 2), ("M", 2003, 3), ("W", 2001, 7), ("W", 2001, 8)}


def test_offense_defense_equals_dense_solution(spark):
    rng = np.random.default_rng(2)
    rows = [("M", 2001, int(a), int(b), int(rng.integers(-1, 2)), float(rng.normal(100, 10)), float(rng.uniform(0.1, 1))) for a, b in (rng.choice(6, 2, replace=False) for _ in range(80))]
    df = spark.createDataFrame(rows, "Gender string, Season int, TeamID int, OppID int, home int, e double, q double")
    got = {r.TeamID: r for r in ratings.offense_defense(df, ["Gender", "Season"], {"x": (F.col("e"), F.col("q"))}).collect()}
    x = np.zeros((80, 14))
    for i, r in enumerate(rows):
        x[i, r[2]] = x[i, 6 + r[3]] = x[i, 13] = 1
        x[i, 12] = r[4]
    q, y = np.array([r[6] for r in rows]), np.array([r[5] for r in rows])
    beta = np.linalg.solve(x.T @ (x * q[:, None]) + np.diag([20.0] * 13 + [0.0]), x.T @ (q * y))
    assert [got[t].x_offense for t in range(6)] == pytest.approx(beta[:6].tolist()) and [got[t].x_defense for t in range(6)] == pytest.approx((-beta[6:12]).tolist())
    assert got[0].x_level == pytest.approx(beta[13])


def test_walk_forward_screens_within_the_fold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in (1, 2, 3):
        for _ in range(80):
            x = rng.normal()
            rows.append((s, x, x * 2 if s == 1 else x, None if s == 1 else rng.normal(), int(x + rng.normal() > 0)))
    df = spark.createDataFrame(rows, "Season int, a double, twin double, late double, y int")
    got = models.walk_forward(df, ["a", "twin", "late"], "Season").collect()
    assert {r.Season for r in got} == {2, 3} and all(0 < r.p < 1 for r in got)
    assert np.mean([(r.p > 0.5) == r.y for r in got]) > 0.65
    flipped = df.withColumns({c: F.when(F.col("Season") == 3, -F.col(c)).otherwise(F.col(c)) for c in ("a", "twin", "late")})
    mirror = sorted(r.p for r in models.walk_forward(flipped, ["a", "twin", "late"], "Season").where("Season = 3").collect())
    assert mirror == pytest.approx(sorted(1 - r.p for r in got if r.Season == 3))  # p(x) + p(-x) = 1
    changed = df.withColumn("y", F.when(F.col("Season") == 3, 1 - F.col("y")).otherwise(F.col("y")))
    again = models.walk_forward(changed, ["a", "twin", "late"], "Season").collect()
    assert sorted(r.p for r in got) == pytest.approx(sorted(r.p for r in again))  # a season's labels don't reach its forecasts


def test_contracts_find_nothing_in_sound_tables(spark):
    m = spark.createDataFrame([("M", 2001, 140, "2001_1_2", 1, 2, 1)], "Gender string, Season int, DayNum int, ID string, Team1ID int, Team2ID int, y int")
    assert contracts.matrix_contract(m, 2010).count() == 0
    assert contracts.submission_contract(m.select("ID", F.lit(0.5).alias("Pred"))).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        contracts.submission_contract(m.select(F.lit(0.5).alias("Pred"), "ID"))
    with pytest.raises(ValueError, match="holds labels"):
        contracts.inference_contract(m, m)
    assert contracts.schema_gaps(m, {"Gender": "string"})[0] == ("Season", "not declared")


def official_folder(tmp_path, spoil=None):
    box = official.BOX
    head = "Season,DayNum,WTeamID,WScore,LTeamID,LScore,WLoc,NumOT"
    for g, base in (("M", 1000), ("W", 3000)):
        line = f"2016,{{d}},{base + 1},80,{base + 2},70,H,0"
        detail = ",".join(f"{s}{c}" for s in "WL" for c in official.BOX + ["Ast", "Stl", "Blk", "PF"])
        values = ",".join("20" if c.endswith("A") or c in ("FGA", "FGA3") else "10" if c != "FGM3" else "5" for _ in "WL" for c in box + ["Ast", "Stl", "Blk", "PF"])
        (tmp_path / f"{g}RegularSeasonCompactResults.csv").write_text(f"{head}\n{line.format(d=10)}\n")
        (tmp_path / f"{g}RegularSeasonDetailedResults.csv").write_text(f"{head},{detail}\n{line.format(d=10)},{values}\n")
        (tmp_path / f"{g}NCAATourneyCompactResults.csv").write_text(f"{head}\n{line.format(d=140)}\n")
        (tmp_path / f"{g}NCAATourneySeeds.csv").write_text(f"Season,Seed,TeamID\n2016,W01,{base + 1}\n2016,X16b,{base + 2}\n")
    if spoil:
        name, old, new = spoil
        path = tmp_path / name
        path.write_text(path.read_text().replace(old, new))
    return str(tmp_path)


def test_official_files_are_read_and_validated(spark, tmp_path):
    got = official.read_official(spark, official_folder(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {s: 4 if "Seeds" in s else 2 for s in official.REQUIRED}
    assert sorted(r.seed for r in got["NCAATourneySeeds"].collect()) == [1.0, 1.0, 16.0, 16.0]
    files = official.inventory(spark, str(tmp_path)).collect()
    assert len({r.file for r in files}) == 8 and [(r.column, r.rows, r.missing, r.low, r.high) for r in files if r.file == "MNCAATourneySeeds.csv"] == [("Season", 2, 0, "2016", "2016"), ("Seed", 2, 0, "W01", "X16b"), ("TeamID", 2, 0, "1001", "1002")]
    (tmp_path / "WNCAATourneySeeds.csv").unlink()
    with pytest.raises(FileNotFoundError, match="WNCAATourneySeeds.csv"):
        official.read_official(spark, str(tmp_path))


@pytest.mark.parametrize("spoil", [("MNCAATourneySeeds.csv", "W01", "W17"), ("WRegularSeasonCompactResults.csv", "80,", "60,"), ("MRegularSeasonCompactResults.csv", ",H,", ",X,")])
def test_spoilt_official_files_are_refused(spark, tmp_path, spoil):
    with pytest.raises(ContractError):
        official.read_official(spark, official_folder(tmp_path, spoil))


def test_store_commits_by_rename_and_reuses_tasks(spark, tmp_path):
    at = f"file://{tmp_path}"
    sha = store.write_json(spark, f"{at}/x.json", {"b": 1, "a": [1, 2]})
    data = store.Files(spark).read(f"{at}/x.json")
    assert json.loads(data) == {"a": [1, 2], "b": 1} and not list(tmp_path.glob("*.tmp"))
    assert store.write_verified(spark, f"{at}/x.json", data, sha) is False
    with pytest.raises(ValueError, match="other bytes"):
        store.write_verified(spark, f"{at}/x.json", b"y", __import__("hashlib").sha256(b"y").hexdigest())
    with pytest.raises(ValueError):
        store.write_json(spark, f"{at}/n.json", float("nan"))
    runs = []
    tasks = store.Tasks(spark, f"{at}/tasks")
    work = lambda: runs.append(1) or spark.range(3)
    assert tasks.run("a", {"v": 1}, work).count() == tasks.run("a", {"v": 1}, work).count() == 3 and len(runs) == 1
    tasks.run("a", {"v": 2}, work)
    assert len(runs) == 2 and [e["reused"] for e in tasks.events] == [False, True, False]
    assert store.latest(spark, f"{at}/tasks/a").endswith(tasks.events[-1]["fingerprint"])
    tasks.write_events()
    assert len(store.Files(spark).read(f"{at}/tasks/events.jsonl").splitlines()) == 3


def test_spliced_lines_keep_other_bytes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ID,Pred\n2026_1_2,0.50\n2026_3001_3002,5e-1\n2026_1_3,0.5000\n")
    new = spark.createDataFrame([("2026_1_2", "0.1"), ("2026_1_3", "0.25")], "ID string, Pred string")
    sinks.splice_lines(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"), new, r"^2026_1_\d$")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "ID,Pred\n2026_1_2,0.1\n2026_3001_3002,5e-1\n2026_1_3,0.25\n"
    with pytest.raises(ContractError):
        sinks.splice_lines(spark, str(tmp_path / "t.csv"), str(tmp_path / "out2"), new.limit(1), r"^2026_1_\d$")


def test_pairs_of_streams_are_written_in_one_job(spark, tmp_path):
    men = spark.createDataFrame([(s, f"1_{i}", 0.5) for s in "ab" for i in range(3)], "stream string, ID string, p double")
    women = spark.createDataFrame([(s, f"3_{i}", 0.5) for s in "xyz" for i in range(2)], "stream string, ID string, p double")
    assert sinks.write_pairs(men, women, str(tmp_path / "p")).count() == 6
    got = spark.read.parquet(str(tmp_path / "p")).groupBy("candidate").count().collect()
    assert len(got) == 6 and all(r["count"] == 5 for r in got)
    sinks.write_ordered(men, str(tmp_path / "o"), ["stream", "ID"], 2)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 6
    with pytest.raises(ContractError):
        sinks.write_ordered(men, str(tmp_path / "o2"), ["stream"])


def test_unfitted_league_is_reproducible(spark):
    a, b = (sorted(map(tuple, synthetic.unfitted(spark).repartition(n).collect())) for n in (1, 3))
    assert a == b and len(a) == 88 and all(r[2] < r[3] and 0 < r[6] < 1 for r in a)
