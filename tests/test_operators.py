"""Hand-computed goldens, laws (future, swap, order, missing) and contracts of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import stats
from fieldglass.operators import bracket, checks, evaluate, joins, models, ratings, reshape, windows
from fieldglass.sources import files, synthetic

GAME = "Gender string, Season int, DayNum int, WTeamID int, LTeamID int, WScore int, LScore int, WLoc string, NumOT int"


def season(spark, shuffle=False, more=()):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(10, 70):
        a, b = sorted(rng.choice(8, 2, replace=False) + 1101)
        w, l = (a, b) if rng.random() < 0.6 else (b, a)
        rows.append(("M", 2016, day, int(w), int(l), int(70 + rng.integers(1, 20)), 70, "HAN"[int(rng.integers(3))], 0))
    rows += list(more)
    if shuffle:
        rng.shuffle(rows)
        rows = [("M", *[int(x) if str(x).lstrip("-").isdigit() else str(x) for x in r[1:]]) for r in rows]
    return spark.createDataFrame(rows, GAME)


def test_orientation_golden(spark):
    g = spark.createDataFrame([("M", 2020, 1, 1102, 1101, 80, 70, "H", 0), ("M", 2020, 2, 1101, 1103, 75, 60, "A", 0)], GAME)
    got = {r.Team2ID: r for r in reshape.canonical(g).collect()}
    assert [(got[t].Team1ID, got[t].y, got[t].Team1Margin, got[t].Team1Loc) for t in (1102, 1103)] == [(1101, 0, -10, "A"), (1101, 1, 15, "A")]
    assert got[1102].ID == "2020_1101_1102"


def test_two_rows_a_game_mirror_each_other(spark):
    rows = reshape.team_rows(season(spark)).groupBy("DayNum").agg(F.count("*").alias("n"), F.sum("margin").alias("m"), F.sum("home").alias("h"), F.sum("win").alias("w")).collect()
    assert all((r.n, r.m, r.h, r.w) == (2, 0, 0, 1) for r in rows)


def test_ids_and_seeds(spark):
    got = reshape.parse_matchup_id(spark.createDataFrame([("2026_1101_1102",), ("2026_3101_3102",), ("2026_1101_3102",)], "ID string")).collect()
    assert [r.Gender for r in got] == ["M", "W", "INVALID"]
    seeds = reshape.split_seed(spark.createDataFrame([("W01a",), ("Z16",), ("Q01",)], "Seed string")).collect()
    assert [(r.Region, r.SeedNum, r.PlayIn) for r in seeds] == [("W", 1, "a"), ("Z", 16, None), (None, None, None)]


def test_metrics_golden(spark):
    r = spark.createDataFrame([(1, 0.8), (0, 0.4)], "y int, p double")
    assert r.agg(stats.brier()).first()[0] == pytest.approx(0.1)
    one = r.where("y = 1").withColumn("k", F.lit(1))
    assert evaluate.roc_auc(one, ["k"]).first().auc is None
    assert evaluate.roc_auc(r.withColumn("k", F.lit(1)), ["k"]).first().auc == 1.0


def test_auc_counts_ties_as_half(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    pos, neg = p[y == 1], p[y == 0]
    expect = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, p)], "k int, y int, p double")
    assert evaluate.roc_auc(df, ["k"]).first().auc == pytest.approx(expect)


def test_average_rank_shares_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "t string, v double").withColumn("k", F.lit(1))
    got = {r.t: r.r for r in windows.average_rank(df, "v", ["k"], "r").collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(2.5 / 3), "c": pytest.approx(2.5 / 3), "d": None}


def test_skew_matches_the_bias_corrected_form(spark):
    x = [1.0, 2.0, 2.5, 9.0]
    n, m = len(x), np.mean(x)
    g = np.mean((np.array(x) - m) ** 3) / np.mean((np.array(x) - m) ** 2) ** 1.5
    got = spark.createDataFrame([(v,) for v in x], "v double").agg(stats.adjusted_skew("v")).first()[0]
    assert got == pytest.approx(g * np.sqrt(n * (n - 1)) / (n - 2))
    assert spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(stats.adjusted_skew("v")).first()[0] is None


def test_checked_join_refuses_broken_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(joins.ContractError):
        joins.checked_join(a, b, ["k"], validate="m:1")
    with pytest.raises(joins.ContractError):
        joins.checked_join(a, b.limit(1), ["k"], validate="1:1", all_match=True)
    assert joins.checked_join(a, b, ["k"], validate="1:m").count() == 2


def test_as_of_takes_the_latest_known_value(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 7, 2.0), ("a", 11, 3.0)], "k string, s int, v double")
    got = {(r.k, r.t): (r.seen, r.v) for r in joins.as_of(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {("a", 5): (5, 1.0), ("a", 10): (7, 2.0), ("b", 5): (None, None)}
    stale = {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", "s", ["v"], stale=F.lit(2)).collect()}
    assert stale == {("a", 5): 1.0, ("a", 10): None, ("b", 5): None}


def test_latest_editions_ignore_the_future_and_keep_absence(spark):
    p = spark.createDataFrame([("A", 100, 1), ("A", 130, 1), ("A", 154, 2), ("B", 110, 1)], "s string, d int, t int")
    got = joins.latest_editions(p, ["s"], "d", 132, 14).collect()
    assert [(r.s, r.d, r.t) for r in got] == [("A", 130, 1)]


def test_overlaps_are_found_past_a_nested_interval(spark):
    i = spark.createDataFrame([(1, 1, 10), (1, 2, 3), (1, 5, 6), (1, 11, 12)], "k int, a int, b int")
    assert sorted(r.a for r in joins.overlapping(i, ["k"], "a", "b").collect()) == [2, 5]


def test_runs_of_seasons(spark):
    s = spark.createDataFrame([(1, y) for y in (2010, 2011, 2013, 2013, 2014, 2015)], "k int, y int")
    got = sorted(tuple(r) for r in windows.run_lengths(s, ["k"], "y").select("first", "last", "length").collect())
    assert got == [(2010, 2011, 2), (2013, 2015, 3)]


def test_pairs_change_sign_when_teams_swap(spark):
    teams = spark.createDataFrame([(1, 10, 3.0, 1.0), (1, 20, 5.0, 4.0)], "s int, TeamID int, o double, d double")
    pairs = spark.createDataFrame([(1, 10, 20), (1, 20, 10)], "s int, Team1ID int, Team2ID int")
    m = joins.pair_roles(pairs, teams, ["s"]).withColumn("x", joins.antisymmetric("o", "d"))
    got = {r.Team1ID: (r.diff_o, r.x) for r in joins.differences(m, ["o"], ["Team1ID", "x"]).collect()}
    assert got[10] == tuple(-v for v in got[20])


def test_forward_choice_is_blind_to_the_future(spark):
    rng = np.random.default_rng(4)
    rows = [(c, s, int(rng.integers(2)), float(rng.random())) for c in "abc" for s in range(2010, 2015) for _ in range(20)]
    cols = "candidate string, Season int, y int, p double"
    base = {r.Season: r.candidate for r in evaluate.forward_choice(spark.createDataFrame(rows, cols)).collect()}
    changed = [(c, s, 1 - y if s == 2014 else y, p) for c, s, y, p in rows]
    assert {r.Season: r.candidate for r in evaluate.forward_choice(spark.createDataFrame(changed, cols)).collect()} == base
    assert min(base) == 2011


def test_ridge_solves_its_normal_equations_in_any_order(spark):
    a = {r.TeamID: r.strength for r in ratings.ridge_strength(season(spark), ["Gender", "Season"]).collect()}
    b = {r.TeamID: r.strength for r in ratings.ridge_strength(season(spark, shuffle=True), ["Gender", "Season"]).collect()}
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], abs=1e-9) for t in a)
    g = season(spark)
    assert ratings.ridge_residual(g, ratings.ridge_strength(g, ["Gender", "Season"]), ["Gender", "Season"]).first().worst < 1e-8


def test_elo_games_of_a_day_read_the_ratings_before_it(spark):
    g = spark.createDataFrame([("M", 2000, 1, 1, 2, 80, 70, "N", 0), ("M", 2000, 1, 1, 3, 80, 70, "N", 0)], GAME)
    got = {r.TeamID: r.elo for r in ratings.elo(g).collect()}
    assert got == {1: pytest.approx(1520), 2: pytest.approx(1490), 3: pytest.approx(1490)}


def test_elo_carries_over_seasons(spark):
    g = spark.createDataFrame([("M", 2000, 1, 1, 2, 80, 70, "N", 0), ("M", 2002, 1, 1, 2, 80, 70, "N", 0)], GAME)
    got = {(r.Season, r.TeamID): r.elo for r in ratings.elo(g).collect()}
    start = 1500 + 0.65**2 * 10
    gain = 20 * (1 - 1 / (1 + 10 ** ((3000 - 2 * start) / 400)))
    assert got[2002, 1] == pytest.approx(start + gain)


def test_bracket_chances_add_up(spark):
    teams = spark.createDataFrame([(i, f"t{i}", 1500.0 + 37 * i) for i in range(8)], "pos int, team string, rating double")
    rows = bracket.bracket(teams).collect()
    assert sum(r.r1 for r in rows) == pytest.approx(4) and sum(r.r2 for r in rows) == pytest.approx(2) and sum(r.r3 for r in rows) == pytest.approx(1)
    by = bracket.final_paths(teams).groupBy("team").agg(F.sum("share").alias("s")).collect()
    assert {r.team: round(r.s, 9) for r in by} == {r.team: round(r.r3, 9) for r in rows}


def test_simplex_blend_finds_the_better_stream(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    rows = [(int(v), float(0.2 + 0.6 * v), float(rng.random())) for v in y]
    df = spark.createDataFrame(rows, "y int, good double, noise double").withColumn("Season", F.lit(2001))
    w = models.simplex_blend(df, ["good", "noise"])
    assert sum(w.values()) == pytest.approx(1) and w["good"] > 0.9


def test_screen_names_its_reasons(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    rows = [(float(a), float(2 * a), 0.0, float(rng.normal()), int(a > 0)) for a in x]
    got = dict((f, s) for f, s, *_ in models.screen(spark.createDataFrame(rows, "a double, twin double, zero double, noise double, y int"), ["a", "twin", "zero", "noise"], "y"))
    assert got == {"a": "retained", "twin": "redundant", "zero": "constant", "noise": "retained"}


def test_violations_name_each_broken_rule(spark):
    bad = spark.createDataFrame([("M", 2000, 1, 1, 1, 60, 70, "X", 0)], GAME)
    assert {r.rule for r in checks.violations(bad, checks.game_rules(stats=False), ["Season"]).collect()} == {"location", "score", "same_team"}
    twice = spark.createDataFrame([("M", 2000, 1, 1, 2, 80, 70, "H", 0), ("M", 2000, 1, 2, 1, 81, 70, "A", 0)], GAME)
    assert checks.duplicate_games(twice).first().n == 2


def test_strict_json_refuses_what_is_not_json():
    assert files.strict_json('{"a": 1}') == {"a": 1}
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', "[Infinity]"):
        with pytest.raises(ValueError):
            files.strict_json(text)


def test_csv_catalog_declares_schemas(spark, tmp_path):
    (tmp_path / "MNCAATourneySeeds.csv").write_text("Season,Seed,TeamID\n2016,W01,1101\n")
    (tmp_path / "Other.csv").write_text("a,b\n1,2\n")
    got = files.csv_catalog(spark, f"file://{tmp_path}")
    assert got["MNCAATourneySeeds"].dtypes == [("Season", "int"), ("Seed", "string"), ("TeamID", "int")] and got["Other"].count() == 1
    with pytest.raises(FileNotFoundError):
        files.csv_catalog(spark, f"file://{tmp_path}/none")


def test_round_robin_meets_every_pair_once(spark):
    rows = synthetic.round_robin(spark, 2, 6).select("Season", F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b")).collect()
    assert len(rows) == len(set(rows)) == 2 * 15 and all(r.a != r.b for r in rows)


def test_sinks(spark, tmp_path):
    from fieldglass import sinks

    df = spark.createDataFrame([(0.1, "a"), (1 / 3, "b")], "p double, k string")
    assert [float(r.p) for r in sinks.exact_floats(df).collect()] == [0.1, 1 / 3]
    got = sinks.ordered_rows(spark.range(50).repartition(5), [F.col("id").desc()], "n").collect()
    assert sorted((r.n, r.id) for r in got) == [(i, 49 - i) for i in range(50)]
    t = spark.createDataFrame([(0, "M1", 0.5), (1, "W1", 0.25)], "row_ord int, ID string, Pred double")
    new = spark.createDataFrame([("W1", 0.9), ("M1", 0.1)], "ID string, Pred double")
    assert [r.Pred for r in sinks.splice(t, new, "ID", F.col("ID").startswith("W"), "Pred").collect()] == [0.5, 0.9]


def test_streaming_counts(spark, tmp_path):
    from fieldglass import streaming

    spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp '2024-01-01 00:20:00', 'a' union all select timestamp '2024-01-01 03:00:00', 'b'").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/in")
    q = streaming.windowed_counts(s, "ts", "k").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]
