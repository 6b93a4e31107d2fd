"""Work that grows with the tables: the bank by batches of teams, ids of five digits, joins that don't pair rows by a hot key."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass import registry, sinks, store
from fieldglass.operators import bank, contracts, evaluate, history, joins, windows
from fieldglass.plans import storage

TABLES = "supplier orders lineitem".split()
SF = "/root/testdata/sf0.001"


def compared(spark, folder, name):
    """Rows of a query and of its statement over a folder, doubles to 6 decimals."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.queries()[name](spark, folder)
    cur = con.execute(registry.oracles()[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    plain = lambda v: "" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in df.collect()), sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


@pytest.fixture(scope="module")
def wide_keys(spark, tmp_path_factory):
    """The league with teams' numbers of up to six digits."""
    folder = str(tmp_path_factory.mktemp("wide"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        for c in df.columns:
            if c.endswith("suppkey"):
                df = df.withColumn(c, (F.col(c) * 3701).cast("long"))
        df.write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_ids_of_any_length_are_judged_by_their_first_digit(spark, wide_keys):
    m = spark.createDataFrame([("2001_12000_13000", "W"), ("2001_3100_10200", "W"), ("2001_10500_30500", "M"), ("2001_35000_36000", "W")], "ID string, Gender string")
    got = lambda **kw: sorted(r.ID for r in contracts.inference_contract(m, m.select("ID"), **kw).collect())
    assert got() == ["2001_10500_30500", "2001_12000_13000", "2001_3100_10200"] and got(sides=(1,)) == ["2001_12000_13000"]
    got, want = compared(spark, wide_keys, "inference_contract")
    assert got == want and len(got) > 1


def team_rows(n_teams=7, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("M", 2001, t, int(rng.integers(1, n_teams)), int(rng.integers(1, 120)), i, int(rng.integers(-1, 2)), *map(float, rng.normal(size=32))) for i, t in enumerate(rng.integers(1, n_teams, 90).tolist())]
    return rows, "Gender string, Season int, TeamID int, OppID int, DayNum int, GameNo int, home int, " + ", ".join(f"{n} double" for n in bank.SIGNALS)


def test_teams_are_worked_on_by_batches():
    team = np.sort(np.random.default_rng(1).integers(0, 200, 3000))
    t = pa.table({"Gender": ["M"] * 3000, "Season": [2001] * 3000, "TeamID": team, "n": np.arange(3000)})
    found = list(bank._whole_teams(iter(t.to_batches(max_chunksize=700))))
    assert len(found) <= 6 and pa.Table.from_batches([b for b, _ in found]).equals(t.combine_chunks())
    seen = [i for b, start in found for i in b.column("TeamID").take(start).to_pylist()]
    assert seen == sorted(set(team.tolist()))
    long = list(bank._whole_teams(iter(pa.table({"Gender": ["M"] * 50, "Season": [1] * 50, "TeamID": [4] * 50}).to_batches(max_chunksize=9))))
    assert [b.num_rows for b, _ in long] == [50]


def test_bank_lays_out_what_its_families_say(spark):
    rows, schema = team_rows()
    df = spark.createDataFrame(rows, schema).repartition(3)
    strength = df.groupBy(*bank.KEY).agg(F.avg("margin").alias("strength"))
    laid = {r.TeamID: r.v for r in bank.bank(df, strength, 120).collect()}
    place = {r[1:]: i for i, r in enumerate(bank.registry())}
    want = {t: [None] * 2944 for t in laid}
    families = {"distribution": (bank.windows(df, 120), bank.STATS), "venue": (bank.venues(df), bank.SMALL), "opponent": (bank.opponents(df, strength), bank.SMALL), "trajectory": (bank.trajectories(df, 120), bank.TREND), "peer": (bank.peers(bank.peer_values(df)), bank.PEER)}
    for family, (frame, stats) in families.items():
        for r in frame.collect():
            for s in stats:
                want[r.TeamID][place[family, r.asDict().get("context", "season"), r.signal, s]] = r[s]
    for t, v in laid.items():
        assert [x is None for x in v] == [x is None for x in want[t]]
        assert [x for x in v if x is not None] == pytest.approx([x for x in want[t] if x is not None])


def test_signals_are_made_in_tasks_as_their_expressions_say(spark):
    """Of games with every kind of missing denominator and value; no signal, and no decimal, is worked out row by row before."""
    rng = np.random.default_rng(8)
    n, box = 400, [*bank.BOX, *[f"opp_{b}" for b in bank.BOX]]
    games = {"Gender": ["M"] * n, "Season": [2001] * n, "TeamID": list(range(n)), "OppID": [0] * n, "DayNum": [1] * n, "GameNo": list(range(n)), "home": [0] * n}
    for c in bank.SCORES:
        x = rng.integers(0, 4 if c != "NumOT" and rng.random() < 0.5 else 60, n)
        games[c] = [None if z else int(v) for v, z in zip(x, rng.random(n) < 0.02, strict=True)]
    df = spark.createDataFrame(list(zip(*games.values(), strict=True)), ", ".join(f"{c} {'string' if c == 'Gender' else 'int'}" for c in games))
    want = {r.TeamID: r for r in bank.signals(df).collect()}
    frame = bank.windows(df, 120)
    got = {(r.TeamID, r.signal): r["max"] for r in frame.where("context = 'season'").collect()}
    assert set(box) < set(bank.SCORES) and len(got) == 32 * n and sum(v is None for v in got.values()) > 100
    assert got == {(t, s): r[s] for t, r in want.items() for s in bank.SIGNALS}
    for plan in (frame, bank.venues(df), bank.trajectories(df, 120), bank.peer_values(df)):
        assert "0.475" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_peers_share_ranks_without_joins_by_value(spark):
    rows = [("M", 1, t, "win", m, None if t == 3 else 2.0, float(t)) for t, m in enumerate([1.0, 1.0, None, 3.0, 0.5])]
    df = spark.createDataFrame(rows, "Gender string, Season int, TeamID int, signal string, m double, r double, s double")
    t = bank.peers(df)
    got = {r.TeamID: r for r in t.collect()}
    for value, out in (("m", "percentile"), ("r", "recent_percentile"), ("s", "consistency_percentile")):
        want = {r.TeamID: r.p for r in windows.average_rank(df, value, ["Gender", "Season", "signal"], "p").collect()}
        assert {k: r[out] for k, r in got.items()} == want
    assert got[2].zscore is None and got[3].zscore == pytest.approx(np.subtract(3, 1.375) / np.std([1, 1, 3, 0.5], ddof=1))
    assert "Join" not in t._jdf.queryExecution().executedPlan().toString()


def counted(monkeypatch, module, name):
    calls, own = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **kw: calls.append(1) or own(*a, **kw))
    return calls


def test_coaches_of_many_stints_are_not_paired(spark):
    rng = np.random.default_rng(5)
    rows = sorted({("M", int(s), int(t)) for s, t in zip(rng.integers(2001, 2009, 150), rng.integers(1, 25, 150), strict=True)})
    rows = [(*r, 0, 400, f"C{rng.integers(0, 3)}") for r in rows]
    coaches = spark.createDataFrame(rows, "Gender string, Season int, TeamID int, FirstDayNum int, LastDayNum int, CoachName string")
    games = coaches.select("Gender", "Season", "TeamID", F.lit(100).alias("DayNum"), F.lit(1).alias("win"), F.lit(5).alias("margin"))
    t = history.coach_history(coaches, games, games.limit(0), 300)
    got = {(r.Season, r.TeamID): r for r in t.collect()}
    assert len(got) == len(rows)
    for _, s, i, _, _, c in rows:
        past = {(r[1], r[2]) for r in rows if r[5] == c and r[1] < s}
        tenure = next(k for k in range(20) if (s - 1 - k, i) not in past)
        r = got[s, i]
        assert (r.prior_teams, r.prior_seasons, r.tenure) == (len({x for _, x in past}), len({y for y, _ in past}), tenure)
    busiest = max(sum(r[5] == c for r in rows) for c in ("C0", "C1", "C2"))
    assert busiest > 30 and "_t#" not in t._jdf.queryExecution().optimizedPlan().toString()  # no stint meets another


@pytest.mark.parametrize("name", ["coach_history", "distribution_long", "resume_pairs", "league_audit", "blend_verify"])
def test_league_of_wide_keys_equals_statements(spark, wide_keys, name):
    got, want = compared(spark, wide_keys, name)
    assert got == want and got


def test_the_league_is_made_once_for_the_audit(spark, monkeypatch):
    kept = counted(monkeypatch, storage, "stored")
    storage._tables(spark, SF)
    assert len(kept) == 1  # all tables are cut from these games


def test_snapshots_of_pairs_are_made_once(spark, monkeypatch):
    kept = counted(monkeypatch, store, "stored")
    teams = spark.createDataFrame([("M", 1, 1.0), ("M", 2, 3.0)], "Gender string, TeamID int, x double")
    pairs = spark.createDataFrame([(0, "M", 1, 2)], "n int, Gender string, Team1ID int, Team2ID int")
    assert joins.ordered_pair_differences(pairs, teams, ["Gender"], ["x"], "n").first().diff_x == -2.0 and len(kept) == 2


def test_percentiles_come_from_batches_of_teams(spark):
    plan = registry.queries()["distribution_long"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "percentile" not in plan and "Generate explode" not in plan


def test_rows_are_numbered_without_python_and_only_what_is_kept_is_written(spark):
    df = spark.createDataFrame([(i * 7 % 50, f"v{i}") for i in range(50)], "k int, v string").repartition(5)
    t = sinks.ordered_rows(df, [F.col("k")], "n", keep=["v"])
    assert t.columns == ["n", "v"]
    want = [f"v{i}" for i in sorted(range(50), key=lambda i: i * 7 % 50)]
    assert [r.v for r in sorted(t.collect(), key=lambda r: r.n)] == want and sorted(r.n for r in t.collect()) == list(range(50))


def test_a_blend_is_verified_in_one_aggregate(spark):
    rows = spark.createDataFrame([(1, "a", 0.2, 1), (1, "b", 0.6, 1), (1, "b", 0.7, 1), (2, "a", 0.5, 0)], "g int, s string, p double, y int")
    t = evaluate.verified_blend(rows, "s", {"a": 0.25, "b": 0.75}, ["g"])
    assert {r.g: r.rebuilt for r in t.collect()} == {1: pytest.approx(0.5), 2: None}
    assert "Join" not in registry.queries()["blend_verify"](spark, SF)._jdf.queryExecution().executedPlan().toString()
