"""Archive members, inventories, observed audits, exact fingerprints and the limits that they hold to."""

import gzip
import hashlib
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import fingerprint as H
from fieldglass.operators import observed as O
from fieldglass.sources import members, official


def archive(path: Path, **files: str | bytes) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "."), text)


def read(spark, path, columns=("a", "b"), **how):
    return sorted((r.member, int(r.row), r.a, r.b) for r in members.read_members(spark, f"file://{path}", list(columns), **how).collect())


def test_members_are_read_in_executors(spark, tmp_path):
    archive(tmp_path / "one.zip", x__csv='b,a,c\n1,"two\nlines",3\n4,,6\n', y__csv__gz=gzip.compress("a,b\né,2\n".encode()), note__txt="no table")
    archive(tmp_path / "two.zip", z__csv="a,b\n")
    want = [("x.csv", 0, "two\nlines", "1"), ("x.csv", 1, "", "4"), ("y.csv.gz", 0, "é", "2")]
    assert read(spark, tmp_path) == want
    assert read(spark, tmp_path / "one.zip", members="x*") == want[:2]
    assert read(spark, tmp_path, only=[str(tmp_path / "two.zip")]) == []
    assert members.read_members(spark, f"file://{tmp_path}", ["a", "b"]).rdd.getNumPartitions() == 3  # a member each
    with pytest.raises(Exception, match="no member"):
        read(spark, tmp_path, members="*.json")


@pytest.mark.parametrize(
    ("text", "how", "message"),
    [
        ("a,b,a\n1,2,3\n", {}, "header"), ("a,c\n1,2\n", {}, "header"), ("", {}, "header"), ("a,b\n1\n", {}, "row 1 of"), ("a,b\n1,2\n1,2,3\n", {}, "row 2 of"),
        ("a,b\n1,2\n3,4\n", {"rows": 1}, "row 2 of"), ("a,b\n1,2\n3,444444\n", {"chars": 9}, "row 2 of"), (",".join(["a", "b", *map(str, range(63))]) + "\n", {}, "header"), ('a,b\n1,"2\n', {}, "end of data"),
    ],
)
def test_members_out_of_bounds_fail_the_read(spark, tmp_path, text, how, message):
    archive(tmp_path / "one.zip", x__csv=text)
    with pytest.raises(Exception, match=message):
        read(spark, tmp_path, **how)


def test_written_members_come_back_in_their_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f'v"{i},\n') for i in range(25)], "a int, b string").repartition(3)
    made = members.write_members(df, f"file://{tmp_path}/out", "t", rows=4).collect()
    archive(tmp_path / "out" / "stray.zip", x__csv="a,b\n9,9\n")  # of a lost attempt
    got = members.read_members(spark, f"file://{tmp_path}/out", ["a", "b"], only=[r.archive for r in made]).collect()
    assert sum(r.rows for r in made) == 25 and {(int(r.a), r.b) for r in got} == {(i, "" if i == 3 else f'v"{i},\n') for i in range(25)}


def test_inventory_streams_records_with_quoted_newlines(spark, tmp_path):
    data = 'id,name\n2,"two\nlines"\n1,\n\n10\n'
    (tmp_path / "t.csv").write_text(data)
    (tmp_path / "empty.csv").write_text("")
    got = {(r.file, r.column): r for r in official.inventory(spark, f"file://{tmp_path}").collect()}
    a, b = got["t.csv", "id"], got["t.csv", "name"]
    assert (a.bytes, a.sha256, a.rows, a.place) == (len(data), hashlib.sha256(data.encode()).hexdigest(), 3, 0)
    assert (a.missing, a.low, a.high) == (0, "1", "2") and (b.missing, b.low, b.high) == (2, "two\nlines", "two\nlines")
    assert got["empty.csv", None].rows == 0 and len(got) == 3


def test_fitted_blocks_are_typed_ordered_and_bounded(spark, tmp_path):
    (tmp_path / "f.csv").write_text("block,fitted,name\nfull,true,b\nfull,true,a\nfull,false,c\nseed,true,a\n")
    how = (f"file://{tmp_path}/f.csv", "block string, fitted boolean, name string", "block = 'full' and fitted", ["name"], ["block", "name"])
    assert [r.name for r in official.fitted_block(spark, *how).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="bytes of text"):
        official.fitted_block(spark, *how, most_bytes=20)
    with pytest.raises(Exception, match="repeated"):
        official.fitted_block(spark, *how[:2], "fitted", ["name"], ["name"])


@pytest.mark.parametrize(("leaf", "node"), [(1000, 10), (7, 3)])
def test_fingerprints_are_those_of_the_bytes(spark, leaf, node):
    rng = np.random.default_rng(3)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.normal(size=60))] + [("b", 0, None), ("b", 1, -0.0), (None, 5, 1.5)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)

    def tree(values):
        raw = np.array([np.nan if v is None else v for v in values], "<f8")
        level = [hashlib.sha256(raw[a : a + leaf].tobytes()).digest() for a in range(0, len(raw), leaf)]
        while len(level) > 1:
            level = [hashlib.sha256(b"".join(level[a : a + node])).digest() for a in range(0, len(level), node)]
        return level[0].hex()

    got = {r.k: (r.n, r.fingerprint) for r in H.vector_fingerprint(df, "k", [F.col("i")], "v", leaf, node).collect()}
    # short vectors are hashed again as lone digests of a level that longer ones need
    lone = lambda d, times: d if not times else lone(hashlib.sha256(bytes.fromhex(d)).hexdigest(), times - 1)
    times = 0 if leaf == 1000 else 2
    assert got == {"a": (60, tree([r[2] for r in rows[:60]])), "b": (2, lone(tree([None, -0.0]), times)), None: (1, lone(tree([1.5]), times))}
    assert H.vector_fingerprint(df.limit(0), "k", [F.col("i")], "v").count() == 0


GAMES = "Season int, DayNum int, WTeamID int, LTeamID int, WScore int, LScore int"


def test_audit_counts_planted_faults_while_writing(spark, tmp_path):
    good = [(2016, 10, 1001, 1002, 80, 70), (2016, 11, 1003, 1002, 75, 60)]
    bad = [(2016, 12, 1001, 1001, 50, 60), (2016, 140, 1001, 1002, 80, 70), good[0]]
    tables = {
        "MTeams": spark.createDataFrame([(1001,), (3005,)], "TeamID int"), "WTeams": spark.createDataFrame([(3005,), (12,)], "TeamID int"),
        "MRegularSeasonCompactResults": spark.createDataFrame(good + bad, GAMES), "WNCAATourneyCompactResults": spark.createDataFrame([(2026, 140, 3001, 3002, 9, 8)], GAMES),
        "SampleSubmissionStage1": spark.createDataFrame([("2026_1001_1002",), ("2026_1002_1001",), ("2026_1001_3001",), ("2026_1001",), (None,)], "ID string"),
    }
    kept, report = O.audit_tables(spark, tables, f"file://{tmp_path}", ["MTeams", "WTeams", "MTeamSpellings"], 2026)
    got = {r.check: (r.passed, r.severity, r.failures) for r in report.collect()}
    assert got["required tables"] == (False, "ERROR", 1) and got["no team in both populations"] == (False, "ERROR", 1)
    assert got["MTeams: ids of the population"] == (False, "ERROR", 1) and got["WTeams: ids of the population"] == (False, "ERROR", 1)
    m = "MRegularSeasonCompactResults: "
    assert [got[m + x] for x in ("teams differ", "winner scores more", "regular season's days", "unique games")] == [(False, "ERROR", 1)] * 4
    assert got["WNCAATourneyCompactResults: no outcome of the target season"] == (False, "WARNING", 1) and got["WNCAATourneyCompactResults: teams differ"] == (True, "ERROR", 0)
    s = "SampleSubmissionStage1: "
    assert [got[s + x][2] for x in ("three parts", "lower team first", "one population")] == [2, 1, 1]
    assert kept["MRegularSeasonCompactResults"].count() == 5 and len(got) == 15


def test_box_scores_are_reconciled(spark, tmp_path):
    cols = [f"{s}{x}" for s in "WL" for x in ("FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "TO")]
    row = lambda *over: (2016, 10, 1001, 1002, 65, 55, *dict(dict(zip(cols, [25, 50, 5, 20, 10, 15, 8, 9, 20, 50, 5, 20, 10, 15, 8, 9], strict=True)), **dict(over)).values())
    df = spark.createDataFrame([row(), row(("WFGM", 51)), row(("LOR", 0))], GAMES + "".join(f", {x} int" for x in cols))
    counts = O.write_observed(df, f"file://{tmp_path}/x", O.result_rules("MRegularSeasonDetailedResults", 2026), "x")[1]
    assert (counts["rows"], counts["made shots within attempts"], counts["points reconcile"], counts["possession gap"], counts["teams differ"]) == (3, 1, 1, 1, 0)
    none = O.write_observed(df.limit(0), f"file://{tmp_path}/y", O.result_rules("MRegularSeasonDetailedResults", 2026), "y")[1]
    assert set(none.values()) == {0}
