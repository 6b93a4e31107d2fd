"""Contracts of tables that cross a boundary: matrices, templates, requests, labels, ledgers, catalogues.

Each is a query of violating rows with the rule they break, in one pass where the rule is about a row and one shuffle
where it is about a key. ``joins.require_empty`` makes a guard of any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.operators.checks import violations


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def schema_gaps(df: DataFrame, declared: dict[str, str]) -> list[tuple[str, str]]:
    """(column, what is wrong) against declared names, order and types; empty if the frame is as declared."""
    have = dict(df.dtypes)
    out = [(c, "missing") for c in declared if c not in have] + [(c, "not declared") for c in have if c not in declared]
    out += [(c, f"{have[c]} instead of {t}") for c, t in declared.items() if c in have and have[c] != t]
    return out if out or list(have) == list(declared) else [(c, "out of order") for c in have]


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(keys, rule) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(rule).alias("rule"))


def finite(columns: list[str]) -> Column:
    return ~_any([F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns])


def game_contract(games: DataFrame, stats: list[str] = ()) -> DataFrame:
    """(Season, DayNum, low, high, rule): what makes an official game invalid, nulls in any required column included."""
    c = F.col
    sides = [f"{s}{x}" for s in "WL" for x in stats]
    numbers = ["Season", "DayNum", "WTeamID", "LTeamID", "WScore", "LScore", *sides]
    rules = {
        "null": _any([c(x).isNull() for x in [*numbers, "WLoc"]]),
        "not finite": ~finite(numbers),
        "negative": _any([c(x) < 0 for x in numbers]),
        "location": ~c("WLoc").isin("H", "A", "N"),
        "same team": c("WTeamID") == c("LTeamID"),
        "score": c("WScore") <= c("LScore"),
    }
    for made, tried in (("FGM", "FGA"), ("FGM3", "FGA3"), ("FTM", "FTA"), ("FGM3", "FGM")):
        if made in stats and tried in stats:
            rules[f"{made} above {tried}"] = _any([c(f"{s}{made}") > c(f"{s}{tried}") for s in "WL"])
    keys = ["Season", "DayNum", F.least("WTeamID", "LTeamID").alias("low"), F.greatest("WTeamID", "LTeamID").alias("high")]
    named = games.select("*", *keys[2:])
    bad = violations(named, rules, ["Season", "DayNum", "low", "high"])
    return bad.unionByName(repeated(named, ["Season", "DayNum", "low", "high"], "repeated"))


def evaluation_games(games: DataFrame, first: int, last: int, excluded: list[int] = (), after: int = 132, populations: tuple[str, ...] = ("M", "W")) -> DataFrame:
    """(Gender, Season, ID, rule): what makes labelled games (Gender, Season, DayNum, ID, y) unfit to evaluate on: seasons outside the
    declared ones, days not after the cutoff, unknown populations or outcomes, ids that don't name the season and two teams of
    four digits, the lower one first, and games that are there twice."""
    c = F.col
    part = lambda i: F.regexp_extract("ID", r"^(\d{4})_(\d{4})_(\d{4})$", i)
    named = F.coalesce(part(1) != "", F.lit(False))
    rules = {
        "null": _any([c(x).isNull() for x in ("Gender", "Season", "DayNum", "ID", "y")]),
        "season": ~c("Season").between(first, last) | c("Season").isin(*(excluded or [-1])),
        "day": c("DayNum") <= after,
        "population": ~c("Gender").isin(*populations),
        "outcome": ~c("y").isin(0, 1),
        "id": ~named,
        "season of id": named & (part(1) != c("Season").cast("string")),
        "order": named & (part(2) >= part(3)),
    }
    keys = ["Gender", "Season", "ID"]
    return violations(games, rules, keys).unionByName(repeated(games, keys, "repeated"))


def selection_history(choices: DataFrame, keys: list[str], season: str = "Season", least: int = 2) -> DataFrame:
    """(keys, season, rule) of choices (keys, season, history_last_season, history_seasons) that didn't use strictly earlier seasons
    only, or fewer than ``least``, or that were made twice for one season."""
    rules = {
        "unknown history": F.col("history_last_season").isNull() | F.col("history_seasons").isNull(),
        "later season": F.col("history_last_season") >= F.col(season),
        "too few seasons": F.col("history_seasons") < least,
    }
    at = [*keys, season]
    return violations(choices, rules, at).unionByName(repeated(choices, at, "repeated"))


def matrix_contract(m: DataFrame, last_season: int, excluded: list[int] = (), cutoff: int = 132) -> DataFrame:
    """(Gender, Season, ID, rule) of a labelled matrix: canonical ids, both labels only, seasons and days in bounds, once a game."""
    c = F.col
    rules = {
        "null": _any([c(x).isNull() for x in ("Gender", "Season", "DayNum", "ID", "y", "Team1ID", "Team2ID")]),
        "gender": ~c("Gender").isin("M", "W"),
        "label": ~c("y").isin(0, 1),
        "season": (c("Season") > last_season) | c("Season").isin(*excluded) if excluded else c("Season") > last_season,
        "day": c("DayNum") <= cutoff,
        "id": c("ID") != F.concat_ws("_", "Season", "Team1ID", "Team2ID"),
        "order": c("Team1ID") >= c("Team2ID"),
    }
    keys = ["Gender", "Season", "ID"]
    return violations(m, rules, keys).unionByName(repeated(m, keys, "repeated"))


def template_pairs(template: DataFrame, teams: DataFrame, id_column: str = "ID") -> DataFrame:
    """The template's rows with Season, Team1ID, Team2ID and the Gender that the snapshot gives both teams; ``rule`` names what
    is wrong with an id (pattern, order, unknown team, genders differ), else null."""
    ok = F.col(id_column).rlike(r"^\d{4}_\d+_\d+$")
    part = F.split(F.col(id_column), "_")
    num = lambda i: F.when(ok, F.try_element_at(part, F.lit(i))).cast("int")
    t = template.withColumns({"Season": num(1), "Team1ID": num(2), "Team2ID": num(3)})
    known = teams.select("Season", "TeamID", "Gender").distinct()
    for i in (1, 2):
        t = t.join(known.select("Season", F.col("TeamID").alias(f"Team{i}ID"), F.col("Gender").alias(f"_g{i}")), ["Season", f"Team{i}ID"], "left")
    rule = F.when(~ok, "pattern").when(F.col("Team1ID") >= F.col("Team2ID"), "order").when(F.col("_g1").isNull() | F.col("_g2").isNull(), "unknown team").when(F.col("_g1") != F.col("_g2"), "genders differ")
    return t.select(*template.columns, "Season", "Team1ID", "Team2ID", F.when(rule.isNull(), F.col("_g1")).alias("Gender"), rule.alias("rule"))


def inference_contract(matrix: DataFrame, template: DataFrame, labels: list[str] = ("y", "Pred"), sides: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(ID, rule): ids of the matrix that the template lacks, of the template that the matrix lacks, repeated ids, and ids whose
    teams' numbers don't suit the gender: women's begin with a digit from 3 on (``sides``: which of
    an id's two teams are looked at). A matrix with a label column is refused."""
    held = [c for c in labels if c in matrix.columns]
    if held:
        raise ValueError(f"an inference matrix holds labels: {held}")
    a, b = matrix.select("ID", "Gender"), template.select("ID")
    part = F.split("ID", "_")
    from_ = lambda i: F.substring(part[i], 1, 1) >= "3"
    women = F.col("Gender") == "W"
    unsuited = a.where(_any([from_(i) != women for i in sides])).select("ID", F.lit("gender").alias("rule"))
    lacks = lambda x, y, r: x.select("ID").join(y.select("ID"), "ID", "left_anti").select("ID", F.lit(r).alias("rule"))
    return unsuited.unionByName(lacks(a, b, "not in template")).unionByName(lacks(b, a, "not in matrix")).unionByName(repeated(a, ["ID"], "repeated"))


def submission_contract(s: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """(ID, rule) of a submission with columns ID string, Pred double, in that order."""
    gaps = schema_gaps(s, declared or {"ID": "string", "Pred": "double"})
    if gaps:
        raise ValueError(f"a submission's columns differ: {gaps}")
    ok = F.col("ID").rlike(r"^\d{4}_\d+_\d+$")
    part = F.split("ID", "_")
    rules = {
        "id": F.col("ID").isNull() | ~ok,
        "order": ok & (F.try_element_at(part, F.lit(2)).cast("int") >= F.try_element_at(part, F.lit(3)).cast("int")),
        "range": F.col("Pred").isNull() | F.isnan("Pred") | (F.col("Pred") < 0) | (F.col("Pred") > 1),
    }
    return violations(s, rules, ["ID"]).unionByName(repeated(s, ["ID"], "repeated"))


def alignment(rows: DataFrame, game: list[str], stream: str = "stream", label: str = "y") -> DataFrame:
    """(game, rule) where streams disagree: a stream lacks a game that another has, has it twice, or labels differ."""
    streams = rows.select(stream).distinct().agg(F.count(F.lit(1)).alias("_all"))  # one row
    per = rows.groupBy(*game).agg(F.countDistinct(stream).alias("_s"), F.count(F.lit(1)).alias("_n"), F.min(label).alias("_a"), F.max(label).alias("_b"))
    rules = {"missing": F.col("_s") < F.col("_all"), "repeated": F.col("_n") > F.col("_s"), "labels": F.col("_a") != F.col("_b")}
    return violations(per.crossJoin(F.broadcast(streams)), rules, game)


def label_clock(rows: DataFrame, started: str, available: str, fitted: str) -> DataFrame:
    """Rows with ``rule``: a label known before its game starts, or not before the fit that uses it."""
    rules = {"null clock": F.col(started).isNull() | F.col(available).isNull(), "before the game": F.col(available) <= F.col(started), "after the fit": F.col(available) > F.col(fitted)}
    return violations(rows, rules, [c for c in rows.columns])


def request_contract(r: DataFrame, numbers: dict[str, tuple[float, float]]) -> DataFrame:
    """(id, rule) of forecast requests (id, season, started_at, observed_at, team_a, team_b, numbers): clocks in order, numbers
    finite and in range, two teams, and no game asked twice, swapped teams included."""
    c = F.col
    out = [c(n).isNull() | F.isnan(c(n).cast("double")) | (c(n) < lo) | (c(n) > hi) for n, (lo, hi) in numbers.items()]
    rules = {"clock": c("observed_at").isNull() | c("started_at").isNull() | (c("observed_at") >= c("started_at")), "teams": c("team_a").isNull() | c("team_b").isNull() | (c("team_a") == c("team_b")), "range": _any(out)}
    pair = ["season", "started_at", F.least("team_a", "team_b").alias("_l"), F.greatest("team_a", "team_b").alias("_h")]
    twice = r.select("id", *pair).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("season", "started_at", "_l", "_h"))).where("_n > 1")
    return violations(r, rules, ["id"]).unionByName(twice.select("id", F.lit("repeated").alias("rule")))


def state_partition(rows: DataFrame, keys: list[str], required: str, states: list[str]) -> DataFrame:
    """(keys, rule) of rows whose states don't add up to what is required, or are negative."""
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in states), F.lit(0))
    return violations(rows, {"negative": _any([F.col(s) < 0 for s in states]), "sum": total != F.col(required)}, keys)


def uncovered(seasons: DataFrame, rankings: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Seasons with fewer than ``least`` ranking systems."""
    have = rankings.groupBy(*keys).agg(F.countDistinct("SystemName").alias("_n"))
    return seasons.join(have, keys, "left").where(F.coalesce("_n", F.lit(0)) < least).select(*keys, F.coalesce("_n", F.lit(0)).alias("systems"))


def interval_contract(t: DataFrame, keys: list[str], first: str, last: str, name: str) -> DataFrame:
    """(keys, first, rule): incomplete, reversed or overlapping intervals; one ordered pass a key."""
    w = Window.partitionBy(*keys).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
    r = t.withColumn("_reach", F.max(last).over(w))
    rules = {"incomplete": _any([F.col(c).isNull() for c in (*keys, first, last, name)]), "reversed": F.col(first) > F.col(last), "overlapping": F.col("_reach") >= F.col(first)}
    return violations(r, rules, [*keys, first])


def seed_contract(s: DataFrame, keys: list[str], available: str, cutoff: int, pattern: str = r"^[WXYZ](0[1-9]|1[0-6])[ab]?$") -> DataFrame:
    """(keys, rule) of seeds: malformed codes, codes not yet available at the cutoff, teams seeded twice."""
    rules = {"code": F.col("Seed").isNull() | ~F.col("Seed").rlike(pattern), "late": F.col(available).isNull() | (F.col(available) > cutoff)}
    return violations(s, rules, keys).unionByName(repeated(s, keys, "repeated"))


def reconciled(ledger: DataFrame, fresh: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rule): repeated rows must carry the ledger's value, and the new ones must be the manifest's, no more and no less."""
    both = fresh.join(ledger.select(key, F.col(value).alias("_old")), key, "left")
    differs = both.where(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col(value))).select(key, F.lit("differs").alias("rule"))
    new = both.where(F.col("_old").isNull()).select(key)
    extra = new.join(manifest.select(key), key, "left_anti").select(key, F.lit("not in manifest").alias("rule"))
    return differs.unionByName(extra).unionByName(manifest.select(key).join(fresh.select(key), key, "left_anti").select(key, F.lit("not delivered").alias("rule")))


def manifest_join(scores: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Both sides of a 1:1 manifest with ``state``: both, no file, no score, or repeated."""
    a, b = (t.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for t, n in ((scores, "_s"), (files, "_f")))
    t = a.join(b, key, "full")
    return t.select(key, F.when((F.col("_s") > 1) | (F.col("_f") > 1), "repeated").when(F.col("_f").isNull(), "no file").when(F.col("_s").isNull(), "no score").otherwise("both").alias("state"))
