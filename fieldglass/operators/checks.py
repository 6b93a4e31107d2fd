"""Validation: every check is a query of violating rows; ``require_empty`` of joins.py makes it a guard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for each rule a row breaks; a rule is the condition of a bad row. One scan for all rules."""
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def game_rules(stats: bool = True) -> dict[str, Column]:
    """What makes a game invalid."""
    c = F.col
    rules = {
        "null": reduce(lambda a, b: a | b, [c(x).isNull() for x in ("Season", "DayNum", "WTeamID", "LTeamID", "WScore", "LScore", "WLoc")]),
        "location": ~c("WLoc").isin("H", "A", "N"),
        "score": (c("WScore") <= c("LScore")) | (c("LScore") < 0),
        "same_team": c("WTeamID") == c("LTeamID"),
        "overtime": c("NumOT") < 0,
    }
    if stats:
        for s in "WL":
            rules[f"{s}_made"] = (c(f"{s}FGM") > c(f"{s}FGA")) | (c(f"{s}FTM") > c(f"{s}FTA")) | (c(f"{s}FGM3") > c(f"{s}FGA3"))
            rules[f"{s}_three"] = c(f"{s}FGM3") > c(f"{s}FGM")
    return rules


def duplicate_games(games: DataFrame) -> DataFrame:
    """Physical games (day and both teams, whoever won) recorded more than once."""
    key = [c for c in ("Gender", "Season", "DayNum") if c in games.columns]
    return games.groupBy(*key, F.least("WTeamID", "LTeamID").alias("low"), F.greatest("WTeamID", "LTeamID").alias("high")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def audit(df: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """check, passed, severity, failures: all checks are one aggregate."""
    counted = df.agg(*[F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias(f"c{i}") for i, (bad, _) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), (F.col(f"c{i}") == 0).alias("passed"), F.lit(sev).alias("severity"), F.col(f"c{i}").alias("failures")) for i, (n, (_, sev)) in enumerate(checks.items())])
    return counted.select(F.inline(rows))


def column_profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, rows, missing, distinct, low, high (as strings): one aggregate over all columns."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"k{i}"), distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), (F.col("n") - F.col(f"k{i}")).alias("missing"), F.col(f"d{i}").alias("distinct"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(rows))


def transitions(members: DataFrame, keys: list[str], step: str, member: str) -> DataFrame:
    """(keys, step, prior, added, removed, current): members (unique by keys and step) of each step that occurs and how they
    change from the step before it. One shuffle by member; steps are few."""
    steps = members.select(*keys, step).distinct()
    after = steps.withColumn("_next", F.lead(step).over(Window.partitionBy(*keys).orderBy(step)))  # a row a step
    w = Window.partitionBy(*keys, member).orderBy(step)
    at = members.join(after, [*keys, step]).withColumn("_had", F.lag("_next").over(w) == F.col(step)).withColumn("_stays", F.lead(step).over(w) == F.col("_next"))
    now = at.groupBy(*keys, step).agg(F.count(F.lit(1)).alias("current"), F.count(F.when(~F.coalesce("_had", F.lit(False)), 1)).alias("added"))
    gone = at.groupBy(*keys, F.col("_next").alias(step)).agg(F.count(F.lit(1)).alias("prior"), F.count(F.when(~F.coalesce("_stays", F.lit(False)), 1)).alias("removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return now.join(gone, [*keys, step], "left").select(*keys, step, zero("prior"), "added", zero("removed"), "current")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (as a multiset) in one and not in the other, marked by side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def submission_rules(id_column: str = "ID", pred: str = "Pred") -> dict[str, Column]:
    ok = F.col(id_column).rlike(r"^\d{4}_\d+_\d+$")
    part = F.split(F.col(id_column), "_")
    return {
        "id": ~ok | F.col(id_column).isNull(),
        "order": ok & (F.try_element_at(part, F.lit(2)).cast("int") >= F.try_element_at(part, F.lit(3)).cast("int")),
        "range": F.col(pred).isNull() | F.isnan(pred) | (F.col(pred) < 0) | (F.col(pred) > 1),
    }
