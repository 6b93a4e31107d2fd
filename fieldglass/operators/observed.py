"""The raw audit of a league's tables: all checks of a table's rows are observed while it is written, in the same job.

Rules are columns that are true where a row breaks them. Counts of broken rules come from ``DataFrame.observe`` and cost no
further scan; only what compares rows with other rows (unique keys, matching keys, populations) takes jobs of its own,
over the written columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

c = F.col
GAME = ["Season", "DayNum", "WTeamID", "LTeamID"]
#: The first women's id, the last day of a regular season, and from when box scores are recorded.
WOMEN_FROM, LAST_REGULAR_DAY, BOX_FROM = 3000, 132, {"M": 2003, "W": 2010}
REPORT = "check string, passed boolean, severity string, failures long"


@dataclass(frozen=True)
class Rule:
    """A named condition that holds where a row is wrong."""

    name: str
    severity: str
    broken: Column


def _possessions(side: str) -> Column:
    return c(f"{side}FGA") - c(f"{side}OR") + c(f"{side}TO") + 0.475 * c(f"{side}FTA")


def _points(side: str) -> Column:
    return 2 * c(f"{side}FGM") + c(f"{side}FGM3") + c(f"{side}FTM")


def result_rules(table: str, target_season: int, last_regular_day: int = LAST_REGULAR_DAY) -> list[Rule]:
    """Rules of a results table, by its name: regular season or tournament, compact or detailed."""
    rules = [Rule("teams differ", "ERROR", c("WTeamID") == c("LTeamID")), Rule("winner scores more", "ERROR", c("WScore") <= c("LScore"))]
    if "RegularSeason" in table:
        rules.append(Rule("regular season's days", "ERROR", c("DayNum") > last_regular_day))
    if "NCAATourney" in table:
        rules.append(Rule("no outcome of the target season", "WARNING", c("Season") == target_season))
    if "Detailed" in table:
        more = [c(f"{s}{made}") > c(f"{s}{tried}") for s in "WL" for made, tried in (("FGM", "FGA"), ("FGM3", "FGA3"), ("FTM", "FTA"))]
        rules.append(Rule("made shots within attempts", "ERROR", sum((F.when(m, 1).otherwise(0) for m in more[1:]), F.when(more[0], 1).otherwise(0))))
        rules.append(Rule("points reconcile", "WARNING", (_points("W") != c("WScore")) | (_points("L") != c("LScore"))))
        rules.append(Rule("possession gap", "WARNING", F.abs(_possessions("W") - _possessions("L")) > 7))
    return rules


def team_rules(gender: str) -> list[Rule]:
    return [Rule("ids of the population", "ERROR", c("TeamID") >= WOMEN_FROM if gender == "M" else c("TeamID") < WOMEN_FROM)]


def template_rules() -> list[Rule]:
    """Ids of a submission: three parts, lower team first, one population."""
    part = lambda i: F.try_element_at(F.split("ID", "_"), F.lit(i)).try_cast("int")
    return [
        Rule("three parts", "ERROR", ~F.coalesce(F.size(F.split("ID", "_")) == 3, F.lit(False))), Rule("lower team first", "ERROR", part(2) >= part(3)),
        Rule("one population", "ERROR", (part(2) < WOMEN_FROM) != (part(3) < WOMEN_FROM)),
    ]


def write_observed(df: DataFrame, path: str, rules: list[Rule], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Write a table and count what breaks each rule in the same job: the table read back, and the counts by rule."""
    seen = Observation(name)
    counts = [F.sum(F.coalesce(r.broken.cast("int"), F.lit(0))).alias(f"r{i}") for i, r in enumerate(rules)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("errorifexists").parquet(path)
    got = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), {"rows": got["rows"]} | {r.name: got[f"r{i}"] or 0 for i, r in enumerate(rules)}


def repeats(df: DataFrame, keys: list[str]) -> int:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n")).first()[0] or 0


def audit_tables(spark: SparkSession, tables: dict[str, DataFrame], folder: str, required: list[str], target_season: int, last_regular_day: int = LAST_REGULAR_DAY) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables, written to the folder, and their report: check, passed, severity, failures.

    Names are those of official files without suffix: a population's letter, then Teams, ...Results or a SampleSubmission."""
    report, kept = [("required tables", set(required) <= set(tables), "ERROR", len(set(required) - set(tables)))], {}
    add = lambda name, severity, n: report.append((name, n == 0, severity, int(n)))
    for name, df in sorted(tables.items()):
        rules = result_rules(name, target_season, last_regular_day) if name.endswith("Results") else team_rules(name[0]) if name.endswith("Teams") else template_rules() if name.startswith("SampleSubmission") else []
        kept[name], counts = write_observed(df, f"{folder}/{name}", rules, f"audit-{name}")
        for r in rules:
            add(f"{name}: {r.name}", r.severity, counts[r.name])
        if name.endswith("Results"):
            add(f"{name}: unique games", "ERROR", repeats(kept[name], GAME))
    if {"MTeams", "WTeams"} <= set(kept):
        both = kept["MTeams"].select("TeamID").distinct().join(kept["WTeams"].select("TeamID").distinct(), "TeamID")
        add("no team in both populations", "ERROR", both.count())
    for g, start in BOX_FROM.items():
        compact, detailed = kept.get(f"{g}RegularSeasonCompactResults"), kept.get(f"{g}RegularSeasonDetailedResults")
        if compact is not None and detailed is not None:
            add(f"{g}: box scores of all games", "ERROR" if g == "M" else "WARNING", compact.where(c("Season") >= start).join(detailed, GAME, "left_anti").count())
    return kept, spark.createDataFrame(report, REPORT)
