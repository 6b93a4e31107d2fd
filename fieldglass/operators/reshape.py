"""Games to team rows, canonical orientation, codes and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_location(loc: Column | str = "WLoc") -> Column:
    loc = F.col(loc) if isinstance(loc, str) else loc
    return F.when(loc == "H", 1).when(loc == "A", -1).otherwise(0)


def inverted_location(loc: Column | str = "WLoc") -> Column:
    """H and A change places; anything else stays."""
    loc = F.col(loc) if isinstance(loc, str) else loc
    return F.when(loc == "H", "A").when(loc == "A", "H").otherwise(loc)


def team_rows(games: DataFrame, stats: list[str] = (), keys: list[str] = ("Gender", "Season", "DayNum", "GameNo", "NumOT")) -> DataFrame:
    """Two rows a game: TeamID, OppID, scores, margin, win, home, and each side's statistics with ``opp_`` for the other's.

    One scan: both rows come from an array of structs, so the games aren't computed twice.
    """
    keys = [k for k in keys if k in games.columns]

    def side(a: str, b: str, win: int) -> Column:
        home = signed_location() if win else -signed_location()
        cols = [F.col(f"{a}TeamID").alias("TeamID"), F.col(f"{b}TeamID").alias("OppID"), F.col(f"{a}Score").alias("Score"), F.col(f"{b}Score").alias("OppScore")]
        cols += [(F.col(f"{a}Score") - F.col(f"{b}Score")).alias("margin"), F.lit(win).alias("win"), home.cast("int").alias("home")]
        for s in stats:
            cols += [F.col(f"{a}{s}").alias(s), F.col(f"{b}{s}").alias(f"opp_{s}")]
        return F.struct(*cols)

    return games.select(*keys, F.inline(F.array(side("W", "L", 1), side("L", "W", 0))))


def canonical(games: DataFrame) -> DataFrame:
    """One row a game with the lower id first: Team1ID, Team2ID, scores, margin, location and outcome of team 1, ID."""
    first = F.col("WTeamID") < F.col("LTeamID")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    rows = games.select(
        *[k for k in ("Gender", "Season", "DayNum", "GameNo") if k in games.columns],
        F.least("WTeamID", "LTeamID").alias("Team1ID"),
        F.greatest("WTeamID", "LTeamID").alias("Team2ID"),
        pick("WScore", "LScore").alias("Team1Score"),
        pick("LScore", "WScore").alias("Team2Score"),
        F.when(first, F.col("WLoc")).otherwise(inverted_location()).alias("Team1Loc"),
        first.cast("int").alias("y"),
    )
    return rows.withColumn("Team1Margin", F.col("Team1Score") - F.col("Team2Score")).withColumn("ID", F.concat_ws("_", "Season", "Team1ID", "Team2ID"))


def parse_matchup_id(df: DataFrame, column: str = "ID", split_at: int = 3000) -> DataFrame:
    """Season, Team1ID, Team2ID and Gender (both ids below ``split_at``: M; both from it on: W; else INVALID)."""
    part = F.split(F.col(column), "_")
    got = df.withColumns({n: part[i].cast("int") for i, n in enumerate(("Season", "Team1ID", "Team2ID"))})
    low, high = F.greatest("Team1ID", "Team2ID") < split_at, F.least("Team1ID", "Team2ID") >= split_at
    return got.withColumn("Gender", F.when(low, "M").when(high, "W").otherwise("INVALID"))


def split_seed(df: DataFrame, column: str = "Seed") -> DataFrame:
    """Region, SeedNum and PlayIn of codes such as W01a; null where a part, or the whole, doesn't match."""
    pattern = r"^([WXYZ])(\d{2})([ab]?)$"
    part = lambda i: F.nullif(F.regexp_extract(column, pattern, i), F.lit(""))
    return df.withColumns({"Region": part(1), "SeedNum": part(2).cast("int"), "PlayIn": part(3)})


def mirrored(rows: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Training rows and their mirror images: features negated, label flipped."""
    other = [(-F.col(c)).alias(c) if c in features else (1 - F.col(c)).alias(c) if c == label else F.col(c) for c in rows.columns]
    return rows.unionByName(rows.select(*other))


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def to_date(text: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """The date that a text says; null where it says none."""
    return F.try_to_date(F.col(text) if isinstance(text, str) else text, pattern)
