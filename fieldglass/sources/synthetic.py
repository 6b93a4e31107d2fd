"""Deterministic synthetic leagues from sequences and hashes, with no random state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.functions.stats import uniform_hash


def round_robin(spark: SparkSession, seasons: int, teams: int, first: int = 2000) -> DataFrame:
    """Season, Round, home, away: each pair once a season, by rotation; ``teams`` is even."""
    m = teams - 1
    grid = spark.range(seasons * m * (teams // 2)).select(
        (F.lit(first) + F.floor(F.col("id") / (m * (teams // 2)))).cast("int").alias("Season"),
        (F.floor(F.col("id") / (teams // 2)) % m).cast("int").alias("Round"),
        (F.col("id") % (teams // 2)).cast("int").alias("g"),
    )
    home = F.when(F.col("g") == 0, F.lit(m)).otherwise((F.col("Round") + F.col("g")) % m)
    away = F.when(F.col("g") == 0, F.col("Round") % m).otherwise((F.col("Round") - F.col("g") + m) % m)
    return grid.select("Season", "Round", home.cast("int").alias("home"), away.cast("int").alias("away"))


def played(league: DataFrame, seed: int = 1) -> DataFrame:
    """The league with an outcome of the home side, from hashes of the pairing."""
    return league.withColumn("y", (uniform_hash(F.lit(seed), "Season", "Round", "home", "away") < 0.55).cast("int"))


def scheduled(teams: DataFrame, size: int) -> DataFrame:
    """league, Round, home, away: a single round robin of every league of given teams (league, place from 0, team), by the circle
    method for ``size`` places, an even number: pairs of the first places meet in the round of their sum, the last place
    meets each in turn. Leagues with open places have fewer games."""
    m = size - 1
    one = teams.select("league", F.col("place").alias("i"), F.col("team").alias("home"))
    two = teams.select("league", F.col("place").alias("j"), F.col("team").alias("away"))
    day = F.when(F.col("j") == m, 2 * F.col("i")).otherwise(F.col("i") + F.col("j")) % m
    return one.join(two, "league").where("i < j").select("league", day.cast("int").alias("Round"), "home", "away")


def unfitted_forecasts(games: DataFrame, seed: int = 7) -> DataFrame:
    """Games (Season, GameNo, Team1ID, Team2ID) with ratings that follow from hashes of season and team, the forecast that the
    rating formula gives, and an outcome from a hash of the game: nothing is fitted and no result has been looked at."""
    rating = lambda t: 1300 + 400 * uniform_hash(F.lit(seed), "Season", t)
    g = games.withColumns({"rating1": rating("Team1ID"), "rating2": rating("Team2ID")})
    g = g.withColumn("p", 1 / (1 + F.pow(F.lit(10.0), (F.col("rating2") - F.col("rating1")) / 400)))
    return g.withColumn("y", (uniform_hash(F.lit(seed), F.lit("y"), "Season", "GameNo") < F.col("p")).cast("int"))


def unfitted(spark: SparkSession, seasons: int = 4, teams: int = 12, rounds: int = 22, first: int = 2001, seed: int = 7) -> DataFrame:
    """Season, Game, Team1ID, Team2ID, rating1, rating2, p, y: games between teams whose ratings follow from hashes; the
    forecast is the rating formula and no outcome has been looked at."""
    rating = lambda t: (1300 + 400 * uniform_hash(F.lit(seed), "Season", t)).alias(f"rating{t[4]}")
    g = spark.range(seasons * rounds).select((F.lit(first) + F.floor(F.col("id") / rounds)).cast("int").alias("Season"), (F.col("id") % rounds).cast("int").alias("Game"))
    one = F.floor(uniform_hash(F.lit(seed), F.lit("a"), "Season", "Game") * teams).cast("int")
    step = 1 + F.floor(uniform_hash(F.lit(seed), F.lit("b"), "Season", "Game") * (teams - 1)).cast("int")
    g = g.withColumn("_a", one).withColumn("_b", (F.col("_a") + step) % teams)
    g = g.select("Season", "Game", (1000 + F.least("_a", "_b")).cast("int").alias("Team1ID"), (1000 + F.greatest("_a", "_b")).cast("int").alias("Team2ID"))
    g = g.select("*", rating("Team1ID"), rating("Team2ID")).withColumn("p", 1 / (1 + F.pow(F.lit(10.0), (F.col("rating2") - F.col("rating1")) / 400)))
    return g.withColumn("y", (uniform_hash(F.lit(seed), F.lit("y"), "Season", "Game") < F.col("p")).cast("int"))
