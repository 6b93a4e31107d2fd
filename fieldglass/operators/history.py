"""What a team brings with it: resumes, coaches, earlier seasons, target histories, ranking snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.stats import logit

LEAGUE = ["Gender", "Season"]
KEY = [*LEAGUE, "TeamID"]
RESUME = [
    "quality_wins", "elite_wins", "seeded_wins", "quality_win_rate", "schedule_quality", "elite_win_rate",
    "seeded_win_rate", "bad_loss_rate", "away_quality_wins", "quality_margin", "late_quality_wins",
]


def resume(rows: DataFrame, seeds: DataFrame, cutoff: int) -> DataFrame:
    """KEY and RESUME of team rows (win, margin, home, DayNum) up to the cutoff; ``seeds``: KEY, seed of seeded teams. A game
    against a seed of 1 to 4 counts 6, against another seed 4, else 0.25."""
    opp = seeds.select(*LEAGUE, F.col("TeamID").alias("OppID"), F.col("seed").alias("_seed"))
    g = rows.where(F.col("DayNum") <= cutoff).join(opp, [*LEAGUE, "OppID"], "left")
    elite, seeded = F.coalesce(F.col("_seed") <= 4, F.lit(False)).cast("int"), F.col("_seed").isNotNull().cast("int")
    quality = F.when(elite == 1, 6.0).when(seeded == 1, 4.0).otherwise(0.25)
    late, away = (F.col("DayNum") > cutoff - 30).cast("int"), (F.col("home") <= 0).cast("int")
    g = g.withColumns({"e": elite, "s": seeded, "q": quality, "l": late, "a": away, "qw": quality * F.col("win")})
    total = lambda x: F.sum(x).cast("double")
    win, q, qw = F.col("win"), F.col("q"), F.col("qw")
    made = [
        total(qw), total(F.col("e") * win), total(F.col("s") * win), (total(qw) + 10) / (total(q) + 20), total(q) / F.count(F.lit(1)),
        (total(F.col("e") * win) + 2.5) / (total("e") + 5), (total(F.col("s") * win) + 2.5) / (total("s") + 5),
        (total((1 - F.col("s")) * (1 - win)) + 2.5) / (total(1 - F.col("s")) + 5), total(qw * F.col("a")),
        total(q * F.col("margin")) / (total(q) + 20), total(qw * F.col("l")),
    ]
    return g.groupBy(*KEY).agg(*[c.alias(n) for n, c in zip(RESUME, made, strict=True)])


def coach_history(coaches: DataFrame, regular: DataFrame, tournament: DataFrame, cutoff: int, windows=(1, 3, 5)) -> DataFrame:
    """KEY and what is known of the coach in charge at the cutoff, from earlier seasons only: stint days, changed, tenure,
    prior teams and seasons, tournament appearances and best wins in five seasons, and for each window and kind of games
    the support, win posterior and margin. ``coaches``: KEY, FirstDayNum, LastDayNum, CoachName; games: KEY, DayNum, win,
    margin. A coach without history has zeros; a team without a coach has nulls.

    Scale: games meet intervals by (league, team), and a coach's earlier teams and seasons are running sums over first years,
    so nothing pairs a coach's stints with each other. The rest is by (coach, season), a small table, and the windows are one
    aggregate over the few seasons before each asked one.
    """
    now = coaches.where((F.col("FirstDayNum") <= cutoff) & (F.col("LastDayNum") >= cutoff)).select(*KEY, "CoachName", (cutoff - F.col("FirstDayNum") + 1).cast("double").alias("stint_days"))
    teams = coaches.select(*KEY).distinct()
    asked = now.select("Gender", F.col("Season").alias("_s"), "CoachName").distinct()
    past = coaches.select("Gender", "Season", "TeamID", "CoachName").distinct()
    own = Window.partitionBy("Gender", "CoachName", "TeamID").orderBy("Season")
    stays = past.withColumn("_n", F.row_number().over(own)).withColumn("_first", (F.col("_n") == 1).cast("long"))
    run = Window.partitionBy("Gender", "CoachName", "TeamID", "_run").orderBy("Season")
    tenure = stays.withColumn("_run", F.col("Season") - F.col("_n")).select(*KEY, "CoachName", (F.row_number().over(run) - 1).cast("double").alias("tenure"))
    earlier = Window.partitionBy("Gender", "CoachName").orderBy("Season").rowsBetween(Window.unboundedPreceding, -1)
    spread = stays.groupBy("Gender", "CoachName", "Season").agg(F.sum("_first").alias("_new"))
    spread = spread.select("Gender", "CoachName", "Season", F.sum("_new").over(earlier).cast("double").alias("prior_teams"), F.count(F.lit(1)).over(earlier).cast("double").alias("prior_seasons"))
    last = coaches.groupBy(*KEY).agg(F.max_by("CoachName", "LastDayNum").alias("_prior"))
    last = last.select("Gender", (F.col("Season") + 1).alias("Season"), "TeamID", "_prior")
    out = teams.join(now, KEY, "left").join(last, KEY, "left")
    out = out.withColumn("changed", F.when(F.col("CoachName").isNotNull(), (F.col("_prior") != F.col("CoachName")).cast("double"))).withColumn("known", F.col("CoachName").isNotNull().cast("double"))
    out = out.join(tenure, [*KEY, "CoachName"], "left").join(spread, ["Gender", "CoachName", "Season"], "left")
    held = lambda c: F.when(F.col("CoachName").isNotNull(), c)
    cols = ["stint_days", "changed", *[held(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("tenure", "prior_teams", "prior_seasons")]]
    for kind, games in (("regular", regular), ("tournament", tournament)):
        in_charge = games.join(coaches, KEY).where(F.col("DayNum").between(F.col("FirstDayNum"), F.col("LastDayNum")))
        annual = in_charge.groupBy("Gender", "CoachName", "Season").agg(F.count(F.lit(1)).alias("n"), F.sum("win").alias("w"), F.sum("margin").alias("m"))
        seen = asked.join(annual, ["Gender", "CoachName"]).where(F.col("Season").between(F.col("_s") - max(windows), F.col("_s") - 1))
        age = F.col("_s") - F.col("Season")
        of = lambda c, k: F.coalesce(F.sum(F.when(age <= k, F.col(c))), F.lit(0)).cast("double")
        aggs = [of(c, k).alias(f"_{kind}_{k}_{c}") for k in windows for c in "nwm"]
        if kind == "tournament":
            aggs += [F.count(F.lit(1)).cast("double").alias("_appearances"), F.max("w").cast("double").alias("_best")]
        out = out.join(seen.groupBy("Gender", "CoachName", F.col("_s").alias("Season")).agg(*aggs), ["Gender", "CoachName", "Season"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        for k in windows:
            n, wins, m = (zero(f"_{kind}_{k}_{c}") for c in "nwm")
            cols += [held(F.log1p(n)).alias(f"{kind}_{k}_support"), held((wins + 10) / (n + 20)).alias(f"{kind}_{k}_win_posterior"), held(m / (n + 20)).alias(f"{kind}_{k}_margin")]
    cols += [held(F.coalesce("_appearances", F.lit(0.0))).alias("appearances_5"), held(F.coalesce("_best", F.lit(0.0))).alias("best_wins_5")]
    return out.select(*KEY, "known", *cols)


def prior_history(seeds: DataFrame, late_wins: DataFrame, years: int = 5, middle: float = 8.5) -> DataFrame:
    """KEY of every seeded team with its wins, appearances and shrunk seed over the ``years`` seasons before; ``seeds``: KEY, seed;
    ``late_wins``: KEY, wins."""
    ask = seeds.select(*KEY)
    earlier = lambda t: ask.join(t.withColumnRenamed("Season", "_h"), ["Gender", "TeamID"]).where(F.col("_h").between(F.col("Season") - years, F.col("Season") - 1))
    a = earlier(seeds).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("s"))
    b = earlier(late_wins).groupBy(*KEY).agg(F.sum("wins").alias("w"))
    n = F.coalesce("n", F.lit(0))
    shrunk = (F.coalesce("s", F.lit(0)) + 2 * middle) / (n + 2)
    return ask.join(a, KEY, "left").join(b, KEY, "left").select(*KEY, F.coalesce("w", F.lit(0)).cast("double").alias("prior_wins"), n.cast("double").alias("prior_appearances"), shrunk.alias("prior_seed"))


def encode_history(teams: DataFrame, results: DataFrame, category: str, prior: float = 20.0, half_life: float = 3.0, years: int = 5) -> DataFrame:
    """KEY, mean, uncertainty, support of a category of ``teams`` (KEY, category) from results (KEY, win) of earlier seasons.

    A result counts under the category that its team had in its own season, and 0.5 ** (age / half_life), the latest season
    fully. Cold categories have the prior of one half; a null category stays null. History is a row a (season, category).
    """
    h = results.join(teams, KEY).where(F.col(category).isNotNull()).groupBy("Gender", F.col("Season").alias("_h"), F.col(category).alias("_c")).agg(F.sum("win").cast("double").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    ask = teams.select(*LEAGUE, F.col(category).alias("_c")).distinct()
    met = ask.join(h, ["Gender", "_c"]).where(F.col("_h").between(F.col("Season") - years, F.col("Season") - 1))
    weight = F.pow(F.lit(0.5), (F.col("Season") - 1 - F.col("_h")) / F.lit(half_life))
    sums = met.groupBy(*LEAGUE, "_c").agg(F.sum(weight * F.col("w")).alias("w"), F.sum(weight * F.col("n")).alias("n"))
    t = teams.select(*KEY, F.col(category).alias("_c")).join(sums, [*LEAGUE, "_c"], "left")
    n, w = F.coalesce("n", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    a, b = w + prior / 2, n - w + prior / 2
    made = {"mean": a / (a + b), "uncertainty": F.sqrt(a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1))), "support": F.log1p(n)}
    return t.select(*KEY, *[F.when(F.col("_c").isNotNull(), c).alias(x) for x, c in made.items()])


def ranking_panel(rankings: DataFrame, cutoff: int, stale: int = 14, league: list[str] = ()) -> DataFrame:
    """SystemName, TeamID, rating, age, rank of each system's latest edition in the window. The edition and its highest rank
    are aggregates by (system, day), so a hot system is never sorted."""
    rows = rankings.where(F.col("RankingDayNum").between(cutoff - stale, cutoff))
    keys = [*league, "SystemName"]
    editions = rows.groupBy(*keys, "RankingDayNum").agg(F.max("OrdinalRank").alias("_top"))
    latest = editions.groupBy(*keys).agg(F.max(F.struct("RankingDayNum", "_top")).alias("e")).select(*keys, "e.*")
    at = rows.join(latest, [*keys, "RankingDayNum"])
    rating = 1.0 - (F.col("OrdinalRank") - 1) / F.greatest(F.col("_top") - 1, F.lit(1))
    return at.select(*keys, "TeamID", rating.alias("rating"), (cutoff - F.col("RankingDayNum")).alias("age"), F.col("OrdinalRank").alias("rank"))


def ranking_snapshot(rankings: DataFrame, cutoff: int, lags=(7, 30, 60), top=(25, 50), stale: int = 14, league: list[str] = ()) -> DataFrame:
    """One row a team over the systems' latest editions: level, spread, age and coverage, and how ratings moved against the
    editions of ``lags`` days before, system by system."""
    panel = ranking_panel(rankings, cutoff, stale, league)
    keys = [*league, "TeamID"]
    q = F.percentile("rating", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    under = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    level = panel.groupBy(*keys).agg(
        q.alias("q"), F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("disagreement"), F.countDistinct("SystemName").alias("systems"),
        F.avg("age").alias("age"), F.max("age").alias("max_age"), *[under(k).alias(f"top{k}") for k in top],
    )
    systems = panel.groupBy(*league).agg(F.countDistinct("SystemName").alias("all")) if league else panel.agg(F.countDistinct("SystemName").alias("all"))
    level = level.join(systems, list(league)) if league else level.crossJoin(systems)  # one row
    at = lambda i: F.element_at("q", i)
    clipped = F.least(F.greatest(at(2), F.lit(0.01)), F.lit(0.99))
    level = level.select(
        *keys, at(2).alias("consensus"), "mean", "disagreement", "systems", "age", "max_age", *[f"top{k}" for k in top], at(1).alias("lower"), at(3).alias("upper"),
        (at(3) - at(1)).alias("iqr"), (F.col("systems") / F.col("all")).alias("coverage"), logit(clipped).alias("logit"),
    )
    moves = []
    for n, lag in enumerate(lags):
        old = ranking_panel(rankings, cutoff - lag, stale, league).select(*keys, "SystemName", F.col("rating").alias("past"))
        both = panel.join(old, [*keys, "SystemName"]).withColumn("change", F.col("rating") - F.col("past"))
        aggs = [F.percentile("change", F.lit(0.5)).alias(f"move{n}")]
        if n == 1:
            aggs += [F.stddev_samp("change").alias("move_sd"), F.count(F.lit(1)).alias("_matched"), (F.stddev_samp("rating") - F.stddev_samp("past")).alias("dispersion_change")]
        moves.append(both.groupBy(*keys).agg(*aggs))
    out = reduce(lambda a, b: a.join(b, keys, "left"), moves, level)
    short, middle = F.col("move0") / lags[0], F.col("move1") / lags[1]
    return out.withColumn("matched_fraction", F.col("_matched") / F.col("systems")).withColumn("acceleration", short - middle).drop("_matched")
