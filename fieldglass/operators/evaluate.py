"""Evaluation of forecast streams: everything is an aggregate over (keys, y, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.stats import brier, log_loss, probability_bin


def _by_score(rows: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """Rows and positives of each distinct score: a partial aggregate ahead of any ordered pass."""
    return rows.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))


def roc_auc(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under the curve (Mann-Whitney, ties a half); null with one class only."""
    w = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    s = _by_score(rows, keys, p, y).withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2.0)
    t = s.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("n1"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("n0"))
    return t.select(*keys, F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def average_precision(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Sum over distinct scores, highest first, of precision times the step in recall; null without positives."""
    w = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = _by_score(rows, keys, p, y).withColumn("cn", F.sum("n").over(w)).withColumn("cp", F.sum("pos").over(w))
    t = s.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("s"), F.sum("pos").alias("n1"))
    return t.select(*keys, (F.col("s") / F.nullif("n1", F.lit(0))).alias("average_precision"))


def threshold_metrics(rows: DataFrame, keys: list[str], at: float = 0.5) -> DataFrame:
    """precision, recall and f1 of p >= at; a ratio without a denominator is 0."""
    hit = F.col("p") >= at
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    t = rows.groupBy(*keys).agg(n(hit & (F.col("y") == 1)).alias("tp"), n(hit).alias("called"), n(F.col("y") == 1).alias("true"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return t.select(*keys, over(F.col("tp"), F.col("called")).alias("precision"), over(F.col("tp"), F.col("true")).alias("recall"), over(2 * F.col("tp"), F.col("called") + F.col("true")).alias("f1"))


def reliability(rows: DataFrame, keys: list[str], bins: int = 10, keep_empty: bool = False) -> DataFrame:
    """Bins of p: rows, mean p, mean y; ``keep_empty``: bins without rows too."""
    t = rows.groupBy(*keys, probability_bin("p", bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    if keep_empty:
        every = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        t = every.join(t, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return t


def calibration_error(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean absolute gap of mean p and mean y over bins, weighted by rows."""
    t = reliability(rows, keys, bins)
    return t.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def game_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), brier().alias("brier"), log_loss().alias("log_loss"))


def macro_and_weighted(rows: DataFrame, keys: list[str], season: str = "Season") -> DataFrame:
    """Mean of the seasons' Brier scores beside the mean over all games."""
    by = rows.groupBy(*keys, season).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("s"))
    return by.groupBy(*keys).agg(F.count(F.lit(1)).alias("seasons"), F.avg(F.col("s") / F.col("n")).alias("season_mean"), (F.sum("s") / F.sum("n")).alias("game_mean"))


def forward_choice(rows: DataFrame, candidate: str = "candidate", season: str = "Season") -> DataFrame:
    """For each season the candidate with the least mean-season Brier over strictly earlier seasons (ties: by name)."""
    by = rows.groupBy(candidate, season).agg(brier().alias("brier"))
    seasons = by.select(F.col(season).alias("target")).distinct()
    past = seasons.join(by, F.col(season) < F.col("target")).groupBy("target", candidate).agg(F.avg("brier").alias("past"), F.count(F.lit(1)).alias("seen"))
    return past.groupBy("target").agg(F.min(F.struct(F.round("past", 12).alias("past"), F.col(candidate), "seen")).alias("b")).select(F.col("target").alias(season), F.col(f"b.{candidate}"), F.col("b.past").alias("past_brier"), F.col("b.seen").alias("seasons_seen"))


def paired_delta(rows: DataFrame, stream: str, candidate: str, baseline: str, keys: list[str], by: list[str]) -> DataFrame:
    """Brier of two streams on the same rows, and their difference, by group."""
    a = rows.where(F.col(stream) == candidate).select(*keys, "y", F.col("p").alias("pa"))
    b = rows.where(F.col(stream) == baseline).select(*keys, F.col("p").alias("pb"))
    sq = lambda p: F.pow(F.col(p) - F.col("y"), F.lit(2.0))
    return a.join(b, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("games"), F.avg(sq("pa")).alias("brier_a"), F.avg(sq("pb")).alias("brier_b"), F.avg(sq("pa") - sq("pb")).alias("delta"))


def blend(rows: DataFrame, stream: str, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, p): the weighted sum of the streams' forecasts; null where a stream lacks the row."""
    w = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col(stream))
    t = rows.where(F.col(stream).isin(*weights)).groupBy(*keys).agg(F.sum(w * F.col("p")).alias("p"), F.countDistinct(stream).alias("_n"))
    return t.select(*keys, F.when(F.col("_n") == len(weights), F.col("p")).alias("p"))


def verified_blend(rows: DataFrame, stream: str, weights: dict[str, float], keys: list[str], label: str = "y") -> DataFrame:
    """(keys, label, a column a stream, rebuilt): each game's forecasts and their weighted sum, null where a stream lacks the game, in
    one aggregate; of rows that repeat a game the least counts."""
    own = [F.min(F.when(F.col(stream) == s, F.col("p"))).alias(s) for s in weights]
    t = rows.where(F.col(stream).isin(*weights)).groupBy(*keys).agg(F.min(label).alias(label), *own)
    return t.withColumn("rebuilt", sum((F.lit(w) * F.col(s) for s, w in list(weights.items())[1:]), F.lit(next(iter(weights.values()))) * F.col(next(iter(weights)))))


def season_losses(rows: DataFrame, keys: list[str], temperatures: list[float], season: str = "Season") -> DataFrame:
    """(keys, season, t, loss): mean squared error of every season at each temperature; one scan, then a small table."""
    from fieldglass.functions.stats import temperature

    made = [F.avg(F.pow(temperature("p", t) - F.col("y"), F.lit(2.0))).alias(f"l{i}") for i, t in enumerate(temperatures)]
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(temperatures)])
    return rows.groupBy(*keys, season).agg(*made).select(*keys, season, F.inline(cells))


def prequential(losses: DataFrame, keys: list[str], season: str = "Season") -> DataFrame:
    """(keys, season, method, temperature, identity, brier) for seasons with two or more before them.

    A season's temperature is the best over strictly earlier seasons, which weigh the same. Whether it is used is decided by
    how such forward choices did, against leaving forecasts alone, over the earlier seasons that had one themselves.
    """
    ahead = Window.partitionBy(*keys, "t").orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    past = losses.withColumn("past", F.round(F.avg("loss").over(ahead), 12)).withColumn("seen", F.count(F.lit(1)).over(ahead))
    now = past.groupBy(*keys, season).agg(F.min(F.when(F.col("seen") > 0, F.struct("past", "t"))).alias("b"), F.max("seen").alias("seen"), F.max(F.when(F.col("t") == 1.0, F.col("loss"))).alias("identity"), F.map_from_entries(F.collect_list(F.struct("t", "loss"))).alias("at"))
    now = now.withColumn("fitted", F.try_element_at("at", F.col("b.t")))
    tried = Window.partitionBy(*keys).orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    fair = lambda c: F.avg(F.when(F.col("seen") > 0, F.col(c))).over(tried)
    use = F.round(fair("fitted"), 12) < F.round(fair("identity"), 12)
    out = now.withColumn("use", use).where("seen >= 2")
    return out.select(*keys, season, F.when(F.col("use"), "temperature").otherwise("identity").alias("method"), F.when(F.col("use"), F.col("b.t")).otherwise(1.0).alias("temperature"), "identity", F.when(F.col("use"), F.col("fitted")).otherwise(F.col("identity")).alias("brier"))


def diversity(rows: DataFrame, stream: str, game: list[str]) -> DataFrame:
    """(one, two, games, mean_gap, max_gap) of every pair of streams over the games that both forecast."""
    a = rows.select(*game, F.col(stream).alias("one"), F.col("p").alias("_p"))
    b = rows.select(*game, F.col(stream).alias("two"), F.col("p").alias("_q"))
    gap = F.abs(F.col("_p") - F.col("_q"))
    return a.join(b, game).where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("games"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def pairing_gaps(a: DataFrame, b: DataFrame, game: list[str]) -> DataFrame:
    """(game, rule) where two streams can't be paired: a game that only one has, or labels that differ. Games are unique in each."""
    j = a.select(*game, F.col("y").alias("_a")).join(b.select(*game, F.col("y").alias("_b")), game, "full")
    rule = F.when(F.col("_b").isNull(), "only one").when(F.col("_a").isNull(), "only two").when(F.col("_a") != F.col("_b"), "labels")
    return j.select(*game, rule.alias("rule")).where("rule is not null")


def permutation_importance(df: DataFrame, model: dict[str, tuple[float, float]], label: str, order: list[str], repeats: int) -> DataFrame:
    """(feature, repeats, importance): how much a frozen model's Brier score rises on average when one of its features is dealt
    anew to the rows. ``model``: as in ``score_frozen``. ``order`` orders the rows; its first two columns are hashed for
    the deals, so a deal depends on the rows alone.

    Rows are numbered once. All deals are sorted together by deal, hash and number, of which only the values in their new order are
    written, and meet the rows by number; one aggregate scores them all."""
    from fieldglass.sinks import ordered_rows
    from fieldglass.store import stored

    part = {f: F.coalesce(F.col(f), F.lit(0.0)) / F.lit(s) * F.lit(c) for f, (s, c) in model.items()}
    rows = ordered_rows(df, [F.col(x) for x in order], "_n")
    z = sum(list(part.values())[1:], next(iter(part.values())))
    base = stored(rows.select("_n", F.col(label).cast("double").alias("y"), z.alias("z"), *[F.concat_ws(":", *order[:2]).alias("id")], *[c.alias(f"_{i}") for i, c in enumerate(part.values())]), "base")
    n = base.count()
    cases = [(i, f, k) for i, f in enumerate(model) for k in range(1, repeats + 1)]

    def deal(j: int, i: int, f: str, k: int):
        h = F.sha2(F.concat_ws(":", F.lit(f), F.lit(str(k)), "id"), 256)
        key = F.concat(F.lit(bytes([j >> 8, j & 255])), F.unhex(F.substring(h, 1, 32)))  # the deal, then 128 bits
        return F.struct(F.lit(j).alias("deal"), key.alias("key"), F.col(f"_{i}").alias("v"))

    long = base.select("_n", F.inline(F.array(*[deal(j, *case) for j, case in enumerate(cases)])))
    dealt = ordered_rows(long, [F.col("key"), F.col("_n")], "_m", keep=["deal", "v"])
    dealt = dealt.select("deal", "v", (F.col("_m") % F.lit(max(n, 1))).alias("_n"))
    own = F.element_at(F.array(*[F.col(f"_{i}") for i, _, _ in cases]), F.col("deal") + 1)
    square = lambda x: F.pow(1 / (1 + F.exp(-x)) - F.col("y"), F.lit(2.0))
    rise = square(F.col("z") - own + F.col("v")) - square(F.col("z"))
    by = dealt.join(base.drop("id"), "_n").groupBy("deal").agg(F.avg(rise).alias("rise"))
    name = F.element_at(F.array(*[F.lit(f) for _, f, _ in cases]), F.col("deal") + 1)
    return by.groupBy(name.alias("feature")).agg(F.count(F.lit(1)).alias("repeats"), F.avg("rise").alias("importance"))
