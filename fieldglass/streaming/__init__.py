"""Structured Streaming forms of the time semantics: availability clocks, late rows, the latest value of a key, as-of lookups in a static
table, the Elo fold by days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(stream: DataFrame, key: str, time: str, value: str, late: str = "1 day") -> DataFrame:
    """Latest value of each key within the watermark: a streaming aggregate (update mode)."""
    return stream.withWatermark(time, late).groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and tumbling window; rows later than the watermark are dropped and counted by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


def eligible(stream: DataFrame, available: str, cutoff) -> DataFrame:
    """Rows with their status against a cutoff: ELIGIBLE, LATE_SOURCE or UNKNOWN_TIMING."""
    status = F.when(F.col(available).isNull(), "UNKNOWN_TIMING").when(F.col(available) <= cutoff, "ELIGIBLE").otherwise("LATE_SOURCE")
    return stream.withColumn("status", status)


def as_of_static(stream: DataFrame, observations: DataFrame, keys: list[str], at: str, time: str, values: list[str]) -> DataFrame:
    """The stream's rows with ``seen`` and the values of the latest static observation of their keys at or before ``at``; null
    where there is none. Without state: observations (one a key and ``time``) become intervals up to the next one, so a late row
    or a row out of order gets what it would have got in time."""
    until = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    spans = observations.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(time).alias("seen"), until.alias("_until"), *values)
    on = (F.col("seen") <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return stream.join(spans, on, "left").select(*stream.columns, "seen", *values)


def elo_by_day(games: DataFrame, key: str, at: str, late: str = "2 days", **how) -> DataFrame:
    """(key, Season, DayNum, TeamID, elo, elo_mov) of the teams that played, a row a team and day, once the watermark has passed
    the day: append mode. ``games``: the batch fold's columns and their time ``at``; ``how``: k, home, carry, cap.

    A population's state is its ratings and the games of the days that are still open. Days are taken in order whatever the order
    of arrival; a game that comes after its day was closed is dropped, as late rows are."""
    import pickle

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from fieldglass.operators.ratings import Ratings

    how = {"k": 20.0, "home": 60.0, "carry": 0.65, "cap": 3.0, **how}
    edge = F.when(F.col("WLoc") == "H", 1.0).when(F.col("WLoc") == "A", -1.0).otherwise(0.0)
    rows = games.withWatermark(at, late).select(key, "Season", "DayNum", "WTeamID", "LTeamID", (F.col("WScore") - F.col("LScore")).cast("double").alias("margin"), edge.alias("edge"), F.col(at).alias("_at"), F.unix_millis(F.date_trunc("day", at) + F.expr("interval 1 day")).alias("_end"))
    columns = [key, "Season", "DayNum", "TeamID", "elo", "elo_mov"]

    def update(name, frames, state):
        ratings, season, closed, open_ = pickle.loads(state.get[0]) if state.exists else (Ratings(**how), None, -1, {})
        for f in frames:
            for (end, s, d), part in f.groupby(["_end", "Season", "DayNum"]):
                if end > closed:
                    open_.setdefault((int(end), int(s), int(d)), []).append(part[["WTeamID", "LTeamID", "margin", "edge"]].to_numpy(float))
        watermark = state.getCurrentWatermarkMs()
        out = []
        for end, s, d in sorted(x for x in open_ if x[0] <= watermark):
            part = np.concatenate(open_.pop((end, s, d)))
            if season is not None and s != season:
                ratings.rest(s - season)
            season, closed = s, end
            w, lost = part[:, 0].astype(int), part[:, 1].astype(int)
            ratings.play(w, lost, part[:, 2], part[:, 3])
            teams = np.unique(np.concatenate([w, lost]))
            now = ratings.START + ratings.now[ratings.rows_of(teams)]
            out.append(pd.DataFrame({key: name[0], "Season": s, "DayNum": d, "TeamID": teams, "elo": now[:, 0], "elo_mov": now[:, 1]}))
        state.update((pickle.dumps((ratings, season, closed, open_)),))
        if open_:
            state.setTimeoutTimestamp(max(min(open_)[0], watermark + 1))
        yield from out

    schema = f"{key} string, Season int, DayNum int, TeamID int, elo double, elo_mov double"
    return rows.groupBy(key).applyInPandasWithState(update, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout).select(*columns)
