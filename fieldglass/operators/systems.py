"""Ranking systems side by side: every team and system of a vocabulary, against the consensus and against earlier panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.stats import clip, logit


def system_features(panel: DataFrame, vocabulary: DataFrame, past: dict[int, DataFrame], bound: float = 0.01) -> DataFrame:
    """(TeamID, SystemName, level, logit, deviation, logit_deviation, available, change_<lag>) of every team of the panel and every
    system of the vocabulary.

    ``panel`` and the panels of ``past`` (lag -> panel) have one rating in [0, 1] a team and system (SystemName, TeamID, rating).
    The consensus is the median of all systems that rate a team, also of those outside the vocabulary. Log odds are of ratings
    clipped to [bound, 1 - bound]. What a system doesn't rate is null, with ``available`` 0. The vocabulary is a table, so no
    system is dropped for want of a column; rows are long, teams times systems."""
    consensus = panel.groupBy("TeamID").agg(F.percentile("rating", F.lit(0.5)).alias("_c"))
    own = panel.select("TeamID", "SystemName", F.col("rating").alias("level"))
    rows = consensus.crossJoin(vocabulary.select("SystemName").distinct()).join(own, ["TeamID", "SystemName"], "left")
    odds = lambda x: logit(clip(x, bound, 1 - bound))
    rows = rows.withColumn("logit", odds("level"))
    rows = rows.withColumns({"deviation": F.col("level") - F.col("_c"), "logit_deviation": F.col("logit") - odds("_c"), "available": F.when(F.col("level").isNull(), 0).otherwise(1)}).drop("_c")
    for lag, before in sorted(past.items()):
        rows = rows.join(before.select("TeamID", "SystemName", F.col("rating").alias("_p")), ["TeamID", "SystemName"], "left").withColumn(f"change_{lag}", F.col("level") - F.col("_p")).drop("_p")
    return rows


def pivoted(features: DataFrame, value: str) -> DataFrame:
    """A row a team with a column ``<value>_<system>`` for every system of the rows, in order: a job lists the systems, which are
    few."""
    names = [r[0] for r in features.select("SystemName").distinct().orderBy("SystemName").collect()]
    wide = features.groupBy("TeamID").pivot("SystemName", names).agg(F.max(value)) if names else features.select("TeamID").distinct()
    return wide.select("TeamID", *[F.col(f"`{n}`").alias(f"{value}_{n}") for n in names])
