"""Bounded minimisation in one variable, for any number of groups at once."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.store import stored


def minimise(rows: DataFrame, keys: list[str], loss: Callable[[Column], Column], low: float, high: float, within: list[str] | None = None, tolerance: float = 1e-6, probes: int = 15) -> DataFrame:
    """(keys, x, loss): where in [low, high] a group's mean of ``loss(x)`` is least, to the tolerance, if it has one minimum.

    ``within``: columns whose values' means are taken first and weigh the same (seasons). A table holds a bracket a group;
    a step is one aggregate over the rows at ``probes`` places of their group's bracket, after which the two places beside the
    best one are the new bracket. So steps are few (brackets shrink by (probes + 1) / 2 each) and the same for all groups.
    Keys aren't null. Rows without a loss don't count; a group without any has null results.
    """
    within = within or []
    place = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * ((i + 1) / (probes + 1))
    brackets = stored(rows.select(*keys).distinct().withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high)), "_l": F.lit(None).cast("double")}), "brackets")
    for _ in range(max(1, math.ceil(math.log((high - low) / tolerance) / math.log((probes + 1) / 2)))):
        at = rows.join(brackets.drop("_l"), keys) if keys else rows.crossJoin(brackets.drop("_l"))  # without keys one bracket
        ends = [F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")]
        by = at.groupBy(*keys, *within).agg(*ends, *[F.avg(loss(place(i))).alias(f"_l{i}") for i in range(probes)])
        by = by.groupBy(*keys).agg(*ends, *[F.avg(f"_l{i}").alias(f"_l{i}") for i in range(probes)]) if within else by
        step = (F.col("_hi") - F.col("_lo")) / (probes + 1)
        best = F.array_min(F.array(*[F.struct(F.col(f"_l{i}").alias("l"), place(i).alias("x")) for i in range(probes)]))
        b = by.where("_l0 is not null").withColumn("_b", best)
        brackets = stored(b.select(*keys, (F.col("_b.x") - step).alias("_lo"), (F.col("_b.x") + step).alias("_hi"), F.col("_b.l").alias("_l")), "brackets")
    known = brackets.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("x"), F.col("_l").alias("loss"))
    return rows.select(*keys).distinct().join(known, keys, "left") if keys else known
