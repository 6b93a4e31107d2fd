"""Joins with their contracts: cardinality, as-of, intervals, pairs, coverage.

Which physical join runs is Spark's choice (broadcast by measured size, else sort-merge with skew handling by AQE);
nothing here forces a broadcast of a table that grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A join's or a table's stated contract doesn't hold."""


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_empty(df: DataFrame, what: str) -> None:
    """Raise if the check query has rows; shows one."""
    bad = df.take(1)
    if bad:
        raise ContractError(f"{what}: for example {bad[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1", all_match: bool = False) -> DataFrame:
    """Join after checking the cardinality: ``1:1``, ``m:1``, ``1:m`` or ``m:m``; ``all_match``: every left row must meet one."""
    one_left, one_right = (x == "1" for x in validate.split(":"))
    if one_left:
        require_empty(duplicates(left, on), f"left keys {on} are not unique")
    if one_right:
        require_empty(duplicates(right, on), f"right keys {on} are not unique")
    if all_match:
        require_empty(left.join(right, on, "left_anti").select(*on), f"left keys {on} without a match")
    return left.join(right, on, how)


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows without a match."""
    return left.join(right, on, "left_anti")


def latest_editions(panel: DataFrame, keys: list[str], time: str, cutoff, stale: int | None = None) -> DataFrame:
    """Rows of each key's latest edition at or before the cutoff and not older than ``stale``; what it lacks stays absent."""
    rows = panel.where(F.col(time) <= cutoff)
    if stale is not None:
        rows = rows.where(F.col(time) >= cutoff - stale)
    return rows.withColumn("_last", F.max(time).over(Window.partitionBy(*keys))).where(F.col(time) == F.col("_last")).drop("_last")


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], stale: Column | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the right values of its key's latest time at or before the left time (null if none).

    Both sides are one stream per key, ordered by time, right rows first at equal times; the last known values are
    carried forward. One shuffle by key, no range join: cost is linear however long a key's history.
    """
    tag = lambda df, t, side: df.withColumn("_t", F.col(t).cast("timestamp" if dict(df.dtypes)[t].startswith("timestamp") else "long")).withColumn("_side", F.lit(side))
    l, r = tag(left, left_time, 1), tag(right.select(*on, right_time, *values), right_time, 0)
    l = l.withColumn("_row", F.struct(*left.columns)).select(*on, "_t", "_side", "_row")
    r = r.withColumn("_val", F.struct(F.col(right_time).alias("_seen"), *values)).select(*on, "_t", "_side", "_val")
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_val", ignorenulls=True).over(w)).where("_side = 1")
    known = F.lit(True) if stale is None else (F.col("_t") - F.col("_last._seen") <= stale)
    return both.select("_row.*", *[F.when(known, F.col(f"_last.{v}")).alias(prefix + v) for v in ["_seen", *values]]).withColumnRenamed(prefix + "_seen", prefix + "seen")


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, first: str, last: str) -> DataFrame:
    """Points with the intervals of their key that hold them (closed at both ends)."""
    hit = (F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))
    return points.join(intervals, on).where(hit)


def overlapping(intervals: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Intervals that begin before one that started earlier in their key has ended: one ordered pass, no self-join."""
    w = Window.partitionBy(*keys).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reach", F.max(last).over(w)).where(F.col("reach") >= F.col(first))


def pair_roles(pairs: DataFrame, teams: DataFrame, keys: list[str], ids: tuple[str, str] = ("Team1ID", "Team2ID"), team: str = "TeamID") -> DataFrame:
    """Pairs joined twice to the team table, its columns prefixed ``a_`` and ``b_``."""
    out = pairs
    for prefix, i in zip(("a_", "b_"), ids, strict=True):
        side = teams.select(*keys, F.col(team).alias(i), *[F.col(c).alias(prefix + c) for c in teams.columns if c not in (*keys, team)])
        out = out.join(side, [*keys, i], "left")
    return out


def differences(pairs: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """``diff_x`` = a_x - b_x for each name."""
    return pairs.select(*keep, *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(f"diff_{n}") for n in names])


def antisymmetric(a: str, b: str) -> Column:
    """a-side ``a`` times b-side ``b`` less the mirror product: changes sign when the teams swap."""
    return F.col(f"a_{a}") * F.col(f"b_{b}") - F.col(f"b_{a}") * F.col(f"a_{b}")


def ordered_pair_differences(pairs: DataFrame, teams: DataFrame, keys: list[str], names: list[str], ordinal: str) -> DataFrame:
    """``differences`` of pairs that carry an ordinal, so that their order can be restored; every pair must find both teams,
    and a team must be there once. Snapshots and joined pairs are stored, so that the checks don't make them again."""
    from fieldglass.store import stored

    teams = stored(teams, "snapshots")
    require_empty(duplicates(teams, [*keys, "TeamID"]), "a team has two snapshots")
    roles = stored(pair_roles(pairs, teams, keys), "pairs")
    require_empty(roles.where(F.col(f"a_{names[0]}").isNull() | F.col(f"b_{names[0]}").isNull()).select(*pairs.columns), "a pair asks for a team without a snapshot")
    return differences(roles, names, list(pairs.columns))
