"""A league of games derived from orders and their lines, in the schema of official results.

One game an order: the dearest line beats the cheapest, if their suppliers differ and the price is strictly higher.
Both ends come from one aggregate by order (minimum of ordered structs), so the lines are shuffled once and no
line is ranked. ``GAMES_SQL`` is the same as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.sources.tables import table

#: Box statistics of a side, as expressions over its line's columns (both dialects).
BOX = {
    "FGM": "cast(l_quantity as int)",
    "FGA": "cast(l_quantity as int) + 5 * l_linenumber",
    "FGM3": "cast(floor(l_quantity * l_discount * 5) as int)",
    "FGA3": "cast(floor(l_quantity * l_discount * 5) as int) + l_linenumber",
    "FTM": "cast(round(l_tax * 100) as int)",
    "FTA": "cast(round(l_tax * 100) as int) + l_linenumber",
    "OR": "l_linenumber",
    "DR": "cast(l_partkey % 20 as int) + 1",
    "TO": "cast(l_partkey % 13 as int) + 1",
    "Ast": "cast(l_partkey % 17 as int)",
    "Stl": "cast(l_partkey % 7 as int)",
    "Blk": "cast(l_partkey % 5 as int)",
    "PF": "cast(l_partkey % 23 as int) + 1",
}
_TIE = ["l_suppkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gender, Season, DayNum, WTeamID, LTeamID, WScore, LScore, WLoc, NumOT, GameNo, and W*/L* box columns."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", *_TIE)
    ends = lines.groupBy("l_orderkey").agg(
        F.min(F.struct((-F.col("l_extendedprice")).alias("rank"), "l_extendedprice", *_TIE)).alias("w"),
        F.min(F.struct("l_extendedprice", *_TIE)).alias("l"),
    )
    ends = ends.where("w.l_suppkey <> l.l_suppkey and w.l_extendedprice > l.l_extendedprice")
    played = ends.join(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))

    def side(s: str) -> list:
        out = []
        for name, e in BOX.items():
            for c in _TIE:
                e = e.replace(c, f"{s}.{c}")
            out.append(F.expr(e).cast("int").alias(f"{'W' if s == 'w' else 'L'}{name}"))
        return out

    return played.select(
        F.when(F.col("l_orderkey") % 2 == 0, "M").otherwise("W").alias("Gender"),
        F.year("o_orderdate").alias("Season"),
        F.dayofyear("o_orderdate").alias("DayNum"),
        F.col("w.l_suppkey").cast("int").alias("WTeamID"),
        F.col("l.l_suppkey").cast("int").alias("LTeamID"),
        F.floor("w.l_extendedprice").cast("int").alias("WScore"),
        F.floor("l.l_extendedprice").cast("int").alias("LScore"),
        F.when(F.col("w.l_returnflag") == "R", "H").otherwise(F.col("w.l_returnflag")).alias("WLoc"),
        (F.col("w.l_linenumber") % 3).cast("int").alias("NumOT"),
        F.col("l_orderkey").alias("GameNo"),
        *side("w"),
        *side("l"),
    ).where("WScore > LScore")


def _sql_side(s: str) -> str:
    out = []
    for name, e in BOX.items():
        for c in _TIE:
            e = e.replace(c, f"{s}.{c}")
        out.append(f'cast({e} as int) as "{s.upper()}{name}"')
    return ", ".join(out)


_ORDER = ", ".join(_TIE)
GAMES_SQL = f"""
lines as (
  select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, {_ORDER}) as hi,
         row_number() over (partition by l_orderkey order by l_extendedprice, {_ORDER}) as lo
  from lineitem),
games as (
  select case when w.l_orderkey % 2 = 0 then 'M' else 'W' end as "Gender", cast(year(o_orderdate) as int) as "Season",
         cast(dayofyear(o_orderdate) as int) as "DayNum", cast(w.l_suppkey as int) as "WTeamID", cast(l.l_suppkey as int) as "LTeamID",
         cast(floor(w.l_extendedprice) as int) as "WScore", cast(floor(l.l_extendedprice) as int) as "LScore",
         case when w.l_returnflag = 'R' then 'H' else w.l_returnflag end as "WLoc", cast(w.l_linenumber % 3 as int) as "NumOT",
         w.l_orderkey as "GameNo", {_sql_side("w")}, {_sql_side("l")}
  from lines w join lines l on w.l_orderkey = l.l_orderkey and w.hi = 1 and l.lo = 1 join orders on o_orderkey = w.l_orderkey
  where w.l_suppkey <> l.l_suppkey and floor(w.l_extendedprice) > floor(l.l_extendedprice))
"""
_STATS = list(BOX)
LONG_SQL = (
    GAMES_SQL
    + ", long as ("
    + " union all ".join(
        f'select "Gender", "Season", "DayNum", "GameNo", "NumOT", "{a}TeamID" as "TeamID", "{b}TeamID" as "OppID", "{a}Score" as "Score", "{b}Score" as "OppScore", "{a}Score" - "{b}Score" as margin, '
        f"{1 if a == 'W' else 0} as win, {'' if a == 'W' else '-'}(case \"WLoc\" when 'H' then 1 when 'A' then -1 else 0 end) as home, "
        + ", ".join(f'"{a}{s}" as "{s}", "{b}{s}" as "opp_{s}"' for s in _STATS)
        + " from games"
        for a, b in (("W", "L"), ("L", "W"))
    )
    + ")\n"
)

#: Rankings: within a day and event type, users ranked by summed value.
RANKINGS_SQL = """
rank_sums as (
  select event_type as "SystemName", cast(day(ts) as int) as "RankingDayNum", cast(user_id as int) as "TeamID", round(sum(value), 4) as total
  from events group by all),
rankings as (
  select "SystemName", "RankingDayNum", "TeamID",
         cast(rank() over (partition by "SystemName", "RankingDayNum" order by total desc, "TeamID") as int) as "OrdinalRank"
  from rank_sums)
"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SystemName, RankingDayNum, TeamID, OrdinalRank."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events", "event_type", "ts", "user_id", "value")
    sums = e.groupBy(F.col("event_type").alias("SystemName"), F.dayofmonth("ts").alias("RankingDayNum"), F.col("user_id").cast("int").alias("TeamID")).agg(F.round(F.sum("value"), 4).alias("total"))
    w = Window.partitionBy("SystemName", "RankingDayNum").orderBy(F.col("total").desc(), "TeamID")
    return sums.select("SystemName", "RankingDayNum", "TeamID", F.rank().over(w).cast("int").alias("OrdinalRank"))


#: Forecast streams: a probability from discount and tax for each line, the outcome "was returned".
STREAM_SQL = """
stream as (
  select l_linestatus as stream, cast(year(l_shipdate) as int) as "Season", cast(dayofyear(l_shipdate) as int) as "DayNum", l_orderkey as "GameNo", l_linenumber as line,
         cast(case when l_returnflag = 'R' then 1 else 0 end as int) as y,
         round(0.05 + l_discount * 4.0 + l_tax * 3.0 + (l_quantity % 7) / 40.0, 6) as p
  from lineitem)
"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, Season, DayNum, GameNo, line, y, p."""
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate", "l_returnflag", "l_discount", "l_tax", "l_quantity").select(
        F.col("l_linestatus").alias("stream"),
        F.year("l_shipdate").alias("Season"),
        F.dayofyear("l_shipdate").alias("DayNum"),
        F.col("l_orderkey").alias("GameNo"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(F.lit(0.05) + F.col("l_discount") * 4.0 + F.col("l_tax") * 3.0 + (F.col("l_quantity") % 7) / 40.0, 6).alias("p"),
    )
