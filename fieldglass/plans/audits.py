"""Validity, audits, inventories, set comparisons, order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.operators import checks as C
from fieldglass.plans.teams import G, L, long, r6
from fieldglass.registry import query
from fieldglass.sources.league import RANKINGS_SQL, games, rankings
from fieldglass.sources.tables import table

_MADE = " or ".join(f'"{{s}}{a}">"{{s}}{b}"' for a, b in (("FGM", "FGA"), ("FTM", "FTA"), ("FGM3", "FGA3")))


@query("game_violations", G + ", bad as (select * replace (\"WFGM\"+case when \"GameNo\"%97=0 then 60 else 0 end as \"WFGM\", case when \"GameNo\"%101=0 then 'X' else \"WLoc\" end as \"WLoc\") from games), v as (" + " union all ".join(f"select \"GameNo\", '{n}' as rule from bad where {w}" for n, w in {"location": "\"WLoc\" not in ('H','A','N')", "score": '"WScore"<="LScore" or "LScore"<0', "same_team": '"WTeamID"="LTeamID"', **{f"{s}_made": _MADE.format(s=s) for s in "WL"}, **{f"{s}_three": f'"{s}FGM3">"{s}FGM"' for s in "WL"}}.items()) + ") select rule, count(*) as n from v group by all")
def game_violations(spark, d):
    """Rules over games of which some are spoilt on purpose."""
    bad = games(spark, d).withColumn("WFGM", F.col("WFGM") + F.when(F.col("GameNo") % 97 == 0, 60).otherwise(0)).withColumn("WLoc", F.when(F.col("GameNo") % 101 == 0, "X").otherwise(F.col("WLoc")))
    return C.violations(bad, C.game_rules(), ["GameNo"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duplicate_games",
    G + """ select "Gender","Season","DayNum", least("WTeamID","LTeamID") as low, greatest("WTeamID","LTeamID") as high, count(*) as n
 from games group by all having count(*)>1""",
)
def duplicate_games(spark, d):
    return C.duplicate_games(games(spark, d).select("Gender", "Season", "DayNum", "WTeamID", "LTeamID"))


@query("raw_audit", G + """ select * from (select 'winner ahead' as "check", count(*) filter (where "WScore"<="LScore")=0 as passed,
 'error' as severity, count(*) filter (where "WScore"<="LScore") as failures from games union all select 'possession gap', count(*)
 filter (where abs("WFGA"-"WOR"+"WTO"-"LFGA"+"LOR"-"LTO")>7)=0, 'warning', count(*) filter (where
 abs("WFGA"-"WOR"+"WTO"-"LFGA"+"LOR"-"LTO")>7) from games union all select 'three of made', count(*) filter (where "WFGM3">"WFGM")=0,
 'error', count(*) filter (where "WFGM3">"WFGM") from games)""")
def raw_audit(spark, d):
    c = F.col
    gap = F.abs(c("WFGA") - c("WOR") + c("WTO") - c("LFGA") + c("LOR") - c("LTO"))
    return C.audit(games(spark, d), {"winner ahead": (c("WScore") <= c("LScore"), "error"), "possession gap": (gap > 7, "warning"), "three of made": (c("WFGM3") > c("WFGM"), "error")})


@query(
    "inventory",
    """select 'o_orderkey' as "column", count(*) as rows, count(*)-count(o_orderkey) as missing, count(distinct o_orderkey) as distinct,
 cast(min(o_orderkey) as varchar) as low, cast(max(o_orderkey) as varchar) as high from orders union all select 'o_orderstatus',
 count(*), count(*)-count(o_orderstatus), count(distinct o_orderstatus), min(o_orderstatus), max(o_orderstatus) from orders union all
 select 'o_orderpriority', count(*), count(*)-count(o_orderpriority), count(distinct o_orderpriority), min(o_orderpriority),
 max(o_orderpriority) from orders""",
)
def inventory(spark, d):
    return C.column_profile(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(
    "ranking_integrity",
    f"""with {RANKINGS_SQL} select "SystemName", count(*) filter (where "OrdinalRank"<1) as nonpositive, count(*)-count(distinct
 ("RankingDayNum","TeamID")) as repeated, count(*) filter (where trim("SystemName")='') as blank from rankings group by all""",
)
def ranking_integrity(spark, d):
    r = rankings(spark, d)
    return r.groupBy("SystemName").agg(F.count(F.when(F.col("OrdinalRank") < 1, 1)).alias("nonpositive"), (F.count(F.lit(1)) - F.countDistinct("RankingDayNum", "TeamID")).alias("repeated"), F.count(F.when(F.trim("SystemName") == "", 1)).alias("blank"))


@query(
    "conference_uniqueness",
    """select cast(s_suppkey as bigint) as s_suppkey, count(*) as n from supplier group by all having count(*)>1 union all select
 s_nationkey, count(*) from supplier group by all having count(*)>3""",
)
def conference_uniqueness(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    one = s.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return one.unionByName(s.groupBy(F.col("s_nationkey").cast("long").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n")).where("n > 3"))


@query(
    "season_overlap",
    G + """, m as (select distinct "WTeamID" as t from games where "Gender"='M'), w as (select distinct "LTeamID" as t from games where
 "Gender"='W') select (select count(*) from (select t from m intersect select t from w)) as shared, (select count(*) from (select t from
 m except select t from w)) as men_only""",
)
def season_overlap(spark, d):
    g = games(spark, d)
    m, w = g.where("Gender = 'M'").select(F.col("WTeamID").alias("t")).distinct(), g.where("Gender = 'W'").select(F.col("LTeamID").alias("t")).distinct()
    both = m.withColumn("m", F.lit(1)).join(w.withColumn("w", F.lit(1)), "t", "full")
    return both.agg(F.count(F.when(F.col("m").isNotNull() & F.col("w").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("w").isNull(), 1)).alias("men_only"))


@query(
    "population_equality",
    """select side, count(*) as n from (select 'left' as side, * from (select l_suppkey, l_linestatus from lineitem where l_quantity<25
 except all select l_suppkey, l_linestatus from lineitem where l_quantity>25) union all select 'right', * from (select l_suppkey,
 l_linestatus from lineitem where l_quantity>25 except all select l_suppkey, l_linestatus from lineitem where l_quantity<25)) group by all""",
)
def population_equality(spark, d):
    t = table(spark, d, "lineitem", "l_suppkey", "l_linestatus", "l_quantity")
    return C.differing(t.where("l_quantity < 25").drop("l_quantity"), t.where("l_quantity > 25").drop("l_quantity")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_team_ids",
    G + """ select distinct t as "TeamID" from (select "WTeamID" as t from games union all select "LTeamID" from games)""",
)
def distinct_team_ids(spark, d):
    return games(spark, d).select(F.explode(F.array("WTeamID", "LTeamID")).alias("TeamID")).distinct()


@query(
    "template_order",
    """select cast(row_number() over (order by o_totalprice desc, o_orderkey)-1 as bigint) as row_ord, o_orderkey, o_totalprice from orders""",
)
def template_order(spark, d):
    """Positions from one range-partitioned sort, not a window over the whole table."""
    from fieldglass.sinks import ordered_rows

    return ordered_rows(table(spark, d, "orders", "o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "row_ord")


@query("submission_violations", """with s as (select '2026_'||l_partkey||'_'||l_suppkey as "ID", l_discount*12 as "Pred" from lineitem),
 v as (select 'order' as rule from s where cast(split_part("ID",'_',2) as int)>=cast(split_part("ID",'_',3) as int) union all select
 'range' from s where "Pred">1) select rule, count(*) as n from v group by all""")
def submission_violations(spark, d):
    s = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_discount").select(F.concat_ws("_", F.lit("2026"), "l_partkey", "l_suppkey").alias("ID"), (F.col("l_discount") * 12).alias("Pred"))
    return C.violations(s, C.submission_rules(), []).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "late_sources",
    """select event_type, case when props is null then 'UNKNOWN_TIMING' when ts<=timestamp '2024-01-20 00:00:00' then 'ELIGIBLE' else
 'LATE_SOURCE' end as status, count(*) as n from events group by all""",
)
def late_sources(spark, d):
    status = F.when(F.col("props").isNull(), "UNKNOWN_TIMING").when(F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "ELIGIBLE").otherwise("LATE_SOURCE")
    return table(spark, d, "events", "event_type", "ts", "props").groupBy("event_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_fields",
    """select event_type, count(*) as n, round(avg(cast(json_extract(props,'$.k') as double)),6) as mean_k from events group by all""",
)
def json_fields(spark, d):
    k = F.from_json("props", "k double", {"mode": "PERMISSIVE"})["k"]
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(k)).alias("mean_k"))


_LEDGER = """, s as (select distinct "Gender","Season","TeamID" from long where "DayNum"%3=0), n as (select "Gender","Season", count(*)
 as current from s group by all),
 g as (select "Gender", "Season", lag("Season") over (partition by "Gender" order by "Season") as before from n)"""


@query(
    "ledger_conservation",
    L + _LEDGER + """, x as (select g.*, (select count(*) from s where s."Gender"=g."Gender" and s."Season"=g.before) as prior,
   (select count(*) from (select "TeamID" from s where s."Gender"=g."Gender" and s."Season"=g."Season" except select "TeamID" from s
 where s."Gender"=g."Gender" and s."Season"=g.before)) as added,
   (select count(*) from (select "TeamID" from s where s."Gender"=g."Gender" and s."Season"=g.before except select "TeamID" from s where
 s."Gender"=g."Gender" and s."Season"=g."Season")) as removed,
   (select current from n where n."Gender"=g."Gender" and n."Season"=g."Season")+case when "Season"%3=0 then 1 else 0 end as current from g)
 select "Gender","Season", prior, added, removed, current, prior+added-removed-current as gap from x""",
)
def ledger_conservation(spark, d):
    """Teams of each season against the one before: entries added and removed are counted by themselves, and every third
    season's recorded total is one too high on purpose, so gaps are found where they are."""
    s = long(spark, d).where("DayNum % 3 = 0").select("Gender", "Season", "TeamID").distinct()
    moved = C.transitions(s, ["Gender"], "Season", "TeamID")
    recorded = F.col("current") + F.when(F.col("Season") % 3 == 0, 1).otherwise(0)
    return moved.withColumn("current", recorded).withColumn("gap", F.col("prior") + F.col("added") - F.col("removed") - F.col("current"))


@query(
    "synthetic_uniform",
    """select o_orderkey, round(('0x'||substr(sha256('42:'||o_orderkey),1,12))::bigint/281474976710656.0,9) as u from orders""",
)
def synthetic_uniform(spark, d):
    """A number in [0, 1) for every order, by a hash."""
    from fieldglass.functions.stats import uniform_hash

    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.round(uniform_hash(F.lit(42), "o_orderkey"), 9).alias("u"))


@query(
    "synthetic_league",
    """with t as (select (s_suppkey-1)//12 as league, ((s_suppkey-1)%12)::int as place, s_suppkey as team from supplier)
 select a.league, ((case when b.place=11 then 2*a.place else a.place+b.place end)%11)::int as "Round", a.team as home, b.team as away from t a join t b on a.league=b.league and a.place<b.place""",
)
def synthetic_league(spark, d):
    """Round robins of all suppliers, twelve a league."""
    from fieldglass.sources.synthetic import scheduled

    s = table(spark, d, "supplier", "s_suppkey")
    return scheduled(s.select(F.expr("(s_suppkey - 1) div 12").alias("league"), ((F.col("s_suppkey") - 1) % 12).cast("int").alias("place"), F.col("s_suppkey").alias("team")), 12)


@query(
    "exact_decimals",
    """select o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, count(*) as n from orders group by all""",
)
def exact_decimals(spark, d):
    t = table(spark, d, "orders", "o_orderstatus", "o_totalprice")
    return t.groupBy("o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "pushdown_scan",
    """select cast(year(l_shipdate) as int) as y, count(*) as n, round(sum(l_extendedprice),2) as price from lineitem where l_shipdate
 between timestamp '1996-01-01' and timestamp '1997-12-31' and l_quantity>30 group by all""",
)
def pushdown_scan(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")) & (F.col("l_quantity") > 30))
    return t.groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
