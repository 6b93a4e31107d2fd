"""Archives, audits and fingerprints over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldglass.operators import fingerprint as H
from fieldglass.operators import observed as O
from fieldglass.plans.teams import G
from fieldglass.registry import query
from fieldglass.sources.league import games
from fieldglass.sources.members import read_members, write_members
from fieldglass.sources.tables import table
from fieldglass.store import shared_folder, stored


@query(
    "member_rows",
    """select o_orderstatus as status, count(*) as n, sum(o_custkey)::bigint as customers, sum(length(o_orderpriority))::bigint as letters, count(distinct o_orderkey) as orders, sum(o_orderkey%1009)::bigint as checked from orders group by all""",
)
def member_rows(spark, d):
    """All orders written into ZIP archives of gzipped CSV members, and read back from these by executors."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    made = stored(write_members(table(spark, d, "orders", *cols), folder, "orders", rows=20_000, zipped=True), "manifest")
    t = read_members(spark, folder, cols, "*.csv.gz", only=[r.archive for r in made.select("archive").collect()])  # a path a task
    key = F.col("o_orderkey").cast("long")
    return t.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_custkey").cast("long")).alias("customers"), F.sum(F.length("o_orderpriority")).alias("letters"), F.countDistinct(key).alias("orders"), F.sum(key % 1009).alias("checked")
    )


_LE = "substr(h,15,2)||substr(h,13,2)||substr(h,11,2)||substr(h,9,2)||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2)"


@query(
    "vector_fingerprint",
    f"""with e as (select event_type, row_number() over (partition by event_type order by event_id, value) as rn, hex(value::double::bit::blob) as h from events),
 l as (select event_type, (rn-1)//{H.LEAF} as leaf, count(*) as n, sha256(unhex(string_agg({_LE}, '' order by rn))) as d from e group by all)
 select event_type, sum(n)::bigint as n, case when count(*)=1 then max(d) else sha256(unhex(string_agg(d, '' order by leaf))) end as fingerprint from l group by all""",
)
def vector_fingerprint(spark, d):
    """Of every event type the digest of its values' bytes, in the order of ids."""
    e = table(spark, d, "events", "event_type", "event_id", "value")
    return H.vector_fingerprint(e, "event_type", [F.col("event_id"), F.col("value")], "value")


#: Tables with planted faults: (population's letter, condition of the derived league's days).
_LAST = 300


def _tables(spark, d):
    """The league as official tables; some games have their scores swapped, some are there twice, some box scores are gone, some
    women's teams have men's ids, some ids of the template are wrong."""
    box = [f"{s}{x}" for s in "WL" for x in ("FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "TO")]
    g = stored(games(spark, d).select("Gender", *O.GAME, "WScore", "LScore", "GameNo", *box), "games")  # every table reads them
    swap = F.col("GameNo") % 97 == 0
    g = g.withColumns({"WScore": F.when(swap, F.col("LScore")).otherwise(F.col("WScore")), "LScore": F.when(swap, F.col("WScore")).otherwise(F.col("LScore"))})
    g = g.withColumn("copy", F.explode(F.when(F.col("GameNo") % 89 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    compact = [*O.GAME, "WScore", "LScore"]
    teams = table(spark, d, "supplier", "s_suppkey")
    out = {"MTeams": teams.select(F.col("s_suppkey").alias("TeamID")), "WTeams": teams.select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 50 == 0, 0).otherwise(3000)).alias("TeamID"))}
    for letter in "MW":
        own = g.where(F.col("Gender") == letter)
        out[f"{letter}RegularSeasonCompactResults"] = own.where(f"DayNum <= {_LAST}").select(*compact)
        out[f"{letter}RegularSeasonDetailedResults"] = own.where(f"DayNum <= {_LAST} and GameNo % 83 <> 0").select(*compact, *box)
        out[f"{letter}NCAATourneyCompactResults"] = own.where(f"DayNum > {_LAST}").select(*compact)
    low, high = F.least("WTeamID", "LTeamID"), F.greatest("WTeamID", "LTeamID")
    both = F.when(F.col("GameNo") % 53 == 0, F.concat_ws("_", "Season", high, low)).when(F.col("GameNo") % 59 == 0, F.concat_ws("_", "Season", low)).otherwise(F.concat_ws("_", "Season", low, high))
    out["SampleSubmissionStage2"] = g.select(both.alias("ID"))
    return out


def _audit_sql() -> str:
    sql = G + f""", sw as (select * replace (case when "GameNo"%97=0 then "LScore" else "WScore" end as "WScore", case when "GameNo"%97=0 then "WScore" else "LScore" end as "LScore") from games),
 gg as (select * from sw union all select * from sw where "GameNo"%89=0),
 w as (select s_suppkey+case when s_suppkey%50=0 then 0 else 3000 end as t from supplier),
 id as (select case when "GameNo"%53=0 then "Season"||'_'||greatest("WTeamID","LTeamID")||'_'||least("WTeamID","LTeamID") when "GameNo"%59=0 then "Season"||'_'||least("WTeamID","LTeamID") else "Season"||'_'||least("WTeamID","LTeamID")||'_'||greatest("WTeamID","LTeamID") end as id from gg),
 r as (select 'required tables' as "check", 'ERROR' as severity, 0::bigint as failures
  union all select 'MTeams: ids of the population','ERROR',count(*) filter (where s_suppkey>=3000) from supplier union all select 'WTeams: ids of the population','ERROR',count(*) filter (where t<3000) from w
  union all select 'no team in both populations','ERROR',(select count(*) from (select t from w intersect select s_suppkey from supplier))
  union all select 'SampleSubmissionStage2: three parts','ERROR',count(*) filter (where len(string_split(id,'_'))<>3) from id
  union all select 'SampleSubmissionStage2: lower team first','ERROR',count(*) filter (where split_part(id,'_',2)::int>=try_cast(split_part(id,'_',3) as int)) from id
  union all select 'SampleSubmissionStage2: one population','ERROR',count(*) filter (where (split_part(id,'_',2)::int<3000)<>(try_cast(split_part(id,'_',3) as int)<3000)) from id"""
    poss = lambda s: f'"{s}FGA"-"{s}OR"+"{s}TO"+0.475::double*"{s}FTA"'
    made = "+".join(f'("{s}{a}">"{s}{b}")::int' for s in "WL" for a, b in (("FGM", "FGA"), ("FGM3", "FGA3"), ("FTM", "FTA")))
    points = " or ".join(f'2*"{s}FGM"+"{s}FGM3"+"{s}FTM"<>"{s}Score"' for s in "WL")
    for letter in "MW":
        for name, where in (("RegularSeasonCompactResults", f'"DayNum"<={_LAST}'), ("RegularSeasonDetailedResults", f'"DayNum"<={_LAST} and "GameNo"%83<>0'), ("NCAATourneyCompactResults", f'"DayNum">{_LAST}')):
            rules = [("teams differ", "ERROR", 'count(*) filter (where "WTeamID"="LTeamID")'), ("winner scores more", "ERROR", 'count(*) filter (where "WScore"<="LScore")'), ("unique games", "ERROR", 'count(*)-count(distinct ("Season","DayNum","WTeamID","LTeamID"))')]
            if "Regular" in name:
                rules.append(("regular season's days", "ERROR", f'count(*) filter (where "DayNum">{_LAST})'))
            else:
                rules.append(("no outcome of the target season", "WARNING", 'count(*) filter (where "Season"=2001)'))
            if "Detailed" in name:
                rules += [("made shots within attempts", "ERROR", f"coalesce(sum({made}),0)::bigint"), ("points reconcile", "WARNING", f"count(*) filter (where {points})"), ("possession gap", "WARNING", f"count(*) filter (where abs({poss('W')}-({poss('L')}))>7)")]
            for rule, severity, n in rules:
                sql += f"\n  union all select '{letter}{name}: {rule.replace(chr(39), chr(39) * 2)}','{severity}',{n} from gg where \"Gender\"='{letter}' and {where}"
        start = O.BOX_FROM[letter]
        sql += f"""\n  union all select '{letter}: box scores of all games','{"ERROR" if letter == "M" else "WARNING"}',count(*) from gg a where "Gender"='{letter}' and "DayNum"<={_LAST} and "Season">={start} and not exists (select 1 from gg b where b."Gender"='{letter}' and b."DayNum"<={_LAST} and b."GameNo"%83<>0 and b."Season"=a."Season" and b."DayNum"=a."DayNum" and b."WTeamID"=a."WTeamID" and b."LTeamID"=a."LTeamID")"""
    return sql + ') select "check", failures=0 as passed, severity, failures from r'


@query("league_audit", _audit_sql())
def league_audit(spark, d):
    """Every check of the raw audit over the league's tables, with planted faults, observed while they are written."""
    tables = _tables(spark, d)
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    return O.audit_tables(spark, tables, folder, list(tables), target_season=2001, last_regular_day=_LAST)[1]
