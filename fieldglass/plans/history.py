"""Resumes, coaches, earlier seasons, target histories and ranking snapshots over the derived league."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.operators import history as H
from fieldglass.operators.joins import ordered_pair_differences
from fieldglass.operators.windows import average_rank
from fieldglass.plans.teams import KEY, L, QK, SEEDS, long, seeds
from fieldglass.registry import query
from fieldglass.sources.league import RANKINGS_SQL, rankings
from fieldglass.store import stored

CUTOFF = 300
#: The best 64 of a league's season are seeded, four to a number.
SEEDED = SEEDS + """, sd as (select "Gender","Season","TeamID", cast(floor((pos-1)/4)+1 as int) as seed from coded where pos<=64)"""
_ON = ' on {b}."Gender"={a}."Gender" and {b}."Season"={a}."Season" and {b}."TeamID"={a}."{t}"'


def on(a: str, b: str, t: str = "TeamID") -> str:
    return _ON.format(a=a, b=b, t=t)


def seeded(spark, d):
    return seeds(spark, d).where("pos <= 64").select(*KEY, (F.floor((F.col("pos") - 1) / 4) + 1).cast("int").alias("seed"))


RESUME_SQL = (
    SEEDED
    + """, rg as (select l.*, coalesce(sd.seed<=4,false)::int as e, (sd.seed is not null)::int as s, case when sd.seed<=4 then
 6.0::double when sd.seed is not null then 4.0::double else 0.25::double end as q,
 ("DayNum">270)::int as late, (home<=0)::int as away from long l left join sd"""
    + on("l", "sd", "OppID")
    + f""" where "DayNum"<={CUTOFF}), res as (select {QK}, cast(sum(q*win) as double) as quality_wins, cast(sum(e*win) as double) as
 elite_wins, cast(sum(s*win) as double) as seeded_wins,
 (sum(q*win)+10)/(sum(q)+20) as quality_win_rate, sum(q)/count(*) as schedule_quality, (sum(e*win)+2.5::double)/(sum(e)+5) as
 elite_win_rate, (sum(s*win)+2.5::double)/(sum(s)+5) as seeded_win_rate,
 (sum((1-s)*(1-win))+2.5::double)/(sum(1-s)+5) as bad_loss_rate, cast(sum(q*win*away) as double) as away_quality_wins,
 sum(q*margin)/(sum(q)+20) as quality_margin, cast(sum(q*win*late) as double) as late_quality_wins from rg group by all)"""
)


@query("resume_snapshot", L + RESUME_SQL + f" select {QK}, " + ", ".join(f"round({c},6) as {c}" for c in H.RESUME) + " from res")
def resume_snapshot(spark, d):
    t = H.resume(long(spark, d), seeded(spark, d), CUTOFF)
    return t.select(*KEY, *[F.round(c, 6).alias(c) for c in H.RESUME])


_DIFFS = ", ".join(f"round(a.{c}-b.{c},6) as diff_{c}" for c in H.RESUME)


@query(
    "resume_pairs",
    L + RESUME_SQL + ', p as (select distinct "Gender","Season", least("TeamID","OppID") as "Team1ID", greatest("TeamID","OppID") as "Team2ID" from long where "DayNum">300), o as (select *, cast(row_number() over (order by "Gender","Season","Team1ID","Team2ID")-1 as bigint) as row_ord from p)'
    + f' select row_ord, o."Gender", o."Season", "Team1ID", "Team2ID", {_DIFFS} from o join res a' + on("o", "a", "Team1ID") + " join res b" + on("o", "b", "Team2ID"),
)
def resume_pairs(spark, d):
    """Differences of late matchups with the template's row numbers carried through both joins."""
    from fieldglass.sinks import ordered_rows

    keys = ["Gender", "Season", "Team1ID", "Team2ID"]
    rows = stored(long(spark, d).select(*KEY, "OppID", "DayNum", "win", "margin", "home"), "games")
    p = rows.where("DayNum > 300").select("Gender", "Season", F.least("TeamID", "OppID").alias("Team1ID"), F.greatest("TeamID", "OppID").alias("Team2ID")).distinct()
    p = ordered_rows(p, [F.col(k) for k in keys], "row_ord")
    t = ordered_pair_differences(p, H.resume(rows, seeded(spark, d), CUTOFF), ["Gender", "Season"], H.RESUME, "row_ord")
    return t.select("row_ord", *keys, *[F.round(f"diff_{c}", 6).alias(f"diff_{c}") for c in H.RESUME])


#: Two stints a season for teams whose id is divisible by 5; names move between teams from season to season.
COACHES = """, ts as (select distinct "Gender","Season","TeamID" from long),
 cb as (select *, 'C'||(("TeamID"*7+("Season"-1990)//3)%60) as one, 'C'||(("TeamID"*11+"Season")%60) as two from ts),
 coaches as (select "Gender","Season","TeamID", 0 as "FirstDayNum", case when "TeamID"%5=0 then 180 else 400 end as "LastDayNum", one as
 "CoachName" from cb where "TeamID"%13<>0
   union all select "Gender","Season","TeamID", 181, 400, two from cb where "TeamID"%5=0 and "TeamID"%13<>0)"""


def coaches(rows):
    """Stints of the teams of rows."""
    t = rows.select(*KEY).distinct().where("TeamID % 13 <> 0")
    name = lambda x: F.concat(F.lit("C"), (x % 60).cast("string"))
    one, two = name(F.col("TeamID") * 7 + F.floor((F.col("Season") - 1990) / 3)), name(F.col("TeamID") * 11 + F.col("Season"))
    split = F.col("TeamID") % 5 == 0
    stint = lambda a, e, n: F.struct(F.lit(a).alias("FirstDayNum"), e.alias("LastDayNum"), n.alias("CoachName"))
    both = F.array(stint(0, F.when(split, 180).otherwise(400), one), F.when(split, stint(181, F.lit(400), two)))
    return t.select(*KEY, F.inline(F.filter(both, lambda x: x.isNotNull())))


def _coach_sql() -> str:
    out = []
    for kind in ("regular", "tournament"):
        for k in (1, 3, 5):
            n, w, m = (f"coalesce({kind}.{c}{k},0)" for c in "nwm")
            out += [f"round(ln(1+{n}),6) as {kind}_{k}_support", f"round(({w}+10.0::double)/({n}+20),6) as {kind}_{k}_win_posterior", f"round({m}/({n}+20.0::double),6) as {kind}_{k}_margin"]
    return ", ".join(f"case when c.\"CoachName\" is not null then {x.rsplit(' as ', 1)[0]} end as {x.rsplit(' as ', 1)[1]}" for x in out)


def _annual(kind: str, where: str) -> str:
    sums = ", ".join(f"coalesce(sum({c}) filter (where a._s-a.\"Season\"<={k}),0) as {c}{k}" for k in (1, 3, 5) for c in "nwm")
    return f""", {kind}_y as (select l."Gender", c."CoachName", l."Season", count(*) as n, sum(win) as w, sum(margin) as m from long l
 join coaches c{on("l", "c")} and l."DayNum" between c."FirstDayNum" and c."LastDayNum" where {where} group by all),
 {kind} as (select "Gender","CoachName",_s, count(*) as seasons, max(w) as best, {sums} from (select y.*, q._s from {kind}_y y join
 (select distinct "Gender","CoachName","Season" as _s from now) q on q."Gender"=y."Gender" and q."CoachName"=y."CoachName" and
 y."Season" between q._s-5 and q._s-1) a group by all)"""


_HELD = lambda x, n: f'case when c."CoachName" is not null then {x} end as {n}'


@query(
    "coach_history",
    L + COACHES + f', now as (select * from coaches where "FirstDayNum"<={CUTOFF} and "LastDayNum">={CUTOFF})' + _annual("regular", f'l."DayNum"<={CUTOFF}') + _annual("tournament", f'l."DayNum">{CUTOFF}')
    + """, h as (select n."Gender", n."Season", n."TeamID", count(distinct p."TeamID") as teams, count(distinct p."Season") as seasons
 from now n join coaches p on p."Gender"=n."Gender" and p."CoachName"=n."CoachName" and p."Season"<n."Season" group by all),
 run as (select n."Gender", n."Season", n."TeamID", p."Season" as y, row_number() over (partition by n."Gender",n."Season",n."TeamID"
 order by p."Season" desc) as k from now n join (select distinct "Gender","Season","TeamID","CoachName" from coaches) p on
 p."Gender"=n."Gender" and p."CoachName"=n."CoachName" and p."TeamID"=n."TeamID" and p."Season"<n."Season"),
 ten as (select "Gender","Season","TeamID", count(*) as tenure from run where "Season"-y=k group by all), pr as (select
 "Gender","Season"+1 as "Season","TeamID", arg_max("CoachName","LastDayNum") as prior from coaches group by all), t as (select distinct
 "Gender","Season","TeamID" from coaches)
 select t."Gender", t."Season", t."TeamID", (c."CoachName" is not null)::double as known, """
    + ", ".join([_HELD(f'({CUTOFF}-c."FirstDayNum"+1)::double', "stint_days"), _HELD('(prior<>c."CoachName")::double', "changed"), _HELD("coalesce(tenure,0)::double", "tenure"), _HELD("coalesce(h.teams,0)::double", "prior_teams"), _HELD("coalesce(h.seasons,0)::double", "prior_seasons")])
    + ", " + _coach_sql() + ", " + _HELD("coalesce(tournament.seasons,0)::double", "appearances_5") + ", " + _HELD("coalesce(tournament.best,0)::double", "best_wins_5")
    + " from t left join now c" + on("t", "c") + " left join h" + on("t", "h") + " left join ten" + on("t", "ten") + " left join pr" + on("t", "pr")
    + "".join(f' left join {k} on {k}."Gender"=t."Gender" and {k}."CoachName"=c."CoachName" and {k}._s=t."Season"' for k in ("regular", "tournament")),
)
def coach_history(spark, d):
    games = stored(long(spark, d).select(*KEY, "DayNum", "win", "margin"), "games")
    t = H.coach_history(stored(coaches(games), "coaches"), games.where(f"DayNum <= {CUTOFF}"), games.where(f"DayNum > {CUTOFF}"), CUTOFF)
    return t.select(*[F.round(c, 6).alias(c) if c.rsplit("_", 1)[-1] in ("support", "posterior", "margin") else c for c in t.columns])


@query(
    "prior_seasons",
    L + SEEDED + """, lw as (select "Gender","Season","TeamID", sum(win) as wins from long where "DayNum">300 group by all)
 select s."Gender", s."Season", s."TeamID", cast(coalesce((select sum(wins) from lw where lw."Gender"=s."Gender" and
 lw."TeamID"=s."TeamID" and lw."Season" between s."Season"-5 and s."Season"-1),0) as double) as prior_wins,
 cast((select count(*) from sd h where h."Gender"=s."Gender" and h."TeamID"=s."TeamID" and h."Season" between s."Season"-5 and
 s."Season"-1) as double) as prior_appearances,
 round((select (coalesce(sum(seed),0)+17.0::double)/(count(*)+2) from sd h where h."Gender"=s."Gender" and h."TeamID"=s."TeamID" and
 h."Season" between s."Season"-5 and s."Season"-1),6) as prior_seed from sd s""",
)
def prior_seasons(spark, d):
    wins = long(spark, d).where("DayNum > 300").groupBy(*KEY).agg(F.sum("win").alias("wins"))
    return H.prior_history(seeded(spark, d), wins).withColumn("prior_seed", F.round("prior_seed", 6))


_ENC = (
    SEEDS
    + f""", st as (select {QK}, round(avg(margin),6) as m from long where "DayNum"<=300 group by all), pc as (select *, (rank() over
 w+(count(*) over (partition by "Gender","Season",m)-1)/2.0)/count(*) over (partition by "Gender","Season") as pct from st window w as
 (partition by "Gender","Season" order by m)),
 cat as (select c."Gender", c."Season", c."TeamID", cast(c."TeamID" as int) as team, cast(least(floor((pos-1)/4)+1,16) as int) as seed,
 case when c."TeamID"%9<>0 then cast(least(floor(pct*10),9) as int) end as rank from coded c join pc"""
    + on("c", "pc")
    + """), lt as (select "Gender","Season","TeamID", win from long where "DayNum">300)"""
)


def _enc(c: str) -> str:
    return f"""select '{c}' as category, cat."Gender", cat."Season", cat."TeamID", case when cat.{c} is not null then
 round((coalesce(w,0)+10)/(coalesce(n,0)+20),6) end as mean,
 case when cat.{c} is not null then round(sqrt((coalesce(w,0)+10)*(coalesce(n,0)-coalesce(w,0)+10)/(pow(coalesce(n,0)+20,2)*(coalesce(n,0)+21))),6) end as uncertainty, case when cat.{c} is not null then round(ln(1+coalesce(n,0)),6) end as support
 from cat left join (select a."Gender", a."Season", a.{c}, sum(pow(0.5,(a."Season"-1-h."Season")/3.0)*win) as w,
 sum(pow(0.5,(a."Season"-1-h."Season")/3.0)) as n from (select distinct "Gender","Season",{c} from cat) a
   join (select cat."Gender", cat."Season", cat.{c}, win from lt join cat{on("lt", "cat")}) h on h."Gender"=a."Gender" and h.{c}=a.{c}
 and h."Season" between a."Season"-5 and a."Season"-1 group by all) x on x."Gender"=cat."Gender" and x."Season"=cat."Season" and
 x.{c}=cat.{c}"""


@query("target_histories", L + _ENC + " " + " union all ".join(_enc(c) for c in ("team", "seed", "rank")))
def target_histories(spark, d):
    """Forward-only encodings by team, seed and rank decile (null for some teams): half-life 3, the latest season in full."""
    st = long(spark, d).where("DayNum <= 300").groupBy(*KEY).agg(F.round(F.avg("margin"), 6).alias("m"))
    pct = average_rank(st, "m", ["Gender", "Season"], "pct")
    cat = seeds(spark, d).join(pct, KEY).select(
        *KEY, F.col("TeamID").alias("team"), F.least(F.floor((F.col("pos") - 1) / 4) + 1, F.lit(16)).cast("int").alias("seed"),
        F.when(F.col("TeamID") % 9 != 0, F.least(F.floor(F.col("pct") * 10), F.lit(9)).cast("int")).alias("rank"),
    )
    results = long(spark, d).where("DayNum > 300").select(*KEY, "win")
    out = None
    for c in ("team", "seed", "rank"):
        t = H.encode_history(cat, results, c).select(F.lit(c).alias("category"), *KEY, *[F.round(x, 6).alias(x) for x in ("mean", "uncertainty", "support")])
        out = t if out is None else out.unionByName(t)
    return out


_DAY, _STALE, _LAGS = 25, 10, (3, 7, 12)


def _panel(name: str, day: int) -> str:
    return f""", {name} as (select "SystemName","TeamID", 1.0-("OrdinalRank"-1)*1.0/greatest(max("OrdinalRank") over (partition by
 "SystemName")-1,1) as rating, {day}-"RankingDayNum" as age, "OrdinalRank" as rank
 from (select *, max("RankingDayNum") over (partition by "SystemName") as last from rankings where "RankingDayNum" between
 {day - _STALE} and {day}) where "RankingDayNum"=last)"""


def _moved(n: int) -> str:
    more = ", round(stddev_samp(p.rating-o.rating),6) as move_sd, count(*) as matched, round(stddev_samp(p.rating)-stddev_samp(o.rating),6) as dispersion_change" if n == 1 else ""
    return f""", m{n} as (select p."TeamID", median(p.rating-o.rating) as move{n}{more} from p join p{n} o on
 o."SystemName"=p."SystemName" and o."TeamID"=p."TeamID" group by all)"""


@query(
    "ranking_snapshot",
    f"with {RANKINGS_SQL}" + _panel("p", _DAY) + "".join(_panel(f"p{n}", _DAY - lag) + _moved(n) for n, lag in enumerate(_LAGS))
    + f""", v as (select "TeamID", median(rating) as consensus, avg(rating) as mean, stddev_samp(rating) as disagreement, count(distinct
 "SystemName") as systems, avg(age) as age, cast(max(age) as int) as max_age, avg((rank<=25)::int) as top25, avg((rank<=50)::int) as top50,
 quantile_cont(rating,0.25) as lower, quantile_cont(rating,0.75) as upper from p group by all)
 select "TeamID", systems, max_age, round(consensus,6) as consensus, round(mean,6) as mean, round(disagreement,6) as disagreement,
 round(age,6) as age, round(top25,6) as top25, round(top50,6) as top50, round(lower,6) as lower, round(upper,6) as upper,
 round(upper-lower,6) as iqr, round(systems*1.0::double/(select count(distinct "SystemName") from p),6) as coverage,
 round(ln(least(greatest(consensus,0.01),0.99)/(1-least(greatest(consensus,0.01),0.99))),6) as logit,
 round(move0,6) as move0, round(move1,6) as move1, round(move2,6) as move2, move_sd, dispersion_change,
 round(matched*1.0::double/systems,6) as matched_fraction, round(move0/{_LAGS[0]}-move1/{_LAGS[1]},6) as acceleration from v left join
 m0 using ("TeamID") left join m1 using ("TeamID") left join m2 using ("TeamID")""",
)
def ranking_snapshot(spark, d):
    t = H.ranking_snapshot(rankings(spark, d), _DAY, _LAGS, stale=_STALE)
    return t.select(*[c if c in ("TeamID", "systems", "max_age") else F.round(c, 6).alias(c) for c in t.columns])
