"""Ratings, brackets and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.operators import boosting as T
from fieldglass.operators import bracket as B
from fieldglass.operators import models as M
from fieldglass.operators import ratings as R
from fieldglass.plans.forecasts import _WIDE as WIDE
from fieldglass.plans.forecasts import CAND, wide
from fieldglass.plans.forecasts import S as STREAMS
from fieldglass.plans.ranks import matchups
from fieldglass.plans.teams import G, L, long, possessions, r6
from fieldglass.registry import query
from fieldglass.sources.league import games
from fieldglass.sources.tables import table

LEAGUE = ["Gender", "Season"]


def jacobi(cells: str, by: str, steps: int, damp: float, out: str) -> str:
    """SQL: solutions of the systems a (by, i, j, v), b (by, i, v), which ``cells`` defines, by damped Jacobi steps."""
    q = [c.strip() for c in by.split(",")]
    same = lambda x, y: " and ".join(f"{x}.{c}={y}.{c}" for c in q)
    return f"""{cells}, dg as materialized (select {by}, i, v from a where i=j),
 x as (select 0 as k, {by}, i, 0.0::double as v from b union all
  select x.k+1, {", ".join(f"a.{c}" for c in q)}, a.i, max(x.v) filter (where a.i=a.j)+{damp}*(max(b.v)-sum(a.v*x.v))/max(dg.v) from a
 join x on {same("x", "a")} and x.i=a.j join b on {same("b", "a")} and b.i=a.i join dg on {same("dg", "a")} and dg.i=a.i where
 x.k<{steps} group by x.k, {", ".join(f"a.{c}" for c in q)}, a.i)
 {out}"""


_RIDGE = (
    G.replace("with ", "with recursive ", 1)
    + """, gm as (select "Gender","Season", unnest([{'w':'strength','q':1.0::double},{'w':'recent','q':pow(0.5,(300-"DayNum")/30.0)}])
 as u, "WTeamID" as w, "LTeamID" as l, ("WScore"-"LScore")::double as m, case "WLoc" when 'H' then 1 when 'A' then -1 else 0 end as h
 from games where "DayNum"<=300),
 e as (select "Gender","Season", u.w as kind, u.q as q, m, unnest([{'i':w,'v':1},{'i':l,'v':-1},{'i':-1,'v':h}]) as c,
 [{'i':w,'v':1},{'i':l,'v':-1},{'i':-1,'v':h}] as row from gm),
 aa as (select "Gender","Season",kind, c.i as i, unnest(row) as r, c.v as cv, q from e), ab as (select "Gender","Season",kind, i, r.i as
 j, q*cv*r.v as v from aa), a as materialized (select "Gender","Season",kind, i, j, sum(v)+max(case when i=j then 20 else 0 end) as v
 from ab group by all),
 b as materialized (select "Gender","Season",kind, c.i as i, sum(q*c.v*m) as v from e group by all)"""
)
_BY = '"Gender", "Season", kind'


def strengths(spark, d):
    g = games(spark, d).where("DayNum <= 300")
    weight = F.pow(F.lit(0.5), (F.lit(300) - F.col("DayNum")) / F.lit(30.0))
    return g, R.ridge_strength(g, LEAGUE, weights={"strength": F.lit(1.0), "recent": weight})


@query("ridge_strength", jacobi(_RIDGE.replace(""",{'w':'recent','q':pow(0.5,(300-"DayNum")/30.0)}""", ""), _BY, 150, 0.6, 'select "Gender","Season", i as "TeamID", round(v,3) as strength from x where k=150'))
def ridge_strength(spark, d):
    return strengths(spark, d)[1].select(*LEAGUE, "TeamID", F.round("strength", 3).alias("strength"))


@query("ridge_residual_check", G + """, t as (select "Gender","Season","WTeamID" as t from games where "DayNum"<=300 union select
 "Gender","Season","LTeamID" from games where "DayNum"<=300) select "Gender","Season", count(*)+1 as equations, "Season"%3<>0 as solved
 from t group by all""")
def ridge_residual_check(spark, d):
    """The normal equations at the ratings; in every third season the ratings are moved on purpose."""
    g, r = strengths(spark, d)
    moved = r.withColumn("strength", F.col("strength") + F.when((F.col("Season") % 3 == 0) & (F.col("TeamID") == R.HOME), 1e-3).otherwise(0.0))
    return R.ridge_residual(g, moved, LEAGUE).select(*LEAGUE, "equations", (F.col("worst") < 1e-5).alias("solved"))


@query("ridge_recent", jacobi(_RIDGE, _BY, 150, 0.6, """, y as (select "Gender","Season", i, max(v) filter (where kind='strength') as s,
 max(v) filter (where kind='recent') as r from x where k=150 group by all) select "Gender","Season", i as "TeamID", round(r,3) as
 recent, round(r-s,3) as change from y"""))
def ridge_recent(spark, d):
    """Strength with games weighted by age (half-life 30 days), and its change from the plain one: one aggregate for both."""
    r = strengths(spark, d)[1]
    return r.select(*LEAGUE, "TeamID", F.round("recent", 3).alias("recent"), F.round(F.col("recent") - F.col("strength"), 3).alias("change"))


_POSS_ROWS = """, pr as (select *, (("FGA"-"OR"+"TO"+0.475*"FTA")+("opp_FGA"-"opp_OR"+"opp_TO"+0.475*"opp_FTA"))/2 as poss,
 abs(("FGA"-"OR"+"TO"+0.475*"FTA")-("opp_FGA"-"opp_OR"+"opp_TO"+0.475*"opp_FTA")) as gap from long where "DayNum"<=300),
 cl as (select *, (100*"Score"/poss)::double as eff from pr where gap/nullif(poss,0)<=0.10)"""


def _sides_sql(kinds: str) -> str:
    """Systems of offense (2 t), defense (2 t + 1), home (-1) and level (-2) from rows cl; ``kinds``: a list of {w, q, y}."""
    row = """[{'i':2*"TeamID",'v':1},{'i':2*"OppID"+1,'v':1},{'i':-1,'v':home},{'i':-2,'v':1}]"""
    return (
        L.replace("with ", "with recursive ", 1) + _POSS_ROWS + f""", ev as (select "Gender","Season", unnest({kinds}) as u, {row} as
 row from cl), e as (select "Gender","Season", u.w as kind, u.q as q, u.y as y, row, unnest(row) as c from ev where u.y is not null),
 aa as (select "Gender","Season",kind, c.i as i, unnest(row) as r, c.v as cv, q from e), ab as (select "Gender","Season",kind, i, r.i as
 j, q*cv*r.v as v from aa), a as materialized (select "Gender","Season",kind, i, j, sum(v)+max(case when i=j and i<>-2 then 20 else 0
 end) as v from ab group by all),
 b as materialized (select "Gender","Season",kind, c.i as i, sum(q*c.v*y) as v from e group by all)"""
    )


_EFF = """[{'w':'adj','q':1.0::double,'y':eff},{'w':'recent','q':pow(0.5,(300-"DayNum")/30.0),'y':eff}]"""
_SPLIT = """, y as (select "Gender","Season",kind, i//2 as "TeamID", max(v) filter (where i%2=0) as o, -max(v) filter (where i%2=1) as d
 from x where k={n} and i>=0 group by all)"""
_POSSESSIONS = ("FGA", "OR", "TO", "FTA")


def efficiencies(spark, d):
    rows = possessions(long(spark, d, *_POSSESSIONS).where("DayNum <= 300")).where("clean").withColumn("efficiency", F.col("efficiency").cast("double"))
    weight = F.pow(F.lit(0.5), (F.lit(300) - F.col("DayNum")) / F.lit(30.0))
    return rows, weight, R.offense_defense(rows, LEAGUE, {"adj": (F.col("efficiency"), F.lit(1.0)), "recent": (F.col("efficiency"), weight)})


@query("offense_defense", jacobi(_sides_sql(_EFF), _BY, 400, 0.4, _SPLIT.format(n=400) + """ select "Gender","Season","TeamID", """ + ", ".join(f"round(max({c}) filter (where kind='{k}'),2) as {k}_{n}" for k in ("adj", "recent") for c, n in (("o", "offense"), ("d", "defense"))) + " from y group by all"))
def offense_defense(spark, d):
    t = efficiencies(spark, d)[2]
    return t.select(*LEAGUE, "TeamID", *[F.round(c, 2).alias(c) for c in ("adj_offense", "adj_defense", "recent_offense", "recent_defense")])


@query(
    "efficiency_residuals",
    jacobi(
        _sides_sql(_EFF), _BY, 400, 0.4,
        """, f as (select "Gender","Season", i, v from x where k=400 and kind='adj'), r as (select cl.*, eff-(o.v+p.v+home*h.v+c.v) as
 res, pow(0.5,(300-"DayNum")/30.0) as w from cl join f o on o."Gender"=cl."Gender" and o."Season"=cl."Season" and o.i=2*cl."TeamID" join
 f p on p."Gender"=cl."Gender" and p."Season"=cl."Season" and p.i=2*cl."OppID"+1
 join f h on h."Gender"=cl."Gender" and h."Season"=cl."Season" and h.i=-1 join f c on c."Gender"=cl."Gender" and c."Season"=cl."Season"
 and c.i=-2)
 select "Gender","Season","TeamID", round(stddev_samp(res),2) as residual_sd, round(quantile_cont(res,0.1),2) as residual_downside,
 round(sum(w*res)/sum(w),2) as recent_residual, round(coalesce(sum(res) filter (where home<=0),0)/(count(*) filter (where home<=0)+5),2)
 as road_residual from r group by all""",
    ),
)
def efficiency_residuals(spark, d):
    """How far games were from what the ratings say: spread, lower tail, recent and road form."""
    rows, weight, fit = efficiencies(spark, d)
    t = R.residual_form(R.residuals(rows, fit, LEAGUE, "efficiency", "adj"), LEAGUE, weight)
    return t.select(*LEAGUE, "TeamID", *[F.round(c, 2).alias(c) for c in t.columns[3:]])


_ELO = (
    G.replace("with ", "with recursive ", 1)
    + """, g as (select "Gender" as p, "Season" as s, "DayNum" as d, "WTeamID" as w, "LTeamID" as l,
 least(ln(1+"WScore"-"LScore"),3.0)::double as sc, case "WLoc" when 'H' then 60 when 'A' then -60 else 0 end as h from games where
 "DayNum"<=300),
 days as (select p, s, d, row_number() over (partition by p order by s, d) as n, s-coalesce(lag(s) over (partition by p order by s, d),
 s) as gap from (select distinct p, s, d from g)),
 every as (select p, w as t from g union select p, l from g),
 r as (select p, t, 0::bigint as n, 1500.0::double as e, 1500.0::double as m from every union all
  select r.p, r.t, r.n+1, 1500+pow(0.65,y.gap)*(r.e-1500)+coalesce(c.e,0), 1500+pow(0.65,y.gap)*(r.m-1500)+coalesce(c.m,0) from r join
 days y on y.p=r.p and y.n=r.n+1
  left join (select p, n, t, sum(e) as e, sum(m) as m from (select p, n, u.t as t, u.x*ge as e, u.x*gm as m from (select g.p, z.n,
 unnest([{'t':g.w,'x':1},{'t':g.l,'x':-1}]) as u, 20*(1-1/(1+pow(10,-(pow(0.65,z.gap)*(a.e-b.e)+g.h)/400))) as ge,
 20*g.sc*(1-1/(1+pow(10,-(pow(0.65,z.gap)*(a.m-b.m)+g.h)/400))) as gm
   from r a join r b on b.p=a.p and b.n=a.n join days z on z.p=a.p and z.n=a.n+1 join g on g.p=z.p and g.s=z.s and g.d=z.d and g.w=a.t
 and g.l=b.t)) group by p, n, t) c on c.p=r.p and c.n=r.n+1 and c.t=r.t),
 ends as (select p, s, max(n) as last, min(n)-1 as first, max(n) filter (where d<=270) as mid from days group by all), played as (select
 distinct p, s, w as t from g union select distinct p, s, l from g),
 fin as (select f.p, f.s, f.t, z.e, z.m, case when n.mid is null then 1500+pow(0.65,y.gap)*(o.e-1500) else o.e end as oe, case when
 n.mid is null then 1500+pow(0.65,y.gap)*(o.m-1500) else o.m end as om
  from played f join ends n on n.p=f.p and n.s=f.s join r z on z.p=f.p and z.t=f.t and z.n=n.last join r o on o.p=f.p and o.t=f.t and
 o.n=coalesce(n.mid,n.first) join days y on y.p=f.p and y.n=n.first+1)
 select p as "Gender", s as "Season", t as "TeamID", round(e,4) as elo, round(m,4) as elo_mov, round(e-oe,4) as elo_change,
 round(m-om,4) as elo_mov_change from fin"""
)


@query("elo_ratings", _ELO)
def elo_ratings(spark, d):
    return R.elo(games(spark, d), cutoff=300).select("Gender", "Season", "TeamID", *[F.round(c, 4).alias(c) for c in ("elo", "elo_mov", "elo_change", "elo_mov_change")])


_EIGHT = L + """, t as (select "Gender","Season","TeamID", round(avg(margin),6) as m from long group by all), o as (select *,
 row_number() over (partition by "Gender","Season" order by m desc,"TeamID")-1 as pos from t), e as (select "Gender","Season", cast(pos
 as int) as pos, "TeamID" as team, 1500+m/100 as rating from o where pos<8),
 full8 as (select "Gender","Season" from e group by all having count(*)=8), b as (select e.* from e join full8 using ("Gender","Season"))
"""
for _r in (1, 2, 3):
    _prev, _cur, _size = ("b" if _r == 1 else f"b{_r - 1}"), f"b{_r}", 1 << _r
    _last = "1.0" if _r == 1 else f"r{_r - 1}"
    _EIGHT += f""", {_cur} as (select x.*, ({_last.replace('r', 'x.r', 1) if _r > 1 else '1.0'})*(select
 sum(({_last.replace('r', 'y.r', 1) if _r > 1 else '1.0'})/(1+pow(10.0,(y.rating-x.rating)/400))) from {_prev} y where
 y."Gender"=x."Gender" and y."Season"=x."Season" and y.pos//{_size}=x.pos//{_size} and y.pos//{_size // 2}<>x.pos//{_size // 2}) as
 r{_r} from {_prev} x)"""


def eight(spark, d):
    """The eight best teams of each season by mean margin, in bracket positions."""
    from pyspark.sql import Window

    t = long(spark, d).groupBy(*LEAGUE, "TeamID").agg(r6(F.avg("margin")).alias("m"))
    pos = F.row_number().over(Window.partitionBy(*LEAGUE).orderBy(F.col("m").desc(), "TeamID")) - 1
    e = t.withColumn("pos", pos).where("pos < 8").select(*LEAGUE, "pos", F.col("TeamID").alias("team"), (1500 + F.col("m") / 100).alias("rating"))
    return e.join(e.groupBy(*LEAGUE).agg(F.count(F.lit(1)).alias("n")).where("n = 8").drop("n"), LEAGUE)


@query("bracket_dp", _EIGHT + ' select "Gender","Season",team, round(r1,9) as r1, round(r2,9) as r2, round(r3,9) as r3 from b3')
def bracket_dp(spark, d):
    return B.bracket(eight(spark, d), 3, LEAGUE).select(*LEAGUE, "team", *[F.round(f"r{i}", 9).alias(f"r{i}") for i in (1, 2, 3)])


@query(
    "final_paths",
    _EIGHT + """ select x."Gender", x."Season", x.team, y.team as opponent, round(x.r2*y.r2/(1+pow(10.0,(y.rating-x.rating)/400)),9) as
 share from b2 x join b2 y on x."Gender"=y."Gender" and x."Season"=y."Season" and x.pos//4<>y.pos//4""",
)
def final_paths(spark, d):
    return B.final_paths(eight(spark, d), 3, LEAGUE).select(*LEAGUE, "team", "opponent", F.round("share", 9).alias("share"))


@query("sensitivity_sweep", _EIGHT.replace("1500+m/100 as rating from o", "1500+m/100+case when pos=0 then delta else 0 end as rating, delta from o, (values (-100),(-50),(0),(50),(100)) v(delta)").replace('"Gender","Season" from e group by all having count(*)=8', '"Gender","Season" from e group by all having count(*)=40').replace('y."Season"=x."Season"', 'y."Season"=x."Season" and y.delta=x.delta') + ' select "Gender","Season", cast(delta as int) as delta, team, round(r3,9) as title from b3 where pos=0')
def sensitivity_sweep(spark, d):
    """The favourite's title chance with its rating moved."""
    e = eight(spark, d).withColumn("delta", F.explode(F.array(*[F.lit(x) for x in (-100, -50, 0, 50, 100)])))
    e = e.withColumn("rating", F.col("rating") + F.when(F.col("pos") == 0, F.col("delta")).otherwise(0))
    return B.bracket(e, 3, [*LEAGUE, "delta"]).where("pos = 0").select(*LEAGUE, "delta", "team", F.round("r3", 9).alias("title"))


@query("elo_win_probability", "select s_suppkey, round(1/(1+pow(10.0,(5000-s_acctbal)/400)),9) as p from supplier")
def elo_win_probability(spark, d):
    return table(spark, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", F.round(B.elo_probability(F.col("s_acctbal"), F.lit(5000.0)), 9).alias("p"))


@query(
    "price_comparison",
    """with p as (select l_orderkey, l_linenumber, 1/(1+l_discount) as a, 1/(1.5+l_tax) as b from lineitem)
 select l_orderkey, l_linenumber, round(a/(a+b),9) as no_vig, round(a+b-1,9) as overround, round((a+b)/a,9) as fair, round((a+b)/b,9) as
 fair_other from p""",
)
def price_comparison(spark, d):
    """Both sides' prices 1 + discount and 1.5 + tax of every line: chances without the margin, the margin, fair prices."""
    t = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return t.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for n, c in M.fair_prices(1 + F.col("l_discount"), 1.5 + F.col("l_tax")).items()])


def matrix(spark, d):
    """Late games as labelled matchups: differences of both teams' regular season and the outcome of the lower id."""
    from fieldglass.operators.reshape import canonical

    m = matchups(spark, d)
    late = canonical(games(spark, d).where("DayNum > 300")).select(*LEAGUE, "Team1ID", "Team2ID", "DayNum", "GameNo", "y")
    diffs = [((F.col(f"a_{c}") - F.col(f"b_{c}")) / 1000).alias(c) for c in ("strength", "offense", "defense")]
    return late.join(m.select(*LEAGUE, "Team1ID", "Team2ID", *diffs), [*LEAGUE, "Team1ID", "Team2ID"])


FEATURES = ["strength", "offense", "defense"]


_LATE = L + """, reg as (select "Gender","Season","TeamID", avg(margin) as strength, avg("Score") as offense, avg("OppScore") as defense
 from long where "DayNum"<=300 group by all),
 mx as (select g."Gender", g."Season", g."GameNo", g."DayNum", least("WTeamID","LTeamID") as "Team1ID", greatest("WTeamID","LTeamID") as
 "Team2ID", ("WTeamID"<"LTeamID")::int as y, (a.strength-b.strength)/1000 as x1, (a.offense-b.offense)/1000 as x2,
 (a.defense-b.defense)/1000 as x3
 from games g left join reg a on a."Gender"=g."Gender" and a."Season"=g."Season" and a."TeamID"=least("WTeamID","LTeamID") left join reg
 b on b."Gender"=g."Gender" and b."Season"=g."Season" and b."TeamID"=greatest("WTeamID","LTeamID") where g."DayNum">300)"""
_SCREEN = """with w as (select *, year(l_shipdate) as fold, l_quantity as f1, l_discount as f2, l_tax as f3,
 l_discount+l_quantity/100000 as f4, 1.0::double as f6, case when l_orderkey%1000=7 then 1.0::double else 0.0::double end as f7,
 (l_returnflag='R')::int as y from lineitem),
 k as (select {fold} as fold, count(*) as n, abs(corr(f1,y)) as r1, abs(corr(f2,y)) as r2, abs(corr(f3,y)) as r3, abs(corr(f4,y)) as r4,
 case when count(*) filter (where f7<>0)>0 then abs(corr(f7,y)) else 0 end as r7, count(*) filter (where f7<>0) as z from w group by all),
 s as (select fold, unnest([{{'f':'f1','s':'retained','r':r1}},
 {{'f':'f2','s':case when r4>r2 then 'redundant' else 'retained' end,'r':r2}}, {{'f':'f3','s':'retained','r':r3}},
 {{'f':'f4','s':case when r4>r2 then 'retained' else 'redundant' end,'r':r4}},
  {{'f':'f5','s':'all_missing','r':0.0::double}}, {{'f':'f6','s':'constant','r':0.0::double}},
 {{'f':'f7','s':case when z=0 then 'constant' when z<greatest(2,ceil(0.005*n)) then 'near_constant' else 'retained' end,'r':r7}}]) as u
 from k)"""
SCREENED = [f"f{i}" for i in range(1, 8)]


def wide_features(spark, d):
    """Lines with features of every kind: useful ones, one that repeats another, an unknown, a constant and a rare one."""
    t = table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return t.select(
        F.year("l_shipdate").alias("fold"), F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"), (F.col("l_discount") + F.col("l_quantity") / 100000).alias("f4"),
        F.lit(None).cast("double").alias("f5"), F.lit(1.0).alias("f6"), F.when(F.col("l_orderkey") % 1000 == 7, 1.0).otherwise(0.0).alias("f7"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


@query("training_screen", _SCREEN.format(fold="0") + """ select u.f as feature, u.s as status, round(u.r,6) as correlation, case when u.s='redundant' then case u.f when 'f2' then 'f4' else 'f2' end end as repeats,
 case when u.f='f5' then 0 else n end as support, case u.f when 'f1' then n1 when 'f2' then n2 when 'f3' then n3 when 'f4' then n4 when 'f5' then 0 when 'f6' then n else n7 end as nonzero
 from s, (select count(*) as n, count(*) filter (where f1<>0) as n1, count(*) filter (where f2<>0) as n2, count(*) filter (where f3<>0) as n3, count(*) filter (where f4<>0) as n4, count(*) filter (where f7<>0) as n7 from w)""")
def training_screen(spark, d):
    rows = [(f, s, round(r, 6), p, u, z) for f, s, r, p, u, z in M.screen(wide_features(spark, d), SCREENED, "y")]
    return spark.createDataFrame(rows, "feature string, status string, correlation double, repeats string, support long, nonzero long")


def _by_fold(spark, d):
    return spark.createDataFrame(M.screen_by_fold(wide_features(spark, d), SCREENED, "y", "fold"), "fold int, feature string, status string, correlation double")


STATUSES = ["all_missing", "constant", "near_constant", "redundant", "retained"]


@query("screening_pivot", _SCREEN.format(fold="fold") + " select fold::int as fold, " + ", ".join(f"count(*) filter (where u.s='{x}') as {x}" for x in STATUSES) + " from s group by all")
def screening_pivot(spark, d):
    """Features by status within each fold, screened there."""
    return _by_fold(spark, d).groupBy("fold").pivot("status", STATUSES).count().na.fill(0)


@query("selection_stability", _SCREEN.format(fold="fold") + " select u.f as feature, count(*) as folds, count(*) filter (where u.s='retained') as retained, round(avg((u.s='retained')::int),6) as share from s group by all")
def selection_stability(spark, d):
    kept = F.when(F.col("status") == "retained", 1).otherwise(0)
    return _by_fold(spark, d).groupBy("feature").agg(F.count(F.lit(1)).alias("folds"), F.sum(kept).alias("retained"), r6(F.avg(kept)).alias("share"))


_SOLVE = """h11*(h22*h33-h23*h23)-h12*(h12*h33-h23*h13)+h13*(h12*h23-h22*h13)"""
_NEWTON = (
    _LATE.replace("with ", "with recursive ", 1)
    + """, fold as (select distinct "Season" as s from mx where "Season">(select min("Season") from mx)),
 sc as (select s, sqrt(avg(coalesce(x1,0)*coalesce(x1,0))) as d1, sqrt(avg(coalesce(x2,0)*coalesce(x2,0))) as d2,
 sqrt(avg(coalesce(x3,0)*coalesce(x3,0))) as d3 from fold join mx on "Season"<s group by s),
 tr as (select s, coalesce(x1,0)/d1 as z1, coalesce(x2,0)/d2 as z2, coalesce(x3,0)/d3 as z3, y from sc join mx on "Season"<s),
 it as (select s, 0 as k, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3 from fold union all
  select s, k+1, w1-((h22*h33-h23*h23)*g1-(h12*h33-h13*h23)*g2+(h12*h23-h13*h22)*g3)/det,
 w2-(-(h12*h33-h13*h23)*g1+(h11*h33-h13*h13)*g2-(h11*h23-h13*h12)*g3)/det,
 w3-((h12*h23-h13*h22)*g1-(h11*h23-h13*h12)*g2+(h11*h22-h12*h12)*g3)/det
  from (select *, """ + _SOLVE + """ as det from (select s,k,w1,w2,w3, 2*sum((p-y)*z1)+10*w1 as g1, 2*sum((p-y)*z2)+10*w2 as g2,
 2*sum((p-y)*z3)+10*w3 as g3, 2*sum(q*z1*z1)+10 as h11, 2*sum(q*z1*z2) as h12, 2*sum(q*z1*z3) as h13, 2*sum(q*z2*z2)+10 as h22,
 2*sum(q*z2*z3) as h23, 2*sum(q*z3*z3)+10 as h33
   from (select *, p*(1-p) as q from (select it.*, z1, z2, z3, y, 1/(1+exp(-(w1*z1+w2*z2+w3*z3))) as p from it join tr using (s) where
 k<12)) group by s,k,w1,w2,w3)))
 select m."Gender", m."Season", m."GameNo", y, round(1/(1+exp(-(w1*coalesce(x1,0)/d1+w2*coalesce(x2,0)/d2+w3*coalesce(x3,0)/d3))),5) as
 p from mx m join it on it.s=m."Season" and k=12 join sc on sc.s=m."Season" """
)


@query("walk_forward_logistic", _NEWTON)
def walk_forward_logistic(spark, d):
    t = M.walk_forward(matrix(spark, d), FEATURES, "Season")
    return t.select("Gender", "Season", "GameNo", "y", F.round("p", 5).alias("p"))


BOOST = {"rounds": 10, "depth": 2, "rate": 0.2, "l2": 10.0, "least": 25}


def _boosted_sql(rounds: int, depth: int, rate: float, l2: float, least: int) -> str:
    """Two levels a tree, a set of named steps a round: histograms, running sums, best splits, margins."""
    assert depth == 2
    mag = "case when x is null or abs(x)<pow(2,-20) then 0 else 1+least(floor((log2(abs(x))+20)*8),319) end"
    sql = _LATE + f""", fold as (select distinct "Season" as s from mx where "Season">(select min("Season") from mx)),
 v as materialized (select "Gender" as g, "Season" as t, "GameNo" as id, y, f, x, {mag} as m from (select *, unnest([1,2,3]) as f, unnest([x1,x2,x3]) as x from mx)),
 c as (select s, f, m, count(*) as n from fold join v on t<s group by all), cb as (select s, f, m, n, sum(n) over (partition by s, f) as rows from c),
 lv as materialized (select s, q.f, q.m, case when q.m=0 then 0 else 1+least(7, 8*coalesce(sum(n) filter (where cb.m<q.m), 0)//max(rows)) end as level from (select distinct s, f, m from fold join v on t<=s) q join cb using (s, f) group by s, q.f, q.m),
 o as materialized (select s, g, id, t<s as train, way, case when way=1 then y else 1-y end as y, max(case when f=1 then b end) as b1, max(case when f=2 then b end) as b2, max(case when f=3 then b end) as b3
  from (select lv.s, g, id, t, y, v.f, unnest([1,-1]) as way, unnest([1,-1])*sign(coalesce(x,0))*level as b from v join lv on lv.f=v.f and lv.m=v.m and t<=lv.s) group by all),
 m0 as (select s, g, id, way, train, y, b1, b2, b3, 0.0::double as z from o)"""

    def best(h: str, by: str, out: str) -> str:
        gain = f"gl*gl/(hl+{l2})+(gt-gl)*(gt-gl)/(ht-hl+{l2})-gt*gt/(ht+{l2})"
        return f"""{h}c as materialized (select *, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over u as gt, sum(h) over u as ht, sum(n) over u as nt from {h} window w as (partition by {by}, f order by b), u as (partition by {by}, f)),
 {out} as materialized (select {by}, f, b, gl, hl, gt, ht from (select *, row_number() over (partition by {by} order by round({gain},6) desc, f, b) as place from {h}c where nl>={least} and nt-nl>={least} and {gain}>1e-9) where place=1)"""

    for r in range(rounds):
        sql += f""", g{r} as materialized (select *, 1/(1+exp(-z))-y as gr, 1/(1+exp(-z))*(1-1/(1+exp(-z))) as he from m{r}),
 h{r} as materialized (select s, f, b, sum(gr) as g, sum(he) as h, count(*) as n from (select s, gr, he, unnest([1,2,3]) as f, unnest([b1,b2,b3]) as b from g{r} where train) group by all),
 {best(f"h{r}", "s", f"k{r}")},
 n{r} as materialized (select a.*, case when k.f is null then 0 else (case k.f when 1 then b1 when 2 then b2 else b3 end>k.b)::int end as node from g{r} a left join k{r} k on k.s=a.s),
 i{r} as materialized (select s, node, f, b, sum(gr) as g, sum(he) as h, count(*) as n from (select s, node, gr, he, unnest([1,2,3]) as f, unnest([b1,b2,b3]) as b from n{r} where train) group by all),
 {best(f"i{r}", "s, node", f"l{r}")},
 t{r} as (select s, node, sum(gr) as g, sum(he) as h from n{r} where train group by all),
 m{r + 1} as materialized (select a.s, a.g, id, way, train, y, b1, b2, b3, z-{rate}*case when k.f is null then t.g/(t.h+{l2}) when case k.f when 1 then b1 when 2 then b2 else b3 end<=k.b then k.gl/(k.hl+{l2}) else (k.gt-k.gl)/(k.ht-k.hl+{l2}) end as z
  from n{r} a join t{r} t on t.s=a.s and t.node=a.node left join l{r} k on k.s=a.s and k.node=a.node)"""
    return sql + f""" select a.g as "Gender", a.s as "Season", a.id as "GameNo", a.y, round((1/(1+exp(-a.z))+1-1/(1+exp(-b.z)))/2,6) as p
 from m{rounds} a join m{rounds} b on b.s=a.s and b.g=a.g and b.id=a.id and a.way=1 and b.way=-1 where not a.train"""


@query("walk_forward_boosted", _boosted_sql(**BOOST))
def walk_forward_boosted(spark, d):
    t = T.walk_forward_boosted(matrix(spark, d), FEATURES, "Season", **BOOST)
    return t.select("Gender", "Season", "GameNo", "y", F.round("p", 6).alias("p"))


_BLEND = """, m as (select "Season", avg(a*a) as aa, avg(a*b) as ab, avg(a*c) as ac, avg(b*b) as bb, avg(b*c) as bc, avg(c*c) as cc,
 avg(a*y) as ay, avg(b*y) as bz, avg(c*y) as cy from w group by all), g as materialized (select avg(aa) as aa, avg(ab) as ab, avg(ac) as
 ac, avg(bb) as bb, avg(bc) as bc, avg(cc) as cc, avg(ay) as ay, avg(bz) as bz, avg(cy) as cy from m),
 it as (select 0 as k, 1/3.0::double as x, 1/3.0::double as y, 1/3.0::double as z union all
  select k+1, greatest(u-th,0), greatest(v-th,0), greatest(q-th,0) from (select *, case when lo+(1-(u+v+q))/3>0 then (u+v+q-1)/3 when
 mid+(1-(hi+mid))/2>0 then (hi+mid-1)/2 else hi-1 end as th
   from (select *, greatest(u,v,q) as hi, least(u,v,q) as lo, u+v+q-greatest(u,v,q)-least(u,v,q) as mid from (select k,
 x-st*(2*(aa*x+ab*y+ac*z-ay)+0.002*(x-1/3.0::double)) as u, y-st*(2*(ab*x+bb*y+bc*z-bz)+0.002*(y-1/3.0::double)) as v,
 z-st*(2*(ac*x+bc*y+cc*z-cy)+0.002*(z-1/3.0::double)) as q
    from (select it.*, g.*, 1/(aa+bb+cc+0.001)/2 as st from it, g where k<1500)))))"""


@query("simplex_blend", STREAMS.replace("with ", "with recursive ", 1) + CAND + WIDE + _BLEND + " select unnest(['a','b','c']) as stream, unnest([round(x,6),round(y,6),round(z,6)]) as weight from it where k=1500")
def simplex_blend(spark, d):
    w = M.simplex_blend(wide(spark, d), ["a", "b", "c"])
    return spark.createDataFrame([(s, round(x, 6)) for s, x in w.items()], "stream string, weight double")


@query("frozen_scoring", "select l_orderkey, l_linenumber, round(1/(1+exp(-(l_discount/0.05*0.7+l_tax/0.04*-0.4))),9) as p from lineitem")
def frozen_scoring(spark, d):
    t = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return M.score_frozen(t, {"l_discount": (0.05, 0.7), "l_tax": (0.04, -0.4)}).select("l_orderkey", "l_linenumber", F.round("p", 9).alias("p"))


@query(
    "symmetric_scaler",
    """select round(sqrt(avg(l_discount*l_discount)),9) as discount, round(sqrt(avg(l_tax*l_tax)),9) as tax from lineitem""",
)
def symmetric_scaler(spark, d):
    t = table(spark, d, "lineitem", "l_discount", "l_tax")
    return t.agg(*[F.round(F.sqrt(F.avg(F.col(f"l_{c}") * F.col(f"l_{c}"))), 9).alias(c) for c in ("discount", "tax")])
