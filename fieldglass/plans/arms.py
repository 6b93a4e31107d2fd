"""Model families and their choice: temperatures, nested evaluation, capacities, additional features, persisted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions.stats import temperature
from fieldglass.operators import boosting as T
from fieldglass.operators import contracts as C
from fieldglass.operators import evaluate as E
from fieldglass.operators import models as M
from fieldglass.operators import nested as N
from fieldglass.operators import persisted as P
from fieldglass.operators import representation as V
from fieldglass.operators.minimise import minimise
from fieldglass.plans.forecasts import CAND, S, candidates
from fieldglass.plans.models import _LATE, _NEWTON, _SOLVE, FEATURES, LEAGUE, _boosted_sql, matrix
from fieldglass.plans.teams import r6
from fieldglass.registry import query
from fieldglass.sources.league import streams

_GOLD = (5**0.5 - 1) / 2


@query(
    "temperature_fit",
    S.replace("with ", "with recursive ", 1) + f""", c as materialized (select stream,"Season",p,y,count(*) as n from stream group by all), ends as (select distinct stream, 0 as k, 0.5::double as lo, 2.0::double as hi from stream),
 g as (select * from ends union all select stream, k+1, case when f1<=f2 then lo else hi-{_GOLD}*(hi-lo) end, case when f1<=f2 then lo+{_GOLD}*(hi-lo) else hi end
  from (select stream, k, lo, hi, avg(l1) as f1, avg(l2) as f2 from (select g.stream, k, lo, hi, "Season", sum(n*pow(1/(1+exp(-ln(p/(1-p))/(hi-{_GOLD}*(hi-lo))))-y,2))/sum(n) as l1,
   sum(n*pow(1/(1+exp(-ln(p/(1-p))/(lo+{_GOLD}*(hi-lo))))-y,2))/sum(n) as l2 from g join c on c.stream=g.stream where k<32 group by all) group by all)),
 t as (select stream, (lo+hi)/2 as t from g where k=32)
 select t.stream, round(max(t),4) as temperature, round(avg(l),6) as loss from t join (select t.stream, "Season", sum(n*pow(1/(1+exp(-ln(p/(1-p))/t))-y,2))/sum(n) as l from t join c on c.stream=t.stream group by all) s on s.stream=t.stream group by t.stream""",
)
def temperature_fit(spark, d):
    """Season-weighted Brier, minimised over temperatures between 1/2 and 2 for all streams at once."""
    rows = streams(spark, d).select("stream", "Season", "p", "y")
    t = minimise(rows, ["stream"], lambda x: F.pow(temperature("p", x) - F.col("y"), F.lit(2.0)), 0.5, 2.0, within=["Season"])
    return t.select("stream", F.round("x", 4).alias("temperature"), r6("loss").alias("loss"))


#: Candidates by family: expressions over p for both dialects.
FAMILIES = {"plain": {"raw": "p", "flat": "0.3+p*0.1"}, "curved": {"sharp": "least(p*p*1.2,0.99)", "mild": "0.5*p+0.2"}}
_EVERY = {c: e for f in FAMILIES.values() for c, e in f.items()}
_L2 = 1e-3


def _slope(t: str) -> str:
    """Slope of a forecast's squared error in the temperature t."""
    q = f"(1/(1+exp(-z/{t})))"
    return f"-2*({q}-y)*{q}*(1-{q})*z/({t}*{t})"


_OUTER = S.replace("with ", "with recursive ", 1) + """, cell as materialized (select "Season" as s, p, y, count(*) as n from stream group by all),
 long as materialized (select s, y, n, family, c, p, ln(p/(1-p)) as z from (select s, y, n, unnest([""" + ", ".join(f"{{'family':'{f}','c':'{c}','p':{e}}}" for f, cs in FAMILIES.items() for c, e in cs.items()) + """], recursive := true) from cell)),
 seasons as (select s, row_number() over (order by s)-1 as before from (select distinct s from cell)),
 brier as materialized (select s, family, c, sum(n*pow(p-y,2))/sum(n) as b from long group by all),
 pick as materialized (select s, before, family, c from (select *, row_number() over (partition by s, family order by past, c) as rn from (select o.s, o.before, h.family, h.c, round(avg(b),12) as past from seasons o join brier h on h.s<o.s where o.before>=2 group by o.s, o.before, h.family, h.c)) where rn=1),
 ends as (select distinct o.s, b.c, 0 as k, 0.5::double as lo, 2.0::double as hi from seasons o join brier b on b.s<o.s),
 bi as (select * from ends union all select s, c, k+1, case when f<0 then (lo+hi)/2 else lo end, case when f<0 then hi else (lo+hi)/2 end from
  (select s, c, k, lo, hi, avg(g) as f from (select bi.s, bi.c, k, lo, hi, long.s as h, sum(n*""" + _slope("((lo+hi)/2)") + """)/sum(n) as g from bi join long on long.c=bi.c and long.s<bi.s where k<42 group by all) group by all)),
 fit as materialized (select s, c, (lo+hi)/2 as t from bi where k=42),
 tried as materialized (select fit.s, fit.c, fit.t, sum(n*pow(1/(1+exp(-z/t))-y,2))/sum(n) as b from fit join long on long.c=fit.c and long.s=fit.s group by all),
 use as (select p.s, p.c, round(avg(t.b),12)<round(avg(b.b),12) as warm from pick p join tried t on t.c=p.c and t.s<p.s join brier b on b.c=t.c and b.s=t.s group by all),
 cal as (select p.s, p.family, p.c, case when warm then t.t else 1.0::double end as t, case when warm then t.b else b.b end as b from pick p join use using (s, c) join tried t on t.s=p.s and t.c=p.c join brier b on b.s=p.s and b.c=p.c),
 two as (select s, max(c) filter (where family='plain') as a, max(c) filter (where family='curved') as b from pick group by s),
 pair as materialized (select o.s, h.s as h, sum(n*pow(pa-pb,2))/sum(n) as dd, sum(n*(h.y-pb)*(pa-pb))/sum(n) as rd, sum(n*pow(h.y-pb,2))/sum(n) as rr from two o join (select s, y, n, """ + ", ".join(f"{e} as {c}" for c, e in _EVERY.items()) + """ from cell) h on h.s<=o.s,
  lateral (select case o.a """ + " ".join(f"when '{c}' then h.{c}" for c in FAMILIES["plain"]) + " end as pa, case o.b " + " ".join(f"when '{c}' then h.{c}" for c in FAMILIES["curved"]) + f""" end as pb) group by all),
 w as (select s, greatest(0, least(1, (avg(rd)+{_L2})/(avg(dd)+{2 * _L2}))) as w from pair where h<s group by s),
 size as (select s, sum(n)::bigint as games from cell group by s)
 select s::int as "Season", model, candidate, round(t,4) as temperature, round(weight,5) as weight, games, round(b,6) as brier from (
  select p.s, p.family||'_raw' as model, p.c as candidate, 1.0::double as t, case when p.family='plain' then w else 1-w end as weight, b.b from pick p join brier b using (s, c) join w using (s)
  union all select s, family||'_calibrated', c, t, null, b from cal
  union all select pair.s, 'blend', null, null, null, w*w*dd-2*w*rd+rr from pair join w using (s) where h=s) join size using (s)"""


@query("nested_evaluation", _OUTER)
def nested_evaluation(spark, d):
    """Outer seasons with two or more before them: every family's choice, raw and calibrated, and the blend, from one scan."""
    games = streams(spark, d).select("Season", "y", *[F.expr(e).alias(c) for c, e in _EVERY.items()])
    t = N.nested_evaluation(games, {f: list(c) for f, c in FAMILIES.items()}, l2=_L2)
    return t.select("Season", "model", "candidate", F.round("temperature", 4).alias("temperature"), F.round("weight", 5).alias("weight"), "games", r6("brier").alias("brier"))


#: Fold seasons, and their scaled features by |r| with the label; mirror images make sums of features 0.
_FOLDS = _LATE.replace("with ", "with recursive ", 1) + """, f0 as materialized (select "Gender" as g, "Season" as t, "GameNo" as id, y, coalesce(x1,0) as x1, coalesce(x2,0) as x2, coalesce(x3,0) as x3 from mx),
 fold as (select distinct t as s from f0 where t>(select min(t) from f0)),
 sc as materialized (select s, count(*) as n, sqrt(avg(x1*x1)) as d1, sqrt(avg(x2*x2)) as d2, sqrt(avg(x3*x3)) as d3, avg(x1*x2) as c12, avg(x1*x3) as c13, avg(x2*x3) as c23, avg(x1*(2*y-1)) as e1, avg(x2*(2*y-1)) as e2, avg(x3*(2*y-1)) as e3 from fold join f0 on t<s group by s),
 cr as materialized (select s, d1, d2, d3, c12/d1/d2 as r12, c13/d1/d3 as r13, c23/d2/d3 as r23, abs(e1)/d1 as q1, abs(e2)/d2 as q2, abs(e3)/d3 as q3, e1/d1 as v1, e2/d2 as v2, e3/d3 as v3 from sc)"""


def _fits(design: str) -> str:
    """Newton steps from ``design``: rows (key, s, t, g, id, y, z1, z2, z3) of training (t < s) and of the fold's own season; ``scored``
    has the latter with p."""
    return f""", de as materialized ({design}), tr as (select * from de where t<s), it as (select distinct key, s, 0 as k, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3 from de union all
  select key, s, k+1, w1-((h22*h33-h23*h23)*g1-(h12*h33-h13*h23)*g2+(h12*h23-h13*h22)*g3)/det, w2-(-(h12*h33-h13*h23)*g1+(h11*h33-h13*h13)*g2-(h11*h23-h13*h12)*g3)/det, w3-((h12*h23-h13*h22)*g1-(h11*h23-h13*h12)*g2+(h11*h22-h12*h12)*g3)/det
  from (select *, {_SOLVE} as det from (select key,s,k,w1,w2,w3, 2*sum((p-y)*z1)+10*w1 as g1, 2*sum((p-y)*z2)+10*w2 as g2, 2*sum((p-y)*z3)+10*w3 as g3, 2*sum(q*z1*z1)+10 as h11, 2*sum(q*z1*z2) as h12, 2*sum(q*z1*z3) as h13, 2*sum(q*z2*z2)+10 as h22, 2*sum(q*z2*z3) as h23, 2*sum(q*z3*z3)+10 as h33
   from (select *, p*(1-p) as q from (select it.*, z1, z2, z3, y, 1/(1+exp(-(w1*z1+w2*z2+w3*z3))) as p from it join tr using (key, s) where k<12)) group by key,s,k,w1,w2,w3))),
 scored as (select de.*, 1/(1+exp(-(w1*z1+w2*z2+w3*z3))) as p from de join it on it.key=de.key and it.s=de.s and k=12 where t=de.s)"""


_CAPS = [1, 2, 3]
_CAPACITY = _FOLDS + """, place as (select *, 1+(q2>q1)::int+(q3>q1)::int as o1, 1+(q1>=q2)::int+(q3>q2)::int as o2, 1+(q1>=q3)::int+(q2>=q3)::int as o3 from cr)""" + _fits(
    f"select cap as key, s, t, g, id, y, case when o1<=cap then x1/d1 else 0 end as z1, case when o2<=cap then x2/d2 else 0 end as z2, case when o3<=cap then x3/d3 else 0 end as z3 from place join f0 on t<=s, (select unnest({_CAPS}) as cap)"
)


def _forecasts_of_capacities(spark, d):
    return M.capacity_path(matrix(spark, d), FEATURES, "Season", _CAPS)


@query("capacity_path", _CAPACITY + ' select key::int as capacity, g as "Gender", s as "Season", id as "GameNo", y, round(p,5) as p from scored')
def capacity_path(spark, d):
    """Forecasts of every season by logistic models of 1, 2 and 3 features of its fold's screening order."""
    return _forecasts_of_capacities(spark, d).select("capacity", "Gender", "Season", "GameNo", "y", F.round("p", 5).alias("p"))


@query("capacity_choice", _CAPACITY + """, b as (select key, s, avg(pow(p-y,2)) as b, count(*) as n from scored group by all), past as (select o.s, b.key, round(avg(b.b),12) as past, count(*) as seen from (select distinct s from b) o join b on b.s<o.s group by all),
 o as (select *, row_number() over (partition by s order by past, key) as rn from past where seen>=2) select o.s as "Season", o.key::int as capacity, b.n as games, round(b.b,6) as brier from o join b on b.s=o.s and b.key=o.key where rn=1""")
def capacity_choice(spark, d):
    """For each season the capacity that did best in two or more earlier ones (ties: the smaller), and how it did."""
    from fieldglass.store import stored

    rows = stored(_forecasts_of_capacities(spark, d).select("capacity", "Season", "y", "p"), "capacities")
    chosen = E.forward_choice(rows, "capacity").where("seasons_seen >= 2").select("Season", "capacity")
    t = E.game_metrics(rows, ["Season", "capacity"]).join(chosen, ["Season", "capacity"])
    return t.select("Season", "capacity", "games", r6("brier").alias("brier"))


EXTRA = ["offense", "defense", "triple"]


def _extended(spark, d):
    """A base of one feature, and additional ones, of which the last repeats the base."""
    return matrix(spark, d).withColumn("triple", 3 * F.col("strength"))


_SCALED = """, m3 as (select s, 1.0::double as a11, r23 as a12, r12 as a13, 1.0::double as a22, r13 as a23, 1.0::double as a33 from cr),
 p1 as (select s, 0 as k, 1.0::double as u1, 0.5::double as u2, 0.25::double as u3 from m3 union all select s, k+1, a/l, b/l, c/l from (select *, sqrt(a*a+b*b+c*c) as l from (select m3.s, k, a11*u1+a12*u2+a13*u3 as a, a12*u1+a22*u2+a23*u3 as b, a13*u1+a23*u2+a33*u3 as c from p1 join m3 using (s) where k<800))),
 l1 as materialized (select s, sg*u1 as u1, sg*u2 as u2, sg*u3 as u3, u1*(a11*u1+a12*u2+a13*u3)+u2*(a12*u1+a22*u2+a23*u3)+u3*(a13*u1+a23*u2+a33*u3) as l from (select *, sign(case when abs(u1)>=abs(u2) and abs(u1)>=abs(u3) then u1 when abs(u2)>=abs(u3) then u2 else u3 end) as sg from p1 where k=800) join m3 using (s)),
 m4 as (select s, a11-l*u1*u1 as a11, a12-l*u1*u2 as a12, a13-l*u1*u3 as a13, a22-l*u2*u2 as a22, a23-l*u2*u3 as a23, a33-l*u3*u3 as a33 from m3 join l1 using (s)),
 p2 as (select s, 0 as k, 0.3::double as u1, -1.0::double as u2, 0.6::double as u3 from m4 union all select s, k+1, a/l, b/l, c/l from (select *, sqrt(a*a+b*b+c*c) as l from (select m4.s, k, a11*u1+a12*u2+a13*u3 as a, a12*u1+a22*u2+a23*u3 as b, a13*u1+a23*u2+a33*u3 as c from p2 join m4 using (s) where k<800))),
 l2 as materialized (select s, u1, u2, u3, u1*(a11*u1+a12*u2+a13*u3)+u2*(a12*u1+a22*u2+a23*u3)+u3*(a13*u1+a23*u2+a33*u3) as l from p2 join m4 using (s) where k=800)"""


@query("representation_arms", _FOLDS + _SCALED + _fits("""select 'base' as key, s, t, g, id, y, x1/d1 as z1, 0.0::double as z2, 0.0::double as z3 from cr join f0 on t<=s
  union all select 'screened', s, t, g, id, y, x1/d1, x2/d2, x3/d3 from cr join f0 on t<=s
  union all select 'embedding', cr.s, t, g, id, y, x1/d1, (l1.u1*x2/d2+l1.u2*x3/d3+l1.u3*x1/d1)/sqrt(l1.l), (l2.u1*x2/d2+l2.u2*x3/d3+l2.u3*x1/d1)/sqrt(l2.l) from cr join f0 on t<=cr.s join l1 on l1.s=cr.s join l2 on l2.s=cr.s""") + ' select key as arm, g as "Gender", s as "Season", id as "GameNo", y, round(p,5) as p from scored')
def representation_arms(spark, d):
    """Forecasts of every season on a base alone, with the additional features that pass the screen, and with their two leading
    directions."""
    t = V.walk_forward_arms(_extended(spark, d), ["strength"], EXTRA, "Season", components=2)
    return t.select("arm", "Gender", "Season", "GameNo", "y", F.round("p", 5).alias("p"))


@query("extra_screen", _FOLDS + """ select s as "Season", unnest(['offense','defense','triple']) as feature, unnest([case when abs(r12)>=0.995 then 'redundant_base' else 'retained' end, case when abs(r13)>=0.995 then 'redundant_base' else 'retained' end, 'redundant_base']) as status,
 unnest([round(q2,6), round(q3,6), round(q1,6)]) as association, unnest([round(abs(v2-r12*v1)/sqrt((1-r12*r12)*(1-v1*v1)),6), round(abs(v3-r13*v1)/sqrt((1-r13*r13)*(1-v1*v1)),6), 0.0::double]) as beyond from cr""")
def extra_screen(spark, d):
    """What each fold's screen says of every additional feature, and how much it tells beyond the base."""
    t = V.extra_audit(_extended(spark, d), ["strength"], EXTRA, "Season")
    return t.select("Season", "feature", "status", r6("association").alias("association"), r6("beyond").alias("beyond"))


_POWER = """, it{0} as (select 0 as k, 1.0::double as u1, 0.4::double as u2, -0.3::double as u3 union all select k+1, a/l, b/l, c/l from (select *, sqrt(a*a+b*b+c*c) as l from (select k, a11*u1+a12*u2+a13*u3 as a, a12*u1+a22*u2+a23*u3 as b, a13*u1+a23*u2+a33*u3 as c from it{0}, mm{0} where k<3000))),
 ev{0} as materialized (select sg*u1 as u1, sg*u2 as u2, sg*u3 as u3, u1*(a11*u1+a12*u2+a13*u3)+u2*(a12*u1+a22*u2+a23*u3)+u3*(a13*u1+a23*u2+a33*u3) as l from (select *, sign(case when abs(u1)>=abs(u2) and abs(u1)>=abs(u3) then u1 when abs(u2)>=abs(u3) then u2 else u3 end) as sg from it{0} where k=3000), mm{0})"""


@query("representation", _LATE.replace("with ", "with recursive ", 1) + """, f0 as materialized (select *, coalesce(x1,0) as a, coalesce(x2,0) as b, coalesce(x3,0) as c from mx), mn as (select avg(a) as ma, avg(b) as mb, avg(c) as mc from f0),
 mm1 as materialized (select covar_pop(a,a) as a11, covar_pop(a,b) as a12, covar_pop(a,c) as a13, covar_pop(b,b) as a22, covar_pop(b,c) as a23, covar_pop(c,c) as a33 from f0)""" + _POWER.format(1) + """,
 mm2 as materialized (select a11-l*u1*u1 as a11, a12-l*u1*u2 as a12, a13-l*u1*u3 as a13, a22-l*u2*u2 as a22, a23-l*u2*u3 as a23, a33-l*u3*u3 as a33 from mm1, ev1)""" + _POWER.format(2) + """
 select "Gender", "Season", "GameNo", round((a-ma)*p.u1+(b-mb)*p.u2+(c-mc)*p.u3,5) as pc1, round((a-ma)*q.u1+(b-mb)*q.u2+(c-mc)*q.u3,5) as pc2 from f0, mn, ev1 p, ev2 q""")
def representation(spark, d):
    """Scores of late games on the two leading directions of their features."""
    t = V.principal_components(matrix(spark, d), FEATURES, 2)
    return t.select(*LEAGUE, "GameNo", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


@query("persisted_model", _NEWTON + ' where m."Season"=(select max("Season") from mx)')
def persisted_model(spark, d):
    """The last season, scored by a model that was fitted to the earlier ones, written, verified and read back."""
    import uuid

    from fieldglass.store import shared_folder, stored

    rows = stored(matrix(spark, d), "matrix")
    last = rows.agg(F.max("Season")).first()[0]
    fits = M.fitted_paths(rows, FEATURES, "Season", "y", 0.1, last, [128])[1] if last is not None else []
    if not fits:  # no season has an earlier one
        return rows.limit(0).select("Gender", "Season", "GameNo", "y", F.lit(0.0).alias("p"))
    weights = fits[-1][2]
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    key = P.save_model(spark, P.fitted_model(FEATURES, ["retained" if w else "capacity" for w in weights], weights), path)
    t = P.load_model(spark, path, key).transform(rows.where(F.col("Season") == last))
    return t.select("Gender", "Season", "GameNo", "y", F.round("p", 5).alias("p"))


BLOCKS = {"form": ["strength"], "attack": ["offense"], "guard": ["defense"]}
_ON = {"all": "111", "only_form": "100", "only_attack": "010", "only_guard": "001", "without_form": "011", "without_attack": "101", "without_guard": "110"}


@query("block_ablation", _FOLDS + _fits("select b.block as key, s, t, g, id, y, a1*x1/d1 as z1, a2*x2/d2 as z2, a3*x3/d3 as z3 from cr join f0 on t<=s, (values " + ", ".join(f"('{b}', {', '.join(m)})" for b, m in _ON.items()) + """) b(block, a1, a2, a3)""") + """, b as (select key, s, count(*) as n, avg(pow(p-y,2)) as b from scored group by all)
 select b.key as block, b.s as "Season", b.n as games, round(b.b,6) as brier, round(b.b-a.b,6) as change from b join b a on a.s=b.s and a.key='all'""")
def block_ablation(spark, d):
    """Every season's Brier score with all features, each block alone and each block left out, and what that changes."""
    t = E.game_metrics(M.walk_forward_blocks(matrix(spark, d), M.block_catalogue(BLOCKS), "Season"), ["block", "Season"])
    every = t.where("block = 'all'").select("Season", F.col("brier").alias("_all"))
    return t.join(every, "Season").select("block", "Season", "games", r6("brier").alias("brier"), r6(F.col("brier") - F.col("_all")).alias("change"))


VARIANTS = {"careful": {"rounds": 3, "depth": 2, "rate": 0.2, "l2": 10.0, "least": 25}, "eager": {"rounds": 3, "depth": 2, "rate": 0.6, "l2": 1.0, "least": 25}}


@query("variant_choice", "with " + ", ".join(f"{n} as materialized ({_boosted_sql(**how)})" for n, how in VARIANTS.items()) + ", f as (" + " union all ".join(f"select '{n}' as variant, * from {n}" for n in VARIANTS) + """),
 b as (select variant, "Season", count(*) as games, avg(pow(p-y,2)) as b from f group by all), past as (select o."Season", b.variant, round(avg(b.b),12) as past, count(*) as seen from (select distinct "Season" from b) o join b on b."Season"<o."Season" group by all),
 c as (select *, row_number() over (partition by "Season" order by past, variant) as rn from past)
 select b.variant, b."Season", b.games, round(b.b,6) as brier, round(b.b-a.b,6) as change, coalesce(c.variant=b.variant,false) as chosen, coalesce(seen,0) as history from b join b a on a.variant='careful' and a."Season"=b."Season" left join c on c."Season"=b."Season" and rn=1""")
def variant_choice(spark, d):
    """Boosting variants by season: score, change against the first, and whether earlier seasons choose the variant."""
    from fieldglass.store import stored

    rows = stored(T.walk_forward_variants(matrix(spark, d), FEATURES, "Season", VARIANTS).select("variant", "Season", "y", F.round("p", 6).alias("p")), "scored")
    b = E.game_metrics(rows, ["variant", "Season"])
    first = b.where("variant = 'careful'").select("Season", F.col("brier").alias("_first"))
    chosen = E.forward_choice(rows, "variant").select("Season", F.col("variant").alias("_chosen"), F.col("seasons_seen").alias("_seen"))
    t = b.join(first, "Season").join(chosen, "Season", "left")
    return t.select("variant", "Season", "games", r6("brier").alias("brier"), r6(F.col("brier") - F.col("_first")).alias("change"), F.coalesce(F.col("_chosen") == F.col("variant"), F.lit(False)).alias("chosen"), F.coalesce("_seen", F.lit(0)).alias("history"))


@query(
    "selection_history",
    S + CAND + """, b as (select candidate,"Season",avg(pow(p-y,2)) as brier from cand group by all), past as (select t."Season", b.candidate, round(avg(b.brier),12) as past, count(*) as seen, max(b."Season") as last from (select distinct "Season" from b) t join b on b."Season"<t."Season" group by all),
 o as (select *, row_number() over (partition by "Season" order by past, candidate) as rn from past), c as (select "Season", last+case when "Season"%4=1 then 1 else 0 end as last, seen from o where rn=1)
 select "Season", 'later season' as rule from c where last>="Season" union all select "Season", 'too few seasons' from c where seen<2""",
)
def selection_history(spark, d):
    """Choices by strictly earlier seasons; in every fourth season the record claims one season more on purpose."""
    rows = candidates(spark, d)
    seasons = rows.select(F.col("Season").alias("_s")).distinct()
    last = E.forward_choice(rows).join(seasons, F.col("_s") < F.col("Season")).groupBy("Season", "candidate", "seasons_seen").agg(F.max("_s").alias("last"))
    choices = last.select("Season", "candidate", (F.col("last") + F.when(F.col("Season") % 4 == 1, 1).otherwise(0)).alias("history_last_season"), F.col("seasons_seen").alias("history_seasons"))
    return C.selection_history(choices.withColumn("scope", F.lit("all")), ["scope"]).select("Season", "rule")


@query(
    "evaluation_games",
    _LATE + """, e as (select case when "GameNo"%61=0 then 'X' else "Gender" end as g, "Season" as s, case when "GameNo"%67=0 then 300 else "DayNum" end as d, case when "GameNo"%71=0 then 2 else y end as y,
  case when "GameNo"%73=0 then ("Season"+1) else "Season" end||'_'||case when "GameNo"%79=0 then lpad("Team2ID"::varchar,4,'0')||'_'||lpad("Team1ID"::varchar,4,'0') when "GameNo"%83=0 then "Team1ID"::varchar else lpad("Team1ID"::varchar,4,'0')||'_'||lpad("Team2ID"::varchar,4,'0') end as id from mx),
 m as (select *, regexp_matches(id,'^[0-9]{4}_[0-9]{4}_[0-9]{4}$') as ok from e)
 select rule, count(*) as n from (select 'population' as rule from m where g not in ('M','W') union all select 'season' from m where s not between 1996 and 2001 or s=1998 union all select 'day' from m where d<=300 union all select 'outcome' from m where y not in (0,1) union all select 'id' from m where not ok
  union all select 'season of id' from m where ok and split_part(id,'_',1)<>s::varchar union all select 'order' from m where ok and split_part(id,'_',2)>=split_part(id,'_',3) union all select 'repeated' from (select g, s, id from m group by all having count(*)>1)) group by all""",
)
def evaluation_games(spark, d):
    """Late games with planted faults against the rules of evaluation games."""
    n, four = F.col("GameNo"), lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
    pair = F.when(n % 79 == 0, F.concat_ws("_", four("Team2ID"), four("Team1ID"))).when(n % 83 == 0, F.col("Team1ID").cast("string")).otherwise(F.concat_ws("_", four("Team1ID"), four("Team2ID")))
    g = matrix(spark, d).select(
        F.when(n % 61 == 0, "X").otherwise(F.col("Gender")).alias("Gender"), "Season", F.when(n % 67 == 0, 300).otherwise(F.col("DayNum")).alias("DayNum"),
        F.concat_ws("_", F.col("Season") + F.when(n % 73 == 0, 1).otherwise(0), pair).alias("ID"), F.when(n % 71 == 0, 2).otherwise(F.col("y")).alias("y"),
    )
    return C.evaluation_games(g, 1996, 2001, [1998], 300).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
