"""Feature matrices: registry, informative columns, wide pivots, interactions, lookups, routes, prequential calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions.stats import ratio, temperature
from fieldglass.operators import evaluate as E
from fieldglass.operators import ratings as R
from fieldglass.plans.forecasts import CAND, S, candidates
from fieldglass.plans.models import _BY, _SPLIT, _sides_sql, jacobi
from fieldglass.plans.ranks import CONF, CUTOFF, STALE, TEAMS, _panel_sql, conferences, matchups, panel
from fieldglass.plans.teams import CONTEXTS, KEY, L, QK, SEEDS, SIGNALS, _UNPIVOT, long, possessions, r6, seeds, signal_rows
from fieldglass.registry import query
from fieldglass.sources.league import RANKINGS_SQL, games, streams

STATS = ["mean", "sd", "low", "high"]


def registry_rows() -> list[tuple[str, str, str, str]]:
    """(name, signal, context, policy) of every value column of ``candidate_matrix``."""
    return [(f"{s}__{c}__{a}", s, c, "null if no game is in the context") for s in SIGNALS[:3] for c in CONTEXTS for a in ("mean", "high")]


@query(
    "feature_registry",
    L + f""", u as ({_UNPIVOT}), n as (select signal as s, context as c, count(distinct ({QK})) filter (where value is not null) as teams from u group by all)
 select e.s||'__'||e.c||'__'||a as feature, e.s as signal, e.c as context, 'null if no game is in the context' as policy, coalesce(teams,0) as teams from (select unnest({SIGNALS[:3]}) as s, c from (select unnest({list(CONTEXTS)}) as c)) e, (select unnest(['mean','high']) as a) left join n on n.s=e.s and n.c=e.c""",
)
def feature_registry(spark, d):
    """The columns of the candidate matrix, and how many teams have a value in each."""
    names = spark.createDataFrame(registry_rows(), "feature string, signal string, context string, policy string")
    rows = signal_rows(long(spark, d, "FGM"), SIGNALS[:3], CONTEXTS).where("value is not null").select(*KEY, "signal", "context").distinct()
    n = rows.groupBy("signal", "context").agg(F.count(F.lit(1)).alias("teams"))
    return names.join(n, ["signal", "context"], "left").select("feature", "signal", "context", "policy", F.coalesce("teams", F.lit(0)).alias("teams"))


@query("candidate_matrix", L + f""", u as ({_UNPIVOT}) select {QK}, """ + ", ".join(f"round({fn}(value) filter (where context='{c}' and signal='{s}'),6) as \"{s}__{c}__{a}\"" for s in SIGNALS[:3] for c in CONTEXTS for a, fn in (("mean", "avg"), ("high", "max"))) + " from u group by all")
def candidate_matrix(spark, d):
    """The long bank pivoted late, over a stated list of names: one shuffle for all columns."""
    rows = signal_rows(long(spark, d, "FGM"), SIGNALS[:3], CONTEXTS)
    names = [f"{s}__{c}" for s in SIGNALS[:3] for c in CONTEXTS]
    wide = rows.withColumn("name", F.concat_ws("__", "signal", "context")).groupBy(*KEY).pivot("name", names).agg(r6(F.avg("value")).alias("mean"), r6(F.max("value")).alias("high"))
    return wide.select(*KEY, *[F.col(f"{n}_{a}").alias(f"{n}__{a}") for n in names for a in ("mean", "high")])


@query("informative_columns", L + " select * from (" + " union all ".join(f"select '{c}' as \"column\", count(\"{c}\") as known, count(*) filter (where \"{c}\"<>0) as nonzero, coalesce(count(*) filter (where \"{c}\"<>0)>0, false) as informative from long" for c in ("margin", "Stl", "home", "NumOT")) + ")")
def informative_columns(spark, d):
    """Columns with any value and any non-zero one: one aggregate over all."""
    cols = ["margin", "Stl", "home", "NumOT"]
    t = long(spark, d, "Stl").agg(*[F.count(c).alias(f"k_{c}") for c in cols], *[F.count(F.when(F.col(c) != 0, 1)).alias(f"z_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k_{c}").alias("known"), F.col(f"z_{c}").alias("nonzero"), (F.col(f"z_{c}") > 0).alias("informative")) for c in cols])
    return t.select(F.inline(rows))


@query(
    "route_counts",
    L + SEEDS + """, s as (select "Gender","Season","TeamID",pos from coded where pos<=16), p as (select distinct "Gender","Season",
 least("TeamID","OppID") as a, greatest("TeamID","OppID") as b from long), j as (select p."Gender", case when x.pos is null or y.pos is
 null then 'seed_free' else 'seeded' end as route, x.pos-y.pos as diff from p left join s x on x."Gender"=p."Gender" and
 x."Season"=p."Season" and x."TeamID"=p.a left join s y on y."Gender"=p."Gender" and y."Season"=p."Season" and y."TeamID"=p.b)
 select "Gender", route, count(*) as n, round(avg(diff),6) as mean_diff from j group by all""",
)
def route_counts(spark, d):
    """Matchups by whether both teams have a seed."""
    s = seeds(spark, d).where("pos <= 16").select(*KEY, "pos")
    pairs = long(spark, d).select("Gender", "Season", F.least("TeamID", "OppID").alias("a"), F.greatest("TeamID", "OppID").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(s.withColumnRenamed("TeamID", side).withColumnRenamed("pos", f"seed_{side}"), ["Gender", "Season", side], "left")
    diff = F.col("seed_a") - F.col("seed_b")
    return pairs.withColumn("route", F.when(diff.isNull(), "seed_free").otherwise("seeded")).groupBy("Gender", "route").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(diff)).alias("mean_diff"))


_INTER = """, rg as (select *, (("FGA"-"OR"+"TO"+0.475*"FTA")+("opp_FGA"-"opp_OR"+"opp_TO"+0.475*"opp_FTA"))/2 as poss from long where
 "DayNum"<=300),
 lg as (select "Gender","Season", (sum("FGM3")+0.5::double)/(sum("FGA3")+1) as prior from rg group by all),
 tm as (select "Gender","Season","TeamID", avg(margin) as strength, avg((poss*40/(40+5*"NumOT"))::double) as tempo, sum("FGM3")::double
 as m3, sum("FGA3")::double as a3, sum("opp_FGM3")::double as om3, sum("opp_FGA3")::double as oa3,
 3.0::double*sum("FGM3")/nullif(sum("Score"),0) as dep,
  avg((100*"Score"/poss)::double) as o, avg((100*"OppScore"/poss)::double) as q, avg((100*"Score"/poss)::double) filter (where
 "DayNum">270) as ro, avg((100*"OppScore"/poss)::double) filter (where "DayNum">270) as rq from rg group by all),
 st as (select tm.*, (m3+100*prior)/(a3+100) as post, (om3+100*prior)/(oa3+100) as opost,
 ((m3+100*prior)/(a3+100))*(1-(m3+100*prior)/(a3+100))/(a3+101) as u2 from tm join lg using ("Gender","Season"))"""
_SIX = """round((a.strength-b.strength)*(a.tempo+b.tempo)/140,2) as pace_strength, round((a.strength-b.strength)*sqrt(a.u2+b.u2),3) as
 uncertainty_strength, round((a.strength-b.strength)*(a.dep+b.dep),3) as three_variance_strength,
 round(a.post*b.opost-b.post*a.opost,6) as shooting_style, round((a.o*b.q-b.o*a.q)/1000000,3) as offense_defense,
 round((a.ro*b.rq-b.ro*a.rq)/1000000,3) as recent_offense_defense"""


@query("interactions", L + _INTER + ', p as (select distinct "Gender","Season", least("TeamID","OppID") as "Team1ID", greatest("TeamID","OppID") as "Team2ID" from long where "DayNum">300) select p.*, ' + _SIX + ' from p join st a on a."Gender"=p."Gender" and a."Season"=p."Season" and a."TeamID"=p."Team1ID" join st b on b."Gender"=p."Gender" and b."Season"=p."Season" and b."TeamID"=p."Team2ID"')
def interactions(spark, d):
    """The six products of both teams' figures: pace, uncertainty and three-point dependence of a strength gap, style, attack
    against defense over the season and lately. Swapping the teams negates each."""
    from fieldglass.operators.joins import antisymmetric, pair_roles

    rows = possessions(long(spark, d, "FGA", "OR", "TO", "FTA", "FGM3", "FGA3").where("DayNum <= 300"))
    c, league = F.col, ["Gender", "Season"]
    eff = lambda x: (100 * c(x) / c("poss")).cast("double")
    late = lambda x: F.avg(F.when(c("DayNum") > 270, eff(x)))
    total = lambda x: F.sum(x).cast("double")
    t = rows.groupBy(*KEY).agg(
        F.avg("margin").alias("strength"), F.avg(c("tempo").cast("double")).alias("tempo"), total("FGM3").alias("m3"), total("FGA3").alias("a3"), total("opp_FGM3").alias("om3"), total("opp_FGA3").alias("oa3"),
        (3.0 * total("FGM3") / F.nullif(total("Score"), F.lit(0.0))).alias("dep"), F.avg(eff("Score")).alias("o"), F.avg(eff("OppScore")).alias("q"), late("Score").alias("ro"), late("OppScore").alias("rq"),
    )
    prior = t.groupBy(*league).agg(((F.sum("m3") + 0.5) / (F.sum("a3") + 1)).alias("prior"))
    post = lambda m, a: (c(m) + 100 * c("prior")) / (c(a) + 100)
    t = t.join(prior, league).withColumns({"post": post("m3", "a3"), "opost": post("om3", "oa3"), "u2": post("m3", "a3") * (1 - post("m3", "a3")) / (c("a3") + 101)})
    pairs = long(spark, d).where("DayNum > 300").select(*league, F.least("TeamID", "OppID").alias("Team1ID"), F.greatest("TeamID", "OppID").alias("Team2ID")).distinct()
    r = pair_roles(pairs, t, league).where("a_strength is not null and b_strength is not null")
    gap, both = c("a_strength") - c("b_strength"), lambda x: c(f"a_{x}") + c(f"b_{x}")
    return r.select(
        *league, "Team1ID", "Team2ID", F.round(gap * both("tempo") / 140, 2).alias("pace_strength"), F.round(gap * F.sqrt(both("u2")), 3).alias("uncertainty_strength"), F.round(gap * both("dep"), 3).alias("three_variance_strength"),
        r6(antisymmetric("post", "opost")).alias("shooting_style"), F.round(antisymmetric("o", "q") / 1000000, 3).alias("offense_defense"), F.round(antisymmetric("ro", "rq") / 1000000, 3).alias("recent_offense_defense"),
    )


@query("known_default_lookup", L + CONF + """, wins as (select "TeamID", "Season"+1 as "Season", count(*) as w from long where win=1 group by all), t as (select distinct "Season","TeamID" from long)
 select t."Season", t."TeamID", case when conf.conf is not null and region<>3 then coalesce(w,0) end as wins from t left join conf using ("TeamID") left join wins using ("TeamID","Season")""")
def known_default_lookup(spark, d):
    """Wins of the season before: 0 for a known key without history, null for an unknown key."""
    rows = long(spark, d)
    wins = rows.where("win = 1").groupBy("TeamID", (F.col("Season") + 1).alias("Season")).agg(F.count(F.lit(1)).alias("w"))
    t = rows.select("Season", "TeamID").distinct().join(conferences(spark, d), "TeamID", "left").join(wins, ["TeamID", "Season"], "left")
    return t.select("Season", "TeamID", F.when(F.col("conf").isNotNull() & (F.col("region") != 3), F.coalesce("w", F.lit(0))).alias("wins"))


@query("system_differences", f"with {RANKINGS_SQL}" + _panel_sql(CUTOFF, "p") + """, pairs as (select distinct r."TeamID" as a, r."TeamID"+1 as b from rankings r), v as (select distinct "SystemName" as system from p)
 select a, b, system, round(x.rating-y.rating,6) as difference, x.rating is not null as has_a, y.rating is not null as has_b from pairs cross join v left join p x on x."TeamID"=a and x."SystemName"=system left join p y on y."TeamID"=b and y."SystemName"=system""")
def system_differences(spark, d):
    """Every system's ratings of both sides; absent stays null and is flagged."""
    from fieldglass.sources.league import rankings

    p = panel(spark, d, CUTOFF).select("TeamID", F.col("SystemName").alias("system"), "rating")
    pairs = rankings(spark, d).select(F.col("TeamID").alias("a"), (F.col("TeamID") + 1).alias("b")).distinct().crossJoin(p.select("system").distinct())  # systems are few
    j = pairs.join(p.select(F.col("TeamID").alias("a"), "system", F.col("rating").alias("x")), ["a", "system"], "left").join(p.select(F.col("TeamID").alias("b"), "system", F.col("rating").alias("y")), ["b", "system"], "left")
    return j.select("a", "b", "system", r6(F.col("x") - F.col("y")).alias("difference"), F.col("x").isNotNull().alias("has_a"), F.col("y").isNotNull().alias("has_b"))


@query(
    "system_coverage",
    f"""with {RANKINGS_SQL}, w as (select * from rankings where "RankingDayNum" between {CUTOFF - STALE} and {CUTOFF}) select
 "SystemName", count(*) as published, count(distinct "TeamID") as teams, round(count(distinct "TeamID")*1.0/(select count(distinct
 "TeamID") from w),6) as coverage from w group by all""",
)
def system_coverage(spark, d):
    from fieldglass.sources.league import rankings

    w = rankings(spark, d).where(F.col("RankingDayNum").between(CUTOFF - STALE, CUTOFF))
    total = w.agg(F.countDistinct("TeamID").alias("all"))  # one row
    t = w.groupBy("SystemName").agg(F.count(F.lit(1)).alias("published"), F.countDistinct("TeamID").alias("teams"))
    return t.crossJoin(F.broadcast(total)).select("SystemName", "published", "teams", r6(F.col("teams") * F.lit(1.0) / F.col("all")).alias("coverage"))


_GRID = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


def _preq(rows: str, key: str) -> str:
    """SQL tables l (losses), n (a season's best earlier temperature and how it did) and c (the choice), by ``key``."""
    k = f'partition by {key}'
    return f"""l as (select {key},"Season",t, avg(pow(1/(1+exp(-ln(p/(1-p))/t))-y,2)) as loss from {rows}, (values
 {", ".join(f"({t}::double)" for t in _GRID)}) v(t) group by all),
 h as (select *, round(avg(loss) over (partition by {key},t order by "Season" rows between unbounded preceding and 1 preceding),12) as
 past, count(*) over (partition by {key},t order by "Season" rows between unbounded preceding and 1 preceding) as seen from l),
 n as (select *, max(case when t=1.0 then loss end) over (partition by {key},"Season") as ident, row_number() over (partition by
 {key},"Season" order by past, t) as rn from h),
 c as (select {key},"Season", t, seen, ident, loss as fitted, round(avg(case when seen>0 then loss end) over ({k} order by "Season" rows
 between unbounded preceding and 1 preceding),12)<round(avg(case when seen>0 then ident end) over ({k} order by "Season" rows between
 unbounded preceding and 1 preceding),12) as use from n where rn=1)"""


_CHOSEN = """case when use then 'temperature' else 'identity' end as method, case when use then t else 1.0::double end as temperature,
 round(ident,6) as identity, round(case when use then fitted else ident end,6) as brier"""


@query("prequential_calibration", S + ", " + _preq("stream", "stream") + f' select stream,"Season", {_CHOSEN} from c where seen>=2')
def prequential_calibration(spark, d):
    """For each season whether earlier seasons speak for a temperature, which, and how it did."""
    t = E.prequential(E.season_losses(streams(spark, d), ["stream"], _GRID), ["stream"])
    return t.select("stream", "Season", "method", "temperature", r6("identity").alias("identity"), r6("brier").alias("brier"))


@query(
    "outer_evaluation",
    S + CAND + ", " + _preq("cand", "candidate") + f""", b as (select candidate,"Season",avg(pow(p-y,2)) as brier from cand group by
 all), past as (select t."Season", b.candidate, round(avg(b.brier),12) as past, count(*) as before from (select distinct "Season" from
 b) t join b on b."Season"<t."Season" group by all),
 o as (select *, row_number() over (partition by "Season" order by past, candidate) as pick from past) select o."Season", o.candidate,
 {_CHOSEN} from o join c on c."Season"=o."Season" and c.candidate=o.candidate where pick=1 and before>=3""",
)
def outer_evaluation(spark, d):
    """Seasons with three or more before them, each with the candidate and the calibration that earlier seasons choose."""
    rows = candidates(spark, d)
    chosen = E.forward_choice(rows).where("seasons_seen >= 3").select("Season", "candidate")
    t = E.prequential(E.season_losses(rows, ["candidate"], _GRID), ["candidate"]).join(chosen, ["Season", "candidate"])
    return t.select("Season", "candidate", "method", "temperature", r6("identity").alias("identity"), r6("brier").alias("brier"))


@query(
    "metric_reaudit",
    S + """, r as (select stream,"Season", avg(pow(p-y,2)) as brier, count(*) as n from stream group by all)
 select stream, "Season", n as games, round(brier,9) as again, "Season"%4=1 as off from r""",
)
def metric_reaudit(spark, d):
    """Recorded season scores against a recomputation from the forecasts at 1e-12; those of every fourth season are spoilt."""
    rows = streams(spark, d)
    recorded = E.game_metrics(rows, ["stream", "Season"]).select("stream", "Season", (F.col("brier") + F.when(F.col("Season") % 4 == 1, 1e-9).otherwise(0.0)).alias("recorded"))
    e = F.pow(F.col("p") - F.col("y"), F.lit(2.0))
    again = rows.groupBy("stream", "Season").agg(F.count(F.lit(1)).alias("games"), (F.sum(e) / F.count(F.lit(1))).alias("again"))
    return again.join(recorded, ["stream", "Season"]).select("stream", "Season", "games", F.round("again", 9).alias("again"), (F.abs(F.col("recorded") - F.col("again")) > 1e-12).alias("off"))


_FACTORS = {"efg": (100, '("FGM"+0.5*"FGM3")', '"FGA"'), "tov": (-100, '"TO"', "poss"), "orb": (100, '"OR"', '("OR"+"opp_DR")'), "ftr": (100, '"FTA"', '"FGA"')}
_FOUR = "[" + ", ".join(f"{{'w':'{k}','q':1.0::double,'y':case when \"FGA\">0 and \"OR\"+\"opp_DR\">0 then ({m}*{a}/{b})::double end}}" for k, (m, a, b) in _FACTORS.items()) + "]"


@query("multi_target_ridge", jacobi(_sides_sql(_FOUR), _BY, 250, 0.4, _SPLIT.format(n=250) + """ select "Gender","Season","TeamID", kind
 as target, round(o,3) as offense, round(d,3) as defense from y"""))
def multi_target_ridge(spark, d):
    """Opponent-adjusted rates: four targets of one design, one aggregate."""
    rows = possessions(long(spark, d, "FGM", "FGM3", "FGA", "FTA", "TO", "OR", "DR").where("DayNum <= 300")).where("clean and FGA > 0 and `OR` + opp_DR > 0")
    c = F.col
    values = {"efg": (c("FGM") + F.lit(0.5) * c("FGM3")) / c("FGA"), "tov": -c("TO") / c("poss"), "orb": c("OR") / (c("OR") + c("opp_DR")), "ftr": c("FTA") / c("FGA")}
    fit = R.offense_defense(rows, ["Gender", "Season"], {k: (100 * v.cast("double"), F.lit(1.0)) for k, v in values.items()})
    cells = F.array(*[F.struct(F.lit(k).alias("target"), F.round(f"{k}_offense", 3).alias("offense"), F.round(f"{k}_defense", 3).alias("defense")) for k in values])
    return fit.select(*KEY, F.inline(cells))


@query("residual_form", L + """, t as (select "Gender","Season","TeamID", round(avg(margin),6) as m from long group by all), r as
 (select l."Gender",l."Season",l."TeamID", l."DayNum", l.home, l.margin-(t.m-o.m) as res from long l join t on t."Gender"=l."Gender" and
 t."Season"=l."Season" and t."TeamID"=l."TeamID" join t o on o."Gender"=l."Gender" and o."Season"=l."Season" and o."TeamID"=l."OppID")
 select "Gender","Season","TeamID", round(stddev_samp(res),4) as sd, round(quantile_cont(res,0.1),4) as q10, round(coalesce(sum(res)
 filter (where home=-1),0)/(count(*) filter (where home=-1)+5.0),4) as road from r group by all""")
def residual_form(spark, d):
    from fieldglass.functions.stats import quantile, shrunk_mean

    rows = long(spark, d)
    t = rows.groupBy(*KEY).agg(r6(F.avg("margin")).alias("m"))
    j = rows.join(t, KEY).join(t.select("Gender", "Season", F.col("TeamID").alias("OppID"), F.col("m").alias("o")), ["Gender", "Season", "OppID"])
    res = F.col("margin") - (F.col("m") - F.col("o"))
    return j.withColumn("res", res).groupBy(*KEY).agg(F.round(F.stddev_samp("res"), 4).alias("sd"), F.round(quantile("res", 0.1), 4).alias("q10"), F.round(shrunk_mean("res", 5.0, F.col("home") == -1), 4).alias("road"))
