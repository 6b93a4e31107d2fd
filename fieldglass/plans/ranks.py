"""Ranking panels: editions as of a cutoff, snapshots, momentum, target encodings, memberships, resumes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.functions.stats import logit, quantile, shrunk_mean
from fieldglass.operators.history import ranking_panel
from fieldglass.operators.joins import as_of, differences, interval_join, overlapping, pair_roles
from fieldglass.operators.windows import average_rank
from fieldglass.plans.teams import KEY, L, QK, SEEDS, long, r6, season_days, seeds
from fieldglass.registry import query
from fieldglass.sources.league import RANKINGS_SQL, rankings
from fieldglass.sources.tables import table

R = f"with {RANKINGS_SQL} "
CUTOFF, STALE = 25, 14


def _panel_sql(cutoff: int, name: str) -> str:
    """Latest editions as of a cutoff with ratings 1 - (rank - 1) / max(highest rank - 1, 1)."""
    return f""", {name} as (select "SystemName","TeamID","RankingDayNum", 1.0-("OrdinalRank"-1)*1.0/greatest(max("OrdinalRank") over
 (partition by "SystemName")-1,1) as rating
 from (select *, max("RankingDayNum") over (partition by "SystemName") as last from rankings where "RankingDayNum" between
 {cutoff - STALE} and {cutoff}) where "RankingDayNum"=last)"""


def panel(spark, d, cutoff: int):
    t = ranking_panel(rankings(spark, d), cutoff, STALE)
    return t.select("SystemName", "TeamID", (cutoff - F.col("age")).cast("int").alias("RankingDayNum"), "rating")


@query("rank_panel_asof", R + _panel_sql(CUTOFF, "p") + ' select "SystemName","TeamID","RankingDayNum", round(rating,6) as rating from p')
def rank_panel_asof(spark, d):
    return panel(spark, d, CUTOFF).select("SystemName", "TeamID", "RankingDayNum", r6("rating").alias("rating"))


@query(
    "rank_snapshot",
    R
    + _panel_sql(CUTOFF, "p")
    + """ select "TeamID", round(median(rating),6) as consensus, round(avg(rating),6) as mean, round(stddev_samp(rating),6) as
 disagreement, count(distinct "SystemName") as systems, round(max(rating),6) as best,
 round(quantile_cont(rating,0.25),6) as q25, round(quantile_cont(rating,0.75),6) as q75, round(avg(case when rating>=0.75 then 1.0 else
 0.0 end),6) as top_fraction, round(ln(least(greatest(median(rating),0.01),0.99)/(1-least(greatest(median(rating),0.01),0.99))),6) as
 log_odds from p group by all""",
)
def rank_snapshot(spark, d):
    mid = quantile("rating", 0.5)
    return panel(spark, d, CUTOFF).groupBy("TeamID").agg(
        r6(mid).alias("consensus"), r6(F.avg("rating")).alias("mean"), r6(F.stddev_samp("rating")).alias("disagreement"), F.countDistinct("SystemName").alias("systems"), r6(F.max("rating")).alias("best"),
        r6(quantile("rating", 0.25)).alias("q25"), r6(quantile("rating", 0.75)).alias("q75"), r6(F.avg(F.when(F.col("rating") >= 0.75, 1.0).otherwise(0.0))).alias("top_fraction"),
        r6(logit(F.least(F.greatest(mid, F.lit(0.01)), F.lit(0.99)))).alias("log_odds"),
    )


@query(
    "rank_momentum",
    R + _panel_sql(CUTOFF, "p") + _panel_sql(CUTOFF - 10, "q") + ' select p."TeamID", count(*) as matched, round(avg(p.rating-q.rating),6) as momentum, round(median(p.rating-q.rating),6) as median_change from p join q using ("SystemName","TeamID") group by all',
)
def rank_momentum(spark, d):
    past = panel(spark, d, CUTOFF - 10).select("SystemName", "TeamID", F.col("rating").alias("past"))
    both = panel(spark, d, CUTOFF).join(past, ["SystemName", "TeamID"]).withColumn("change", F.col("rating") - F.col("past"))
    return both.groupBy("TeamID").agg(F.count(F.lit(1)).alias("matched"), r6(F.avg("change")).alias("momentum"), r6(quantile("change", 0.5)).alias("median_change"))


LAGS = (5, 10, 20)
_SYSTEMS = R + _panel_sql(CUTOFF, "p") + "".join(_panel_sql(CUTOFF - n, f"q{n}") for n in LAGS)


def systems(spark, d):
    """All systems that published up to the cutoff, of all teams with a rating then."""
    from fieldglass.operators.systems import system_features

    vocabulary = rankings(spark, d).where(F.col("RankingDayNum") <= CUTOFF).select("SystemName")
    return system_features(panel(spark, d, CUTOFF), vocabulary, {n: panel(spark, d, CUTOFF - n) for n in LAGS})


@query("system_snapshot", _SYSTEMS + f""", c as (select "TeamID", median(rating) as c from p group by all), v as (select distinct "SystemName" from rankings where "RankingDayNum"<={CUTOFF}),
 j as (select c."TeamID", v."SystemName", p.rating as level, ln(least(greatest(p.rating,0.01),0.99)/(1-least(greatest(p.rating,0.01),0.99))) as lo, c, ln(least(greatest(c,0.01),0.99)/(1-least(greatest(c,0.01),0.99))) as co, """ + ", ".join(f"p.rating-q{n}.rating as change_{n}" for n in LAGS) + """
 from c cross join v left join p on p."TeamID"=c."TeamID" and p."SystemName"=v."SystemName" """ + " ".join(f'left join q{n} on q{n}."TeamID"=c."TeamID" and q{n}."SystemName"=v."SystemName"' for n in LAGS) + """)
 select "TeamID","SystemName", round(level,6) as level, round(lo,6) as logit, round(level-c,6) as deviation, round(lo-co,6) as logit_deviation, (level is not null)::int as available, """ + ", ".join(f"round(change_{n},6) as change_{n}" for n in LAGS) + " from j")
def system_snapshot(spark, d):
    t = systems(spark, d)
    return t.select("TeamID", "SystemName", "available", *[r6(c).alias(c) for c in ("level", "logit", "deviation", "logit_deviation", *[f"change_{n}" for n in LAGS])])


_NAMES = ["click", "error", "purchase", "signup", "view"]  # for the statement, which can't name columns by data


@query("system_pivot", R + _panel_sql(CUTOFF, "p") + ' select "TeamID", ' + ", ".join(f"round(max(rating) filter (where \"SystemName\"='{s}'),6) as rating_{s}, cast(count(*) filter (where \"SystemName\"='{s}') as int) as available_{s}" for s in _NAMES) + " from p group by all")
def system_pivot(spark, d):
    """Ratings and their presence, with columns for every system of the data."""
    from fieldglass.operators.systems import pivoted

    t = systems(spark, d).withColumn("rating", r6("level"))
    return pivoted(t, "rating").join(pivoted(t, "available"), "TeamID")


@query(
    "system_vocabulary",
    R + """ select "SystemName", count(distinct "RankingDayNum") as editions, count(distinct "TeamID") as teams, min("RankingDayNum") as
 first, max("RankingDayNum") as last from rankings group by all""",
)
def system_vocabulary(spark, d):
    return rankings(spark, d).groupBy("SystemName").agg(F.countDistinct("RankingDayNum").alias("editions"), F.countDistinct("TeamID").alias("teams"), F.min("RankingDayNum").alias("first"), F.max("RankingDayNum").alias("last"))


@query(
    "asof_observation",
    """with obs as (select user_id as team, ts, max(value) as value from events where event_type='view' group by all), asked as (select
 event_id, user_id as team, ts from events where event_type='purchase')
 select a.event_id, a.team, o.ts as seen, o.value from asked a asof left join obs o on a.team=o.team and a.ts>=o.ts""",
)
def asof_observation(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value").withColumnRenamed("user_id", "team")
    obs = e.where("event_type = 'view'").groupBy("team", "ts").agg(F.max("value").alias("value"))
    return as_of(e.where("event_type = 'purchase'").select("event_id", "team", "ts"), obs, ["team"], "ts", "ts", ["value"]).select("event_id", "team", "seen", "value")


STINTS = """stints as (select user_id as "TeamID", cast(day(ts) as int) as first, event_type as coach, coalesce(cast(lead(day(ts)) over
 (partition by user_id order by ts, event_id) as int)-1, 30) as last from (select * from events where event_type in ('signup','error')))
, valid as (select * from stints where last>=first)"""


def stints(spark, d):
    """TeamID, first, last, coach: intervals from one event to the day before the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type in ('signup', 'error')")
    rows = e.select(F.col("user_id").alias("TeamID"), F.dayofmonth("ts").alias("first"), F.coalesce(F.lead(F.dayofmonth("ts")).over(w) - 1, F.lit(30)).alias("last"), F.col("event_type").alias("coach"))
    return rows.where("last >= first")


@query(
    "coach_interval_join",
    f"""with {STINTS} select e.event_id, e.user_id as "TeamID", v.coach, v.first, v.last from events e join valid v on
 v."TeamID"=e.user_id and day(e.ts) between v.first and v.last where e.event_type='purchase'""",
)
def coach_interval_join(spark, d):
    points = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("TeamID"), F.dayofmonth("ts").alias("day"))
    return interval_join(points, stints(spark, d), ["TeamID"], "day", "first", "last").select("event_id", "TeamID", "coach", "first", "last")


@query(
    "interval_overlaps",
    f"""with {STINTS}, r as (select *, max(last) over (partition by "TeamID" order by first, last rows between unbounded preceding and 1
 preceding) as reach from (select "TeamID", first, last+1 as last, coach from valid)) select "TeamID", first, last, reach from r where
 reach>=first""",
)
def interval_overlaps(spark, d):
    return overlapping(stints(spark, d).withColumn("last", F.col("last") + 1), ["TeamID"], "first", "last").select("TeamID", "first", "last", "reach")


@query("active_interval", f"with {STINTS} select coach, count(*) as active from valid where first<=20 and last>=20 group by all")
def active_interval(spark, d):
    return stints(spark, d).where("first <= 20 and last >= 20").groupBy("coach").agg(F.count(F.lit(1)).alias("active"))


@query(
    "previous_holder",
    f"""with {STINTS} select "TeamID", arg_max(coach, first*100+last) as coach, max(first) as first from valid where last<20 group by all""",
)
def previous_holder(spark, d):
    return stints(spark, d).where("last < 20").groupBy("TeamID").agg(F.max_by("coach", F.col("first") * 100 + F.col("last")).alias("coach"), F.max("first").alias("first"))


CONF = """, conf as (select cast(s_suppkey as int) as "TeamID", n_name as conf, n_regionkey as region from supplier join nation on
 s_nationkey=n_nationkey)"""


def conferences(spark, d):
    """TeamID, conf, region; the dimension is left to Spark to broadcast by its size."""
    s, n = table(spark, d, "supplier", "s_suppkey", "s_nationkey"), table(spark, d, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("int").alias("TeamID"), F.col("n_name").alias("conf"), F.col("n_regionkey").alias("region"))


@query(
    "conference_peers",
    L
    + CONF
    + f""", t as (select {QK}, round(avg(margin),6) as strength from long group by all), j as (select * from t join conf using
 ("TeamID")), c as (select "Gender","Season",conf, count(*) as n, avg(strength) as mean, median(strength) as mid,
 quantile_cont(strength,0.75) as q75, stddev_samp(strength) as sd from j group by all)
 select j."Gender", j."Season", j."TeamID", j.conf, round(ln(1+n),6) as log_size, round(mean,8) as mean, round(mid,8) as median,
 round(q75,8) as q75, round(sd,6) as sd,
 round((rank() over (partition by j."Gender",j."Season",j.conf order by strength)+(count(*) over (partition by
 j."Gender",j."Season",j.conf,strength)-1)/2.0)/n,6) as pct from j join c on j."Gender"=c."Gender" and j."Season"=c."Season" and
 j.conf=c.conf""",
)
def conference_peers(spark, d):
    t = long(spark, d).groupBy(*KEY).agg(r6(F.avg("margin")).alias("strength")).join(conferences(spark, d).select("TeamID", "conf"), "TeamID")
    g = ["Gender", "Season", "conf"]
    c = t.groupBy(*g).agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("log_size"), F.avg("strength").alias("mean"), quantile("strength", 0.5).alias("median"), quantile("strength", 0.75).alias("q75"), F.stddev_samp("strength").alias("sd"))
    return average_rank(t, "strength", g, "pct").join(c, g).select(*KEY, "conf", *[F.round(x, 8).alias(x) for x in ("mean", "median", "q75")], *[r6(x).alias(x) for x in ("log_size", "sd", "pct")])


@query(
    "nonconference_record",
    L
    + CONF
    + f""", x as (select l.*, a.conf as ca, b.conf as cb from long l left join conf a on a."TeamID"=l."TeamID" left join conf b on
 b."TeamID"=l."OppID")
 select {QK}, count(*) as games, round(sum(win)/(count(*)+20.0),6) as win_shrunk, round(sum(margin)/(count(*)+20.0),6) as margin_shrunk
 from x where ca is not null and cb is not null and ca<>cb and lower(ca) not in ('france','peru') group by all""",
)
def nonconference_record(spark, d):
    c = conferences(spark, d).select("TeamID", "conf")
    rows = long(spark, d).join(c.withColumnRenamed("conf", "ca"), "TeamID", "left").join(c.select(F.col("TeamID").alias("OppID"), F.col("conf").alias("cb")), "OppID", "left")
    rows = rows.where(F.col("ca").isNotNull() & F.col("cb").isNotNull() & (F.col("ca") != F.col("cb")) & ~F.lower("ca").isin("france", "peru"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("games"), r6(shrunk_mean("win", 20.0)).alias("win_shrunk"), r6(shrunk_mean("margin", 20.0)).alias("margin_shrunk"))


#: Prior of the target encoding, years of its half-life and of its history.
PRIOR, HALF_LIFE, HISTORY = 10.0, 3.0, 5


@query(
    "target_encoding",
    L
    + SEEDS
    + f""", cat as (select "Gender","Season","TeamID", least(cast(floor((pos-1)/4)+1 as int),16) as seed from coded), h as (select
 l."Gender", l."Season" as hs, c.seed, cast(sum(win) as double) as w, cast(count(*) as double) as n from long l join cat c on
 c."Gender"=l."Gender" and c."Season"=l."Season" and c."TeamID"=l."TeamID" where "DayNum">300 group by all),
 e as (select c."Gender", c."Season", c."TeamID", c.seed, coalesce(sum(pow(0.5,(c."Season"-1-hs)/{HALF_LIFE})*w),0) as w,
 coalesce(sum(pow(0.5,(c."Season"-1-hs)/{HALF_LIFE})*n),0) as n from cat c left join h on h."Gender"=c."Gender" and h.seed=c.seed and hs
 between c."Season"-{HISTORY} and c."Season"-1 group by all)
 select "Gender","Season","TeamID",seed, round((w+{PRIOR})/(n+{2 * PRIOR}),6) as te_mean,
 round(sqrt(((w+{PRIOR})/(n+{2 * PRIOR}))*(1-(w+{PRIOR})/(n+{2 * PRIOR}))/(n+{2 * PRIOR + 1})),6) as te_sd, round(ln(1+n),6) as support
 from e""",
)
def target_encoding(spark, d):
    """Forward-only encoding of a team's seed by outcomes of earlier seasons, each counted under its own season's seed.

    History is one row per (gender, season, category): the range join over the last five seasons is small.
    """
    cat = seeds(spark, d).select(*KEY, F.least(F.floor((F.col("pos") - 1) / 4) + 1, F.lit(16)).cast("int").alias("seed"))
    late = long(spark, d).where("DayNum > 300").join(cat, KEY)
    h = late.groupBy("Gender", F.col("Season").alias("hs"), "seed").agg(F.sum("win").cast("double").alias("w"), F.count(F.lit(1)).cast("double").alias("n"))
    ask = cat.select("Gender", "Season", "seed").distinct().join(h, ["Gender", "seed"]).where(F.col("hs").between(F.col("Season") - HISTORY, F.col("Season") - 1))
    age = F.pow(F.lit(0.5), (F.col("Season") - 1 - F.col("hs")) / F.lit(HALF_LIFE))
    sums = ask.groupBy("Gender", "Season", "seed").agg(F.sum(age * F.col("w")).alias("w"), F.sum(age * F.col("n")).alias("n"))
    e = cat.join(sums, ["Gender", "Season", "seed"], "left").na.fill(0.0, ["w", "n"])
    m = (F.col("w") + PRIOR) / (F.col("n") + 2 * PRIOR)
    return e.select(*KEY, "seed", r6(m).alias("te_mean"), r6(F.sqrt(m * (1 - m) / (F.col("n") + 2 * PRIOR + 1))).alias("te_sd"), r6(F.log1p("n")).alias("support"))


@query(
    "resume_features",
    L
    + SEEDS
    + f""", s as (select "Gender","Season","TeamID" as "OppID", cast(floor((pos-1)/4)+1 as int) as opp_seed from coded), r as (select
 l.*, case when opp_seed<=4 then 6.0 when opp_seed<=8 then 4.0 else 0.25 end as quality, "DayNum">270 as late, home=-1 as away from long
 l left join s using ("Gender","Season","OppID") where "DayNum"<=300)
 select {QK}, cast(round(sum(quality*win),6) as double) as quality_wins, round((sum(quality*win)+10)/(sum(quality)+20),6) as
 quality_rate, round((coalesce(sum(quality*win) filter (where late),0)+10)/(coalesce(sum(quality) filter (where late),0)+20),6) as
 late_rate, round((coalesce(sum(quality*win) filter (where away),0)+10)/(coalesce(sum(quality) filter (where away),0)+20),6) as
 away_rate from r group by all""",
)
def resume_features(spark, d):
    s = seeds(spark, d).select("Gender", "Season", F.col("TeamID").alias("OppID"), (F.floor((F.col("pos") - 1) / 4) + 1).cast("int").alias("opp_seed"))
    rows = season_days(spark, d).join(s, ["Gender", "Season", "OppID"], "left").withColumn("quality", F.when(F.col("opp_seed") <= 4, 6.0).when(F.col("opp_seed") <= 8, 4.0).otherwise(0.25))
    won = F.col("quality") * F.col("win")

    def rate(where):
        of = lambda x: F.coalesce(F.sum(F.when(where, x)), F.lit(0.0))
        return r6((of(won) + 10) / (of(F.col("quality")) + 20))

    return rows.groupBy(*KEY).agg(r6(F.sum(won)).alias("quality_wins"), rate(F.lit(True)).alias("quality_rate"), rate(F.col("DayNum") > 270).alias("late_rate"), rate(F.col("home") == -1).alias("away_rate"))


TEAMS = f""", t as (select {QK}, avg(margin) as strength, avg("Score") as offense, avg("OppScore") as defense from long where
 "DayNum"<=300 group by all),
 pairs as (select distinct "Gender","Season", least("TeamID","OppID") as "Team1ID", greatest("TeamID","OppID") as "Team2ID" from long
 where "DayNum">300)"""


def matchups(spark, d):
    """Pairs of late games with both teams' regular-season figures."""
    reg = season_days(spark, d).groupBy(*KEY).agg(F.avg("margin").alias("strength"), F.avg("Score").alias("offense"), F.avg("OppScore").alias("defense"))
    pairs = long(spark, d).where("DayNum > 300").select("Gender", "Season", F.least("TeamID", "OppID").alias("Team1ID"), F.greatest("TeamID", "OppID").alias("Team2ID")).distinct()
    return pair_roles(pairs, reg, ["Gender", "Season"])


_ROLES = ' from pairs p left join t a on a."Gender"=p."Gender" and a."Season"=p."Season" and a."TeamID"=p."Team1ID" left join t b on b."Gender"=p."Gender" and b."Season"=p."Season" and b."TeamID"=p."Team2ID"'
_PK = 'p."Gender",p."Season",p."Team1ID",p."Team2ID"'


@query("pair_differences", L + TEAMS + f" select {_PK}, round(a.strength-b.strength,4) as diff_strength, round(a.offense-b.offense,4) as diff_offense, round(a.defense-b.defense,4) as diff_defense" + _ROLES)
def pair_differences(spark, d):
    keep = ["Gender", "Season", "Team1ID", "Team2ID"]
    out = differences(matchups(spark, d), ["strength", "offense", "defense"], keep)
    return out.select(*keep, *[F.round(c, 4).alias(c) for c in out.columns if c not in keep])


@query("antisymmetric_products", L + TEAMS + f" select {_PK}, round(a.offense/1000*(b.defense/1000)-b.offense/1000*(a.defense/1000),4) as matchup" + _ROLES)
def antisymmetric_products(spark, d):
    m = matchups(spark, d)
    x = F.col("a_offense") / 1000 * (F.col("b_defense") / 1000) - F.col("b_offense") / 1000 * (F.col("a_defense") / 1000)
    return m.select("Gender", "Season", "Team1ID", "Team2ID", F.round(x, 4).alias("matchup"))


@query(
    "anti_join_coverage",
    """select cast(s_suppkey as bigint) as s_suppkey from supplier where not exists (select 1 from lineitem where l_suppkey=s_suppkey
 and l_quantity>49 and l_discount>0.09)""",
)
def anti_join_coverage(spark, d):
    dear = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount").where("l_quantity > 49 and l_discount > 0.09")
    return table(spark, d, "supplier", "s_suppkey").join(dear, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti")


@query(
    "semi_join_population",
    """select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey=c_custkey and
 o_orderpriority='1-URGENT')""",
)
def semi_join_population(spark, d):
    urgent = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("source_coverage", L + CONF + """, have as (select distinct "Season","TeamID" from long) select "Season", count(*) as teams,
 count(conf) as known, round(count(conf)*1.0/count(*),6) as fraction from have left join conf on conf."TeamID"=have."TeamID" and
 region<>2 group by all""")
def source_coverage(spark, d):
    have = long(spark, d).select("Season", "TeamID").distinct()
    known = have.join(conferences(spark, d).where("region <> 2"), "TeamID", "left")
    return known.groupBy("Season").agg(F.count(F.lit(1)).alias("teams"), F.count("conf").alias("known"), r6(F.count("conf") * F.lit(1.0) / F.count(F.lit(1))).alias("fraction"))
