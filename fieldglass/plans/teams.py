"""Team rows, summaries, profiles and distributions over the derived league."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions.stats import adjusted_skew, beta_posterior, decay, quantile, ratio, shrunk_mean, weighted_mean
from fieldglass.operators import bank as B
from fieldglass.operators.reshape import canonical, inverted_location, mirrored, parse_matchup_id, split_seed, team_rows, union_all
from fieldglass.operators.windows import average_rank, last_n, run_lengths, z_score
from fieldglass.registry import query
from fieldglass.sources.league import BOX, GAMES_SQL, LONG_SQL, games

G, L = f"with {GAMES_SQL} ", f"with {LONG_SQL} "
KEY = ["Gender", "Season", "TeamID"]
QK = '"Gender", "Season", "TeamID"'


def r6(x):
    return F.round(x, 6)


def long(spark, d, *stats):
    return team_rows(games(spark, d), list(stats))


def season_days(spark, d, *stats):
    """Team rows up to day 300: the regular season."""
    return long(spark, d, *stats).where("DayNum <= 300")


@query("team_long", L + f'select {QK}, "DayNum", "GameNo", "OppID", "Score", "OppScore", margin, win, home, "FGM", "opp_FGM" from long')
def team_long(spark, d):
    return long(spark, d, "FGM").select(*KEY, "DayNum", "GameNo", "OppID", "Score", "OppScore", "margin", "win", "home", "FGM", "opp_FGM")


@query(
    "canonical_games",
    G
    + """select "Gender", "Season", "DayNum", "GameNo", least("WTeamID","LTeamID") as "Team1ID", greatest("WTeamID","LTeamID") as "Team2ID",
  case when "WTeamID"<"LTeamID" then "WScore" else "LScore" end as "Team1Score", case when "WTeamID"<"LTeamID" then "LScore" else
 "WScore" end as "Team2Score",
  case when "WTeamID"<"LTeamID" then "WLoc" when "WLoc"='H' then 'A' when "WLoc"='A' then 'H' else "WLoc" end as "Team1Loc",
  cast("WTeamID"<"LTeamID" as int) as y, (case when "WTeamID"<"LTeamID" then 1 else -1 end)*("WScore"-"LScore") as "Team1Margin",
  "Season"||'_'||least("WTeamID","LTeamID")||'_'||greatest("WTeamID","LTeamID") as "ID" from games""",
)
def canonical_games(spark, d):
    return canonical(games(spark, d))


@query(
    "location_inversion",
    G + """select "WLoc", case "WLoc" when 'H' then 'A' when 'A' then 'H' else "WLoc" end as "LLoc", count(*) as n from games group by all""",
)
def location_inversion(spark, d):
    return games(spark, d).groupBy("WLoc").agg(F.count(F.lit(1)).alias("n")).withColumn("LLoc", inverted_location())


@query(
    "parse_matchup_id",
    G
    + """, ids as (select distinct "Season"||'_'||(least("WTeamID","LTeamID")+case "Gender" when 'W' then 3000 else 1000
 end)||'_'||(greatest("WTeamID","LTeamID")+case "Gender" when 'W' then 3000 else 1000 end) as "ID" from games),
 p as (select "ID", cast(split_part("ID",'_',1) as int) as "Season", cast(split_part("ID",'_',2) as int) as "Team1ID",
 cast(split_part("ID",'_',3) as int) as "Team2ID" from ids)
 select *, case when greatest("Team1ID","Team2ID")<3000 then 'M' when least("Team1ID","Team2ID")>=3000 then 'W' else 'INVALID' end as
 "Gender" from p""",
)
def parse_matchup(spark, d):
    shift = F.when(F.col("Gender") == "W", 3000).otherwise(1000)
    ids = games(spark, d).select(F.concat_ws("_", "Season", F.least("WTeamID", "LTeamID") + shift, F.greatest("WTeamID", "LTeamID") + shift).alias("ID")).distinct()
    return parse_matchup_id(ids)


SEEDS = """, wins as (select "Gender","Season","TeamID", cast(sum(win) as bigint) as w, count(*) as n from long where "DayNum"<=300
 group by all),
 seeds as (select "Gender","Season","TeamID", cast(row_number() over (partition by "Gender","Season" order by w*1.0/n desc, "TeamID") as
 int) as pos from wins),
 coded as (select "Gender","Season","TeamID", pos, substr('WXYZ', cast((pos-1)%4+1 as int), 1)||lpad(cast(cast(floor((pos-1)/4)+1 as
 int) as varchar),2,'0')||case when pos%7=0 then 'a' when pos%7=1 then 'b' else '' end as "Seed" from seeds)
"""


def seeds(spark, d):
    """Gender, Season, TeamID, pos, Seed: a code from the order of win rates within the season."""
    from pyspark.sql import Window

    w = season_days(spark, d).groupBy(*KEY).agg(F.sum("win").alias("w"), F.count(F.lit(1)).alias("n"))
    pos = F.row_number().over(Window.partitionBy("Gender", "Season").orderBy((F.col("w") * F.lit(1.0) / F.col("n")).desc(), "TeamID"))
    at = w.withColumn("pos", pos)
    code = F.concat(F.substring(F.lit("WXYZ"), ((F.col("pos") - 1) % 4 + 1).cast("int"), F.lit(1)), F.lpad((F.floor((F.col("pos") - 1) / 4) + 1).cast("string"), 2, "0"), F.when(F.col("pos") % 7 == 0, "a").when(F.col("pos") % 7 == 1, "b").otherwise(""))
    return at.select(*KEY, "pos", code.alias("Seed"))


@query("seed_parse", L + SEEDS + """select "Gender","Season","TeamID","Seed",
 nullif(regexp_extract("Seed",'^([WXYZ])(\\d{2})([ab]?)$',1),'') as "Region",
 cast(nullif(regexp_extract("Seed",'^([WXYZ])(\\d{2})([ab]?)$',2),'') as int) as "SeedNum",
 nullif(regexp_extract("Seed",'^([WXYZ])(\\d{2})([ab]?)$',3),'') as "PlayIn" from coded""")
def seed_parse(spark, d):
    return split_seed(seeds(spark, d)).select(*KEY, "Seed", "Region", "SeedNum", "PlayIn")


@query(
    "team_summary",
    L + f"""select {QK}, count(*) as games, round(avg(win),6) as win_rate, round(avg(margin),6) as margin_mean,
 round(stddev_samp(margin),6) as margin_sd from long group by all""",
)
def team_summary(spark, d):
    return long(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("games"), r6(F.avg("win")).alias("win_rate"), r6(F.avg("margin")).alias("margin_mean"), r6(F.stddev_samp("margin")).alias("margin_sd"))


@query(
    "schedule_strength",
    L + f', t as (select {QK}, avg(margin) as strength from long group by all) select l."Gender", l."Season", l."TeamID", count(*) as games, round(avg(t.strength),6) as schedule, round(stddev_samp(t.strength),6) as schedule_sd from long l join t on t."Gender"=l."Gender" and t."Season"=l."Season" and t."TeamID"=l."OppID" group by all',
)
def schedule_strength(spark, d):
    rows = long(spark, d)
    t = rows.groupBy(*KEY).agg(F.avg("margin").alias("strength")).withColumnRenamed("TeamID", "OppID")
    return rows.join(t, ["Gender", "Season", "OppID"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("games"), r6(F.avg("strength")).alias("schedule"), r6(F.stddev_samp("strength")).alias("schedule_sd"))


@query(
    "box_rates",
    L
    + f"""select {QK}, round((sum("FGM")+0.5*sum("FGM3"))/nullif(sum("FGA"),0),6) as efg,
 round(sum("TO")/nullif(sum("FGA")-sum("OR")+sum("TO")+0.475*sum("FTA"),0),6) as tov,
 round(sum("OR")/nullif(sum("OR")+sum("opp_DR"),0),6) as orb, round(sum("FTA")/nullif(sum("FGA"),0),6) as ftr,
 round(sum("FGA3")/nullif(sum("FGA"),0),6) as three_rate,
 round((sum("opp_FGM")+0.5*sum("opp_FGM3"))/nullif(sum("opp_FGA"),0),6) as opp_efg from long group by all""",
)
def box_rates(spark, d):
    s = F.sum
    poss = s("FGA") - s("OR") + s("TO") + F.lit(0.475) * s("FTA")
    return long(spark, d, "FGM", "FGM3", "FGA", "FGA3", "FTA", "OR", "DR", "TO").groupBy(*KEY).agg(
        r6(ratio(s("FGM") + F.lit(0.5) * s("FGM3"), s("FGA"))).alias("efg"),
        r6(ratio(s("TO"), poss)).alias("tov"),
        r6(ratio(s("OR"), s("OR") + s("opp_DR"))).alias("orb"),
        r6(ratio(s("FTA"), s("FGA"))).alias("ftr"),
        r6(ratio(s("FGA3"), s("FGA"))).alias("three_rate"),
        r6(ratio(s("opp_FGM") + F.lit(0.5) * s("opp_FGM3"), s("opp_FGA"))).alias("opp_efg"),
    )


#: Attempts that a league prior counts as.
PSEUDO_ATTEMPTS = 100.0


@query(
    "shooting_posterior",
    L
    + f""", t as (select {QK}, cast(sum("FGM3") as double) as made, cast(sum("FGA3") as double) as att from long group by all),
 p as (select "Gender","Season", (sum(made)+0.5)/(sum(att)+1.0) as prior from t group by all)
 select t."Gender", t."Season", t."TeamID", round((made+100*prior)/(att+100),6) as three_mean,
 round(sqrt(((made+100*prior)/(att+100))*(1-(made+100*prior)/(att+100))/(att+101)),6) as three_sd from t join p using ("Gender","Season")""",
)
def shooting_posterior(spark, d):
    t = long(spark, d, "FGM3", "FGA3").groupBy(*KEY).agg(F.sum("FGM3").cast("double").alias("made"), F.sum("FGA3").cast("double").alias("att"))
    prior = t.groupBy("Gender", "Season").agg(((F.sum("made") + 0.5) / (F.sum("att") + 1.0)).alias("prior"))
    mean = (F.col("made") + PSEUDO_ATTEMPTS * F.col("prior")) / (F.col("att") + PSEUDO_ATTEMPTS)
    return t.join(prior, ["Gender", "Season"]).select(*KEY, r6(mean).alias("three_mean"), r6(F.sqrt(mean * (1 - mean) / (F.col("att") + PSEUDO_ATTEMPTS + 1))).alias("three_sd"))


POSS = '(("FGA"-"OR"+"TO"+0.475*"FTA")+("opp_FGA"-"opp_OR"+"opp_TO"+0.475*"opp_FTA"))/2'


def possessions(rows):
    """poss (both sides' mean), gap, tempo, efficiency and clean (sides agree within a tenth) of each team row."""
    side = lambda p: F.col(f"{p}FGA") - F.col(f"{p}OR") + F.col(f"{p}TO") + F.lit(0.475) * F.col(f"{p}FTA")
    out = rows.withColumn("poss", (side("") + side("opp_")) / 2).withColumn("gap", F.abs(side("") - side("opp_")) / F.nullif("poss", F.lit(0.0)))
    return out.withColumn("tempo", F.col("poss") * 40 / (40 + 5 * F.col("NumOT"))).withColumn("efficiency", 100 * F.col("Score") / F.nullif("poss", F.lit(0.0))).withColumn("clean", F.col("gap") <= 0.10)


@query(
    "possession_efficiency",
    L
    + f""", q as (select *, {POSS} as poss, abs(("FGA"-"OR"+"TO"+0.475*"FTA")-("opp_FGA"-"opp_OR"+"opp_TO"+0.475*"opp_FTA")) as raw_gap
 from long)
 select {QK}, round(avg(poss*40/(40+5*"NumOT")),8) as tempo, round(stddev_samp(poss*40/(40+5*"NumOT")),6) as tempo_sd,
 round(avg(100*"Score"/nullif(poss,0)),4) as efficiency,
 round(avg(raw_gap/nullif(poss,0)),6) as gap, round(avg(case when raw_gap/nullif(poss,0)<=0.10 then 1.0 else 0.0 end),6) as
 clean_fraction from q group by all""",
)
def possession_efficiency(spark, d):
    rows = possessions(long(spark, d, "FGA", "OR", "TO", "FTA"))
    return rows.groupBy(*KEY).agg(F.round(F.avg("tempo"), 8).alias("tempo"), r6(F.stddev_samp("tempo")).alias("tempo_sd"), F.round(F.avg("efficiency"), 4).alias("efficiency"), r6(F.avg("gap")).alias("gap"), r6(F.avg(F.when(F.col("clean"), 1.0).otherwise(0.0))).alias("clean_fraction"))


@query(
    "close_game_posterior",
    L + f"""select {QK}, count(*) filter (where abs(margin)<=5000) as close_games, round((coalesce(sum(win) filter (where
 abs(margin)<=5000),0)+2.5)/(count(*) filter (where abs(margin)<=5000)+5.0),6) as close_rate, cast(300-max("DayNum") as int) as
 rest_days from long where "DayNum"<=300 group by all""",
)
def close_game_posterior(spark, d):
    close = F.abs("margin") <= 5000
    n = F.count(F.when(close, 1))
    return season_days(spark, d).groupBy(*KEY).agg(n.alias("close_games"), r6(beta_posterior(F.coalesce(F.sum(F.when(close, F.col("win"))), F.lit(0)), n, 2.5, 2.5)).alias("close_rate"), (F.lit(300) - F.max("DayNum")).cast("int").alias("rest_days"))


@query(
    "context_aggregates",
    L
    + f"""select {QK}, count(*) filter (where "DayNum">286) as last14, round(avg(case when "NumOT">0 then 1.0 else 0.0 end),6) as
 ot_fraction,
 round(quantile_cont(margin,0.1),6) as margin_q10, round(pow(sum("Score"),11.5)/(pow(sum("Score"),11.5)+pow(sum("OppScore"),11.5)),6) as
 pythagorean from long where "DayNum"<=300 group by all""",
)
def context_aggregates(spark, d):
    a, b = F.pow(F.sum("Score"), F.lit(11.5)), F.pow(F.sum("OppScore"), F.lit(11.5))
    return season_days(spark, d).groupBy(*KEY).agg(F.count(F.when(F.col("DayNum") > 286, 1)).alias("last14"), r6(F.avg(F.when(F.col("NumOT") > 0, 1.0).otherwise(0.0))).alias("ot_fraction"), r6(quantile("margin", 0.1)).alias("margin_q10"), r6(a / (a + b)).alias("pythagorean"))


@query(
    "venue_profile",
    L + f"select {QK}, " + ", ".join(f"count(*) filter (where home={v}) as {n}_games, round(coalesce(sum(margin) filter (where home={v}),0)/(count(*) filter (where home={v})+5.0),6) as {n}_margin" for n, v in (("home", 1), ("road", -1), ("neutral", 0))) + " from long group by all",
)
def venue_profile(spark, d):
    aggs = []
    for n, v in (("home", 1), ("road", -1), ("neutral", 0)):
        at = F.col("home") == v
        aggs += [F.count(F.when(at, 1)).alias(f"{n}_games"), r6(shrunk_mean("margin", 5.0, at)).alias(f"{n}_margin")]
    return long(spark, d).groupBy(*KEY).agg(*aggs)


@query(
    "opponent_profile",
    L
    + f""", t as (select {QK}, avg(margin) as strength from long group by all), q as (select "Gender","Season",
 quantile_cont(strength,0.75) as q75, quantile_cont(strength,0.25) as q25 from t group by all)
 select l."Gender", l."Season", l."TeamID", count(*) filter (where t.strength>=q75) as strong_games, round(avg(margin) filter (where
 t.strength>=q75),6) as strong_margin, count(*) filter (where t.strength<=q25) as weak_games, round(avg(margin) filter (where
 t.strength<=q25),6) as weak_margin
 from long l join t on t."Gender"=l."Gender" and t."Season"=l."Season" and t."TeamID"=l."OppID" join q on q."Gender"=l."Gender" and
 q."Season"=l."Season" group by all""",
)
def opponent_profile(spark, d):
    rows = long(spark, d)
    t = rows.groupBy(*KEY).agg(F.avg("margin").alias("strength"))
    q = t.groupBy("Gender", "Season").agg(quantile("strength", 0.75).alias("q75"), quantile("strength", 0.25).alias("q25"))
    known = rows.join(t.withColumnRenamed("TeamID", "OppID"), ["Gender", "Season", "OppID"]).join(q, ["Gender", "Season"])
    strong, weak = F.col("strength") >= F.col("q75"), F.col("strength") <= F.col("q25")
    return known.groupBy(*KEY).agg(F.count(F.when(strong, 1)).alias("strong_games"), r6(F.avg(F.when(strong, F.col("margin")))).alias("strong_margin"), F.count(F.when(weak, 1)).alias("weak_games"), r6(F.avg(F.when(weak, F.col("margin")))).alias("weak_margin"))


SIGNALS = ["margin", "Score", "FGM", "Ast", "Stl"]
CONTEXTS = {"season": "true", "last30days": '"DayNum" > 270', "home": "home = 1", "road": "home = -1"}


def signal_rows(rows, signals, contexts):
    """Long rows (keys, DayNum, context, signal, value): a row for each context that a game is in and each signal."""
    tags = F.filter(F.array(*[F.when(F.expr(cond.replace('"', "`")), F.lit(name)) for name, cond in contexts.items()]), lambda x: x.isNotNull())
    cols = ", ".join(f"'{s}', cast(`{s}` as double)" for s in signals)
    return rows.select(*KEY, "DayNum", F.explode(tags).alias("context"), *signals).select(*KEY, "DayNum", "context", F.expr(f"stack({len(signals)}, {cols}) as (signal, value)"))


_UNPIVOT = " union all ".join(f"select {QK}, \"DayNum\", '{c}' as context, '{s}' as signal, cast(\"{s}\" as double) as value from long where {w}" for c, w in CONTEXTS.items() for s in SIGNALS)


@query(
    "distribution_long",
    L
    + f""", u as ({_UNPIVOT}) select {QK}, context, signal, count(value) as n, round(avg(value),6) as mean, round(median(value),6) as
 median, round(stddev_samp(value),6) as sd, min(value) as low, max(value) as high,
 round(quantile_cont(value,0.1),6) as q10, round(quantile_cont(value,0.25),6) as q25, round(quantile_cont(value,0.75),6) as q75,
 round(quantile_cont(value,0.9),6) as q90,
 round(quantile_cont(value,0.75)-quantile_cont(value,0.25),6) as iqr, case when count(value)>=3 and stddev_samp(value)>0 then
 round(skewness(value),4) end as skew from u group by all""",
)
def distribution_long(spark, d):
    contexts = {c: F.expr(e.replace('"', "`")) for c, e in CONTEXTS.items()}
    finish = lambda stat, v: v if stat in ("count", "min", "max") else B.half_up(v, 1e4 if stat == "skew" else 1e6)
    t = B.described(long(spark, d, "FGM", "Ast", "Stl"), contexts, B.STATS, finish=finish, signals=SIGNALS)
    return t.withColumnsRenamed({"count": "n", "std": "sd", "min": "low", "max": "high"})


@query(
    "trajectory",
    L
    + f""", o as (select *, margin - lag(margin) over (partition by {QK} order by "DayNum", "GameNo") as step from long)
 select {QK}, case when count(*)>=3 and var_pop("DayNum")>0 then round(regr_slope(margin,"DayNum"),6) end as slope,
 round(avg(abs(step)),6) as mean_step,
 round(avg(margin) filter (where "DayNum">240)-avg(margin) filter (where "DayNum"<=240),6) as recent_change from o group by all""",
)
def trajectory(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("DayNum", "GameNo")
    rows = long(spark, d).withColumn("step", F.col("margin") - F.lag("margin").over(w))
    late = F.avg(F.when(F.col("DayNum") > 240, F.col("margin"))) - F.avg(F.when(F.col("DayNum") <= 240, F.col("margin")))
    slope = F.when((F.count(F.lit(1)) >= 3) & (F.var_pop("DayNum") > 0), F.regr_slope(F.col("margin").cast("double"), F.col("DayNum").cast("double")))
    return rows.groupBy(*KEY).agg(r6(slope).alias("slope"), r6(F.avg(F.abs("step"))).alias("mean_step"), r6(late).alias("recent_change"))


@query(
    "peer_profile",
    L
    + f""", t as (select {QK}, round(avg(margin),6) as strength from long group by all), m as (select "Gender","Season", avg(strength)
 as a, stddev_samp(strength) as s, count(*) as n from t group by all)
 select t."Gender", t."Season", t."TeamID", strength, round((strength-a)/nullif(s,0),6) as z, round((rank() over (partition by
 t."Gender",t."Season" order by strength)+(count(*) over (partition by t."Gender",t."Season",strength)-1)/2.0)/n,6) as pct from t join m
 using ("Gender","Season")""",
)
def peer_profile(spark, d):
    t = long(spark, d).groupBy(*KEY).agg(r6(F.avg("margin")).alias("strength"))
    t = average_rank(z_score(t, "strength", ["Gender", "Season"], "z"), "strength", ["Gender", "Season"], "pct")
    return t.select(*KEY, "strength", r6("z").alias("z"), r6("pct").alias("pct"))


@query(
    "last7",
    L + f""", o as (select *, row_number() over (partition by {QK} order by "DayNum" desc, "OppID" desc, "GameNo" desc) as rn from long)
 select {QK}, count(*) as n, round(avg(margin),6) as margin, cast(sum(win) as bigint) as wins from o where rn<=7 group by all""",
)
def last7(spark, d):
    rows = last_n(long(spark, d), KEY, [F.col("DayNum").desc(), F.col("OppID").desc(), F.col("GameNo").desc()], 7)
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("margin")).alias("margin"), F.sum("win").alias("wins"))


@query(
    "decayed_margin",
    L + f"""select {QK}, round(sum(pow(0.5,(300-"DayNum")/30.0)*margin)/sum(pow(0.5,(300-"DayNum")/30.0)),4) as margin from long where
 "DayNum"<=300 group by all""",
)
def decayed_margin(spark, d):
    rows = season_days(spark, d).withColumn("w", decay(F.lit(300) - F.col("DayNum"), 30.0))
    return rows.groupBy(*KEY).agg(F.round(weighted_mean("margin", "w"), 4).alias("margin"))


@query(
    "mirror_augmentation",
    L + """, m as (select "Gender","Season", margin, home, win as y from long union all select "Gender","Season", -margin, -home, 1-win
 from long)
 select "Gender","Season", y, count(*) as n, round(avg(margin),6) as margin, cast(sum(home) as bigint) as home from m group by all""",
)
def mirror_augmentation(spark, d):
    rows = mirrored(long(spark, d).select("Gender", "Season", "margin", "home", F.col("win").alias("y")), ["margin", "home"])
    return rows.groupBy("Gender", "Season", "y").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("margin")).alias("margin"), F.sum("home").alias("home"))


@query("season_overview", G + """select "Gender","Season", count(*) as games, count(distinct "DayNum") as days,
 round(avg("WScore"-"LScore"),6) as margin, round(avg(case when "WLoc"='H' then 1.0 else 0.0 end),6) as home_wins, round(avg(case when
 "NumOT">0 then 1.0 else 0.0 end),6) as overtime from games group by all""")
def season_overview(spark, d):
    f = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return games(spark, d).groupBy("Gender", "Season").agg(F.count(F.lit(1)).alias("games"), F.countDistinct("DayNum").alias("days"), r6(F.avg(F.col("WScore") - F.col("LScore"))).alias("margin"), f(F.col("WLoc") == "H").alias("home_wins"), f(F.col("NumOT") > 0).alias("overtime"))


@query("split_audit", G + """select "Gender", case when "DayNum">300 then 'late' else 'regular' end as part, count(*) as games,
 count(distinct "Season") as seasons, min("Season") as first, max("Season") as last, string_agg(distinct cast("Season" as varchar), ','
 order by cast("Season" as varchar)) as list from games group by all""")
def split_audit(spark, d):
    part = F.when(F.col("DayNum") > 300, "late").otherwise("regular").alias("part")
    return games(spark, d).groupBy("Gender", part).agg(F.count(F.lit(1)).alias("games"), F.countDistinct("Season").alias("seasons"), F.min("Season").alias("first"), F.max("Season").alias("last"), F.concat_ws(",", F.array_sort(F.collect_set(F.col("Season").cast("string")))).alias("list"))


@query(
    "tenure_islands",
    L + """, s as (select distinct "Gender","TeamID","Season" from long), i as (select *, "Season"-row_number() over (partition by
 "Gender","TeamID" order by "Season") as g from s)
 select "Gender","TeamID", min("Season") as first, max("Season") as last, count(*) as length from i group by "Gender","TeamID",g""",
)
def tenure_islands(spark, d):
    return run_lengths(long(spark, d), ["Gender", "TeamID"], "Season").select("Gender", "TeamID", "first", "last", "length")


@query(
    "ragged_union",
    """select cast(s_suppkey as bigint) as id, s_name as name, s_acctbal as balance, cast(null as varchar) as segment from supplier
 union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer""",
)
def ragged_union(spark, d):
    from fieldglass.sources.tables import table

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_all(s, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))


@query(
    "null_preserving_sum",
    L + f"""select {QK}, cast(sum(case when home=1 then "Blk" end) as bigint) as home_blocks from long group by all""",
)
def null_preserving_sum(spark, d):
    return long(spark, d, "Blk").groupBy(*KEY).agg(F.sum(F.when(F.col("home") == 1, F.col("Blk"))).alias("home_blocks"))


@query(
    "game_signals",
    L + f"""select {QK}, "GameNo", round("FGM"*1.0/nullif("FGA",0),6) as fg, round("Ast"*1.0/nullif("TO",0),6) as ast_to,
 round("FTM"*1.0/nullif("FTA",0),6) as ft, round("Stl"*1.0/nullif("opp_TO"-1,0),6) as steal_rate,
 round(("FGM"-"FGM3")*1.0/nullif("FGA"-"FGA3",0),6) as two from long""",
)
def game_signals(spark, d):
    rows = long(spark, d, *BOX)
    f = lambda a, b: r6(ratio(F.col(a) * F.lit(1.0) if isinstance(a, str) else a * F.lit(1.0), b))
    return rows.select(*KEY, "GameNo", f("FGM", "FGA").alias("fg"), f("Ast", "TO").alias("ast_to"), f("FTM", "FTA").alias("ft"), f("Stl", F.col("opp_TO") - 1).alias("steal_rate"), f(F.col("FGM") - F.col("FGM3"), F.col("FGA") - F.col("FGA3")).alias("two"))
