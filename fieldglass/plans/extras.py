"""Contexts, routes, clocks, dates, choices with ties, numbered and distinct rows, official files there and back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.functions.stats import ratio, shrunk_mean
from fieldglass.operators.bracket import elo_probability
from fieldglass.operators.reshape import canonical
from fieldglass.operators.windows import average_rank
from fieldglass.plans.bank import OFF
from fieldglass.plans.history import SEEDED, on, seeded
from fieldglass.plans.models import _EIGHT, eight
from fieldglass.plans.ranks import CONF, conferences
from fieldglass.plans.teams import G, KEY, L, QK, long, r6
from fieldglass.registry import query
from fieldglass.sources.league import STREAM_SQL, games, streams
from fieldglass.sources.tables import table

LEAGUE = ["Gender", "Season"]

_CTX = f""", rg as (select * from long where "DayNum"<=300), s as (select {QK}, avg(margin) as strength from rg group by all), q as
 (select "Gender","Season", quantile_cont(strength,0.75) as q75 from s group by all),
 x as (select rg.*, s.strength, (s.strength>=q75)::int as elite from rg join s{on("rg", "s", "OppID")} join q on q."Gender"=rg."Gender"
 and q."Season"=rg."Season")"""


@query(
    "context_snapshot",
    L + _CTX + f""" select {QK}, round((sum(win*elite)+2.5::double)/(sum(elite)+5),6) as elite_win_posterior, round(avg(elite),6) as
 elite_fraction, round(coalesce(sum(margin) filter (where elite=1),0)/(sum(elite)+5.0::double),5) as strong_margin,
 count(*) filter (where "DayNum">286) as last14, round(avg(("NumOT">0)::int),6) as overtime_fraction,
 round(1/(1+pow(sum("OppScore")/greatest(sum("Score"),1)::double,11.5)),6) as pythagorean, round(quantile_cont(margin,0.1),5) as lower_tail,
 round(coalesce(sum(margin) filter (where home=0),0)/(count(*) filter (where home=0)+5.0::double),5) as neutral_margin,
 round(coalesce(sum(margin) filter (where home=-1),0)/(count(*) filter (where home=-1)+5.0::double),5) as road_margin,
 round(stddev_samp(strength),5) as schedule_sd, cast(300-max("DayNum") as int) as rest_days,
 round(3.0::double*sum("FGM3")/nullif(sum("Score"),0),8) as three_dependence,
 round(sum("Ast")::double/nullif(sum("FGM"),0),6) as assist_ratio, round(sum("Ast")::double/nullif(sum("TO"),0),6) as assist_turnover,
 round(sum("Blk")::double/nullif(sum("opp_FGA")-sum("opp_FGA3"),0),6) as block_rate from x group by all""",
)
def context_snapshot(spark, d):
    """A team's season in context: elite opponents, late and overtime games, venues, rest, style."""
    rows = long(spark, d, "FGM", "FGM3", "FGA", "FGA3", "Ast", "TO", "Blk").where("DayNum <= 300")
    s = rows.groupBy(*KEY).agg(F.avg("margin").alias("strength"))
    cut = s.groupBy(*LEAGUE).agg(F.percentile("strength", F.lit(0.75)).alias("q75"))
    x = rows.join(s.withColumnRenamed("TeamID", "OppID"), [*LEAGUE, "OppID"]).join(cut, LEAGUE).withColumn("elite", (F.col("strength") >= F.col("q75")).cast("int"))
    t, home = (lambda c: F.sum(c).cast("double")), F.col("home")
    return x.groupBy(*KEY).agg(
        r6((t(F.col("win") * F.col("elite")) + 2.5) / (t("elite") + 5)).alias("elite_win_posterior"), r6(F.avg("elite")).alias("elite_fraction"), F.round(shrunk_mean("margin", 5.0, F.col("elite") == 1), 5).alias("strong_margin"),
        F.count(F.when(F.col("DayNum") > 286, 1)).alias("last14"), r6(F.avg((F.col("NumOT") > 0).cast("int"))).alias("overtime_fraction"), r6(1 / (1 + F.pow(t("OppScore") / F.greatest(t("Score"), F.lit(1.0)), F.lit(11.5)))).alias("pythagorean"),
        F.round(F.percentile("margin", F.lit(0.1)), 5).alias("lower_tail"), F.round(shrunk_mean("margin", 5.0, home == 0), 5).alias("neutral_margin"), F.round(shrunk_mean("margin", 5.0, home == -1), 5).alias("road_margin"),
        F.round(F.stddev_samp("strength"), 5).alias("schedule_sd"), (F.lit(300) - F.max("DayNum")).cast("int").alias("rest_days"), F.round(3.0 * ratio(t("FGM3"), t("Score")), 8).alias("three_dependence"),
        r6(ratio(t("Ast"), t("FGM"))).alias("assist_ratio"), r6(ratio(t("Ast"), t("TO"))).alias("assist_turnover"), r6(ratio(t("Blk"), t("opp_FGA") - t("opp_FGA3"))).alias("block_rate"),
    )


@query(
    "conference_snapshot",
    L + CONF + _CTX + f""", cf as (select "TeamID", conf from conf where lower(conf) not in ('france','peru')), n as (select a.conf,
 x."Gender", x."Season", count(*) as n, sum(win) as w, sum(margin) as m, sum(strength) as o, sum(margin+strength) as j from x join cf a
 on a."TeamID"=x."TeamID" join cf b on b."TeamID"=x."OppID" where a.conf<>b.conf group by all),
 p as (select s.*, conf, (rank() over w+(count(*) over (partition by "Gender","Season",conf,strength)-1)/2.0)/count(*) over (partition
 by "Gender","Season",conf) as pct from (select "Gender","Season","TeamID", round(strength,6) as strength from s) s join cf using
 ("TeamID") window w as (partition by "Gender","Season",conf order by strength)),
 g as (select "Gender","Season",conf, ln(1+count(*)) as teams, avg(strength) as mean, median(strength) as mid,
 quantile_cont(strength,0.75) as upper, stddev_samp(strength) as sd from p group by all)
 select {", ".join(f'p."{k}"' for k in ("Gender", "Season", "TeamID"))}, p.conf, round(teams,6) as teams, round(mean+3e-8,5) as mean,
 round(mid+3e-8,5) as median, round(upper+3e-8,5) as upper, round(sd+3e-8,5) as sd, round(pct,6) as percentile, round(ln(1+coalesce(n,0)),6) as
 support, round((coalesce(w,0)+10.0::double)/(coalesce(n,0)+20),6) as win_posterior,
 round(coalesce(m,0)/(coalesce(n,0)+20.0::double),5) as margin, round(coalesce(o,0)/(coalesce(n,0)+20.0::double),5) as
 opponent_strength, round(coalesce(j,0)/(coalesce(n,0)+20.0::double),5) as adjusted_margin
 from p join g on g."Gender"=p."Gender" and g."Season"=p."Season" and g.conf=p.conf left join n on n."Gender"=p."Gender" and
 n."Season"=p."Season" and n.conf=p.conf""",
)
def conference_snapshot(spark, d):
    """Peers of a team's conference, and the conference's record against others; independents (here two names) have none."""
    c = conferences(spark, d).where(~F.lower("conf").isin("france", "peru")).select("TeamID", "conf")
    rows = long(spark, d).where("DayNum <= 300")
    s = rows.groupBy(*KEY).agg(F.avg("margin").alias("strength"))
    x = rows.join(s.withColumnRenamed("TeamID", "OppID"), [*LEAGUE, "OppID"]).join(c, "TeamID").join(c.select(F.col("TeamID").alias("OppID"), F.col("conf").alias("_o")), "OppID").where("conf <> _o")
    n = x.groupBy(*LEAGUE, "conf").agg(F.count(F.lit(1)).alias("n"), F.sum("win").alias("w"), F.sum("margin").alias("m"), F.sum("strength").alias("o"), F.sum(F.col("margin") + F.col("strength")).alias("j"))
    p = average_rank(s.withColumn("strength", r6("strength")).join(c, "TeamID"), "strength", [*LEAGUE, "conf"], "pct")
    q = F.percentile("strength", F.array(F.lit(0.5), F.lit(0.75)))
    g = p.groupBy(*LEAGUE, "conf").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("teams"), F.avg("strength").alias("mean"), q.alias("q"), F.stddev_samp("strength").alias("sd"))
    z = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    over = lambda k: F.round(z(k) / (z("n") + 20), 5)
    return p.join(g, [*LEAGUE, "conf"]).join(n, [*LEAGUE, "conf"], "left").select(
        *KEY, "conf", r6("teams").alias("teams"), F.round(F.col("mean") + OFF, 5).alias("mean"), F.round(F.col("q")[0] + OFF, 5).alias("median"), F.round(F.col("q")[1] + OFF, 5).alias("upper"), F.round(F.col("sd") + OFF, 5).alias("sd"), r6("pct").alias("percentile"),
        r6(F.log1p(z("n"))).alias("support"), r6((z("w") + 10) / (z("n") + 20)).alias("win_posterior"), over("m").alias("margin"), over("o").alias("opponent_strength"), over("j").alias("adjusted_margin"),
    )


@query(
    "route_predictions",
    L + SEEDED + f""", s as (select {QK}, avg(margin) as strength from long where "DayNum"<=300 and "TeamID"%11<>0 group by all), p as
 (select distinct "Gender","Season", least("TeamID","OppID") as a, greatest("TeamID","OppID") as b from long where "DayNum">300)
 select p."Gender", p."Season", p.a as "Team1ID", p.b as "Team2ID", case when x.seed is not null and y.seed is not null then 'seeded'
 else 'seed_free' end as route,
 round(case when x.seed is not null and y.seed is not null then 1/(1+exp(-0.15*(y.seed-x.seed))) when u.strength is not null and
 v.strength is not null then 1/(1+exp(-(u.strength-v.strength)/10000)) else 0.5 end,6) as p
 from p left join sd x on x."Gender"=p."Gender" and x."Season"=p."Season" and x."TeamID"=p.a left join sd y on y."Gender"=p."Gender" and
 y."Season"=p."Season" and y."TeamID"=p.b left join s u on u."Gender"=p."Gender" and u."Season"=p."Season" and u."TeamID"=p.a left join
 s v on v."Gender"=p."Gender" and v."Season"=p."Season" and v."TeamID"=p.b""",
)
def route_predictions(spark, d):
    """A frozen model a route: by seeds where both teams have one, else by strength, else one half."""
    from fieldglass.operators.joins import pair_roles

    s = long(spark, d).where("DayNum <= 300 and TeamID % 11 <> 0").groupBy(*KEY).agg(F.avg("margin").alias("strength"))
    t = s.join(seeded(spark, d), KEY, "full")
    pairs = long(spark, d).where("DayNum > 300").select(*LEAGUE, F.least("TeamID", "OppID").alias("Team1ID"), F.greatest("TeamID", "OppID").alias("Team2ID")).distinct()
    r = pair_roles(pairs, t, LEAGUE)
    seed, gap = F.col("b_seed") - F.col("a_seed"), F.col("a_strength") - F.col("b_strength")
    p = F.coalesce(1 / (1 + F.exp(-0.15 * seed)), 1 / (1 + F.exp(-gap / 10000)), F.lit(0.5))
    return r.select(*LEAGUE, "Team1ID", "Team2ID", F.when(seed.isNull(), "seed_free").otherwise("seeded").alias("route"), r6(p).alias("p"))


@query(
    "availability_filter",
    """select user_id, count(*) filter (where ts<=timestamp '2024-01-15 00:00:00') as usable, count(*) filter (where ts>timestamp
 '2024-01-15 00:00:00') as excluded_late, max(ts) filter (where ts<=timestamp '2024-01-15 00:00:00') as seen,
 arg_max(value, (ts, event_id)) filter (where ts<=timestamp '2024-01-15 00:00:00') as value from events where event_type='view' group by all""",
)
def availability_filter(spark, d):
    """The latest observation that was available at the cutoff, and how many came too late."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "ts", "value").where("event_type = 'view'")
    ok = F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    last = F.max(F.when(ok, F.struct("ts", "event_id", "value")))
    t = e.groupBy("user_id").agg(F.count(F.when(ok, 1)).alias("usable"), F.count(F.when(~ok, 1)).alias("excluded_late"), last.alias("l"))
    return t.select("user_id", "usable", "excluded_late", F.col("l.ts").alias("seen"), F.col("l.value").alias("value"))


@query(
    "season_dates",
    """with s as (select case when o_orderkey%13=0 then 'not a date' when o_orderkey%17=0 then '2001-02-30' else
 strftime(o_orderdate,'%Y-%m-%d') end as text from orders), p as (select try_cast(text as date) as day from s)
 select cast(year(day) as int) as season, count(*) as n, min(day) as first, max(day) as last from p group by all""",
)
def season_dates(spark, d):
    """Dates read from text: what isn't one becomes null."""
    from fieldglass.operators.reshape import to_date

    n = F.col("o_orderkey")
    text = F.when(n % 13 == 0, "not a date").when(n % 17 == 0, "2001-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = table(spark, d, "orders", "o_orderkey", "o_orderdate").select(to_date(text).alias("day"))
    return day.groupBy(F.year("day").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("ordered_matchups", _EIGHT.split(", b1 as")[0] + ' select x."Gender", x."Season", x.team, y.team as opponent, round(1/(1+pow(10.0,(y.rating-x.rating)/400)),9) as p from b x join b y on x."Gender"=y."Gender" and x."Season"=y."Season" and x.team<>y.team')
def ordered_matchups(spark, d):
    """Every team of a bracket against every other, in both orders."""
    e = eight(spark, d)
    other = e.select(*LEAGUE, F.col("team").alias("opponent"), F.col("rating").alias("_r"))
    return e.join(other, LEAGUE).where("team <> opponent").select(*LEAGUE, "team", "opponent", F.round(elo_probability(F.col("rating"), F.col("_r")), 9).alias("p"))


@query(
    "distinct_finalists",
    """with c as (select c_custkey, c_acctbal, sha256(c_nationkey||'|'||c_mktsegment||'|'||cast(floor(c_acctbal/500) as bigint)) as
 content from customer), f as (select *, row_number() over (partition by content order by c_acctbal desc, c_custkey) as rn from c)
 select cast(row_number() over (order by c_acctbal desc, content)-1 as int) as priority, c_custkey, c_acctbal, content from f where rn=1
 order by c_acctbal desc, content limit 25""",
)
def distinct_finalists(spark, d):
    """The 25 best rows of different content, numbered; of equal contents the best stays."""
    from fieldglass.operators.windows import best_distinct

    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    content = F.sha2(F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500)), 256)
    return best_distinct(c.select("c_custkey", "c_acctbal", content.alias("content")), "content", [F.col("c_acctbal").desc(), F.col("c_custkey")], [F.col("c_acctbal").desc(), F.col("content")], 25, "priority")


@query(
    "numbered_games",
    G + """ select cast(row_number() over (order by
 "Season","DayNum",least("WTeamID","LTeamID"),greatest("WTeamID","LTeamID"),"GameNo")-1 as bigint) as row_ord,
 "Gender","Season","DayNum","GameNo", least("WTeamID","LTeamID") as "Team1ID", greatest("WTeamID","LTeamID") as "Team2ID" from games""",
)
def numbered_games(spark, d):
    from fieldglass.sinks import ordered_rows

    keys = ["Season", "DayNum", "Team1ID", "Team2ID", "GameNo"]
    return ordered_rows(canonical(games(spark, d)).select("Gender", *keys), [F.col(k) for k in keys], "row_ord")


@query(
    "largest_changes",
    G + """, s as (select "Gender","Season","WTeamID" as "TeamID", count(*) as wins from games group by all), c as (select *,
 wins-lag(wins) over (partition by "Gender","TeamID" order by "Season") as change from s) select "Gender","Season","TeamID", change from
 c where change is not null order by abs(change) desc, "Gender","Season","TeamID" limit 10""",
)
def largest_changes(spark, d):
    s = games(spark, d).groupBy("Gender", "Season", F.col("WTeamID").alias("TeamID")).agg(F.count(F.lit(1)).alias("wins"))
    c = s.withColumn("change", F.col("wins") - F.lag("wins").over(Window.partitionBy("Gender", "TeamID").orderBy("Season"))).where("change is not null")
    return c.orderBy(F.abs("change").desc(), "Gender", "Season", "TeamID").limit(10).select("Gender", "Season", "TeamID", "change")


@query(
    "official_games_roundtrip",
    G + """, g as (select distinct on ("Gender","Season","DayNum",least("WTeamID","LTeamID"),greatest("WTeamID","LTeamID")) * from games
 order by "Gender","Season","DayNum",least("WTeamID","LTeamID"),greatest("WTeamID","LTeamID"),"GameNo")
 select "Gender", case when "DayNum"<=300 then 'RegularSeasonCompactResults' else 'NCAATourneyCompactResults' end as stem, count(*) as
 games, cast(sum("WScore") as bigint) as points, cast(sum("WScore"*("DayNum"%7)) as bigint) as checked from g group by all""",
)
def official_games_roundtrip(spark, d):
    """The league's games written as official files, then read back by the catalogue and held to the games' contract."""
    import uuid

    from fieldglass.operators.contracts import game_contract
    from fieldglass.operators.joins import require_empty
    from fieldglass.schema import SCHEMAS
    from fieldglass.sources.official import official_results, write_official
    from fieldglass.store import shared_folder

    pair = [F.least("WTeamID", "LTeamID"), F.greatest("WTeamID", "LTeamID")]
    cols = [c.split()[0] for c in SCHEMAS["RegularSeasonCompactResults"].split(", ")]
    once = games(spark, d).groupBy("Gender", "Season", "DayNum", *[c.alias(f"_{i}") for i, c in enumerate(pair)]).agg(F.min(F.struct("GameNo", *[c for c in cols if c not in ("Season", "DayNum")])).alias("g")).select("Gender", "Season", "DayNum", "g.*")
    folder = f"{shared_folder(spark)}/official-{uuid.uuid4().hex}"
    parts = {"RegularSeasonCompactResults": once.where("DayNum <= 300"), "NCAATourneyCompactResults": once.where("DayNum > 300")}
    for stem, t in parts.items():
        write_official(t, folder, stem)
    out = None
    for stem in parts:
        t = official_results(spark, folder, stem)
        for g in "MW":
            require_empty(game_contract(t.where(F.col("Gender") == g)), f"{g}{stem}")
        t = t.groupBy("Gender", F.lit(stem).alias("stem")).agg(F.count(F.lit(1)).alias("games"), F.sum("WScore").alias("points"), F.sum(F.col("WScore") * (F.col("DayNum") % 7)).alias("checked"))
        out = t if out is None else out.unionByName(t)
    return out


@query(
    "unfitted_league",
    G + """, r as (select "Season","GameNo", least("WTeamID","LTeamID") as "Team1ID", greatest("WTeamID","LTeamID") as "Team2ID" from games),
 u as (select *, 1300+400*(('0x'||substr(sha256('7:'||"Season"||':'||"Team1ID"),1,12))::bigint/281474976710656.0) as r1, 1300+400*(('0x'||substr(sha256('7:'||"Season"||':'||"Team2ID"),1,12))::bigint/281474976710656.0) as r2 from r),
 p as (select *, 1/(1+pow(10.0,(r2-r1)/400)) as p from u)
 select "Season","GameNo","Team1ID","Team2ID", round(r1,6) as rating1, round(r2,6) as rating2, round(p,9) as p, ((('0x'||substr(sha256('7:y:'||"Season"||':'||"GameNo"),1,12))::bigint/281474976710656.0)<p)::int as y from p""",
)
def unfitted_league(spark, d):
    """Every game's forecast from ratings that nothing was fitted for."""
    from fieldglass.sources.synthetic import unfitted_forecasts

    g = canonical(games(spark, d)).select("Season", "GameNo", "Team1ID", "Team2ID")
    return unfitted_forecasts(g).select("Season", "GameNo", "Team1ID", "Team2ID", F.round("rating1", 6).alias("rating1"), F.round("rating2", 6).alias("rating2"), F.round("p", 9).alias("p"), "y")
