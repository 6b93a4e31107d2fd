"""The candidate bank over the derived league."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from fieldglass.operators import bank as B
from fieldglass.plans.teams import KEY, L, QK, long
from fieldglass.registry import query, statement
from fieldglass.store import stored

CUTOFF = 300
#: Added before rounding, as rates often lie half way between two rounded values.
OFF = 3e-8
#: Team rows of the regular season with the signals; ``s`` is strength by mean margin.
SIG = (
    L
    + ', reg as (select * from long where "DayNum"<=300), sig as (select "Gender","Season","TeamID","OppID","DayNum","GameNo",home, '
    + ", ".join(f"{e} as {n}" for n, e in B.SIGNALS.items())
    + f' from reg), s as (select {QK}, avg(margin) as strength from reg group by all)\n'
)
_ON = ", ".join(B.SIGNALS)


def regular(spark, d):
    """Team rows of the regular season, whose signals the bank makes."""
    return long(spark, d, *B.BOX).where(f"DayNum <= {CUTOFF}")


def strength(rows):
    return rows.groupBy(*KEY).agg(F.avg("margin").alias("strength"))


def _described(contexts: str, stats) -> str:
    sql = {
        "mean": "avg(value)", "median": "median(value)", "std": "stddev_samp(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)",
        "q10": "quantile_cont(value,0.1)", "q25": "quantile_cont(value,0.25)", "q75": "quantile_cont(value,0.75)", "q90": "quantile_cont(value,0.9)",
        "iqr": "quantile_cont(value,0.75)-quantile_cont(value,0.25)", "skew": "case when count(value)>=3 and stddev_samp(value)>0 then skewness(value) end",
    }
    cols = ", ".join(f'{sql[x]} as "{x}"' if x == "count" else f'round({sql[x]}+3e-8,{3 if x == "skew" else 4}) as "{x}"' for x in stats)
    return f", tagged as ({contexts}), u as (select * from (select {QK}, context, {_ON} from tagged) unpivot include nulls (value for signal in ({_ON})))\n select {QK}, context, signal, {cols} from u group by all"


def _rounded(stat, v):
    return v if stat == "count" else B.half_up(v + OFF, 1e3 if stat == "skew" else 1e4)


def _union(**where) -> str:
    return " union all ".join(f"select sig.*, '{n}' as context from sig where {w}" for n, w in where.items())


_LAST7 = f"""select * exclude (rn), 'last7games' as context from (select *, row_number() over (partition by {QK} order by "DayNum" desc,
 "OppID" desc, "GameNo" desc) as rn from sig) where rn<=7"""


@query("bank_windows", SIG + _described(_union(season="true", last30days='"DayNum">270', last60days='"DayNum">240') + " union all " + _LAST7, B.STATS))
def bank_windows(spark, d):
    return B.windows(regular(spark, d), CUTOFF, _rounded)


@query("bank_venues", SIG + _described(_union(home="home=1", road="home=-1", neutral="home=0", nonhome="home<=0"), B.SMALL))
def bank_venues(spark, d):
    return B.venues(regular(spark, d), _rounded)


_MET = """, q as (select "Gender","Season", quantile_cont(strength,0.25) as q25, quantile_cont(strength,0.5) as q50,
 quantile_cont(strength,0.75) as q75 from s group by all),
 met as (select sig.*, s.strength, q25, q50, q75 from sig join s on s."Gender"=sig."Gender" and s."Season"=sig."Season" and
 s."TeamID"=sig."OppID" join q on q."Gender"=sig."Gender" and q."Season"=sig."Season")"""


@query(
    "bank_opponents",
    SIG + _MET + _described(" union all ".join(f"select *, '{n}' as context from met where {w}" for n, w in {"upper_quartile": "strength>=q75", "lower_quartile": "strength<=q25", "above_median": "strength>=q50"}.items()), B.SMALL),
)
def bank_opponents(spark, d):
    rows = stored(regular(spark, d), "games")  # read for strength and for the bank
    return B.opponents(rows, strength(rows), _rounded)


@query(
    "bank_trajectories",
    SIG
    + f""", u as (select * from (select {QK}, "DayNum", {_ON} from sig) unpivot include nulls (value for signal in ({_ON}))), day as
 (select {QK}, signal, "DayNum", avg(value) as value from u group by all),
 o as (select *, abs(value-lag(value) over (partition by {QK}, signal order by "DayNum")) as step, "DayNum">=avg("DayNum") over
 (partition by {QK}, signal) as late from day)
 select {QK}, signal, round(case when count(value)>=3 and var_pop("DayNum") filter (where value is not null)>0 then
 regr_slope(value,"DayNum") end+3e-8,4) as slope_day,
 round(avg(value) filter (where "DayNum">270)-avg(value) filter (where "DayNum" between 241 and 270)+3e-8,4) as recent_change,
 round(avg(value) filter (where "DayNum">270)-2*avg(value) filter (where "DayNum" between 241 and 270)+avg(value) filter (where
 "DayNum"<=240)+3e-8,4) as acceleration,
 round(avg(step)+3e-8,4) as mean_abs_change, round(stddev_samp(value) filter (where late)+3e-8,4) as late_volatility from o group by all""",
)
def bank_trajectories(spark, d):
    return B.trajectories(regular(spark, d), CUTOFF, _rounded)


def _pct(value: str) -> str:
    w = 'partition by "Gender","Season",signal'
    return f"case when {value} is not null then round((rank() over ({w} order by {value})+(count(*) over ({w},{value})-1)/2.0)/count({value}) over ({w}),6) end"


@query(
    "bank_peers",
    SIG
    + f""", u as (select * from (select {QK}, {_ON} from sig) unpivot include nulls (value for signal in ({_ON}))), l as (select * from
 (select {QK}, {_ON} from ({_LAST7})) unpivot include nulls (value for signal in ({_ON}))),
 a as (select {QK}, signal, round(avg(value),8) as m, round(stddev_samp(value),8) as s from u group by all), b as (select {QK}, signal,
 round(avg(value),8) as r from l group by all),
 j as (select a.*, b.r from a join b using ("Gender","Season","TeamID",signal)), z as (select "Gender","Season",signal, avg(m) as am,
 stddev_samp(m) as sm from j group by all)
 select "Gender","Season","TeamID",signal, {_pct("m")} as percentile, round((m-am)/nullif(sm,0),5) as zscore, {_pct("r")} as
 recent_percentile, {_pct("s")} as consistency_percentile from j join z using ("Gender","Season",signal)""",
)
def bank_peers(spark, d):
    t = B.peers(B.peer_values(regular(spark, d)))
    return t.select(*KEY, "signal", *[F.round(c, 5 if c == "zscore" else 6).alias(c) for c in B.PEER])


#: Decimals to which the values of a column agree across engines.
_DECIMALS = {"skew": 3, "zscore": 5, "percentile": 6, "recent_percentile": 6, "consistency_percentile": 6, "count": 0}
_FAMILIES = {"distribution": ("bank_windows", B.STATS), "venue": ("bank_venues", B.SMALL), "opponent": ("bank_opponents", B.SMALL), "trajectory": ("bank_trajectories", B.TREND), "peer": ("bank_peers", B.PEER)}


def _cells_sql() -> str:
    """All cells (KEY, place, value), rounded, from the families' own statements."""
    places = ", ".join(f"({i}, '{f}', '{c}', '{s}', '{t}')" for i, (_, f, c, s, t) in enumerate(B.registry()))
    parts = []
    for family, (name, stats) in _FAMILIES.items():
        context = "context" if family in ("distribution", "venue", "opponent") else "'season'"
        each = ", ".join(f"{{'stat': '{t}', 'value': cast(\"{t}\" as double)}}" for t in stats)
        parts.append(f"select {QK}, '{family}' as family, context, signal, u.stat as stat, u.value as value from (select {QK}, {context} as context, signal, unnest([{each}]) as u from ({statement(name)}))")
    return f"with places(place, family, context, signal, stat) as (values {places}), long as materialized ({' union all '.join(parts)}), cell as materialized (select {QK}, place, value from long join places using (family, context, signal, stat) where value is not null) "


def _scales():
    """What is added to and what multiplies the value of each place before it is rounded to what engines agree on."""
    places = B.registry()
    return np.array([0.0 if r[1] == "peer" or r[4] == "count" else OFF for r in places]), 10.0 ** np.array([_DECIMALS.get(r[4], 4) for r in places])


def _bank(spark, d, fold, schema):
    rows = stored(regular(spark, d), "games")
    off, scale = _scales()
    return B.bank(rows, strength(rows), CUTOFF, lambda blocks: fold((keys, B.half_up(v + off, scale)) for keys, v in blocks), schema)


def _bounds(blocks):
    """A row a place: teams that have a value, the least and the largest one, over a task's blocks."""
    import pyarrow as pa

    total = None
    for _, v in blocks:
        none = np.isnan(v)
        n, low, high = (~none).sum(axis=0), np.where(none, np.inf, v).min(axis=0), np.where(none, -np.inf, v).max(axis=0)
        total = (total[0] + n, np.minimum(total[1], low), np.maximum(total[2], high)) if total else (n, low, high)
    if total:
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(x[some]) for x in total]], ["place", "teams", "low", "high"])


_MARGIN = next(i for i, r in enumerate(B.registry()) if r[0] == "research_distribution_season_margin_mean")


def _digests(blocks):
    """A row a team: known columns, its mean margin, the digest of every known column's place and value in millionths."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = pa.array([f"{i}:" for i in range(len(B.registry()))])
    for keys, v in blocks:
        known = ~np.isnan(v)
        n = known.sum(axis=1)
        millionths = pa.array(B.half_up(v[known] * 1_000_000, 1.0).astype(np.int64)).cast(pa.string())
        cells = pc.binary_join_element_wise(names.take(pa.array(np.nonzero(known)[1])), millionths, "")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), cells)
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, ",")]
        margin = v[:, _MARGIN]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(margin, mask=np.isnan(margin)), pa.array(digest)], [*KEY, "known", "margin", "digest"])


@query(
    "candidate_registry",
    _cells_sql() + ", n as (select place, count(*) as teams, min(value) as low, max(value) as high from cell group by place) select "
    "'research_'||family||'_'||context||'_'||signal||'_'||stat as name, family, context, signal, stat, coalesce(teams,0) as teams, low, high from places left join n using (place)",
)
def candidate_registry(spark, d):
    """The catalog of the bank's columns, with the teams that have a value in each, and its bounds."""
    names = spark.createDataFrame([(i, *r) for i, r in enumerate(B.registry())], "place int, name string, family string, context string, signal string, stat string")
    n = _bank(spark, d, _bounds, "place int, teams long, low double, high double").groupBy("place").agg(F.sum("teams").alias("teams"), F.min("low").alias("low"), F.max("high").alias("high"))
    return names.join(n, "place", "left").select("name", "family", "context", "signal", "stat", F.coalesce("teams", F.lit(0)).alias("teams"), "low", "high")


@query("candidate_bank", _cells_sql() + f"select {QK}, count(*) as known, max(case when place={B.registry().index(next(r for r in B.registry() if r[0] == 'research_distribution_season_margin_mean'))} then value end) as margin, sha256(string_agg(place||':'||cast(round(value*1000000) as bigint), ',' order by place)) as digest from cell group by all")
def candidate_bank(spark, d):
    """All 2,944 columns of every team laid out, and a digest of every known column's place and rounded value."""
    return _bank(spark, d, _digests, "Gender string, Season int, TeamID int, known long, margin double, digest string")
