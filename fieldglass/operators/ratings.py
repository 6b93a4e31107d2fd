"""Team ratings: ridge regressions on the incidence design, and the Elo fold.

Ridge: Spark sums the games by pair of teams and venue, for all weightings and targets at once, so what reaches the solver
of a league has the size of its distinct pairings, however many games it has. The solver is conjugate gradients on those
sums; no matrix of teams by teams is ever built. Elo is a fold in time order: sorted batches stream through one task a
population, which holds the ratings and a day's games.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.models import NotConverged

HOME = -1


def conjugate_gradients(product, b: np.ndarray, steps: int = 5000, tol: float = 1e-13) -> np.ndarray:
    """x with product(x) = b, for a symmetric positive definite product; an error if that isn't reached.

    Rounding may keep the residual from falling to ``tol`` times b; one that has stopped falling below 1e-9 times b will do."""
    x, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), float(r @ r)
    goal, enough = tol * tol * max(rr, 1e-300), 1e-18 * max(rr, 1e-300)
    for _ in range(steps):
        if rr <= goal:
            return x
        q = product(p)
        a = rr / float(p @ q)
        x, r = x + a * p, r - a * q
        rr, old = float(r @ r), rr
        p = r + (rr / old) * p
    if rr > enough:
        raise NotConverged(f"the residual is {(rr / max(float(b @ b), 1e-300)) ** 0.5:.1e} of the right side after {steps} steps")
    return x


def _solved(sums: DataFrame, keys: list[str], kinds: dict[str, str], schema: str, solve) -> DataFrame:
    def run(key, t):
        import pyarrow as pa

        cols = solve({c: t.column(c).to_numpy() for c in t.column_names if c not in keys})
        n = len(next(iter(cols.values())))
        return pa.table({**{k: pa.array([v.as_py()] * n) for k, v in zip(keys, key, strict=True)}, **cols}).cast(target(t))

    def target(t):
        import pyarrow as pa

        own = {k: t.schema.field(k).type for k in keys}
        rest = [x.split() for x in schema.split(", ")]
        return pa.schema([(k, own[k]) for k in keys] + [(n, {"int": pa.int32(), "double": pa.float64()}[k]) for n, k in rest])

    return sums.groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)


def _kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def ridge_strength(games: DataFrame, keys: list[str], alpha: float = 20.0, weights: dict[str, Column] | None = None) -> DataFrame:
    """(keys, TeamID, a column for each weighting): least squares of margins on winner minus loser plus home, all penalised, no
    intercept. TeamID HOME is the home advantage. Without ``weights`` there is one column, ``strength``."""
    weights = weights or {"strength": F.lit(1.0)}
    h = F.when(F.col("WLoc") == "H", 1.0).when(F.col("WLoc") == "A", -1.0).otherwise(0.0)
    g = games.select(*keys, F.col("WTeamID").alias("w"), F.col("LTeamID").alias("l"), h.alias("h"), (F.col("WScore") - F.col("LScore")).cast("double").alias("m"), *[c.alias(f"q{i}") for i, c in enumerate(weights.values())])
    names, n = list(weights), range(len(weights))
    sums = g.groupBy(*keys, "w", "l", "h").agg(*[F.sum(f"q{i}").alias(f"n{i}") for i in n], *[F.sum(F.col(f"q{i}") * F.col("m")).alias(f"m{i}") for i in n])

    def solve(t):
        ids, at = np.unique(np.r_[t["w"], t["l"]], return_inverse=True)
        w, l, h, k = at[: len(t["w"])], at[len(t["w"]) :], t["h"], len(ids)
        add = lambda v: np.r_[np.bincount(w, v, k) - np.bincount(l, v, k), (h * v).sum()]
        out = {"TeamID": np.r_[ids, HOME].astype(np.int32)}
        for i, name in enumerate(names):
            q = t[f"n{i}"]
            out[name] = conjugate_gradients(lambda b, q=q: add(q * (b[w] - b[l] + h * b[k])) + alpha * b, add(t[f"m{i}"]))
        return out

    return _solved(sums, keys, _kinds(games), "TeamID int, " + ", ".join(f"{x} double" for x in names), solve)


def ridge_residual(games: DataFrame, ratings: DataFrame, keys: list[str], alpha: float = 20.0) -> DataFrame:
    """(keys, equations, worst): how many normal equations there are and their largest gap at the given ratings, summed by Spark
    from the games (not by the solver)."""
    h = F.when(F.col("WLoc") == "H", 1.0).when(F.col("WLoc") == "A", -1.0).otherwise(0.0)
    g = games.select(*keys, F.col("WTeamID").alias("w"), F.col("LTeamID").alias("l"), h.alias("h"), (F.col("WScore") - F.col("LScore")).cast("double").alias("m"))
    beta = ratings.select(*keys, F.col("TeamID").alias("t"), F.col("strength").alias("b"))
    side = lambda c: beta.withColumnRenamed("t", c).withColumnRenamed("b", f"b{c}")
    home = beta.where(F.col("t") == HOME).select(*keys, F.col("b").alias("bh"))
    e = g.join(side("w"), [*keys, "w"]).join(side("l"), [*keys, "l"]).join(home, keys).withColumn("e", F.col("bw") - F.col("bl") + F.col("h") * F.col("bh") - F.col("m"))
    parts = F.array(F.struct(F.col("w").alias("t"), F.col("e").alias("v")), F.struct(F.col("l").alias("t"), (-F.col("e")).alias("v")), F.struct(F.lit(HOME).alias("t"), (F.col("h") * F.col("e")).alias("v")))
    sums = e.select(*keys, F.inline(parts)).groupBy(*keys, "t").agg(F.sum("v").alias("v"))
    both = beta.join(sums, [*keys, "t"], "left").withColumn("gap", F.abs(F.coalesce("v", F.lit(0.0)) + alpha * F.col("b")))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("equations"), F.max("gap").alias("worst"))


def offense_defense(rows: DataFrame, keys: list[str], targets: dict[str, tuple[Column, Column]], alpha: float = 20.0) -> DataFrame:
    """(keys, TeamID, and for each target x_offense, x_defense, x_home, x_level): ridge of a target (value, weight) of each team row on its
    offense, the opponent's defense and home; the intercept (level) is free. Defense is signed so that more is better.

    All targets share the design: one aggregate by (team, opponent, home) with a count and a sum for each."""
    names = list(targets)
    r = rows.select(*keys, "TeamID", "OppID", "home", *[x for i, (v, q) in enumerate(targets.values()) for x in (v.cast("double").alias(f"v{i}"), q.alias(f"q{i}"))])
    known = lambda i: F.when(F.col(f"v{i}").isNotNull(), F.col(f"q{i}"))
    sums = r.groupBy(*keys, "TeamID", "OppID", "home").agg(*[x for i in range(len(names)) for x in (F.coalesce(F.sum(known(i)), F.lit(0.0)).alias(f"n{i}"), F.coalesce(F.sum(F.col(f"q{i}") * F.col(f"v{i}")), F.lit(0.0)).alias(f"y{i}"))])

    def solve(t):
        ids, at = np.unique(np.r_[t["TeamID"], t["OppID"]], return_inverse=True)
        k, m = len(ids), len(t["TeamID"])
        o, d, h = at[:m], at[m:] + k, t["home"].astype(float)
        penalty = np.r_[np.full(2 * k + 1, alpha), 0.0]

        def add(v):
            return np.r_[np.bincount(o, v, k), np.bincount(d - k, v, k), (h * v).sum(), v.sum()]

        out = {"TeamID": ids.astype(np.int32)}
        for i, name in enumerate(names):
            q = t[f"n{i}"]
            b = conjugate_gradients(lambda b, q=q: add(q * (b[o] + b[d] + h * b[-2] + b[-1])) + penalty * b, add(t[f"y{i}"]))
            out |= {f"{name}_offense": b[:k], f"{name}_defense": -b[k : 2 * k], f"{name}_home": np.full(k, b[-2]), f"{name}_level": np.full(k, b[-1])}
        return out

    cols = ", ".join(f"{n}_{c} double" for n in names for c in ("offense", "defense", "home", "level"))
    return _solved(sums, keys, _kinds(rows), "TeamID int, " + cols, solve)


def residuals(rows: DataFrame, fit: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows with ``residual``: the value less what the fit of ``offense_defense`` says."""
    own = fit.select(*keys, "TeamID", F.col(f"{name}_offense").alias("_o"), F.col(f"{name}_home").alias("_h"), F.col(f"{name}_level").alias("_c"))
    opp = fit.select(*keys, F.col("TeamID").alias("OppID"), F.col(f"{name}_defense").alias("_d"))
    j = rows.join(own, [*keys, "TeamID"]).join(opp, [*keys, "OppID"])
    return j.withColumn("residual", F.col(value) - (F.col("_o") - F.col("_d") + F.col("home") * F.col("_h") + F.col("_c"))).drop("_o", "_h", "_c", "_d")


def residual_form(rows: DataFrame, keys: list[str], weight: Column, prior: float = 5.0) -> DataFrame:
    """(keys, TeamID): spread, lower tail, recent mean (by weight) and shrunk away mean of ``residual``."""
    r, away = F.col("residual"), F.col("home") <= 0
    return rows.groupBy(*keys, "TeamID").agg(
        F.stddev_samp(r).alias("residual_sd"), F.percentile(r, F.lit(0.1)).alias("residual_downside"), (F.sum(weight * r) / F.sum(weight)).alias("recent_residual"),
        (F.coalesce(F.sum(F.when(away, r)), F.lit(0.0)) / (F.count(F.when(away, 1)) + prior)).alias("road_residual"),
    )


class Ratings:
    """Plain and by-margin ratings of one population as two columns of an array, a row a team; a day is taken as whole arrays."""

    START = 1500.0

    def __init__(self, k: float, home: float, carry: float, cap: float):
        self.k, self.home, self.carry, self.cap = k, home, carry, cap
        self.row: dict[int, int] = {}
        self.now = np.zeros((0, 2))  # ratings less START
        self.mark = np.zeros((0, 2))  # as they were before the recent days
        self.played = np.zeros(0, bool)  # this season

    def rows_of(self, teams: np.ndarray) -> np.ndarray:
        every, place = np.unique(teams, return_inverse=True)
        fresh = [t for t in every.tolist() if t not in self.row]
        self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
        grow = lambda x: np.concatenate([x, np.zeros((len(fresh), *x.shape[1:]), x.dtype)])
        self.now, self.mark, self.played = grow(self.now), grow(self.mark), grow(self.played)
        return np.array([self.row[t] for t in every.tolist()], np.int64)[place]

    def play(self, winners: np.ndarray, losers: np.ndarray, margins: np.ndarray, edge: np.ndarray) -> None:
        """Games of one day: all are read from the ratings of before it, then all gains are added up."""
        w, lost = np.split(self.rows_of(np.concatenate([winners, losers])), 2)
        ahead = self.now[w] - self.now[lost] + self.home * edge[:, None]
        size = np.column_stack([np.ones(len(w)), np.minimum(np.log1p(margins), self.cap)])
        gain = self.k * size / (1 + 10 ** (ahead / 400))
        np.add.at(self.now, w, gain)
        np.subtract.at(self.now, lost, gain)
        self.played[w] = self.played[lost] = True

    def rest(self, seasons: int) -> None:
        """Between seasons ratings move back to the start, and nobody has played."""
        self.now = self.now * self.carry**seasons
        self.mark, self.played = self.now.copy(), np.zeros_like(self.played)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Teams that played this season, and for each its ratings and their changes since the mark."""
        team = np.fromiter(self.row, np.int64, len(self.row))[self.played]
        return team, np.hstack([self.START + self.now, self.now - self.mark])[self.played]


def elo(games: DataFrame, key: str = "Gender", cutoff: int = 132, k: float = 20.0, home: float = 60.0, carry: float = 0.65, cap: float = 3.0, recent: int = 30) -> DataFrame:
    """(key, Season, TeamID, elo, elo_mov, elo_change, elo_mov_change) at the cutoff of each season; changes are since
    ``recent`` days before it. Days of a population stream in order through one task, which holds its ratings and a day."""
    edge = F.when(F.col("WLoc") == "H", 1.0).when(F.col("WLoc") == "A", -1.0).otherwise(0.0)
    cols = [key, "Season", "DayNum", "WTeamID", "LTeamID", "margin", "edge"]
    out = [key, "Season", "TeamID", "elo", "elo_mov", "elo_change", "elo_mov_change"]

    def days(batches):
        """((population, season, day), winners, losers, margins, edges) of each day of the sorted batches."""
        at, held = None, []
        for b in batches:
            names = b.column(0).to_pylist()
            number = np.column_stack([b.column(i).to_numpy() for i in (1, 2)])
            cut = [i for i in range(b.num_rows) if i == 0 or names[i] != names[i - 1] or (number[i] != number[i - 1]).any()]
            values = [b.column(i).to_numpy() for i in range(3, 7)]
            for lo, hi in zip(cut, [*cut[1:], b.num_rows], strict=True):
                day = (names[lo], *number[lo].tolist())
                if day != at and held:
                    yield at, *map(np.concatenate, zip(*held, strict=True))
                    held = []
                at = day
                held.append([v[lo:hi] for v in values])
        if held:
            yield at, *map(np.concatenate, zip(*held, strict=True))

    def run(batches):
        import pyarrow as pa

        def season_end(name, season, ratings):
            team, values = ratings.table()
            fixed = [pa.array([name] * len(team), pa.string()), pa.array(np.full(len(team), season), pa.int32()), pa.array(team, pa.int32())]
            return pa.RecordBatch.from_arrays([*fixed, *(pa.array(c) for c in values.T)], out)

        last, ratings = None, None
        for (name, season, day), *arrays in days(batches):
            if last is not None and (name, season) != last:
                yield season_end(*last, ratings)
            if last is None or name != last[0]:
                ratings = Ratings(k, home, carry, cap)
            elif season != last[1]:
                ratings.rest(season - last[1])
            last = (name, season)
            ratings.play(*arrays)
            if day <= cutoff - recent:
                ratings.mark = ratings.now.copy()
        if last is not None:
            yield season_end(*last, ratings)

    rows = games.where(F.col("DayNum") <= cutoff).select(key, "Season", "DayNum", "WTeamID", "LTeamID", (F.col("WScore") - F.col("LScore")).cast("double").alias("margin"), edge.alias("edge"))
    seq = rows.repartition(key).sortWithinPartitions(*cols)
    return seq.mapInArrow(run, f"{key} string, Season int, TeamID int, elo double, elo_mov double, elo_change double, elo_mov_change double")
