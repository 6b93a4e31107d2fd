"""Nested outer evaluation: for every outer season the candidates, temperatures and blend that strictly earlier seasons choose.

One pass over the games sums, by season, the cross products of all streams and the label, and each stream's Brier score and its
slope in the temperature at Chebyshev nodes. Both are analytic in the temperature between the bounds, so their
interpolants stand for the rows: means over the seasons before any season are prefix sums of these small vectors, and
no choice reads the games again. The driver gets a vector a season and context, of a size that games don't change.
"""

from __future__ import annotations

import numpy as np
from numpy.polynomial import chebyshev as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.models import _matrix, simplex_minimum, summed

#: Nodes of the interpolants; between temperatures of 1/2 and 2 their error is under 3**-NODES.
NODES = 32


class Season:
    """Sums of one season: games, mean cross products of the streams and the label, interpolants of loss and slope."""

    def __init__(self, v: np.ndarray, k: int, low: float, high: float):
        self.n, self.low, self.high = int(v[0]), low, high
        cut = 1 + (k + 1) ** 2
        self.cross = v[1:cut].reshape(k + 1, k + 1) / v[0]
        self.loss, self.slope = (v[cut:].reshape(2, k, NODES) / v[0])

    def brier(self, w: np.ndarray) -> float:
        m = self.cross
        return float(w @ m[:-1, :-1] @ w - 2 * w @ m[:-1, -1] + m[-1, -1])


def _nodes(low: float, high: float) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * C.chebpts1(NODES)


def season_sums(games: DataFrame, streams: list[str], label: str, season: str, context: list[str], low: float, high: float) -> dict[tuple, dict[int, Season]]:
    """context -> season -> its sums; one pass."""
    k, t = len(streams), _nodes(low, high)
    cases = sorted((tuple(r) for r in games.select(*context, season).distinct().collect()), key=str)  # contexts times seasons
    number = games.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(cases)], games.select(*context, season).schema.add("_case", "long")) if cases else None
    if number is None:
        return {}
    rows = games.join(F.broadcast(number), [*context, season]).select("_case", *[F.col(c).cast("double").alias(c) for c in (*streams, label)])

    def parts(b):
        x, case = _matrix(b, [*streams, label]), b.column("_case").to_numpy()
        for c in np.unique(case):
            own = x[case == c]
            p, y = np.clip(own[:, :k, None], 1e-7, 1 - 1e-7), own[:, k, None, None]
            z = np.log(p / (1 - p))
            loss, slope = np.zeros((k, NODES)), np.zeros((k, NODES))
            for a in range(0, len(own), 1000):
                q = 1 / (1 + np.exp(-z[a : a + 1000] / t))
                loss += ((q - y[a : a + 1000]) ** 2).sum(axis=0)
                slope -= (2 * (q - y[a : a + 1000]) * q * (1 - q) * z[a : a + 1000] / t**2).sum(axis=0)
            yield int(c), np.concatenate([[len(own)], (own.T @ own).ravel(), loss.ravel(), slope.ravel()])

    got = summed(rows, parts, 1 + (k + 1) ** 2 + 2 * k * NODES)
    out: dict[tuple, dict[int, Season]] = {}
    for i, c in enumerate(cases):
        out.setdefault(c[:-1], {})[c[-1]] = Season(got[i], k, low, high)
    return out


def _at(values: np.ndarray, t: float, low: float, high: float) -> float:
    return float(C.chebval((2 * t - low - high) / (high - low), _coefficients(values)))


def _coefficients(values: np.ndarray) -> np.ndarray:
    """Of the interpolant through values at the nodes."""
    x = C.chebpts1(NODES)
    c = 2 / NODES * (C.chebvander(x, NODES - 1).T @ values)
    c[0] /= 2
    return c


def best_temperature(seasons: list[Season], stream: int) -> float:
    """Least mean loss of the seasons, which weigh the same: a root of the slope, or a bound."""
    low, high = seasons[0].low, seasons[0].high
    slope, loss = (np.mean([getattr(s, part)[stream] for s in seasons], axis=0) for part in ("slope", "loss"))
    roots = C.chebroots(C.chebtrim(_coefficients(slope), 1e-15))
    inner = [(low + high) / 2 + (high - low) / 2 * r.real for r in roots if abs(r.imag) < 1e-7 and -1 < r.real < 1]
    return float(min([low, high, *inner], key=lambda t: (round(_at(loss, t, low, high), 13), t)))


def calibration(seasons: dict[int, Season], history: list[int], stream: int) -> float:
    """The temperature that the history speaks for: fitted to all of it, if forecasts by temperatures fitted before each of its
    seasons but the first beat the raw ones, else 1."""
    raw, fitted, one = [], [], np.eye(len(next(iter(seasons.values())).loss))[stream]
    for i, year in enumerate(history[1:], 1):
        s = seasons[year]
        fitted.append(_at(s.loss[stream], best_temperature([seasons[h] for h in history[:i]], stream), s.low, s.high))
        raw.append(s.brier(one))
    return best_temperature([seasons[h] for h in history], stream) if round(np.mean(fitted), 12) < round(np.mean(raw), 12) else 1.0


def evaluate(seasons: dict[int, Season], families: dict[str, list[str]], least: int, l2: float) -> list[tuple]:
    """(season, model, candidate, temperature, weight, games, brier) of all outer seasons with ``least`` earlier ones."""
    streams = [c for f in families.values() for c in f]
    one = dict(zip(streams, np.eye(len(streams)), strict=True))
    out, years = [], sorted(seasons)
    for i, outer in enumerate(years):
        history = years[:i]
        if len(history) < least:
            continue
        now, chosen = seasons[outer], {}
        for name, candidates in families.items():
            chosen[name] = min(candidates, key=lambda c: (round(float(np.mean([seasons[h].brier(one[c]) for h in history])), 12), c))
        on = [streams.index(c) for c in chosen.values()]
        m = np.mean([seasons[h].cross for h in history], axis=0)
        k = len(on)
        w = simplex_minimum(m[np.ix_(on, on)] + l2 * np.eye(k), m[on, -1] + l2 / k)
        for weight, (name, c) in zip(w, chosen.items(), strict=True):
            at = streams.index(c)
            t = calibration(seasons, history, at)
            raw = now.brier(one[c])
            out.append((outer, f"{name}_raw", c, 1.0, float(weight), now.n, raw))
            out.append((outer, f"{name}_calibrated", c, t, None, now.n, raw if t == 1.0 else _at(now.loss[at], t, now.low, now.high)))
        mixed = np.zeros(len(streams))
        mixed[on] = w
        out.append((outer, "blend", None, None, None, now.n, now.brier(mixed)))
    return out


def nested_evaluation(games: DataFrame, families: dict[str, list[str]], label: str = "y", season: str = "Season", context: list[str] | None = None, least: int = 2, l2: float = 1e-3, bounds: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """(context, season, model, candidate, temperature, weight, games, brier): of every family the candidate that earlier
    seasons choose, raw (with its weight in the blend) and calibrated, and the blend of the raw ones.

    ``games``: a row a game, with a column of forecasts for every candidate of ``families``. Seasons weigh the same."""
    context = context or []
    if least < 2:
        raise ValueError("calibration needs two earlier seasons")
    sums = season_sums(games, [c for f in families.values() for c in f], label, season, context, *bounds)
    rows = [(*c, int(r[0]), *r[1:]) for c, s in sums.items() for r in evaluate(s, families, least, l2)]
    schema = games.select(*context).schema.add(season, "integer")
    for name, kind in (("model", "string"), ("candidate", "string"), ("temperature", "double"), ("weight", "double"), ("games", "long"), ("brier", "double")):
        schema = schema.add(name, kind)
    return games.sparkSession.createDataFrame(rows, schema)
