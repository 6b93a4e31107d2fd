"""Training screen, walk-forward logistic models and their capacities, simplex blends, prices, frozen models."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(b, columns) -> np.ndarray:
    """Columns of an Arrow batch as doubles; null and NaN become NaN."""
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]) if b.num_rows else np.zeros((0, len(columns)))


def summed(df: DataFrame, parts, size: int) -> dict:
    """key -> sum over all rows of the vectors (of ``size`` numbers) that ``parts(batch)`` yields as (key, vector): tasks add up
    their own, then one task a key adds up the tasks'. The driver gets a vector a key."""

    def run(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for key, v in parts(b):
                total[key] = total.get(key, 0.0) + v
        if total:
            flat = np.concatenate([np.asarray(v, np.float64) for v in total.values()])
            at = np.arange(0, len(flat) + 1, size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "v"])

    def add(t):
        import pyarrow as pa

        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, size).sum(axis=0)
        return pa.table({"key": t.column("key")[:1], "v": pa.array([v], pa.list_(pa.float64()))})

    got = df.mapInArrow(run, "key long, v array<double>").groupBy("key").applyInArrow(add, "key long, v array<double>").collect()
    return {r["key"]: np.array(r["v"]) for r in got}


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross products of the columns (null: 0), from products of Arrow batches."""
    k = len(columns)

    def parts(b):
        x = np.nan_to_num(_matrix(b, columns))
        yield 0, np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    v = summed(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), parts, 1 + k + k * k).get(0, np.zeros(1 + k + k * k))
    return int(v[0]), v[1 : 1 + k], v[1 + k :].reshape(k, k)


def pivots(corr: np.ndarray, strength: np.ndarray, open_: np.ndarray, most: int, bound: float) -> tuple[list[int], np.ndarray]:
    """The features taken, strongest first, and for each feature the one that stands for it (-1: none): a taken one covers
    whatever correlates with it to the bound, and what is covered is open no more. ``most`` features are taken at most,
    so a smaller ``most`` takes the first of them."""
    taken, by = [], np.full(len(strength), -1)
    free = open_.copy()
    while free.any() and len(taken) < most:
        i = int(np.argmax(np.where(free, strength, -1.0)))
        covers = free & (np.abs(corr[i]) >= bound)
        covers[i] = True
        by[covers] = i
        free &= ~covers
        taken.append(i)
    return taken, by


def correlations(n: float, sums: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """From moments; 0 where a column has no spread."""
    cov = cross - np.outer(sums, sums) / max(n, 1)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    spread[spread <= 1e-12 * np.maximum(1.0, np.sqrt(np.abs(np.diag(cross))))] = np.inf
    return cov / np.outer(spread, spread)


def screen_moments(n: float, sums: np.ndarray, cross: np.ndarray, support: np.ndarray, nonzero: np.ndarray, most: int = 128, redundant: float = 0.995, rare: float = 0.005) -> list[tuple[str, float, int]]:
    """(status, |r| with the label, index of the feature it repeats or -1) of each feature, from moments of features and label.

    Features without a value are ``all_missing``, those with too few non-zero ones ``near_constant``, those without spread
    ``constant``. The rest are taken by falling |r| (ties: catalog order): ``retained`` up to ``most``, ``redundant`` if their
    correlation with a retained one reaches the bound, else ``capacity``.
    """
    r = correlations(n, sums, cross)
    k = len(sums) - 1
    strength = np.abs(r[:k, k])
    dead = {"all_missing": support == 0, "near_constant": (nonzero > 0) & (nonzero < max(2, int(np.ceil(rare * n)))), "constant": np.diag(r)[:k] == 0}
    taken, by = pivots(r[:k, :k], strength, ~np.any(list(dead.values()), axis=0), most, redundant)
    live = np.select([np.isin(np.arange(k), taken), by >= 0], ["retained", "redundant"], "capacity")
    status = np.select(list(dead.values()), list(dead), live)
    return [(str(status[i]), float(strength[i]), int(by[i]) if status[i] == "redundant" else -1) for i in range(k)]


def screening_order(n, sums, cross, support, nonzero, **bounds) -> list[int]:
    """The retained features in the order they are taken: the first c of them are those of a screen that takes c."""
    rows = screen_moments(n, sums, cross, support, nonzero, **bounds)
    return sorted((i for i, row in enumerate(rows) if row[0] == "retained"), key=lambda i: (-rows[i][1], i))


def fold_moments(df: DataFrame, features: list[str], label: str, fold: str) -> dict:
    """fold value -> (rows, sums, cross products, support, non-zero counts) of features and label, one pass for all folds."""
    k = len(features)
    size = 1 + (k + 1) + (k + 1) ** 2 + 2 * k

    def parts(b):
        x, which = _matrix(b, [*features, label]), b.column(fold).to_numpy(zero_copy_only=False)
        for f in np.unique(which):
            raw = x[which == f]
            z = np.nan_to_num(raw)
            yield int(f), np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel(), np.isfinite(raw[:, :k]).sum(axis=0), (np.abs(z[:, :k]) > 1e-12).sum(axis=0)])

    cols = [F.col(c).cast("double").alias(c) for c in (*features, label)]
    got = summed(df.select(F.col(fold).cast("long").alias(fold), *cols), parts, size)
    cut = np.cumsum([1, k + 1, (k + 1) ** 2, k])
    return {f: (v[0], v[1 : cut[1]], v[cut[1] : cut[2]].reshape(k + 1, k + 1), v[cut[2] : cut[3]], v[cut[3] :]) for f, v in got.items()}


def screen(df: DataFrame, features: list[str], label: str, **bounds) -> list[tuple[str, str, float, str | None, int, int]]:
    """(feature, status, |r|, feature it repeats, rows with a value, rows with a non-zero one), as ``screen_moments`` says."""
    moments = fold_moments(df.withColumn("_one", F.lit(0)), features, label, "_one")
    k = len(features)
    n, s, x, support, nonzero = moments.get(0, (0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1)), np.zeros(k), np.zeros(k)))
    found = screen_moments(n, s, x, support, nonzero, **bounds)
    return [(f, a, b, features[c] if c >= 0 else None, int(u), int(z)) for f, (a, b, c), u, z in zip(features, found, support, nonzero, strict=True)]


def screen_by_fold(df: DataFrame, features: list[str], label: str, fold: str, **bounds) -> list[tuple[int, str, str, float]]:
    """(fold, feature, status, |r|) of a screen within each fold's own rows."""
    found = sorted(fold_moments(df, features, label, fold).items())
    return [(f, name, a, b) for f, m in found for name, (a, b, _) in zip(features, screen_moments(*m, **bounds), strict=True)]


def mirrored_moments(parts: list) -> tuple:
    """Moments of the rows of several folds together with their mirror images (features negated, label flipped)."""
    n, s, x, support, nonzero = (sum(p[i] for p in parts) for i in range(5))
    k = len(s) - 1
    cross = np.zeros_like(x)
    cross[:k, :k] = 2 * x[:k, :k]
    cross[:k, k] = cross[k, :k] = 2 * x[:k, k] - s[:k]  # x y - x (1 - y)
    cross[k, k] = n
    sums = np.zeros(k + 1)
    sums[k] = n
    return 2 * n, sums, cross, 2 * support, 2 * nonzero


class NotConverged(RuntimeError):
    """An iteration that ended before its result was as exact as stated."""


def fold_logistic(df: DataFrame, features: list[str], label: str, season: str, designs: dict[int, tuple[int, np.ndarray]], c: float, steps: int = 50) -> dict[int, np.ndarray]:
    """key -> weights on the raw features of L2 logistic fits: Newton steps of all fits together, a pass over the rows a step.

    ``designs``: key -> (fold season, features x columns): a fit learns from strictly earlier seasons' rows, unknown values as
    0, projected on its columns. With mirror images the loss is twice that of the rows and needs no intercept.
    The driver gets a gradient and a Hessian of a fit's columns; a task holds as much for every fit.
    """
    k, m = len(features), max((p.shape[1] for _, p in designs.values()), default=0)
    if not m:
        return {key: np.zeros(k) for key in designs}
    wide = {key: (s, np.pad(p, ((0, 0), (0, m - p.shape[1])))) for key, (s, p) in designs.items()}  # columns of zeros stay at 0
    w = {key: np.zeros(m) for key in wide}
    cols = df.select(F.col(season).cast("long").alias(season), *[F.col(x).cast("double").alias(x) for x in (*features, label)])
    for _ in range(steps):
        now = dict(w)

        def parts(b, now=now):
            x, which = _matrix(b, [*features, label]), b.column(season).to_numpy(zero_copy_only=False)
            for key, (s, p) in wide.items():
                rows = x[which < s]
                if len(rows):
                    z, y = np.nan_to_num(rows[:, :k]) @ p, rows[:, k]
                    q = 1 / (1 + np.exp(-np.clip(z @ now[key], -500, 500)))
                    yield key, np.concatenate([2 * z.T @ (q - y), (2 * (z * (q * (1 - q))[:, None]).T @ z).ravel()])

        got, moved = summed(cols, parts, m + m * m), 0.0
        for key, v in got.items():
            step = np.linalg.solve(v[m:].reshape(m, m) + np.eye(m) / c, v[:m] + now[key] / c)
            w[key] = now[key] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            return {key: wide[key][1] @ v for key, v in w.items()}
    raise NotConverged(f"logistic fits still move by {moved} after {steps} steps")


def linear_forecasts(df: DataFrame, weights: list[tuple], keys: list[str], features: list[str], season: str) -> DataFrame:
    """Rows of each season with ``p`` by its weights on the raw features (unknown: 0), once for each row of ``weights``:
    (season, keys, weights)."""
    kinds = "".join(f", {k} {'string' if weights and isinstance(weights[0][1 + i], str) else 'int'}" for i, k in enumerate(keys))
    table = df.sparkSession.createDataFrame([(int(r[0]), *r[1:-1], [float(x) for x in r[-1]]) for r in weights], f"_s long{kinds}, _w array<double>")
    x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features])
    z = F.aggregate(F.zip_with(x, "_w", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return df.join(table, F.col(season) == F.col("_s")).withColumn("p", 1 / (1 + F.exp(-z))).select(*df.columns, *keys, "p")


def _scales(moments: tuple) -> np.ndarray:
    """1 / standard deviation of each feature of mirrored moments."""
    sd = np.sqrt(np.diag(moments[2])[:-1] / max(moments[0], 1))
    return 1 / np.where(sd > 0, sd, 1)


def walk_forward(df: DataFrame, features: list[str], season: str, label: str = "y", c: float = 0.1, first: int | None = None, most: int = 128) -> DataFrame:
    """Forecasts ``p`` of each season by a model of strictly earlier seasons only: rows and their mirror images, the screen
    within the fold, unknown values at the mirror's median (0), scaling, then L2 logistic regression.

    Columns without a value in a fold are left out there. Without a season that has an earlier one there are no rows.

    Scale: the matrix is written once; the screens of all folds are one pass, and so is each Newton step of all folds.
    """
    rows, fits = fitted_paths(df, features, season, label, c, first, [most])
    return linear_forecasts(rows, [(s, w) for s, _, w in fits], [], features, season)


def fitted_paths(df: DataFrame, features: list[str], season: str, label: str, c: float, first: int | None, capacities: list[int]) -> tuple[DataFrame, list[tuple]]:
    """The written rows, and (season, capacity, weights on raw features) of a fit for every fold and capacity. A fold has one
    order of screening, whose prefixes are the capacities' features."""
    from fieldglass.store import stored

    df = stored(df, "walk")
    moments = fold_moments(df, features, label, season)
    designs, names = {}, []
    for s in [s for s in sorted(moments)[1:] if first is None or s >= first]:
        m = mirrored_moments([moments[t] for t in moments if t < s])
        order, scale = screening_order(*m, most=max(capacities)), np.diag(_scales(m))
        for cap in capacities:
            designs[len(names)] = (s, scale[:, order[:cap]])
            names.append((s, cap))
    w = fold_logistic(df, features, label, season, designs, c)
    return df, [(s, cap, w[i]) for i, (s, cap) in enumerate(names)]


def capacity_path(df: DataFrame, features: list[str], season: str, capacities: list[int], label: str = "y", c: float = 0.1) -> DataFrame:
    """The rows with ``capacity`` and ``p``: forecasts of every season by models that keep so many features of one screening
    order. All folds and capacities share the screen's pass and each Newton step's pass."""
    rows, fits = fitted_paths(df, features, season, label, c, None, sorted(set(capacities)))
    return linear_forecasts(rows, fits, ["capacity"], features, season)


def block_catalogue(blocks: dict[str, list[str]]) -> dict[str, list[str]]:
    """``all``, each block alone and everything ``without`` each block: ordered lists in which no name repeats."""
    once = lambda lists: list(dict.fromkeys(x for names in lists for x in names))
    alone = {f"only_{b}": once([names]) for b, names in blocks.items()}
    rest = {f"without_{b}": once(names for other, names in blocks.items() if other != b) for b in blocks}
    return {"all": once(blocks.values()), **alone, **rest}


def walk_forward_blocks(df: DataFrame, catalogue: dict[str, list[str]], season: str, label: str = "y", c: float = 0.1, known: float = 0.95) -> DataFrame:
    """The rows with ``block`` and ``p``: forecasts of every season by logistic models without an intercept on each list of the
    catalogue. Of a list a fold takes the features that at least a share of ``known`` of its rows have, and that vary.

    One pass of moments serves all folds and lists, and so does each Newton step; a list's gradient and Hessian are those of
    its columns of the same rows. A list without a usable feature forecasts 1/2."""
    from fieldglass.store import stored

    df = stored(df, "blocks")
    features = list(dict.fromkeys(x for names in catalogue.values() for x in names))
    moments = fold_moments(df, features, label, season)
    designs, names = {}, []
    for s in sorted(moments)[1:]:
        m = mirrored_moments([moments[t] for t in moments if t < s])
        scale = np.diag(_scales(m))
        usable = (m[3] >= known * m[0]) & (np.diag(m[2])[:-1] > 1e-24 * max(m[0], 1))
        for block, own in catalogue.items():
            designs[len(names)] = (s, scale[:, [i for i, f in enumerate(features) if f in own and usable[i]]])
            names.append((s, block))
    w = fold_logistic(df, features, label, season, designs, c)
    return linear_forecasts(df, [(*name, w[i]) for i, name in enumerate(names)], ["block"], features, season)


def simplex_minimum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The w >= 0 with sum 1 that minimises w a w - 2 b w for a positive definite a: the best over all sets of positive
    weights, each solved exactly. For up to 16 weights."""
    k = len(b)
    if k > 16:
        raise ValueError("more than 16 streams")
    best = None
    for size in range(1, k + 1):
        for on in map(list, combinations(range(k), size)):
            m = np.zeros((size + 1, size + 1))
            m[:size, :size], m[size, :size], m[:size, size] = a[np.ix_(on, on)], 1, 1
            w = np.zeros(k)
            w[on] = np.linalg.solve(m, np.append(b[on], 1.0))[:size]
            if (w >= -1e-12).all():
                w = np.maximum(w, 0) / np.maximum(w, 0).sum()
                value = w @ a @ w - 2 * b @ w
                if best is None or value < best[0]:
                    best = (value, w)
    return best[1]


def simplex_blend(df: DataFrame, streams: list[str], label: str = "y", season: str = "Season", l2: float = 1e-3) -> dict[str, float]:
    """Non-negative weights that sum to 1 and minimise the blend's Brier score, every season weighing the same, drawn towards
    equal weights by l2. Spark sums cross products by season; the driver solves a problem of the number of streams."""
    moments = [m for m in fold_moments(df, streams, label, season).values() if m[0]]
    k = len(streams)
    x = sum((m[2] / m[0] for m in moments), np.zeros((k + 1, k + 1))) / max(len(moments), 1)
    w = simplex_minimum(x[:-1, :-1] + l2 * np.eye(k), x[:-1, -1] + l2 / k)
    return dict(zip(streams, map(float, w), strict=True))


def fair_prices(one: Column, two: Column) -> dict[str, Column]:
    """Of decimal prices of both sides: the first side's chance without the margin, the margin, and both fair prices."""
    a, b = 1 / one, 1 / two
    return {"no_vig": a / (a + b), "overround": a + b - 1, "fair": (a + b) / a, "fair_other": (a + b) / b}


def score_frozen(df: DataFrame, coefficients: dict[str, tuple[float, float]]) -> DataFrame:
    """p from frozen (scale, coefficient) pairs: a sigmoid of the sum of x / scale * coefficient, as a JVM expression."""
    terms = [F.coalesce(F.col(f), F.lit(0.0)) / F.lit(s) * F.lit(c) for f, (s, c) in coefficients.items()]
    z = sum(terms[1:], terms[0])
    return df.withColumn("p", F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z))))
