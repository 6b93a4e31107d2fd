"""Additional features beside an existing base: which of them add anything, and as what.

Everything follows from one pass of cross products of base, additional features and label by season, which folds add up. A
fold keeps its screened base. Additional features are either screened as well, after those that a base feature stands
for, or scaled and projected on their leading directions. Their correlation with the label beyond the base comes from
the Schur complement of the base in the same matrix. Both arms are linear in the features, so all fits of all folds and
arms are one logistic problem each on a projection of the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.models import NotConverged, _scales, correlations, fold_logistic, fold_moments, gram, linear_forecasts, mirrored_moments, screen_moments, screening_order
from fieldglass.store import stored


def leading_directions(m: np.ndarray, k: int, steps: int = 20_000, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a positive semidefinite matrix and their eigenvectors as columns, by subspace iteration with
    a few directions to spare; a column's largest entry is positive."""
    n = len(m)
    k, width = min(k, n), min(k + 4, n)
    q = np.linalg.qr(np.cos(np.outer(np.arange(1, n + 1), np.arange(1, width + 1))))[0]
    scale = max(float(np.abs(m).max()), 1e-300)
    for _ in range(steps):
        values, turn = np.linalg.eigh(q.T @ m @ q)  # the best basis within the subspace
        v, top = (q @ turn)[:, ::-1], values[::-1]
        if np.abs(m @ v[:, :k] - v[:, :k] * top[:k]).max() <= tol * scale * n:
            v = v[:, :k]
            return top[:k], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1, 1)
        q = np.linalg.qr(m @ v)[0]
    raise NotConverged(f"directions aren't exact after {steps} steps")


def principal_components(df: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """Columns pc1..pck: scores on the leading directions of the centred columns (unknown: 0), as expressions."""
    n, s, x = gram(df, columns)
    mean = s / max(n, 1)
    _, v = leading_directions(x / max(n, 1) - np.outer(mean, mean), k)
    out = {}
    for j in range(v.shape[1]):
        terms = [(F.coalesce(F.col(c), F.lit(0.0)) - float(mean[i])) * float(v[i, j]) for i, c in enumerate(columns)]
        out[f"pc{j + 1}"] = sum(terms[1:], terms[0])
    return df.withColumns(out)


def beyond(r: np.ndarray, base: list[int], extra: list[int], label: int) -> np.ndarray:
    """|partial correlation| of each extra feature with the label, given the base; 0 where the base explains one of them."""
    rest = [*extra, label]
    s = r[np.ix_(rest, rest)]
    if base:
        s = s - r[np.ix_(rest, base)] @ np.linalg.pinv(r[np.ix_(base, base)], rcond=1e-10, hermitian=True) @ r[np.ix_(base, rest)]
    left = np.where(np.diag(s) > 1e-9, np.diag(s), np.inf)
    return np.abs(s[:-1, -1]) / np.sqrt(left[:-1] * left[-1])


def _part(m: tuple, on: list[int]) -> tuple:
    """Moments of some features and the label."""
    n, s, x, support, nonzero = m
    rows = [*on, len(s) - 1]
    return n, s[rows], x[np.ix_(rows, rows)], support[on], nonzero[on]


def extra_screen(m: tuple, n_base: int, base_most: int, most: int, bound: float = 0.995) -> tuple[list[int], list[int], list[tuple[str, float, float]]]:
    """Of mirrored moments of base, extra features and label: base and extra features kept, and for each extra one (status, |r|
    with the label, |r| beyond the base). One that a kept base feature stands for is ``redundant_base``."""
    k = len(m[1]) - 1
    base, extra = screening_order(*_part(m, list(range(n_base))), most=base_most), list(range(n_base, k))
    r = correlations(*m[:3])
    doubled = (np.abs(r[np.ix_(extra, base)]) >= bound).any(axis=1) if base else np.zeros(len(extra), bool)
    part = _part(m, extra)
    part = (*part[:3], np.where(doubled, 0, part[3]), part[4])
    rows = screen_moments(*part, most=most, redundant=bound)
    kept = [extra[i] for i in screening_order(*part, most=most, redundant=bound)]
    audit = [("redundant_base" if d else a, float(abs(r[e, k])), float(x)) for d, (a, _, _), e, x in zip(doubled, rows, extra, beyond(r, base, extra, k), strict=True)]
    return base, kept, audit


def _embedded(m: tuple, n_base: int, components: int) -> np.ndarray:
    """Projection of all features on the leading directions of the scaled extra ones, each of unit spread."""
    k = len(m[1]) - 1
    scale = _scales(m)
    usable = [i for i in range(n_base, k) if m[2][i, i] > 1e-24]
    out = np.zeros((k, min(components, len(usable))))
    if usable:
        x = m[2][np.ix_(usable, usable)] / m[0] * np.outer(scale[usable], scale[usable])
        values, v = leading_directions(x, components)
        spread = np.sqrt(np.maximum(values, 0))
        out[usable] = scale[usable, None] * v / np.where(spread > 1e-9, spread, np.inf)
    return out


def _folds(df: DataFrame, base: list[str], extra: list[str], season: str, label: str) -> dict[int, tuple]:
    by = fold_moments(df, [*base, *extra], label, season)
    return {s: mirrored_moments([by[t] for t in by if t < s]) for s in sorted(by)[1:]}


def extra_audit(df: DataFrame, base: list[str], extra: list[str], season: str, label: str = "y", base_most: int = 128, most: int = 64) -> DataFrame:
    """(season, feature, status, association, beyond): how each fold's screen judges every additional feature."""
    rows = []
    for s, m in _folds(df, base, extra, season, label).items():
        rows += [(int(s), name, *a) for name, a in zip(extra, extra_screen(m, len(base), base_most, most)[2], strict=True)]
    return df.sparkSession.createDataFrame(rows, f"{season} int, feature string, status string, association double, beyond double")


def walk_forward_arms(df: DataFrame, base: list[str], extra: list[str], season: str, label: str = "y", c: float = 0.1, base_most: int = 128, most: int = 64, components: int = 8) -> DataFrame:
    """The rows with ``arm`` (base, screened, embedding) and ``p``: forecasts of every season by logistic models of strictly
    earlier ones, on the base alone, with the additional features that pass the screen, and with their leading directions."""
    df = stored(df, "arms")
    designs, names = {}, []
    for s, m in _folds(df, base, extra, season, label).items():
        own, kept, _ = extra_screen(m, len(base), base_most, most)
        scale = np.diag(_scales(m))
        for arm, columns in (("base", scale[:, own]), ("screened", scale[:, [*own, *kept]]), ("embedding", np.hstack([scale[:, own], _embedded(m, len(base), components)]))):
            designs[len(names)] = (s, columns)
            names.append((s, arm))
    w = fold_logistic(df, [*base, *extra], label, season, designs, c)
    return linear_forecasts(df, [(*name, w[i]) for i, name in enumerate(names)], ["arm"], [*base, *extra], season)
