"""Histogram gradient boosting of binary outcomes, all walk-forward folds at once.

Every fold learns from the rows of strictly earlier seasons and their mirror images (features negated, label flipped).
Values fall into cells of a fixed logarithmic grid, and a fold's training rows give each feature ``2 * LEVELS + 1`` bins,
alike on both sides of zero, by quantiles of the magnitude's cells. A pass over the rows sums gradients, hessians and counts by
(fold, node, feature, bin) from Arrow batches; the driver gets that histogram, of a size that rows don't change, and takes each
node's best split. A tree of depth d costs d passes for all folds together; margins of finished trees are written beside the
rows every ``every`` trees, so that a pass evaluates few trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.models import _matrix, fold_moments, mirrored_moments, screen_moments, summed
from fieldglass.store import stored

#: The grid: cells an octave, the exponent below which a value counts as 0, and cells of a sign.
PER_OCTAVE, LEAST, CELLS = 8, -20, 320
#: Bins of a sign.
LEVELS = 8
BINS = 2 * LEVELS + 1


def cells(x: np.ndarray) -> np.ndarray:
    """Signed cell of each value; unknown and tiny ones: 0."""
    size = np.abs(np.nan_to_num(x))
    cell = np.minimum(np.floor((np.log2(np.maximum(size, 2.0**LEAST)) - LEAST) * PER_OCTAVE) + 1, CELLS)
    return np.where(size < 2.0**LEAST, 0, np.sign(np.nan_to_num(x)) * cell).astype(np.int16)


def levels(counts: np.ndarray) -> np.ndarray:
    """Bin of every cell's magnitude, from the training rows' counts by (feature, magnitude): 0 for 0, else 1 and the whole
    eighths of the rows below it."""
    below = np.cumsum(counts, axis=1) - counts
    rows = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out = 1 + np.minimum(LEVELS - 1, LEVELS * below // rows)
    out[:, 0] = 0
    return out.astype(np.int8)


@dataclass
class Trees:
    """A fold's bins and its trees: for inner nodes in level order the feature (-1: no split, all go left) and the last bin of
    the left side, and the leaves' values."""

    level: np.ndarray
    usable: np.ndarray
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    last: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def bins(self, cell: np.ndarray) -> np.ndarray:
        return np.sign(cell).astype(np.int8) * self.level[np.arange(cell.shape[1]), np.abs(cell)]

    def node(self, bins: np.ndarray, t: int, depth: int) -> np.ndarray:
        """Place among the nodes of a depth of tree t."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for d in range(depth):
            k = at + (1 << d) - 1
            f = self.feature[t][k]
            at = 2 * at + ((f >= 0) & (bins[rows, f] > self.last[t][k]))
        return at

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        total = np.zeros(len(bins))
        for t in range(first, len(self.value)):
            total += self.value[t][self.node(bins, t, self.depth)]
        return total


def best_splits(hist: np.ndarray, usable: np.ndarray, l2: float, least: int) -> list[tuple]:
    """For each node (feature, last bin of the left side, (G, H) left, (G, H) right), feature -1 where no split gains.

    ``hist``: (3, nodes, features, bins) sums of gradients, hessians and rows. Gains equal to 1e-6 are ties: the lower
    feature and bin win, as mirrored data has every gain twice."""
    out = []
    left = np.cumsum(hist, axis=3)
    for node in range(hist.shape[1]):
        total = left[:, node, 0, -1]
        g, h, n = left[:, node, :, :-1]
        rg, rh, rn = (total[i] - x for i, x in enumerate((g, h, n)))
        gain = g * g / (h + l2) + rg * rg / (rh + l2) - total[0] ** 2 / (total[1] + l2)
        ok = (n >= least) & (rn >= least) & usable[:, None] & (gain > 1e-9)
        if not ok.any():
            out.append((-1, 0, tuple(total[:2]), (0.0, 0.0)))
            continue
        f, b = np.unravel_index(np.argmax(np.where(ok, np.round(gain, 6), -1.0)), gain.shape)
        out.append((int(f), int(b) - LEVELS, (g[f, b], h[f, b]), (rg[f, b], rh[f, b])))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _histograms(folds: dict[int, Trees], order: list[int], done: int, level: int, k: int):
    """(fold, histogram of the level's nodes) of a batch with columns season, y, cell, margin."""

    def parts(b):
        season, y = b.column("season").to_numpy(), b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
        cell = b.column("cell").flatten().to_numpy().reshape(len(season), k)
        before = b.column("margin").flatten().to_numpy().reshape(len(season), 2 * len(order))
        for j, s in enumerate(order):
            rows = season < s
            if not rows.any():
                continue
            trees, n = folds[s], 1 << level
            hist = np.zeros((3, n, k, BINS))
            for way, label, held in ((1, y[rows], before[rows, 2 * j]), (-1, 1 - y[rows], before[rows, 2 * j + 1])):
                bins = trees.bins(way * cell[rows])
                p = _sigmoid(held + trees.margin(bins, done))
                at = trees.node(bins, len(trees.value), level) * BINS + LEVELS
                for f in range(k):
                    for i, w in enumerate((p - label, p * (1 - p), None)):
                        hist[i, :, f] += np.bincount(at + bins[:, f], w, n * BINS).reshape(n, BINS)
            yield s, hist.ravel()

    return parts


def grow(df: DataFrame, features: list[str], season: str, label: str = "y", rounds: int = 120, depth: int = 3, rate: float = 0.04, l2: float = 10.0, least: int = 25, most: int = 128, every: int = 16) -> dict[int, Trees]:
    """season -> trees learnt from all earlier seasons; features are screened within each fold. No earlier season: no fold."""
    k = len(features)
    moments = fold_moments(df, features, label, season)
    order = sorted(moments)[1:]
    if not order:
        return {}

    def as_cells(batches):
        import pyarrow as pa

        for b in batches:
            c = cells(_matrix(b, features))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, k, dtype=np.int32)), pa.array(c.ravel()))
            none = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(order) * len(c) + 1, 2 * len(order), dtype=np.int32)), pa.array(np.zeros(2 * len(order) * len(c))))
            yield pa.RecordBatch.from_arrays([b.column(season), b.column(label), lists, none], ["season", "y", "cell", "margin"])

    schema = "season long, y double, cell array<short>, margin array<double>"
    cols = [F.col(season).cast("long").alias(season), F.col(label).cast("double").alias(label), *[F.col(f).cast("double").alias(f) for f in features]]
    rows = stored(df.select(*cols).mapInArrow(as_cells, schema), "cells")

    def counted(b):
        which = b.column("season").to_numpy()
        size = np.abs(b.column("cell").flatten().to_numpy().reshape(len(which), k).astype(np.int64)) + np.arange(k) * (CELLS + 1)
        for s in np.unique(which):
            yield int(s), np.bincount(size[which == s].ravel(), minlength=k * (CELLS + 1)).astype(np.float64)

    counts = summed(rows, counted, k * (CELLS + 1))
    folds = {}
    for s in order:
        earlier = [t for t in moments if t < s]
        kept = [a == "retained" for a, _, _ in screen_moments(*mirrored_moments([moments[t] for t in earlier]), most=most)]
        folds[s] = Trees(levels(sum(counts[t] for t in earlier).reshape(k, CELLS + 1).astype(np.int64)), np.array(kept), depth)
    done = 0
    for t in range(rounds):
        for trees in folds.values():
            trees.feature.append(np.full((1 << depth) - 1, -1))
            trees.last.append(np.zeros((1 << depth) - 1, np.int64))
        leaves = {}
        for level in range(depth):
            got = summed(rows, _histograms(folds, order, done, level, k), 3 * (1 << level) * k * BINS)
            for s, trees in folds.items():
                splits = best_splits(got[s].reshape(3, 1 << level, k, BINS), trees.usable, l2, least)
                for node, (f, b, *_) in enumerate(splits):
                    trees.feature[t][(1 << level) - 1 + node], trees.last[t][(1 << level) - 1 + node] = f, b
                leaves[s] = [-rate * g / (h + l2) for _, _, *sides in splits for g, h in sides]
        for s, trees in folds.items():
            trees.value.append(np.array(leaves[s]))
        if (t + 1) % every == 0 and t + 1 < rounds:
            rows, done = stored(rows.mapInArrow(_kept_margins(folds, order, done, k), schema), "cells"), t + 1
    return folds


def _kept_margins(folds: dict[int, Trees], order: list[int], done: int, k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            cell = b.column("cell").flatten().to_numpy().reshape(b.num_rows, k)
            m = b.column("margin").flatten().to_numpy().reshape(b.num_rows, 2 * len(order)).copy()
            for j, s in enumerate(order):
                for i, way in enumerate((1, -1)):
                    m[:, 2 * j + i] += folds[s].margin(folds[s].bins(way * cell), done)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 2 * len(order), dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["season", "y", "cell", "margin"])

    return run


def forecasts(df: DataFrame, folds: dict[int, Trees], features: list[str], season: str) -> DataFrame:
    """The rows of the folds' own seasons with ``p``: the mean of p(x) and 1 - p(-x)."""
    rows = df.where(F.col(season).isin([int(s) for s in folds])).select(F.struct(*df.columns).alias("row"), F.col(season).cast("long").alias("season"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    names = [f"x{i}" for i in range(len(features))]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cell, which, p = cells(_matrix(b, names)), b.column("season").to_numpy(), np.zeros(b.num_rows)
            for s in np.unique(which):
                own = which == s
                ahead, back = (_sigmoid(folds[s].margin(folds[s].bins(way * cell[own]))) for way in (1, -1))
                p[own] = (ahead + 1 - back) / 2
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p)], ["row", "p"])

    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row}, p double").select("row.*", "p")


def walk_forward_boosted(df: DataFrame, features: list[str], season: str, label: str = "y", **how) -> DataFrame:
    """Forecasts ``p`` of every season that has an earlier one; ``how``: as in ``grow``."""
    df = stored(df, "walk")
    return forecasts(df, grow(df, features, season, label, **how), features, season)


def walk_forward_variants(df: DataFrame, features: list[str], season: str, variants: dict[str, dict], label: str = "y") -> DataFrame:
    """The rows' forecasts by every variant (name -> parameters of ``grow``), with its name in ``variant``; rows are written once."""
    df, out = stored(df, "variants"), None
    for name, how in variants.items():
        t = forecasts(df, grow(df, features, season, label, **how), features, season).withColumn("variant", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out
