"""Histogram boosting against a plain version, one fold at a time, by loops over rows."""

import math
import random

import numpy as np
import pytest

from fieldglass.operators import boosting as B


def league(seasons=(2001, 2002, 2004), n=120):
    rng, rows = random.Random(4), []
    for s in seasons:
        for i in range(n):
            a, b = rng.gauss(0, 2), rng.choice([0.0, 1.0, -3.0, None])
            rows.append((s, i, a, b, rng.gauss(0, 1), int(a + (b or 0) / 2 + rng.gauss(0, 1) > 0)))
    return rows


def plain(rows, season, rounds, depth, rate, l2, least):
    """i -> p of the season's rows."""

    def cell(v):
        if v is None or abs(v) < 2.0**-20:
            return 0
        return int(math.copysign(min(math.floor((math.log2(abs(v)) + 20) * 8) + 1, 320), v))

    before = [r for r in rows if r[0] < season]
    sizes = [[abs(cell(r[2 + f])) for r in before] for f in range(3)]

    def bins(r, way):
        out = []
        for f in range(3):
            c = way * cell(r[2 + f])
            below = sum(m < abs(c) for m in sizes[f])
            out.append(0 if c == 0 else (1 if c > 0 else -1) * (1 + min(7, 8 * below // len(before))))
        return out

    data = [(bins(r, way), r[5] if way == 1 else 1 - r[5]) for r in before for way in (1, -1)]
    trees = []

    def margin(x):
        return sum(walk(t, x) for t in trees)

    def walk(t, x):
        while isinstance(t, tuple):
            f, b, left, right = t
            t = right if x[f] > b else left
        return t

    def tree(at, d):
        g, h = sum(a[1] for a in at), sum(a[2] for a in at)
        best = None
        if d:
            for f in range(3):
                for b in range(-8, 8):
                    left = [a for a in at if a[0][f] <= b]
                    if len(left) < least or len(at) - len(left) < least:
                        continue
                    gl, hl = sum(a[1] for a in left), sum(a[2] for a in left)
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    if gain > 1e-9 and (best is None or round(gain, 6) > best[0]):
                        best = (round(gain, 6), f, b)
        if best is None:
            return -rate * g / (h + l2)
        _, f, b = best
        return f, b, tree([a for a in at if a[0][f] <= b], d - 1), tree([a for a in at if a[0][f] > b], d - 1)

    for _ in range(rounds):
        at = []
        for x, y in data:
            p = 1 / (1 + math.exp(-margin(x)))
            at.append((x, p - y, p * (1 - p)))
        trees.append(tree(at, depth))
    s = lambda z: 1 / (1 + math.exp(-z))
    return {r[1]: (s(margin(bins(r, 1))) + 1 - s(margin(bins(r, -1)))) / 2 for r in rows if r[0] == season}


COLUMNS = "Season int, i int, a double, b double, c double, y int"


@pytest.mark.parametrize("every", [1, 16])  # margins written after every tree, or never
def test_forecasts_equal_the_plain_version(spark, every):
    rows = league()
    how = {"rounds": 3, "depth": 3, "rate": 0.3, "l2": 2.0, "least": 10}
    got = B.walk_forward_boosted(spark.createDataFrame(rows, COLUMNS).repartition(3), ["a", "b", "c"], "Season", every=every, **how)
    assert got.columns == ["Season", "i", "a", "b", "c", "y", "p"]
    found = {(r.Season, r.i): r.p for r in got.collect()}
    want = {(s, i): p for s in (2002, 2004) for i, p in plain(rows, s, **how).items()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    by = {(r[0], r[1]): r[5] for r in rows}
    assert sum((found[k] - by[k]) ** 2 for k in found) / len(found) < 0.2  # it has learnt something


def test_mirrored_rows_get_the_complement(spark):
    rows = league()
    df = spark.createDataFrame(rows, COLUMNS)
    folds = B.grow(df, ["a", "b", "c"], "Season", rounds=2, depth=2)
    p = {(r.Season, r.i): r.p for r in B.forecasts(df, folds, ["a", "b", "c"], "Season").collect()}
    q = {(r.Season, r.i): r.p for r in B.forecasts(df.selectExpr("Season", "i", "-a as a", "-b as b", "-c as c", "y"), folds, ["a", "b", "c"], "Season").collect()}
    assert all(abs(p[k] + q[k] - 1) < 1e-12 for k in p)


def test_unusable_features_are_never_split_on_and_one_season_has_no_fold(spark):
    rows = [(*r[:3], 5.0, None, r[5]) for r in league()]
    folds = B.grow(spark.createDataFrame(rows, COLUMNS), ["a", "b", "c"], "Season", rounds=2, depth=2)
    assert all(set(np.concatenate(t.feature).tolist()) <= {-1, 0, 1} for t in folds.values()) and not any(t.usable[2] for t in folds.values())
    assert B.walk_forward_boosted(spark.createDataFrame(league((2001,)), COLUMNS), ["a", "b", "c"], "Season").count() == 0
