"""Minimisation, nested evaluation, capacities, additional features and persisted models against plain versions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldglass.operators import models as M
from fieldglass.operators import nested as N
from fieldglass.operators import persisted as P
from fieldglass.operators import representation as V
from fieldglass.operators.minimise import minimise


def test_minimise_finds_every_groups_minimum_and_bounds(spark):
    rows = [("a", 1, 0.7), ("a", 1, 0.9), ("a", 2, 1.4), ("b", 1, 9.0), ("c", 1, -3.0), ("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, season int, m double")
    got = {r.k: r for r in minimise(df, ["k"], lambda x: F.pow(x - F.col("m"), F.lit(2.0)), 0.5, 2.0, within=["season"]).collect()}
    assert got["a"].x == pytest.approx((0.8 + 1.4) / 2, abs=1e-6)  # seasons weigh the same
    assert got["b"].x == pytest.approx(2.0, abs=1e-6) and got["c"].x == pytest.approx(0.5, abs=1e-6)
    assert got["d"].x is None and got["d"].loss is None
    one = minimise(df.where("k = 'a'"), [], lambda x: F.pow(x - F.col("m"), F.lit(2.0)), 0.5, 2.0).collect()
    assert len(one) == 1 and one[0].x == pytest.approx(1.0, abs=1e-6)
    assert minimise(df.limit(0), ["k"], lambda x: F.pow(x - F.col("m"), F.lit(2.0)), 0.5, 2.0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5))
def test_simplex_minimum_beats_every_corner_and_mixture(seed, k):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(k + 2, k))
    a, b = x.T @ x + 1e-3 * np.eye(k), rng.normal(size=k)
    w = M.simplex_minimum(a, b)
    value = lambda v: v @ a @ v - 2 * b @ v
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert all(value(w) <= value(v) + 1e-9 for v in rng.dirichlet(np.ones(k) * 0.5, 300)) and all(value(w) <= value(v) + 1e-9 for v in np.eye(k))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_pivots_are_those_of_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, 7))
    x[:, 5], x[:, 6] = x[:, 0] + rng.normal(size=12) * 1e-3, x[:, 1]
    corr, strength = np.corrcoef(x.T), np.round(rng.random(7), 1)
    open_ = rng.random(7) < 0.8
    taken, by = M.pivots(corr, strength, open_, 3, 0.99)
    left, want, over = [i for i in range(7) if open_[i]], [], {}
    while left and len(want) < 3:
        top = max(left, key=lambda i: (strength[i], -i))
        want.append(top)
        over |= {i: top for i in left if i == top or abs(corr[i, top]) >= 0.99}
        left = [i for i in left if i not in over]
    assert taken == want and by.tolist() == [over.get(i, -1) for i in range(7)]
    assert M.pivots(corr, strength, open_, 2, 0.99)[0] == want[:2]


# nested evaluation


def squash(z):
    return 1 / (1 + math.exp(-z))


def temper(p, t):
    p = min(max(p, 1e-7), 1 - 1e-7)
    return squash(math.log(p / (1 - p)) / t)


def plain_nested(rows, families, least, l2):
    """rows: (season, y, {candidate: p}); by golden section and a grid of weights."""
    seasons = sorted({r[0] for r in rows})
    of = {s: [r for r in rows if r[0] == s] for s in seasons}
    loss = lambda s, c, t=1.0: sum((temper(r[2][c], t) - r[1]) ** 2 for r in of[s]) / len(of[s])
    raw = lambda s, c: sum((r[2][c] - r[1]) ** 2 for r in of[s]) / len(of[s])

    def fit(hist, c):
        lo, hi, g = 0.5, 2.0, (5**0.5 - 1) / 2
        f = lambda t: sum(loss(s, c, t) for s in hist) / len(hist)
        while hi - lo > 1e-9:
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if f(a) <= f(b) else (a, hi)
        return (lo + hi) / 2

    out = {}
    for i, s in enumerate(seasons):
        hist = seasons[:i]
        if len(hist) < least:
            continue
        chosen = {f: min(cs, key=lambda c: (sum(raw(h, c) for h in hist) / len(hist), c)) for f, cs in families.items()}
        for f, c in chosen.items():
            tried = [(raw(h, c), loss(h, c, fit(hist[:k], c))) for k, h in enumerate(hist) if k]
            t = fit(hist, c) if np.mean([b for _, b in tried]) < np.mean([a for a, _ in tried]) else 1.0
            out[s, f"{f}_raw"] = (c, 1.0, raw(s, c))
            out[s, f"{f}_calibrated"] = (c, t, loss(s, c, t))
        grid = [(w, 1 - w) for w in np.linspace(0, 1, 20001)]
        a, b = chosen.values()
        moments = []
        for h in hist:
            d, r = np.array([x[2][a] - x[2][b] for x in of[h]]), np.array([x[1] - x[2][b] for x in of[h]])
            moments.append((np.mean(d * d), np.mean(r * d)))
        dd, rd = np.mean(moments, axis=0)
        w = min(grid, key=lambda g: g[0] ** 2 * dd - 2 * g[0] * rd + l2 * ((g[0] - 0.5) ** 2 + (g[1] - 0.5) ** 2))
        out[s, "blend"] = (None, w[0], sum((w[0] * r[2][a] + w[1] * r[2][b] - r[1]) ** 2 for r in of[s]) / len(of[s]))
    return out


def test_nested_evaluation_equals_the_plain_version(spark):
    rng, rows = random.Random(3), {"M": [], "W": []}
    for g in rows:
        for s in (2001, 2002, 2004, 2005):
            for _ in range(rng.randint(20, 40)):
                z = rng.gauss(0, 1.5)
                p = squash(z)
                rows[g].append((s, int(rng.random() < squash(0.5 * z)), {"a": p, "b": min(max(p + rng.gauss(0, 0.1), 0.0), 1.0), "c": 0.5 + 0.5 * (p - 0.5), "d": 0.4}))
    families = {"one": ["a", "b"], "two": ["c", "d"]}
    df = spark.createDataFrame([(g, s, y, *p.values()) for g, rs in rows.items() for s, y, p in rs], "Gender string, Season int, y int, a double, b double, c double, d double").repartition(3)
    got = {g: {(r.Season, r.model): r for r in N.nested_evaluation(df, families, context=["Gender"], l2=0.01).collect() if r.Gender == g} for g in rows}
    for g, rs in rows.items():
        want = plain_nested(rs, families, 2, 0.01)
        assert got[g].keys() == want.keys()
        for key, (c, t, b) in want.items():
            r = got[g][key]
            assert r.candidate == c and r.brier == pytest.approx(b, abs=2e-6)
            if key[1] != "blend":
                assert r.temperature == pytest.approx(t, abs=1e-5)
            else:
                assert got[g][key[0], "one_raw"].weight == pytest.approx(t, abs=1e-4)
    # later seasons don't change what earlier ones chose
    early = N.nested_evaluation(df.where("Season < 2005"), families, context=["Gender"], l2=0.01).collect()
    choice = lambda r: (r.candidate, r.temperature and round(r.temperature, 9), r.weight and round(r.weight, 9))
    assert {(r.Gender, r.Season, r.model): choice(r) for r in early} == {(g, *k): choice(r) for g in rows for k, r in got[g].items() if k[0] < 2005}
    assert N.nested_evaluation(df.limit(0), families).count() == 0


# arms and capacities


def league(spark, seasons=(2001, 2002, 2003), n=60):
    rng = random.Random(8)
    rows = []
    for s in seasons:
        for i in range(n):
            a, b, c = rng.gauss(0, 1), rng.gauss(0, 3), rng.choice([0.0, 1.0, None])
            rows.append((s, i, a, b, c, 2 * a, None, int(a + b / 3 + rng.gauss(0, 1) > 0)))
    return rows, spark.createDataFrame(rows, "Season int, i int, a double, b double, c double, twice double, void double, y int")


def logistic(x, y, c):
    """Weights of the mirrored L2 fit by gradient steps of a plain loop."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(2 * (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / c, 2 * x.T @ (p - y) + w / c)
    return w


def test_capacities_are_prefixes_of_one_order(spark):
    rows, df = league(spark)
    got = M.capacity_path(df, ["a", "b", "c", "twice", "void"], "Season", [2, 1, 64]).collect()
    full = {(r.Season, r.i): r.p for r in M.walk_forward(df, ["a", "b", "c", "twice", "void"], "Season").collect()}
    by = {(r.capacity, r.Season, r.i): r.p for r in got}
    assert {k[0] for k in by} == {1, 2, 64} and all(by[64, *k] == pytest.approx(p, abs=1e-9) for k, p in full.items())
    x = np.array([[v or 0.0 for v in r[2:5]] for r in rows if r[0] < 2003])
    y = np.array([r[7] for r in rows if r[0] < 2003])
    r = np.abs(x.T @ (2 * y - 1)) / np.sqrt(len(x) * (x * x).sum(axis=0))
    for cap in (1, 2):
        on = np.argsort(-r)[:cap]
        sd = np.sqrt((x[:, on] ** 2).mean(axis=0))
        w = logistic(x[:, on] / sd, y, 0.1)
        for q in rows:
            if q[0] == 2003:
                z = np.array([q[2 + j] or 0.0 for j in on]) / sd @ w
                assert by[cap, 2003, q[1]] == pytest.approx(squash(z), abs=1e-8)


def test_arms_screen_and_embed_the_additional_features(spark):
    rows, df = league(spark)
    audit = {(r.Season, r.feature): r for r in V.extra_audit(df, ["a"], ["b", "c", "twice", "void"], "Season").collect()}
    assert [audit[2003, f].status for f in ("b", "c", "twice", "void")] == ["retained", "retained", "redundant_base", "all_missing"]
    x = np.array([[v or 0.0 for v in r[2:5]] for r in rows if r[0] < 2003])
    y = 2.0 * np.array([r[7] for r in rows if r[0] < 2003]) - 1
    left = lambda v: v - x[:, 0] * (x[:, 0] @ v) / (x[:, 0] @ x[:, 0])
    cos = lambda u, v: abs(u @ v) / np.sqrt((u @ u) * (v @ v))
    assert audit[2003, "b"].beyond == pytest.approx(cos(left(x[:, 1]), left(y)), abs=1e-9) and audit[2003, "b"].association == pytest.approx(cos(x[:, 1], y), abs=1e-9)
    assert audit[2003, "twice"].beyond == 0 and audit[2003, "void"].beyond == 0
    got = {(r.arm, r.Season, r.i): r.p for r in V.walk_forward_arms(df, ["a"], ["b", "c", "twice", "void"], "Season", components=2).collect()}
    base = {(r.Season, r.i): r.p for r in M.walk_forward(df, ["a"], "Season").collect()}
    screened = {(r.Season, r.i): r.p for r in M.walk_forward(df, ["a", "b", "c"], "Season").collect()}
    assert all(got["base", *k] == pytest.approx(p, abs=1e-9) for k, p in base.items()) and all(got["screened", *k] == pytest.approx(p, abs=1e-9) for k, p in screened.items())
    scaled = np.column_stack([x[:, 1:], x[:, 0]]) / np.sqrt((np.column_stack([x[:, 1:], x[:, 0]]) ** 2).mean(axis=0))
    values, v = np.linalg.eigh(scaled.T @ scaled / len(x))
    z = np.column_stack([x[:, 0] / np.sqrt((x[:, 0] ** 2).mean()), scaled @ v[:, ::-1][:, :2] / np.sqrt(values[::-1][:2])])
    w = logistic(z, (y + 1) / 2, 0.1)
    for q in rows:
        if q[0] == 2003:
            own = np.array([q[3] or 0, q[4] or 0, q[2]]) / np.sqrt((np.column_stack([x[:, 1:], x[:, 0]]) ** 2).mean(axis=0))
            at = np.concatenate([[q[2] / np.sqrt((x[:, 0] ** 2).mean())], own @ v[:, ::-1][:, :2] / np.sqrt(values[::-1][:2])])
            assert got["embedding", 2003, q[1]] == pytest.approx(squash(at @ w), abs=1e-7)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 5))
def test_leading_directions_are_eigenvectors(seed, n, k):
    x = np.random.default_rng(seed).normal(size=(n + 3, n)) * np.linspace(1, 3, n)
    m = x.T @ x
    values, v = V.leading_directions(m, k)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][: len(values)], rtol=1e-8) and np.allclose(m @ v, v * values, atol=1e-6 * np.abs(m).max())
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)


def test_fits_that_do_not_converge_raise(spark):
    df = league(spark)[1]
    with pytest.raises(M.NotConverged):
        M.fold_logistic(df, ["a"], "y", "Season", {0: (2003, np.eye(1))}, 1.0, steps=1)
    with pytest.raises(M.NotConverged):
        V.leading_directions(np.diag([1.0, 0.999999, 0.5, 0.4, 0.3, 0.2, 0.1]) + 1e-3, 1, steps=1)


# persisted models


def test_scores_after_loading_are_those_before(spark, tmp_path):
    df = league(spark)[1]
    model = P.fitted_model(["a", "b", "void"], ["retained", "capacity", "retained"], [0.5, 9.0, -2.0])
    path = f"file://{tmp_path}/model"
    key = P.save_model(spark, model, path)
    loaded = P.load_model(spark, path, key)
    want = {(r.Season, r.i): squash(0.5 * r.a) for r in df.collect()}
    for m in (model, loaded):
        got = m.transform(df)
        assert got.columns == [*df.columns, "p"] and all(r.p == pytest.approx(want[r.Season, r.i]) for r in got.collect())
    assert loaded.stages[0].kept() == ["a", "void"]
    with pytest.raises(ValueError, match="missing"):
        loaded.transform(df.drop("b"))
    with pytest.raises(Exception, match="infinite"):
        loaded.transform(df.withColumn("b", F.lit(float("inf")))).collect()


def test_changed_or_unfinished_models_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    key = P.save_model(spark, P.fitted_model(["a"], ["retained"], [0.5]), path)
    with pytest.raises(ValueError, match="other bytes"):
        P.load_model(spark, path, "0" * 64)
    part = next(p for p in (tmp_path / "model").rglob("part-*") if p.stat().st_size and not p.name.endswith(".crc"))
    part.write_text(part.read_text().replace("0.5", "0.6") + " ")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="other bytes"):
        P.load_model(spark, path, key)
    (tmp_path / "model" / "fingerprint.json").unlink()
    with pytest.raises(FileNotFoundError):
        P.load_model(spark, path)


def test_an_unsolved_system_raises():
    from fieldglass.operators.ratings import conjugate_gradients

    m = np.diag(np.linspace(1, 1e6, 50))
    assert np.allclose(m @ conjugate_gradients(lambda v: m @ v, np.ones(50)), 1)
    with pytest.raises(M.NotConverged):
        conjugate_gradients(lambda v: m @ v, np.ones(50), steps=3)


def test_a_failing_replacement_leaves_the_old_file(spark, tmp_path):
    from fieldglass.store import Files, write_json

    at = f"file://{tmp_path}"
    write_json(spark, f"{at}/latest.json", {"x": 1})
    write_json(spark, f"{at}/latest.json", {"x": 2})
    assert Files(spark).read(f"{at}/latest.json") == b'{"x":2}\n'
    (tmp_path / "taken" / "inner").mkdir(parents=True)  # a folder with content can't be replaced
    with pytest.raises(OSError):
        Files(spark).write(f"{at}/taken", b"x")
    assert (tmp_path / "taken" / "inner").is_dir() and not list(tmp_path.glob("*.tmp"))
