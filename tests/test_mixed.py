"""Random effects of nested groups against dense matrices."""

import numpy as np
import pytest

from trajspark.operators import mixed as mx
from trajspark.operators import regression as rg


def nested(seed=0, n=120, centre=1.5, country=1.0):
    r = np.random.default_rng(seed)
    cs = r.integers(0, 15, n)
    ks = cs % 5
    u, v = r.normal(0, centre, 15), r.normal(0, country, 5)
    a, b = r.normal(size=n), (ks % 2).astype(float)
    y = 2 + .7 * a - b + u[cs] + v[ks] + r.normal(0, 1, n)
    return [(int(c), f"k{k}", float(s), float(t), float(w))
            for c, k, s, t, w in zip(cs, ks, a, b, y)]


SCHEMA = "centre int, country string, a double, b double, y double"


def deviance(rows, ratios, reml):
    """By the whole covariance matrix."""
    x = np.array([[1, r[2], r[3]] for r in rows])
    y = np.array([r[4] for r in rows])
    v = np.eye(len(rows))
    for i, ratio in enumerate(ratios):
        g = np.array([r[i] if i else (r[0], r[1]) for r in rows], dtype=str)
        g = np.array(["|".join(np.atleast_1d(s)) for s in g])
        v += ratio * (g[:, None] == g[None, :])
    w = np.linalg.inv(v)
    info = x.T @ w @ x
    beta = np.linalg.solve(info, x.T @ w @ y)
    e = y - x @ beta
    free = len(y) - (3 if reml else 0)
    var = e @ w @ e / free
    dev = free * np.log(var) + np.linalg.slogdet(v)[1]
    if reml:
        dev += np.linalg.slogdet(info)[1]
    return dev, beta, np.sqrt(np.diag(np.linalg.inv(info)) * var), var


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model_equals_dense_likelihood(spark, reml):
    rows = nested()
    df = spark.createDataFrame(
        [*rows, (None, "k1", 1.0, 1.0, 1.0), (1, "k1", None, 1.0, 1.0)],
        SCHEMA).repartition(3)
    fit = {r["term"]: r for r in mx.mixed_model(
        df, "y", ["a", "b"], ["centre", "country"], reml).collect()}
    var = fit["var_residual"]["estimate"]
    ratios = [fit[f"var_{c}"]["estimate"] / var for c in
              ("centre", "country")]
    dev, beta, err, dense_var = deviance(rows, ratios, reml)
    assert var == pytest.approx(dense_var)
    for t, b, e in zip(("intercept", "a", "b"), beta, err):
        assert fit[t]["estimate"] == pytest.approx(b)
        assert fit[t]["std_error"] == pytest.approx(e)
    # Nothing near is better.
    for f in (.9, .99, 1.01, 1.1):
        for i in (0, 1):
            near = list(ratios)
            near[i] *= f
            assert deviance(rows, near, reml)[0] > dev - 1e-6


def test_no_variance_between_groups(spark):
    """Groups that don't differ: least squares."""
    r = np.random.default_rng(5)
    rows = []
    for c in range(10):
        e = r.normal(size=8)
        a = r.normal(size=8)
        e, a = e - e.mean(), a - a.mean()
        rows += [(c, f"k{c % 2}", float(s), 0.0, float(2 + s + t))
                 for s, t in zip(a, e)]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = {x["term"]: x for x in mx.mixed_model(
        df, "y", ["a"], ["centre", "country"]).collect()}
    ols = {x["term"]: x for x in rg.wls(df, "y", ["a"]).collect()}
    assert fit["var_centre"]["estimate"] == 0.0
    assert fit["a"]["estimate"] == pytest.approx(ols["a"]["estimate"])
    assert fit["a"]["std_error"] == pytest.approx(ols["a"]["std_error"])
    with pytest.raises(ValueError):
        mx.mixed_model(df.limit(1), "y", ["a"], ["centre"])


def test_one_level_equals_random_intercept(spark):
    df = spark.createDataFrame(nested(2, country=0.0), SCHEMA)
    a = {r["term"]: r for r in mx.mixed_model(
        df, "y", ["a"], ["centre"], reml=False).collect()}
    b = {r["term"]: r for r in rg.random_intercept(
        df, "y", ["a"], "centre").collect()}
    assert a["a"]["estimate"] == pytest.approx(b["a"]["estimate"], rel=1e-4)
    assert a["var_centre"]["estimate"] == pytest.approx(
        b["var_group"]["estimate"], rel=1e-2)


def survival(seed=0, n=90):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g, a, b = int(r.integers(0, 9)), r.normal(), r.normal()
        t = r.exponential(np.exp(-.5 * a - (g % 3 - 1)))
        rows.append((g, float(np.ceil(10 * t)), float(r.random() < .8),
                     float(a), float(b)))
    return rows


def penalised(rows, variance, rounds=60):
    """Coefficients by Newton steps on all effects at once."""
    t, d = (np.array([r[i] for r in rows]) for i in (1, 2))
    g = sorted({r[0] for r in rows})
    x = np.array([[r[3], r[4], *[float(r[0] == k) for k in g]] for r in rows])
    x[:, :2] -= x[:, :2].mean(0)
    ridge = np.diag([0, 0, *[1 / variance] * len(g)])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        e = np.exp(x @ b)
        grad, info = -ridge @ b, ridge.copy()
        for i in np.flatnonzero(d):
            at = t >= t[i]
            m = (e[at, None] * x[at]).sum(0) / e[at].sum()
            grad += x[i] - m
            info += (x[at].T @ (x[at] * e[at, None])) / e[at].sum() \
                - np.outer(m, m)
        b += np.linalg.solve(info, grad)
    return b[:2]


def test_cox_with_groups(spark):
    rows = survival()
    df = spark.createDataFrame(
        [*rows, (None, 1.0, 1.0, 1.0, 1.0)],
        "site int, days double, event double, a double, b double")
    fit = {r["term"]: r for r in mx.cox_groups(
        df, "days", "event", ["a", "b"], "site", variance=.4,
        tol=1e-5).collect()}
    want = penalised(rows, .4)
    assert fit["a"]["estimate"] == pytest.approx(want[0], abs=1e-4)
    assert fit["b"]["estimate"] == pytest.approx(want[1], abs=1e-4)
    assert fit["var_site"]["estimate"] == .4
    assert 0 < fit["a"]["std_error"] < .5
    with pytest.raises(ArithmeticError):
        mx.cox_groups(df, "days", "event", ["a"], "site", max_iter=1)
