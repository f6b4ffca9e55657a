"""Local regression from sums of bins, against weighted least squares."""

import numpy as np
import pytest

from trajspark import params as P
from trajspark.operators import reports as rp


def brute(x, y, w, at, span, mids):
    """Least squares with kernel weights, row by row."""
    order = np.unique(mids)
    dist = np.abs(order - at)
    count = np.array([(mids == m).sum() for m in order])
    h = min(d for d in dist if count[dist <= d].sum() >= span * len(x))
    far = np.abs(mids - at)
    k = (far == 0).astype(float) if h == 0 else np.where(
        far < 1.001 * h, (1 - np.minimum(far / (1.001 * h), 1) ** 3) ** 3, 0)
    c = k * w
    X = np.column_stack([np.ones_like(x), x - at])
    G = X.T @ (X * c[:, None])
    inv = np.linalg.inv(G)
    beta = inv @ (X.T @ (c * y))
    rss = (c * (y - X @ beta) ** 2).sum()
    spread = inv @ (X.T @ (X * (k * c)[:, None])) @ inv
    return beta[0], np.sqrt(rss / (k.sum() - 2) * spread[0, 0])


def test_curve_equals_least_squares(spark):
    r = np.random.default_rng(5)
    n = 800
    d = {a: r.gamma(2, .08, n) for a in P.MODEL_NAMES}
    ttr, length = r.uniform(0, 1, n), r.integers(1, 400, n)
    ev = (r.uniform(size=n) < .2).astype(int)
    rows = [(float(ttr[i]), int(length[i]), int(ev[i]),
             *[float(d[a][i]) for a in d]) for i in range(n)]
    df = spark.createDataFrame(rows, "ttr double, length long, stroke int, "
                               + ", ".join(f"{a}_diff double" for a in d))
    got = {(g.model, g.outcome, g.x): g for g in
           rp.agreement_smooth(df, ["stroke"]).collect()}
    assert len(got) == 4 * 2 * 51
    for a, name in P.MODEL_NAMES.items():
        x = d[a] * 100
        use = x <= 50
        x = x[use]
        mids = np.minimum(np.floor(x), 49) + .5
        for outcome, y, w in (("ttr", ttr[use] * 100, length[use]),
                              ("stroke", ev[use], np.ones(use.sum()))):
            for at in (0, 7, 23, 50):
                fit, se = brute(x, y, w.astype(float), at, .75, mids)
                g = got[name, outcome, float(at)]
                assert g.fit == pytest.approx(fit, rel=1e-6)
                assert g.se == pytest.approx(se, rel=1e-6)


def test_curve_of_few_rows(spark):
    """Nothing left, one row, and rows that don't vary."""
    cols = "ttr double, length long, stroke int, " + ", ".join(
        f"{a}_diff double" for a in P.MODEL_NAMES)
    none = spark.createDataFrame([(.5, 3, 0, .9, None, float("nan"), .7)],
                                 cols)
    assert rp.agreement_smooth(none, ["stroke"]).count() == 0
    same = spark.createDataFrame([(.5, 3, 1, .1, .1, .1, .1)] * 3, cols)
    got = rp.agreement_smooth(same, ["stroke"]).collect()
    assert {(g.outcome, round(g.fit, 9)) for g in got
            if g.fit is not None} == {("ttr", 50.0), ("stroke", 1.0)}
