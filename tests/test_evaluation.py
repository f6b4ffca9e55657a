import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions.special import (beta_cdf, binomial_interval,
                                         t_two_sided)
from trajspark.operators import evaluation as ev
from trajspark.operators import policies as po
from trajspark.operators import regression as rg
from trajspark.operators import reports as rp
from trajspark.operators.scan import ChunkedScan


def binom_tail(n, r, p):
    return sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k)
               for k in range(r, n + 1))


def test_binomial_interval_inverts_the_tail():
    for r, n in ((3, 10), (50, 80), (1, 7)):
        lo, hi = binomial_interval(r, n)
        assert binom_tail(n, r, lo) == pytest.approx(.025, abs=1e-9)
        assert 1 - binom_tail(n, r + 1, hi) == pytest.approx(.025, abs=1e-9)
    assert binomial_interval(0, 5)[0] == 0 and binomial_interval(5, 5)[1] == 1


def test_t_and_beta():
    assert beta_cdf(.3, 1, 1) == pytest.approx(.3)
    # One degree of freedom is the Cauchy distribution.
    assert t_two_sided(2.0, 1) == pytest.approx(
        1 - 2 / math.pi * math.atan(2.0))


def test_wis_and_bootstrap(spark):
    r = np.random.default_rng(0)
    rows = [("A", int(i), 0, float(r.normal(5, 2)), float(r.uniform(.5, 2)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "trial string, subjid long, trajid long, "
                                     "value double, p_weight double")
    got = {x["policy"]: x["value"] for x in ev.wis(df, ["p"]).collect()}
    v = np.array([x[3] for x in rows])
    w = np.array([x[4] for x in rows])
    assert got["clinician"] == pytest.approx(v.mean())
    assert got["p"] == pytest.approx((v * w).sum() / w.sum())
    ci = {x["policy"]: x for x in ev.bootstrap_interval(
        ev.bootstrap(df, ["p"], 400)).collect()}
    half = 1.96 * v.std() / np.sqrt(300)
    assert ci["clinician"]["lower"] == pytest.approx(v.mean() - half, abs=.08)
    assert ci["clinician"]["upper"] == pytest.approx(v.mean() + half, abs=.08)


def test_bootstrap_draws(spark):
    """The draws of the md5 by trajectory and replicate, with nulls in keys,
    values and weights; no trajectory becomes rows of its own."""
    import hashlib
    from trajspark.functions.columns import poisson_bounds
    rows = [("A", 1, 0, 2.0, 0.5, 1.0), ("A", 2, 1, 3.0, None, 2.0),
            (None, 3, 0, None, 1.5, 0.25), ("B", None, None, 1.0, 2.0, 0.0),
            (None, None, None, 5.0, 0.1, 4.0), ("é|", 1, 0, -1.0, 3.0, 1.0)]
    df = spark.createDataFrame(
        rows, "trial string, subjid long, trajid long, value double, "
              "p_weight double, q_weight double").repartition(3)
    out = ev.bootstrap(df, ["p", "q"], 10, seed=7)
    assert out.schema.simpleString() == \
        "struct<replicate:int,policy:string,value:double>"
    assert "Generate" not in out._jdf.queryExecution().executedPlan() \
        .toString()
    got = {(x["replicate"], x["policy"]): x["value"] for x in out.collect()}
    want = {}
    for rep in range(10):
        draws = []
        for r in rows:
            text = "|".join(["7", str(rep // 4),
                             *[str(k) for k in r[:3] if k is not None]])
            at = 8 * (rep % 4)
            u = int(hashlib.md5(text.encode()).hexdigest()[at:at + 8], 16)
            draws.append(sum(u / 2 ** 32 >= b for b in poisson_bounds()))
        n = sum(draws)
        want[rep + 1, "clinician"] = sum(
            c * r[3] for c, r in zip(draws, rows) if r[3] is not None) / n \
            if n else None
        for i, p in ((4, "p"), (5, "q")):
            w = sum(c * r[i] for c, r in zip(draws, rows) if r[i] is not None)
            wv = sum(c * r[i] * r[3] for c, r in zip(draws, rows)
                     if r[i] is not None and r[3] is not None)
            want[rep + 1, p] = wv / w if w else None
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k] == (x if x is None else pytest.approx(x))
    assert ev.bootstrap(df.limit(0), ["p"], 10).count() == 0
    none = df.withColumn("value", F.lit(None).cast("double"))
    assert {x["value"] for x in ev.bootstrap(none, ["p"], 5).collect()} == \
        {None}


def test_auroc_and_spearman_on_chunks(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(3), 200).round(2)
    y = [int(r.choice(3, p=x / x.sum())) for x in p]
    df = spark.createDataFrame(
        [(x.tolist(), int(k)) for x, k in zip(p, y)],
        "p array<double>, y int")
    want = []
    for c in range(3):
        pos = [x[c] for x, k in zip(p, y) if k == c]
        neg = [x[c] for x, k in zip(p, y) if k != c]
        want.append(np.mean([(a > b) + .5 * (a == b)
                             for a in pos for b in neg]))
    for scan in (None, ChunkedScan(5)):
        kw = {} if scan is None else {"scan": scan}
        assert ev.auroc_ovr(df, **kw).first()[0] == pytest.approx(
            np.mean(want))
    z = df.withColumn("z", F.col("p")[0])
    ranks = z.toPandas()[["y", "z"]].rank().corr().iloc[0, 1]
    assert ev.spearman(z, "y", "z").first()[0] == pytest.approx(ranks)
    assert ev.spearman(z, "y", "z", ChunkedScan(4)).first()[0] == \
        pytest.approx(ranks)


def test_contrast_matches_full_model(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b = float(r.uniform(0, .1)), float(r.uniform(0, .1))
        rows.append((a, b, float(r.uniform(0, 1)), int(r.integers(1, 300)),
                     int(r.random() < .3 + .3 * (a < .05))))
    df = spark.createDataFrame(
        rows, "policy_diff double, threshold_diff double, ttr double, "
              "length int, any_event int")
    out = rg.contrast_tests(df, [], [.05]).first()
    d = df.withColumns({
        "p": (F.col("policy_diff") < .05).cast("double"),
        "t": (F.col("threshold_diff") < .05).cast("double")})
    d = d.withColumns({"s": F.col("p") + F.col("t"),
                       "b": F.col("p") * F.col("t")})
    # The first coefficient of y ~ (p + t) + p is the contrast at -1/2 ...
    # so use y ~ p + s, where the coefficient of p is beta_p - beta_t.
    lin = {x["term"]: x for x in rg.wls(d, "ttr", ["p", "s"], "length")
           .collect()}
    assert out["ttr_t"] == pytest.approx(lin["p"]["statistic"], rel=1e-6)
    log = {x["term"]: x for x in rg.logit(d, "any_event", ["p", "s", "b"])
           .collect()}
    assert out["any_event_z"] == pytest.approx(log["p"]["statistic"],
                                               rel=1e-4)


def test_random_intercept_recovers_groups(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(60):
        b = r.normal(0, 2)
        for _ in range(int(r.integers(3, 12))):
            x = float(r.normal())
            rows.append((g, x, float(1 + 3 * x + b + r.normal(0, 1))))
    df = spark.createDataFrame(rows, "g int, x double, y double")
    fit = {x["term"]: x for x in rg.random_intercept(df, "y", ["x"], "g")
           .collect()}
    assert fit["x"]["estimate"] == pytest.approx(3, abs=.15)
    assert fit["var_residual"]["estimate"] == pytest.approx(1, abs=.25)
    assert fit["var_group"]["estimate"] == pytest.approx(4, abs=1.8)

    # The likelihood is highest there.
    pd_ = df.toPandas()

    def loglik(beta, sb, se):
        total = 0.0
        for _, d in pd_.groupby("g"):
            n = len(d)
            v = se * np.eye(n) + sb
            e = d["y"] - beta[0] - beta[1] * d["x"]
            total -= .5 * (np.linalg.slogdet(v)[1]
                           + e @ np.linalg.solve(v, e))
        return total

    b = [fit["intercept"]["estimate"], fit["x"]["estimate"]]
    sb, se = (fit[k]["estimate"] for k in ("var_group", "var_residual"))
    best = loglik(b, sb, se)
    for db, ds, de in ((.02, 0, 0), (-.02, 0, 0), (0, .1, 0), (0, -.1, 0),
                       (0, 0, .02), (0, 0, -.02)):
        assert loglik([b[0], b[1] + db], sb + ds, se + de) < best


def test_cox_score_is_zero(spark):
    r = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        x, z = float(r.normal()), float(r.integers(0, 2))
        t = r.exponential(1 / np.exp(.7 * x - .4 * z)) * 100
        rows.append((int(min(t, 150)) + 1, int(t < 150), x, z))
    df = spark.createDataFrame(rows, "t int, d int, x double, z double")
    fit = {f["term"]: f for f in rg.cox_ph(df, "t", "d", ["x", "z"])
           .collect()}
    b = np.array([fit["x"]["estimate"], fit["z"]["estimate"]])
    a = np.array(rows, dtype=float)
    score = np.zeros(2)
    for t, d, *x in a:
        if d:
            risk = a[a[:, 0] >= t]
            w = np.exp(risk[:, 2:] @ b)
            score += np.array(x) - (w @ risk[:, 2:]) / w.sum()
    assert np.allclose(score, 0, atol=1e-6)
    assert abs(b[0] - .7) < .25


def test_fitted_q_against_loops(spark):
    r = np.random.default_rng(5)
    rows = [(int(r.integers(0, 4)), int(r.integers(0, 3)),
             int(r.integers(1, 9)), float(r.random()),
             float(r.random() < .8), int(r.integers(0, 4)))
            for _ in range(300)]
    df = spark.createDataFrame(
        rows, "state long, option int, k int, reward double, not_done double, "
              "next_state long")
    got = {(x["state"], x["option"]): x["q"]
           for x in po.fitted_q(df, .3, .9, 5, .7).collect()}
    n = np.zeros((4, 3))
    for s, o, *_ in rows:
        n[s, o] += 1
    ok = n / n.max(axis=1, keepdims=True) >= .3
    q = np.zeros((4, 3))
    for _ in range(5):
        v = np.where(ok & (n > 0), q, -np.inf).max(axis=1)
        t = np.zeros((4, 3))
        for s, o, k, rew, nd, s2 in rows:
            t[s, o] += rew + nd * .9 ** k * v[s2]
        q = .7 * t / np.maximum(n, 1) + .3 * q
    for (s, o), x in got.items():
        assert x == pytest.approx(q[s, o])


def test_classification_table(spark):
    rows = []
    for a in ("POLICY", "RANDOM"):
        for s in ("sensitivity", "specificity"):
            rows += [(f"{a}/classification/{s}", .5),
                     (f"{a}/classification/{s}_lower", .4),
                     (f"{a}/classification/{s}_upper", .6)]
    out = rp.classification_table(spark.createDataFrame(
        rows, "metric string, value double")).collect()
    assert len(out) == 2
    assert out[0]["sensitivity"] == "50.0% (40.0%, 60.0%)"
