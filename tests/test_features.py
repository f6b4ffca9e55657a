import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from trajspark.operators import features as fe
from trajspark.operators import transitions as tn
from trajspark.params import VALUE_DOSE, Params
from trajspark.plans import pipeline as pl
from trajspark.session import cut_lineage
from trajspark.sources import adapter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trajectories(spark):
    return cut_lineage(pl.build_trajectories(
        adapter.visits(spark, SF), adapter.events(spark, SF),
        adapter.baseline(spark, SF)))


def uniform(train, new):
    """Positions by numpy."""
    refs = np.linspace(0, 1, len(np.unique(train)))
    q = np.percentile(train, refs * 100)
    y = .5 * (np.interp(new, q, refs)
              - np.interp(-new, -q[::-1], -refs[::-1]))
    return np.where(new <= q[0], 0.0, np.where(new >= q[-1], 1.0, y))


@pytest.mark.parametrize("lookup", [1 << 10, 0])
def test_quantile_uniform(spark, lookup):
    """By bisection and by merging: ties, one value, many, none twice."""
    r = np.random.default_rng(1)
    for train in (np.array([1.0, 1.0, 1.0, 2.0, 2.5, 4.0, 4.0, 7.0]),
                  np.array([3.0]), np.array([3.0, 3.0, 3.0]),
                  np.array([1.0, 2.0]), r.normal(size=301),
                  np.round(r.normal(size=500), 1),
                  np.repeat([0.0, 5.0, 6.0], [90, 3, 1])):
        df = spark.createDataFrame([(float(v),) for v in train], "x double")
        fit = fe.QuantileUniform("x", lookup).fit(df)
        new = np.concatenate([train, train + .03, [-99.0, 99.0]])
        rows = spark.createDataFrame(
            [(i, float(v)) for i, v in enumerate(new)] + [(-1, None)],
            "i int, x double")
        got = {q["i"]: q["u"] for q in fit.transform(rows, "u").collect()}
        assert got.pop(-1) is None and len(got) == len(new)
        want = uniform(train, new)
        assert np.allclose([got[i] for i in range(len(new))], want)
        over = fit.transform(rows)
        assert over.columns == ["i", "x"] and over.count() == len(new) + 1
        knots = fit.knots.orderBy("x").collect()
        assert len({k["x"] for k in knots}) == len(knots)
        q = np.concatenate([[k["x"]] * (k["hi"] - k["lo"] + 1)
                            for k in knots])
        m = len(np.unique(train))
        assert np.allclose(q, np.percentile(train, np.linspace(0, 100, m)))


def test_quantile_uniform_of_many_values(spark, monkeypatch):
    """More values than one task orders, and a value in most rows."""
    from trajspark.operators import scan
    monkeypatch.setattr(scan, "HOT_ROWS", 100)
    r = np.random.default_rng(2)
    train = np.concatenate([r.normal(size=900), np.full(2000, .25)])
    df = spark.createDataFrame([(float(v),) for v in train], "x double")
    fit = fe.QuantileUniform("x", 50).fit(df)
    assert fit.size > 200
    got = {q["x"]: q["u"] for q in fit.transform(df, "u").collect()}
    at = np.array(sorted(got))
    assert np.allclose([got[v] for v in at], uniform(train, at))
    with pytest.raises(ValueError):
        fit.fit(df.filter("x > 1e9"))


def test_min_max_and_one_hot(spark):
    df = spark.createDataFrame(
        [(1.0, 5, "b"), (3.0, 5, "a"), (2.0, 5, None)],
        "x double, c int, k string")
    out = fe.MinMax(("x", "c")).fit(df).transform(df)
    assert rows_of(out, "x", "c") == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    hot = fe.OneHotDropFirst(("k",)).fit(df)
    assert [r["k_b"] for r in hot.transform(df).collect()] == [1.0, 0.0, None]
    new = spark.createDataFrame([("z",)], "k string")
    with pytest.raises(Exception, match="unknown level"):
        hot.transform(new).collect()


def test_prev_values_cascade(frame):
    df = frame([("A", 1, 0, d, v) for d, v in
                enumerate([1.0, None, 3.0, 4.0, 5.0])],
               "trial string, subjid long, trajid long, study_day int, "
               "value double")
    out = fe.prev_values(df, "value")
    assert rows_of(out, "study_day", *[f"value_prev_{i}" for i in
                                       range(1, 5)]) == [
        (0, 1.0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 1.0),
        (2, 3.0, 1.0, 1.0, 1.0), (3, 3.0, 3.0, 1.0, 1.0),
        (4, 4.0, 3.0, 3.0, 1.0)]


def test_reward_by_hand(frame):
    df = frame([("A", 1, 0, d, 2.5, 1.0, e, 0, 0) for d, e in
                ((0, 0), (3, 0), (5, 1))],
               "trial string, subjid long, trajid long, study_day int, value "
               "double, dose double, stroke int, hem_stroke int, "
               "major_bleed int")
    ev = ("stroke", "hem_stroke", "major_bleed")
    out = tn.transition_reward(df, ev, .5, 1.0, -1.0)
    assert rows_of(out, "study_day", "reward") == [
        (0, 1.75), (3, 1.0), (5, None)]


def test_reward_equals_daily_sum(trajectories):
    ev = Params().events_evaluated
    key = ["trial", "subjid", "trajid", "study_day"]
    for gamma in (.99, 1.0):
        a = tn.transition_reward(trajectories, ev, gamma, 1.0, -.5).select(
            *key, F.col("reward").alias("a"))
        b = tn.transition_reward_daily(trajectories, ev, gamma, 1.0, -.5)
        both = a.join(b, key)
        assert both.count() == trajectories.count()
        bad = both.filter(~F.coalesce(
            F.abs(F.col("a") - F.col("reward")) < 1e-9,
            F.col("a").isNull() & F.col("reward").isNull()))
        assert bad.count() == 0


def test_transitions(trajectories):
    train = trajectories.filter("trial <> 'RELY'")
    test = trajectories.filter("trial = 'RELY'")
    out, fit = tn.build_transitions(train, VALUE_DOSE, min_length=1)
    out = cut_lineage(out)
    names = fit.state_names()
    assert names[:2] == ["value", "dose"] and "dose_prev_4" in names
    assert out.agg(F.sum("sample_prob")).first()[0] == pytest.approx(1.0)
    assert out.filter("not_done not in (0, 1) or option not between 0 and 6") \
        .count() == 0
    assert out.na.drop().count() == out.count() > 50
    again, _ = tn.build_transitions(test, VALUE_DOSE, fit, min_length=1)
    assert again.columns == out.columns
    drawn = tn.weighted_sample(out, "sample_prob", 300, seed=3)
    assert drawn.agg(F.sum("draws")).first()[0] == 300
    same = tn.weighted_sample(out, "sample_prob", 300, seed=3)
    assert drawn.exceptAll(same).count() == 0


def test_total_weight_reads_no_next_state(trajectories):
    out, _ = tn.build_transitions(trajectories, VALUE_DOSE, min_length=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Once for the rows, and not again for the sum of their weights.
    assert plan.count("lead(dose_prev_4#") == 1
    assert plan.count("lead(__whole#") == 2


def test_whole_rows_are_those_without_null_or_nan(spark):
    df = spark.createDataFrame(
        [(1.0, 1), (None, 1), (float("nan"), 1), (1.0, None)],
        "a double, b int")
    kept = df.filter(tn.whole(df, ["a", "b"]))
    assert [tuple(r) for r in kept.collect()] == [(1.0, 1)]
    assert df.na.drop().exceptAll(kept).count() == 0


def test_weighted_sample_follows_weights(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 10, 99.0)
                                  .otherwise(1.0).alias("w"))
    out = tn.weighted_sample(df, "w", 20000, 5, keys=("id",), buckets=7)
    top = out.filter("id < 10").agg(F.sum("draws")).first()[0]
    assert abs(top / 20000 - .5) < .02


def test_missing_states(trajectories):
    rows = tn.eligible_rows(trajectories, VALUE_DOSE, 1)
    fit = fe.StateBuilder(VALUE_DOSE).fit(rows)
    n = tn.missing_states(rows, fit.transform(rows),
                          VALUE_DOSE.events_kept, ["value"]).first()[0]
    assert n == 0
