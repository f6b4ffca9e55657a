"""Exact quantiles by counting, against numpy and another engine's sort."""

import math

import numpy as np
import pytest

from trajspark.operators import selection as se
from trajspark.operators.relational import describe_by

P = [0.0, 0.025, 0.25, 0.5, 0.75, 0.99, 1.0]


def expected(values):
    known = sorted((v for v in values if v is not None),
                   key=lambda v: (math.isnan(v), v))
    if not known:
        return 0, None
    out = []
    for p in P:
        at = p * (len(known) - 1)
        lo, hi = known[math.floor(at)], known[math.ceil(at)]
        out.append(lo if lo == hi or at == math.floor(at) else
                   (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
    return len(known), out


def groups():
    rng = np.random.default_rng(3)
    wide = 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1, 1], 3000)
    return {
        "even": list(rng.normal(size=2500)),
        "hot": [7.0] * 4000 + list(rng.normal(7, 1, 900)),
        "wide": [float(x) for x in wide],
        "steps": [float(x) for x in rng.integers(0, 400, 5000)],
        "odd": [float("nan")] * 40 + [float("inf"), float("-inf"), None]
        + list(rng.normal(size=500)),
        "one": [2.5], "none": [None, None],
        None: list(rng.normal(size=700)) + [None]}


@pytest.mark.parametrize("held", [1, 20, 300, 100_000])
def test_summary_equals_sorting(spark, held):
    """Ranges are narrowed below every group's size, or not at all."""
    rows = [(k, None if v is None else float(v))
            for k, vs in groups().items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in se.summarise(df, ["g"], "v", P, held).collect()}
    assert set(got) == set(groups())
    for k, vs in groups().items():
        n, q = expected([None if v is None else float(v) for v in vs])
        assert got[k].n == n
        if q is None:
            assert got[k].min is None and not got[k].q
            continue
        assert np.allclose(got[k].q, q, rtol=1e-12, atol=0, equal_nan=True)
        known = [v for v in vs if v is not None]
        if k not in ("odd", "wide"):
            assert got[k].mean == pytest.approx(np.mean(known))
            assert (got[k].min, got[k].max) == (min(known), max(known))


@pytest.mark.parametrize("held", [10, 100_000])
def test_whole_column_and_empty_table(spark, held):
    df = spark.range(1001).selectExpr("CAST(id % 777 AS DOUBLE) AS v")
    xs = [i % 777 for i in range(1001)]
    assert se.quantile(df, "v", 0.55, held).first().q == pytest.approx(
        np.quantile(xs, 0.55))
    none = df.filter("v < 0")
    assert se.quantile(none, "v", 0.5, held).first().q is None
    assert se.summarise(none.selectExpr("v", "1 AS g"), ["g"], "v", [0.5],
                        held).count() == 0


def test_describe_keeps_the_kind_of_column(spark):
    df = spark.range(10).selectExpr("id % 2 AS g", "CAST(id AS INT) AS v")
    out = describe_by(df, ["g"], "v")
    assert dict(out.dtypes)["min"] == dict(out.dtypes)["max"] == "int"
    assert sorted((r.g, r.n, r.min, r.q50, r.max) for r in out.collect()) \
        == [(0, 5, 0, 4.0, 8), (1, 5, 1, 5.0, 9)]
