import math

from helpers import rows_of
from pyspark.sql import functions as F

from trajspark.functions import columns as fc
from trajspark.operators import evaluation as ev
from trajspark.operators import policies as po
from trajspark.operators import relational as rel


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def test_decision_codes(frame):
    r = [.79, .8, .9, 1.0, 1.1, 1.2, 1.21, None, math.inf]
    df = frame([(i, x) for i, x in enumerate(r)], "i int, r double")
    codes = rows_of(df.select("i", fc.decision_code("r").alias("c")))
    assert [c for _, c in codes] == [0, 1, 2, 3, 4, 5, 6, None, 6]


def test_relative_change(frame):
    df = frame([(2.0, 1.0), (0.0, 0.0), (3.0, 0.0), (None, 1.0)],
               "a double, b double")
    out = [r[0] for r in df.select(fc.relative_change("a", "b")).collect()]
    assert out == [2.0, 1.0, math.inf, None]


def test_rule_policy(frame):
    v = [1.5, 1.99, 2.0, 3.0, 3.01, 4.99, 5.0, None]
    df = frame([(x,) for x in v], "v double")
    out = df.select(fc.rule_policy("v"), fc.rule_policy_code("v")).collect()
    assert [r[0] for r in out] == [1.15, 1.10, 1, 1, .9, .9, .85, 1]
    assert [r[1] for r in out] == [5, 4, 3, 3, 2, 2, 1, 0]


def test_decode_text(frame):
    df = frame([(b" caf\xc3\xa9 ",), (b"caf\xe9",), (None,)], "b binary")
    assert [r[0] for r in df.select(fc.decode_text("b")).collect()] == [
        "café", "café", None]


def test_cut_and_value_bin(frame):
    df = frame([(5.0,), (5.1,), (-1.0,), (3.0,), (3.5,), (3.6,)], "x double")
    out = df.select(fc.cut("x", [0, 5, 10], ["a", "b"]),
                    fc.value_bin("x")).collect()
    assert [r[0] for r in out] == ["a", "b", None, "a", "a", "a"]
    assert [r[1] for r in out][3:] == ["2 - 3", "3 - 3.5", "> 3.5"]


def test_feasible_set_and_masking(spark):
    p = F.array(F.lit(.5), F.lit(.1), F.lit(.4))
    q = F.array(F.lit(1.0), F.lit(9.0), F.lit(2.0))
    r = one(spark, fc.feasible(p, .3).alias("f"),
            fc.argmax(fc.masked_q(q, p, .3)).alias("a"),
            fc.feasible(F.array(F.lit(1.0), F.lit(.3)), .3).alias("gt"),
            fc.feasible(F.array(F.lit(1.0), F.lit(.3)), .3, False)
            .alias("ge"))
    assert r["f"] == [True, False, True] and r["a"] == 2
    assert r["gt"] == [True, False] and r["ge"] == [True, True]
    df = spark.range(1).select(p.alias("p"))
    assert ev.contiguity(df, .3).first()[0] == 0.0


def test_poisson_draw_has_mean_one(spark):
    df = spark.range(20000).select(
        fc.poisson_one(fc.hash_uniform(["id"], 7)).alias("c"))
    r = df.agg(F.avg("c"), F.var_samp("c")).first()
    assert abs(r[0] - 1) < .03 and abs(r[1] - 1) < .05


def test_poisson_draw_of_hex_digits_is_the_same(spark):
    cuts = {int(b * 2 ** 32) + i for b in fc.poisson_bounds()
            for i in (-1, 0, 1, 2)} | {0, 2 ** 32 - 1}
    df = spark.createDataFrame([(f"{c:08x}",) for c in sorted(cuts)
                                if c < 2 ** 32], "h string")
    u = F.conv("h", 16, 10).cast("double") / F.lit(4294967296.0)
    r = df.select(fc.poisson_one(u).alias("a"), fc.poisson_hex(
        F.col("h")).alias("b")).collect()
    assert len(r) > 40 and {x.a for x in r} >= set(range(10))
    assert all(x.a == x.b for x in r)


def test_nan_and_caps(spark):
    r = one(spark, fc.nan_to_null(F.lit(float("nan"))).alias("n"),
            fc.recode_capped(F.lit(">89"), ">89", 90).alias("a"),
            fc.recode_capped(F.lit("71"), ">89", 90).alias("b"),
            fc.centre_id_text(F.lit(12345)).alias("c"))
    assert tuple(r) == (None, 90, 71, 12)


def test_score_mlp(frame):
    df = frame([([1.0, -2.0],), ([0.5, 0.5],)], "x array<double>")
    w = [([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]), ([[1.0], [1.0]], [0.5])]
    out = [r[0] for r in df.select(po.score_mlp(w, "x")).collect()]
    assert out == [[1.5], [1.5]]


def test_first_record_skips_nulls(frame):
    df = frame([(1, 1, None, 5.0), (1, 2, 7.0, 6.0)],
               "k int, d int, a double, b double")
    assert rows_of(rel.first_record(df, ["k"], ["d"]), "k", "a", "b") == [
        (1, 7.0, 5.0)]


def test_disjoint(frame):
    a, b = frame([(1,), (2,)], "k int"), frame([(3,)], "k int")
    rel.assert_disjoint(a, b, "k")
    try:
        rel.assert_disjoint(a, a, "k")
    except AssertionError:
        pass
    else:
        raise RuntimeError("overlap not found")


def test_best_run_modes(frame):
    runs = frame([("a", 1, 9.0), ("a", 5, 2.0), ("b", 6, 3.0), ("b", 7, None)],
                 "run string, iteration int, m double")
    assert tuple(rel.best_run(runs, "m", "max", 5).first()) == ("b", 6, 3.0)
    assert tuple(rel.best_run(runs, "m", "min", 5).first()) == ("a", 5, 2.0)
