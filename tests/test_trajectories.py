import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from trajspark import params as P
from trajspark.operators import trajectories as tr
from trajspark.plans import pipeline as pl
from trajspark.sources import adapter

SF = "/root/testdata/sf0.001"
FLAGS = ("death", "stroke", "major_bleed", "minor_bleed", "hem_stroke",
         "hosp", "sys_emb")


def visits(frame, days, values=None, doses=None, traj=None, **extra):
    n = len(days)
    values = values or [2.5] * n
    doses = doses or [10.0] * n
    cols = {"trial": ["A"] * n, "subjid": [1] * n, "study_day": days,
            "value": values, "dose": doses, **extra}
    types = {"trial": "string", "subjid": "long", "study_day": "int",
             "value": "double", "dose": "double", "trajid": "long",
             "termination": "string", "value_type": "string", "seq": "long",
             "interrupt_flag": "double"}
    if traj is not None:
        cols["trajid"] = traj
    schema = ", ".join(f"{c} {types.get(c, 'int')}" for c in cols)
    return frame(list(zip(*cols.values())), schema)


def test_split_at_flag_keeps_runs_and_drops_singles(frame):
    df = visits(frame, list(range(8)), f=[0, 0, 1, 1, 0, 0, 1, 0])
    out = tr.split_at_flag(df, "f", "STOP")
    assert rows_of(out, "study_day", "trajid", "termination") == [
        (0, 0, None), (1, 0, "STOP"), (4, 1, None), (5, 1, "STOP")]


def test_split_at_flag_keeps_given_reason_and_nulls_are_false(frame):
    df = visits(frame, [0, 1, 2, 3], f=[None, 0, None, 0],
                termination=[None, None, None, "TRIAL_TERMINATION"])
    out = tr.split_at_flag(df, "f", "STOP")
    assert rows_of(out, "study_day", "termination")[-1] == (
        3, "TRIAL_TERMINATION")


def test_split_at_gaps_edge(frame):
    out = tr.split_at_gaps(visits(frame, [0, 90, 181]))
    assert rows_of(out, "study_day", "trajid", "termination") == [
        (0, 0, None), (90, 0, P.TIME_GAP), (181, 1, None)]


def test_split_at_events_closes_trajectory(frame):
    ev = {f: [0] * 5 for f in FLAGS}
    ev["stroke"] = [0, 0, 1, 0, 0]
    df = visits(frame, [0, 10, 20, 30, 40], traj=[0] * 5,
                termination=[None, "X", None, None, "TRIAL_TERMINATION"], **ev)
    out = tr.split_at_events(df, [f for f in FLAGS if f != "minor_bleed"])
    assert rows_of(out, "study_day", "trajid", "termination") == [
        (0, 0, None), (10, 0, None), (20, 0, P.ADVERSE_EVENT),
        (30, 1, None), (40, 1, "TRIAL_TERMINATION")]


def test_impute_resets_event_rows(frame):
    ev = {f: [0] * 4 for f in FLAGS}
    ev["hosp"] = [0, 1, 0, 0]
    df = visits(frame, [0, 5, 9, 12], [2.0, None, 3.0, 2.0],
                [None, None, 10.0, None], traj=[0, 0, 1, 1],
                termination=[None] * 4, **ev)
    out = tr.impute(df, FLAGS)
    assert rows_of(out, "study_day", "value", "dose") == [
        (0, 2.0, 10.0), (5, None, None), (9, 3.0, 10.0), (12, 2.0, 10.0)]


def test_collapse_days_sums(frame):
    df = visits(frame, [3, 3, 4], [2.0, 1.0, None])
    assert rows_of(tr.collapse_days(df, tr.KEYS, ["value"]),
                   "study_day", "value") == [(3, 3.0), (4, None)]
    assert rows_of(tr.collapse_days(df, tr.KEYS, ["value"], "avg"),
                   "study_day", "value")[0] == (3, 1.5)


def test_interpolation_leading_and_trailing(frame):
    df = visits(frame, [0, 1, 4, 6], [None, 2.0, 5.0, None], traj=[0] * 4)
    out = tr.interpolate_daily(df)
    assert rows_of(out, "study_day", "value") == [
        (0, None), (1, 2.0), (2, 3.0), (3, 4.0), (4, 5.0), (5, 5.0), (6, 5.0)]
    ttr = tr.time_in_range(df).first()
    assert ttr["ttr"] == pytest.approx(2 / 7) and ttr["length"] == 6


def test_merge_events_places_and_drops(frame, spark):
    v = visits(frame, [10, 20, 60], traj=[0, 0, 0], seq=[1, 2, 3],
               value_type=["Y"] * 3, interrupt_flag=[0.0] * 3,
               termination=[None, None, "TRIAL_TERMINATION"])
    names = ", ".join(f"{f} int" for f in FLAGS)
    e = spark.createDataFrame(
        [("A", 1, day, None, *[int(f == which) for f in FLAGS])
         for day, which in ((5, "death"), (20, "stroke"), (30, "hosp"),
                            (40, "hosp"), (200, "hosp"), (None, "death"))]
        + [("A", 99, 1, None, *[1] * 7)],
        f"trial string, subjid long, event_day int, rankin double, {names}")
    out = tr.merge_events(v, e, FLAGS)
    # Day 5 precedes the visits, 40 follows another event, 200 is too far.
    assert rows_of(out, "study_day", "stroke", "hosp", "rankin") == [
        (10, 0, 0, None), (20, 1, 0, 3.0), (30, 0, 1, None), (60, 0, 0, None)]


def test_preset_cleanup(frame):
    v = visits(frame, [0, 1, 2, 3, 4], [2.0, 2.0, 2.0, 0.0, 2.0],
               [2.3, 99.0, 5.0, 5.0, 5.0], seq=list(range(5)),
               value_type=["Y"] * 5, interrupt_flag=[0.0] * 5,
               termination=[None] * 5).withColumn("trial", F.lit("ENGAGE"))
    out = pl.preset_daily_dose(v)
    # The zero value is a cut, the last row is alone and goes.
    assert rows_of(out, "study_day", "dose") == [
        (0, None), (1, None), (2, None)]
    w = v.withColumns({"trial": F.lit("ARISTOTLE"), "dose": F.lit(-10.0)})
    assert {r["dose"] for r in pl.preset_weekly_dose(w).collect()} == {10.0}


def test_one_pass_equals_presets(spark):
    v, _, _ = pl.prepare(adapter.visits(spark, SF), adapter.events(spark, SF),
                         adapter.baseline(spark, SF))
    a = pl.union_trials(pl.preset_daily_dose(v), pl.preset_avg_dose(v),
                        pl.preset_weekly_dose(v))
    b = pl.clean_trials(v).select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cut_unintuitive(frame):
    df = visits(frame, [0, 1, 2, 3, 4, 5], [2.5, 2.5, 3.5, 2.5, 2.5, 2.5],
                [10.0, 10.0, 10.0, 12.0, 12.0, 12.0], traj=[0] * 6)
    out = tr.cut_unintuitive(df)
    assert rows_of(out, "study_day", "trajid", "termination") == [
        (0, 0, None), (1, 0, P.UNINTUITIVE), (3, 1, None), (4, 1, None),
        (5, 1, P.UNINTUITIVE)]


def test_pipeline_invariants(spark):
    df = pl.build_trajectories(
        adapter.visits(spark, SF), adapter.events(spark, SF),
        adapter.baseline(spark, SF)).cache()
    key = ["trial", "subjid", "trajid"]
    per = df.groupBy(*key).agg(F.count("*").alias("n"),
                               F.count("termination").alias("t"),
                               F.count_distinct("study_day").alias("d"))
    assert per.filter("n < 2 or n <> d").count() == 0
    assert per.filter("t > 1").count() == 0
    dense = df.groupBy("subjid").agg(F.max("trajid").alias("m"),
                                     F.count_distinct("trajid").alias("c"))
    assert dense.filter("m + 1 <> c").count() == 0
    gaps = tr.gap(df, key, ["study_day"], "g")
    assert gaps.filter("g > 90").count() == 0
    train, val, test = pl.prepare_splits(df, remove_unintuitive=True)
    assert val.filter("trial <> 'ARISTOTLE'").count() == 0
    assert train.filter("trial = 'RELY'").count() == 0
    assert test.filter("trial <> 'RELY'").count() == 0
    assert train.join(val, "subjid", "left_semi").count() == 0
    n = df.filter("trial = 'ARISTOTLE'").select("subjid").distinct().count()
    assert val.select("subjid").distinct().count() == int(0.2 * n)
    df.unpersist()


def test_fast_time_in_range_equals_daily_grid(spark):
    df = pl.build_trajectories(
        adapter.visits(spark, SF), adapter.events(spark, SF),
        adapter.baseline(spark, SF))
    fast = tr.time_in_range(df)
    grid = tr.interpolate_daily(df).groupBy("trial", "subjid", "trajid").agg(
        F.avg(tr.in_range("value").cast("double")).alias("grid"))
    both = fast.join(grid, ["trial", "subjid", "trajid"])
    assert both.count() == fast.count() > 100
    assert both.filter(F.abs(F.col("ttr") - F.col("grid")) > 1e-12) \
        .count() == 0
