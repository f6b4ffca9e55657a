"""The audited run gives the tables of the plain one, and counts them."""

from helpers import rows_of

from trajspark.plans import pipeline as pl
from trajspark.plans.audits import STEPS, run_audited
from trajspark.sources import adapter

SF = "/root/testdata/sf0.001"
COLS = ["trial", "subjid", "trajid", "study_day", "value", "dose",
        "termination", "weight"]


def inputs(spark):
    return (adapter.visits(spark, SF), adapter.events(spark, SF),
            adapter.baseline(spark, SF))


def test_audited_run_equals_the_plain_one(spark):
    splits, report = run_audited(*inputs(spark))
    plain = pl.prepare_splits(pl.build_trajectories(*inputs(spark)))
    said = {(r.step, r.metric, r.group): r.value for r in report.collect()}
    for name, df in zip(("train", "val", "test"), plain):
        want = rows_of(df, *COLS)
        assert rows_of(splits[name], *COLS) == want
        assert said["splits", "split_rows", name] == len(want)
        assert said["splits", "misplaced_rows", name] == 0
    assert said["splits", "shared_subjects", "all"] == 0
    assert {s for s, _, _ in said} == set(STEPS)
    trials = ("ENGAGE", "ROCKET_AF", "RELY", "ARISTOTLE")
    total = sum(d.count() for d in plain)
    assert sum(said["prune", "rows", t] for t in trials) == total
    assert said["events", "max_rows_per_day", "all"] == 1
    assert said["split_events", "max_splitting_events", "all"] <= 1


def test_hot_subjects_give_the_same_report(spark):
    v, e, b = inputs(spark)
    few = v.filter("subjid % 5 = 0")
    key = lambda df: {(r.step, r.metric, r.group): round(r.value, 6)
                      for r in df.collect() if r.value is not None}
    assert key(run_audited(few, e, b, hot_rows=10)[1]) \
        == key(run_audited(few, e, b)[1])


def test_no_rows(spark):
    v, e, b = inputs(spark)
    splits, report = run_audited(v.limit(0), e.limit(0), b.limit(0))
    assert all(d.isEmpty() for d in splits.values())
    assert report.filter("value > 0").isEmpty()
