"""From raw visits, events and baseline to trajectories and data splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark import params as P
from trajspark.functions.columns import (null_if, recode_capped, row_sum,
                                         truth)
from trajspark.operators import trajectories as tr
from trajspark.operators.relational import (complete_cases, indicators,
                                            keep_ids, union_all)
from trajspark.operators.scan import PLAIN, by_key, lag, next_known
from trajspark.params import Params

KEYS = ["trial", "subjid"]
RAW_ORDER = ["study_day", "seq"]


def prepare(visits: DataFrame, events: DataFrame, baseline: DataFrame,
            params: Params = Params(), scan=PLAIN):
    """Preliminary cleaning: matching subjects, complete baselines, event
    flags, observed period only, and the end of the trial marked."""
    events = keep_ids(events, visits, "subjid")
    events = indicators(events, "event_name", P.EVENT_NAMES, drop=True)
    baseline = complete_baseline(keep_ids(baseline, visits, "subjid"), params)
    visits = keep_ids(visits, baseline, "subjid")
    visits = mark_trial_end(visits.filter(F.col("study_day") >= 0), scan)
    return visits, events, baseline


def complete_baseline(baseline: DataFrame,
                      params: Params = Params()) -> DataFrame:
    baseline = (baseline.withColumnRenamed("region", "continent")
                .withColumn("age", recode_capped("age", ">89", 90)))
    return complete_cases(baseline, params.static_cols)


def mark_trial_end(visits: DataFrame, scan=PLAIN) -> DataFrame:
    visits = tr.trim_to_observed(visits, KEYS, RAW_ORDER, scan=scan)
    seen = truth(F.col("value_type") == "Y")
    last = F.max(F.when(seen & F.col("value").isNotNull(),
                        F.col("study_day")))
    visits = scan.group(visits, KEYS, RAW_ORDER, __last=last)
    return (visits.withColumn("termination", F.when(
        seen & (F.col("study_day") == F.col("__last")), P.TRIAL_END))
        .drop("__last"))


def preset_daily_dose(visits: DataFrame, scan=PLAIN,
                      trials=Params.daily_dose_trials) -> DataFrame:
    """Trials that record daily doses: impossible doses blanked, the mean of
    the three rows before a visit times seven, cut where two doses in a row
    are zero or a value is missing."""
    v = visits.filter(F.col("trial").isin(*trials))
    v = v.withColumn("dose", null_if("dose", (F.col("dose") % 0.5 != 0)
                                     | (F.col("dose") == 99)))
    v = tr.trailing_mean(v, KEYS, RAW_ORDER, "dose", "dose", scan=scan)
    v = v.filter(F.col("value_type") == "Y")
    v = v.withColumn("value", null_if("value", F.col("value") == 0))
    v = tr.neighbour_zero(v, KEYS, RAW_ORDER, "dose", "__near", scan)
    v = v.withColumn("__stop", truth(F.col("dose") == 0) & F.col("__near")
                     | F.col("value").isNull())
    return tr.split_at_flag(v, "__stop", P.DOSE_INTERRUPTION, KEYS, RAW_ORDER,
                            "value_type", scan).drop("__near", "__stop")


def preset_avg_dose(visits: DataFrame, scan=PLAIN,
                    trials=Params.avg_dose_trials) -> DataFrame:
    """Trials with average daily doses and their own interruption flag."""
    v = visits.filter(F.col("trial").isin(*trials))
    v = v.withColumn("dose", F.col("dose") * 7)
    v = v.withColumn("__stop", truth(F.col("interrupt_flag") != 0))
    v = tr.split_at_flag(v, "__stop", P.TRIAL_INTERRUPTION, KEYS, RAW_ORDER,
                         "value_type", scan).drop("__stop")
    return v.filter(F.col("value_type") == "Y")


def preset_weekly_dose(visits: DataFrame, scan=PLAIN,
                       trials=Params.weekly_dose_trials) -> DataFrame:
    """Trials with weekly doses: signs repaired, doses filled backward, cut
    where two doses in a row are zero."""
    v = visits.filter(F.col("trial").isin(*trials))
    v = v.withColumn("dose", F.abs("dose"))
    v = tr.fill_backward(v, KEYS, RAW_ORDER, ["dose"], scan)
    v = v.na.drop(subset=["value", "dose"])
    v = v.filter(F.col("value_type") == "Y")
    v = tr.neighbour_zero(v, KEYS, RAW_ORDER, "dose", "__near", scan)
    v = v.withColumn("__stop", (F.col("dose") == 0) & F.col("__near"))
    return tr.split_at_flag(v, "__stop", P.DOSE_INTERRUPTION, KEYS, RAW_ORDER,
                            "value_type", scan).drop("__near", "__stop")


def union_trials(*visits: DataFrame, max_dose: float = 140.0,
                 scan=PLAIN) -> DataFrame:
    """All trials together, without subjects that have an outlying dose."""
    return tr.drop_groups_with(union_all(*visits), KEYS,
                               F.col("dose") >= max_dose, scan)


def preset_trials(visits: DataFrame, params: Params = Params(),
                  scan=PLAIN) -> DataFrame:
    """The three presets in one pass: the rules of a row's trial are chosen
    by expressions, so the input is read and sorted once."""
    daily = F.col("trial").isin(*params.daily_dose_trials)
    avg = F.col("trial").isin(*params.avg_dose_trials)
    weekly = F.col("trial").isin(*params.weekly_dose_trials)
    dose, value = F.col("dose"), F.col("value")
    seen = truth(F.col("value_type") == "Y")

    v = visits.filter(daily | avg | weekly)
    v = v.withColumn("dose", F.when(weekly, F.abs(dose)).when(avg, dose * 7)
                     .when(daily, null_if(dose, (dose % 0.5 != 0)
                                          | (dose == 99))))
    back = {f"__l{i}": lag("dose", i) for i in (1, 2, 3)}
    v = scan.add(v, KEYS, RAW_ORDER, **back, __next=next_known("dose"))
    known = sum([F.col(c).isNotNull().cast("int") for c in back], F.lit(0))
    mean = F.when(known > 0, row_sum(reversed(list(back))) / known * 7.0)
    v = v.withColumns({
        "dose": F.when(daily, mean).when(weekly, F.col("__next"))
        .otherwise(dose),
        "value": F.when(~daily | truth(value != 0), value)}) \
        .drop(*back, "__next")

    v = v.filter(avg | (seen & (daily | (value.isNotNull()
                                         & dose.isNotNull()))))
    v = tr.neighbour_zero(v, KEYS, RAW_ORDER, "dose", "__near", scan)
    zeros = truth(dose == 0) & F.col("__near")
    v = v.withColumn("__stop", F.when(
        avg, truth(F.col("interrupt_flag") != 0)).when(
        daily, zeros | value.isNull()).otherwise(zeros)).drop("__near")
    reason = F.when(avg, P.TRIAL_INTERRUPTION).otherwise(P.DOSE_INTERRUPTION)
    v = tr.split_at_flag(v, "__stop", reason, KEYS, RAW_ORDER, "value_type",
                         scan).drop("__stop")
    return v.filter(seen)


def clean_trials(visits: DataFrame, params: Params = Params(),
                 scan=PLAIN) -> DataFrame:
    """All trials by their presets, without subjects that have an outlying
    dose."""
    return tr.drop_groups_with(preset_trials(visits, params, scan), KEYS,
                               F.col("dose") >= params.dose_outlier, scan)


def subject_trajectories(visits: DataFrame, events: DataFrame,
                         params: Params = Params(), scan=PLAIN,
                         upto: str | None = None) -> DataFrame:
    """Everything that happens inside a subject, after `prepare`; `upto`
    names a step to stop after."""
    steps = {
        "union": lambda _: clean_trials(visits, params, scan),
        "events": lambda d: tr.merge_events(d, events, params.events_kept,
                                            KEYS, params.event_range,
                                            scan=scan),
        "split_events": lambda d: tr.split_at_events(
            d, params.events_splitting, KEYS, scan=scan),
        "impute": lambda d: tr.impute(d, params.events_kept, KEYS, scan=scan),
        "split_gaps": lambda d: tr.split_at_gaps(d, KEYS,
                                                 max_gap=params.max_gap,
                                                 scan=scan),
        "prune": lambda d: tr.drop_short(d, KEYS, min_rows=params.min_rows,
                                         scan=scan),
    }
    out = None
    for name, step in steps.items():
        out = step(out)
        if name == upto:
            break
    return out


def build_trajectories(visits: DataFrame, events: DataFrame,
                       baseline: DataFrame, params: Params = Params(),
                       hot_rows: int | None = None,
                       upto: str | None = None) -> DataFrame:
    """The full preparation. Subjects are independent, so one pass by subject
    does all of it; subjects too large for a task take the chunked path."""
    baseline = complete_baseline(baseline, params)
    events = indicators(events, "event_name", P.EVENT_NAMES, drop=True)
    ids = baseline.select("subjid")

    def per_subject(scan, v, e):
        # One partitioning by subject serves the joins and every window.
        v = scan.cluster(v.filter(F.col("study_day") >= 0), ["subjid"])
        v = mark_trial_end(v.join(ids, "subjid", "left_semi"), scan)
        e = scan.cluster(e, ["subjid"])
        return subject_trajectories(v, e, params, scan, upto)

    out = by_key(per_subject, [visits, events], KEYS, hot_rows)
    if upto is not None:
        return out
    return tr.merge_baseline(out, baseline, params.static_cols,
                             yes_no_cols=["diabetes"])


def prepare_splits(trajectories: DataFrame, params: Params = Params(),
                   remove_unintuitive: bool = False):
    """Train, validation and test tables; odd decisions are cut out of the
    training part on request."""
    marked = tr.split_subjects(trajectories, params.test_trial,
                               params.val_trial, params.val_fraction,
                               params.seed)
    train, val, test = (marked.filter(F.col("split") == s).drop("split")
                        for s in ("train", "val", "test"))
    if remove_unintuitive:
        def cut(scan, d):
            d = tr.cut_unintuitive(d, KEYS, scan=scan)
            return tr.drop_short(d, KEYS, min_rows=params.min_rows, scan=scan)
        train = by_key(cut, [train], KEYS)
    return train, val, test
