"""The preparation step by step, every step audited while it runs.

Each of the ten steps is written once and the next one goes on from the copy.
Numbers of rows are observed by the job that writes it. All that needs a
subject or a trajectory comes from one grouping of the copy's few columns; the
groupings of all steps are one table, which each statistic reads once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trajspark.functions.columns import any_of, truth
from trajspark.operators import relational as rel
from trajspark.operators import trajectories as tr
from trajspark.operators.reports import daily_entry_audit, imputation_audit
from trajspark.operators.scan import choose_scan
from trajspark.operators.selection import summarise
from trajspark.params import Params
from trajspark.plans import pipeline as pl
from trajspark.session import cut_lineage, written

KEYS = ["trial", "subjid"]
STEPS = ("prepared", "presets", "union", "events", "split_events", "impute",
         "split_gaps", "baseline", "prune", "splits")
REPORT = "step string, metric string, group string, value double"
QUARTILES = ("min", "q25", "q50", "mean", "q75", "max")


def _seen(df: DataFrame):
    return truth(F.col("value_type") == "Y") \
        if "value_type" in df.columns else F.lit(True)


def _row_counts(df: DataFrame) -> dict:
    seen, value, dose = _seen(df), F.col("value"), F.col("dose")
    return {"rows": F.lit(True),
            "null_values": seen & value.isNull(),
            "zero_values": seen & truth(value == 0),
            "null_doses": seen & dose.isNull(),
            "zero_doses": seen & truth(dose == 0),
            "negative_doses": truth(dose < 0)}


class Audit:
    """Collects what is known of each step. `groups` are the trials by which
    rows are counted; rows of other trials still count in the rest."""

    def __init__(self, groups, events=(), splitting=()):
        self.groups, self.events = list(groups), list(events)
        self.splitting = list(splitting)
        self.observed: list[tuple] = []
        self.per: list[DataFrame] = []
        self.parts: list[DataFrame] = []

    def keep(self, step: str, df: DataFrame, counts: dict,
             by: str | None = "trial", groups=None) -> DataFrame:
        """Write a step; `counts` names conditions whose rows are counted by
        the same job, per group or for all."""
        levels = (groups or self.groups) if by else ["all"]
        # Names of observed columns must be plain, so they are numbered.
        named = {f"m{i}": (m, g) for i, (m, g) in enumerate(
            (m, g) for m in counts for g in levels)}
        obs = Observation()
        copy = written(df.observe(obs, *[
            F.count_if(counts[m] & truth(F.col(by) == g) if by else counts[m])
            .alias(name) for name, (m, g) in named.items()]))
        found = obs.get
        self.observed += [(step, m, g, float(found.get(name, 0)))
                          for name, (m, g) in named.items()]
        return copy

    def step(self, name: str, df: DataFrame, nested: bool = True,
             more: dict | None = None) -> DataFrame:
        """Keep a table of visits and group it by trajectory."""
        copy = self.keep(name, df, {**_row_counts(df), **(more or {})})
        keys = [*KEYS, "trajid"] if nested else KEYS
        have = [e for e in self.events if e in copy.columns]
        split = any_of([e for e in self.splitting if e in have]) \
            if have else F.lit(None).cast("boolean")
        self.per.append(copy.filter(_seen(copy)).groupBy(*keys).agg(
            F.count("value").alias("entries"),
            (F.max("study_day") - F.min("study_day")).alias("days"),
            F.count("dose").alias("doses"),
            F.count_if(F.col("dose").isNull()).alias("open_doses"),
            F.count_if(split).alias("splits"),
            *[(F.sum(e) if e in have else F.lit(None)).cast("long").alias(e)
              for e in self.events])
            .select(F.lit(name).alias("step"), *KEYS, "entries", "days",
                    "doses", "open_doses",
                    (F.col("splits") if have else F.lit(None).cast("long"))
                    .alias("splits"), *self.events))
        return copy

    def add(self, step: str, df: DataFrame, cols, group=None) -> None:
        """Columns of a finished table as metrics of a step."""
        self.parts.append(_long(df.withColumn("step", F.lit(step)), cols,
                                F.lit("all") if group is None
                                else F.col(group)))

    def report(self, spark) -> DataFrame:
        """(step, metric, group, value) of everything kept."""
        per = self.per[0]
        for p in self.per[1:]:
            per = per.unionByName(p)
        per = cut_lineage(per)
        by, trial = ["step", "trial"], F.col("trial")
        # One row per subject first: trials are few, subjects are many.
        subjects = per.groupBy(*by, "subjid").agg(
            F.count(F.lit(1)).alias("trajectories"),
            *[F.sum(c).alias(c) for c in ("entries", "doses", "open_doses",
                                          *self.events)],
            F.max("splits").alias("splits"))
        n = F.count(F.lit(1))
        sums = cut_lineage(subjects.groupBy(*by).agg(
            n.cast("double").alias("subjects"),
            F.sum("trajectories").alias("trajectories"),
            F.avg("entries").alias("values_per_subject"),
            F.avg("doses").alias("doses_per_subject"),
            F.count_if(F.col("open_doses") > 0)
            .alias("subjects_with_null_dose"),
            F.max("splits").alias("splits"),
            *[F.sum(e).alias(e) for e in self.events],
            *[(F.sum(e) / n).alias(f"{e}_per_subject")
              for e in self.events]))
        cols = ["subjects", "trajectories", "values_per_subject",
                "doses_per_subject", "subjects_with_null_dose"]
        rates = [*self.events, *[f"{e}_per_subject" for e in self.events]]
        out = [_long(sums, cols, trial),
               _long(sums, rates, trial).filter("value IS NOT NULL"),
               _long(sums.groupBy("step").agg(
                   F.max("splits").alias("max_splitting_events")),
                   ["max_splitting_events"], F.lit("all"))
               .filter("value IS NOT NULL")]
        for c in ("entries", "days"):
            d = rel.describe_by(per, by, c).withColumnsRenamed(
                {q: f"{c}_{q}" for q in QUARTILES})
            out.append(_long(d, [f"{c}_{q}" for q in QUARTILES], trial))
        out.append(spark.createDataFrame(self.observed, REPORT))
        report, *more = [*out, *self.parts]
        for m in more:
            report = report.unionByName(m)
        return report


def _long(df: DataFrame, cols, group) -> DataFrame:
    return df.select("step", group.alias("group"), *[
        F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["step", "group"], list(cols), "metric", "value").select(
        "step", "metric", "group", "value")


def run_audited(visits: DataFrame, events: DataFrame, baseline: DataFrame,
                params: Params = Params(), hot_rows: int | None = None):
    """Splits and audit report of the preparation: ({split: table}, report)."""
    spark = visits.sparkSession
    groups = [*params.daily_dose_trials, *params.avg_dose_trials,
              *params.weekly_dose_trials]
    log = Audit(groups, params.events_kept, params.events_splitting)
    scan = choose_scan([visits, events], KEYS, hot_rows)

    v, e, b = pl.prepare(visits, events, baseline, params, scan)
    v = log.step("prepared", v, nested=False)
    flags = list(params.events_kept)
    e = log.keep("prepared", e, {"event_rows": F.lit(True)})
    b = log.keep("prepared", b, {"baseline_rows": F.lit(True)}, by=None)
    _prepared(log, v, e, b, flags, params, scan)

    v = log.step("presets", pl.preset_trials(v, params, scan))
    v = log.step("union", tr.drop_groups_with(
        v, KEYS, F.col("dose") >= params.dose_outlier, scan))
    doses = summarise(v.filter(_seen(v)), [], "dose", [0.25, 0.5, 0.75])
    log.add("union", doses.select(
        F.col("n").alias("dose_n"), F.col("min").alias("dose_min"),
        F.col("mean").alias("dose_mean"), F.col("max").alias("dose_max"),
        *[F.col("q")[i].alias(f"dose_q{p}")
          for i, p in enumerate((25, 50, 75))]),
        ["dose_n", "dose_min", "dose_q25", "dose_q50", "dose_mean",
         "dose_q75", "dose_max"])
    log.add("union", v.agg(F.stddev_samp("dose").alias("dose_sd")),
            ["dose_sd"])

    v = log.step("events", tr.merge_events(
        v, e, params.events_kept, KEYS, params.event_range, scan=scan))
    log.add("events", rel.group_size(v, [*KEYS, "study_day"]).agg(
        F.max("n").alias("max_rows_per_day")), ["max_rows_per_day"])
    v = log.step("split_events", tr.split_at_events(
        v, params.events_splitting, KEYS, scan=scan))
    gaps = imputation_audit(v, scan=scan)
    log.parts.append(gaps.select(F.lit("impute").alias("step"), "metric",
                                 "group", "value"))
    v = log.step("impute", tr.impute(v, params.events_kept, KEYS, scan=scan))
    v = log.step("split_gaps", tr.split_at_gaps(
        v, KEYS, max_gap=params.max_gap, scan=scan))
    nulls = tr.merge_baseline(v, b, params.static_cols,
                              yes_no_cols=["diabetes"])
    v = log.step("baseline", nulls, more={
        f"null_{c}": F.col(c).isNull() for c in params.static_cols})
    v = log.step("prune", tr.drop_short(v, KEYS, min_rows=params.min_rows,
                                        scan=scan))

    marked = tr.split_subjects(v, params.test_trial, params.val_trial,
                               params.val_fraction, params.seed)
    trial, val, test = F.col("trial"), params.val_trial, params.test_trial
    odd = (F.when(F.col("split") == "val", trial != val)
           .when(F.col("split") == "test", trial != test)
           .otherwise(trial == test))
    marked = log.keep("splits", marked, {
        "split_rows": F.lit(True), "misplaced_rows": truth(odd)},
        "split", ["train", "val", "test"])
    both = marked.filter("split <> 'test'").groupBy("subjid").agg(
        (F.min("split") != F.max("split")).alias("shared"))
    log.add("splits", both.agg(F.count_if("shared").alias("shared_subjects")),
            ["shared_subjects"])
    return ({s: marked.filter(F.col("split") == s).drop("split")
             for s in ("train", "val", "test")}, log.report(spark))


def _prepared(log: Audit, visits, events, baseline, flags, params, scan):
    """What the first step says of its three tables."""
    for name, df in (("visit", visits), ("event", events),
                     ("baseline", baseline)):
        log.add("prepared", df.agg(F.count_distinct("subjid").alias(
            f"{name}_subjects")), [f"{name}_subjects"])
    trials = visits.groupBy("trial").agg(
        F.count_distinct("subjid").alias("__n"))
    sums = events.groupBy("trial").agg(*[F.sum(e).alias(e) for e in flags]) \
        .join(trials, "trial")
    sums = sums.withColumns({f"{e}_per_subject": F.col(e) / F.col("__n")
                             for e in flags})
    log.add("prepared", sums, [*flags, *[f"{e}_per_subject" for e in flags]],
            "trial")
    entries = daily_entry_audit(visits, params.daily_dose_trials, scan=scan)
    entries = entries.groupBy("trial").agg(*[
        F.coalesce(F.sum(F.when(F.col("entries") == i, F.col("n"))), F.lit(0))
        .alias(f"entries_before_{i}") for i in range(4)])
    log.add("prepared", entries, [f"entries_before_{i}" for i in range(4)],
            "trial")
