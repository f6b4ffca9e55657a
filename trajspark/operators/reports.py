"""Tables for reports and statistical models: time to event, consistency,
cohort summaries, audits and heatmap data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark import params as P
from trajspark.functions.columns import (any_of, cut, finite, fmt_ci,
                                         fmt_mean_sd, map_codes, metric_part,
                                         relative_change, truth, value_bin)
from trajspark.operators.relational import (above_percentile, complete_grid,
                                            describe_by, first_record,
                                            mean_count, median_range,
                                            outer_coalesce, pivot,
                                            share_within, star_join,
                                            truncate_after, weighted_mean,
                                            with_group_mean)
from trajspark.operators.scan import PLAIN, lead
from trajspark.operators.trajectories import (DAY, KEYS, ORDER, TRAJ,
                                              fill_distance, trailing_count,
                                              ttr_aggs, with_days_in_range)
from trajspark.session import cut_lineage

WITHIN = [*KEYS, TRAJ]


# Time to event and model inputs.

def time_to_event(events: DataFrame, visits: DataFrame,
                  outcome=("stroke", "major_bleed", "sys_emb"),
                  key: str = "subjid", day: str = DAY) -> DataFrame:
    """First day of a composite outcome, else the last visit, per subject
    with visits."""
    first = events.groupBy(key).agg(
        F.min(F.when(any_of(outcome), F.col(day))).alias("__event"))
    last = visits.groupBy(key).agg(F.max(day).alias("__last"))
    return last.join(first, key, "left").select(
        key, F.coalesce("__event", "__last").alias("time_to_event"),
        F.col("__event").isNotNull().cast("int").alias("composite_outcome"))


def before_outcome(visits: DataFrame, tte: DataFrame,
                   key: str = "subjid") -> DataFrame:
    """Visits up to the outcome; subjects without one keep all."""
    ends = tte.filter("composite_outcome = 1").select(
        key, F.col("time_to_event").alias("__end"))
    return truncate_after(visits, ends, key, DAY, "__end")


def subject_consistency(compared: DataFrame, diff: str,
                        key: str = "subjid") -> DataFrame:
    """Share of decisions within 5% of the algorithm, per subject."""
    rows = compared.filter(finite(diff))
    return rows.groupBy(key).agg(
        F.avg((F.abs(F.col(diff)) <= 0.05).cast("double"))
        .alias("algorithm_consistency"))


def consistency_table(compared: DataFrame, diff: str, chars: DataFrame,
                      meds: DataFrame, tte: DataFrame,
                      key: str = "subjid") -> DataFrame:
    """Input of the time-to-event model: consistency before the outcome,
    characteristics, medication, outcome and the centre's mean
    consistency."""
    rows = before_outcome(compared, tte, key)
    # One row for each subject; the mean of the centre reads it again.
    per = cut_lineage(star_join(subject_consistency(rows, diff, key), [
        (chars, key), (meds, key), (tte, key)]))
    return with_group_mean(per, "centre", "algorithm_consistency",
                           "centre_algorithm_consistency")


def ttr_table(compared: DataFrame, diff: str, chars: DataFrame,
              key: str = "subjid") -> DataFrame:
    """Input of the time-in-range model: time in range of a subject weighted
    by trajectory length, consistency and the centre's mean. `compared`
    carries `ttr` and `length` of its trajectory."""
    rows = compared.filter(finite(diff))
    close = (F.abs(F.col(diff)) <= 0.05).cast("double")
    per_traj = rows.groupBy(key, TRAJ).agg(
        F.avg("ttr").alias("ttr"), F.avg("length").alias("length"),
        F.sum(close).alias("__close"), F.count(close).alias("__rows"))
    ttr = per_traj.groupBy(key).agg(
        weighted_mean("ttr", "length").alias("ttr"),
        (F.sum("__close") / F.sum("__rows")).alias("algorithm_consistency"))
    per = cut_lineage(star_join(ttr, [(chars, key)]))
    return with_group_mean(per, "centre", "algorithm_consistency",
                           "centre_algorithm_consistency")


def centre_table(ttr: DataFrame) -> DataFrame:
    """Mean and count of consistency and time in range by centre."""
    return mean_count(ttr, ["centre"], ["algorithm_consistency", "ttr"])


def patient_flags(patients: DataFrame) -> DataFrame:
    """The eleven 0/1 characteristics derived from coded answers."""
    yes = lambda c, v: truth(F.col(c) == v).cast("int")
    return patients.withColumns({
        "male": yes("sex", 1),
        "white": truth(F.col("ethnic").isin(6, 9)).cast("int"),
        "warfuse": yes("oac_history", "Experienced"),
        "smoker": yes("tobacco", 2), "alcohol": yes("alcohol_use", 2),
        "hf": yes("heart_failure", 2), "prior_stroke": yes("stroke_hx", 2),
        "diab": yes("diabetes", 2), "hypt": yes("hypertension", 2),
        "amiod": yes("amiodarone", 1), "insulin": yes("insulin_use", 1)})


FLAG_COLS = ("male", "white", "warfuse", "smoker", "alcohol", "hf",
             "prior_stroke", "diab", "hypt", "amiod", "insulin")


def country_table(gdp: DataFrame, health: DataFrame) -> DataFrame:
    """Income and health figures by country; high income is above the 55th
    percentile."""
    gdp = above_percentile(gdp, "gdp", 0.55, "highincome")
    return outer_coalesce(gdp, health, ["country"])


def characteristics(patients: DataFrame, centres: DataFrame,
                    countries: DataFrame, key: str = "subjid") -> DataFrame:
    """Patient, centre and country characteristics, one row per patient."""
    p = patient_flags(patients).select(key, "centre", "country", "age",
                                       "weight", *FLAG_COLS)
    c = centres.select(
        "centre", truth(F.col("location") == 2).cast("int").alias("sechosp"),
        truth(F.col("clinic") == 1).cast("int").alias("acclinic"))
    out = star_join(p, [(c, "centre"),
                        (countries.select("country", "highincome", "dale",
                                          "hsp"), "country")])
    return out.na.fill(0, ["sechosp", "acclinic"]).dropDuplicates()


def control_tte_table(patients: DataFrame, meds: DataFrame,
                      centre_country: DataFrame, events: DataFrame,
                      censoring: DataFrame, key: str = "subjid") -> DataFrame:
    """Time-to-event rows of the comparison arm, one per composite event,
    with centre values taken over from the treated arm."""
    names = ["Major Bleeding", "Ischemic Stroke", "Systemic Embolism",
             "Cardiovascular Death"]
    hits = events.filter(F.col("event_name").isin(names)).select(
        key, F.col("event_day").alias("__event"))
    base = patient_flags(patients).filter("arm = 2").select(
        key, "centre", "age", "weight", *FLAG_COLS)
    out = star_join(base, [(meds, key), (centre_country, "centre"),
                           (hits, key), (censoring, key)])
    return (out.withColumns({
        "composite_outcome": F.col("__event").isNotNull().cast("int"),
        "time_to_event": F.coalesce("__event", "censor_day")})
        .drop("__event", "censor_day").na.drop())


# Cohort summaries.

def baseline_summary(df: DataFrame, by: str = "trial", keys=KEYS,
                     order=(DAY,), measures=("age", "weight"),
                     shares=("sex", "diabetes"),
                     levels: dict | None = None) -> DataFrame:
    """Means and shares over the first record of each subject. `levels` lists
    categories whose levels are reported as shares."""
    cols = [*measures, *shares, *(levels or {})]
    first = first_record(df.select(*keys, *order, *cols), list(keys),
                         list(order))
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"),
                 F.stddev_samp(m).alias(f"{m}_sd")]
    aggs += [(F.avg(F.col(s).cast("double")) * 100).alias(f"{s}_pct")
             for s in shares]
    for c, names in (levels or {}).items():
        aggs += [(F.avg(truth(F.col(c) == v).cast("double")) * 100)
                 .alias(f"{c}_{v.lower().replace(' ', '_')}_pct")
                 for v in names]
    return first.groupBy(by).agg(*aggs)


def cohort_summary(df: DataFrame, events, by: str = "trial",
                   measures=("age", "weight"), shares=("sex", "diabetes"),
                   levels: dict | None = None, scan=PLAIN) -> DataFrame:
    """Numbers by trial: rows, subjects, trajectories, lengths, event rates,
    time in range, and the baseline of the subjects."""
    rows = with_days_in_range(df, scan=scan)
    per_traj = rows.groupBy(*WITHIN).agg(
        F.count(F.lit(1)).alias("__rows"), F.count("value").alias("__known"),
        *[e.alias(f"__{n}") for n, e in ttr_aggs().items()],
        *[F.sum(e).alias(e) for e in events])
    years = F.sum("__length") / P.DAYS_PER_YEAR
    per_trial = per_traj.groupBy(by).agg(
        F.sum("__rows").alias("pairs"),
        F.count(F.lit(1)).alias("trajectories"),
        F.avg("__length").alias("length_mean"),
        F.stddev_samp("__length").alias("length_sd"),
        (F.avg("__ttr") * 100).alias("ttr_pct"),
        *[F.try_divide(F.sum(e) * 100, years).alias(f"{e}_per_100y")
          for e in events])
    # Measurements are counted per subject, as the published table does.
    per_subject = per_traj.groupBy(*KEYS).agg(
        F.sum("__known").alias("__known")).groupBy(by).agg(
        F.count(F.lit(1)).alias("subjects"),
        F.avg("__known").alias("values_mean"),
        F.stddev_samp("__known").alias("values_sd"))
    base = baseline_summary(df, by, measures=measures, shares=shares,
                            levels=levels)
    return per_trial.join(per_subject, by).join(base, by)


def median_follow_up_months(df: DataFrame) -> DataFrame:
    days = median_range(df, KEYS, DAY)
    return days.select((F.col("median_range") / P.DAYS_PER_MONTH)
                       .alias("median_follow_up_months"))


def format_summary(summary: DataFrame, by: str = "trial") -> DataFrame:
    """Numbers as text: `mean (sd)` pairs joined, one decimal elsewhere."""
    out = [F.col(by)]
    for c in summary.columns:
        if c == by or c.endswith("_sd"):
            continue
        if c.endswith("_mean"):
            base = c[:-5]
            out.append(fmt_mean_sd(c, f"{base}_sd").alias(base))
        elif c.endswith("_per_100y"):
            out.append(F.format_string("%.2f", c).alias(c))
        elif c.endswith("_pct"):
            out.append(F.format_string("%.1f", c).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return summary.select(*out)


def control_summary(subjects: DataFrame, events: DataFrame, tte: DataFrame,
                    event_names, key: str = "subjid") -> DataFrame:
    """Rate per 100 years of each event name among first events, over the
    total time of the time-to-event table."""
    ids = tte.select(key).distinct()
    mine = (events.join(ids, key, "left_semi")
            .join(subjects.select(key), key, "left_semi")
            .filter(F.col("event_name").isin(list(event_names))))
    first = mine.groupBy(key).agg(F.min_by(
        "event_name", F.struct(F.col("event_day").isNull(), "event_day",
                               "event_name")).alias("event_name"))
    years = tte.agg(F.sum("time_to_event") / P.DAYS_PER_YEAR).scalar()
    return (first.groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))
            .select("event_name", "n", (F.col("n") / years * 100)
                    .alias("per_100y")))


# Audits.

def _long(df: DataFrame, by: str, cols, prefix: str) -> DataFrame:
    named = df.select(F.col(by).alias("group"),
                      *[F.col(c).cast("double").alias(prefix + c)
                        for c in cols])
    return named.unpivot(["group"], [prefix + c for c in cols], "metric",
                         "value").select("metric", "group", "value")


def daily_entry_audit(df: DataFrame, trials, keys=KEYS,
                      order=("study_day", "seq"), scan=PLAIN) -> DataFrame:
    """How many of the three rows before an observed row have a dose."""
    rows = df.filter(F.col("trial").isin(*trials))
    rows = trailing_count(rows, keys, list(order), "dose", "entries", 3, scan)
    return (rows.filter(F.col("value_type") == "Y")
            .groupBy("trial", "entries").agg(F.count(F.lit(1)).alias("n")))


def imputation_audit(df: DataFrame, keys=KEYS, order=ORDER,
                     scan=PLAIN) -> DataFrame:
    """Days between a dose filled backward and its source."""
    rows = fill_distance(df.select(*keys, *order, "dose"), keys, order,
                         "dose", "gap", scan)
    d = describe_by(rows.filter("gap > 0"), ["trial"], "gap")
    return _long(d, "trial", ["min", "q25", "q50", "q75", "max"], "gap_")


# Heatmaps and curves.

def heatmap(df: DataFrame, action: str, group: str | None = None,
            group_levels=()) -> DataFrame:
    """Share of each action within a value bin, every cell present."""
    by = [group] if group else []
    labels = dict(enumerate(P.ACTION_LABELS))
    rows = df.select(*by, value_bin("value").alias("value_bin"),
                     map_codes(F.col(action).cast("int"), labels)
                     .alias("action")).na.drop()
    counts = rows.groupBy(*by, "value_bin", "action").agg(
        F.count(F.lit(1)).alias("n"))
    levels = {"value_bin": P.VALUE_LABELS, "action": P.ACTION_LABELS}
    if group:
        levels = {group: list(group_levels), **levels}
    grid = complete_grid(counts, levels)
    # The window spans the cells of a finished grid.
    w = Window.partitionBy(*by, "value_bin")
    return grid.withColumn("share", F.try_divide(
        F.col("n").cast("double"), F.sum("n").over(w)))


def transition_frame(df: DataFrame, patched: bool = False,
                     scan=PLAIN) -> DataFrame:
    """Bins of the value, the dose change that followed and the value change
    after it. `patched` moves a value of exactly 2 into the middle bin."""
    df = scan.add(df, WITHIN, ORDER, __nd=lead("dose"), __nv=lead("value"))
    ratio = relative_change("__nd", "dose")
    df = df.withColumns({
        "__ratio": F.when((F.col("dose") == 0) & (F.col("__nd") == 0), None)
        .otherwise(ratio),
        "__change": F.col("__nv") - F.col("value")})
    df = df.na.drop(subset=["value", "__ratio", "__change"])
    bins = cut("value", P.AUDIT_VALUE_BOUNDS, P.AUDIT_VALUE_LABELS)
    if patched:
        bins = F.when(F.col("value") == 2, "[2, 3]").otherwise(bins)
    rel = F.col("__ratio") - 1
    code = (F.when(rel == 0, 3).when(rel <= -0.2, 0).when(rel <= -0.1, 1)
            .when(rel <= 0, 2).when(rel <= 0.1, 4).when(rel <= 0.2, 5)
            .otherwise(6))
    return df.select(
        "trial", bins.alias("value_bin"),
        map_codes(code, dict(enumerate(P.ACTION_LABELS))).alias("dose_change"),
        cut("__change", P.VALUE_CHANGE_BOUNDS, P.VALUE_CHANGE_LABELS)
        .alias("value_change"))


def transition_heatmaps(df: DataFrame, patched: bool = False, scan=PLAIN):
    """Dose change by value bin, and value change by dose change."""
    rows = transition_frame(df, patched, scan)
    first = share_within(rows.na.drop(subset=["value_bin"]),
                         ["trial", "value_bin"], ["dose_change"])
    second = share_within(rows, ["trial", "dose_change"], ["value_change"])
    return first, second


def agreement_curve(dis: DataFrame, width: float = 1.0) -> DataFrame:
    """Time in range and length by bins of the mean absolute difference, in
    percent, for every algorithm."""
    pairs = F.explode(F.array(*[F.struct(
        F.lit(n).alias("model"), (F.col(f"{a}_diff") * 100).alias("diff"))
        for a, n in P.MODEL_NAMES.items()])).alias("p")
    rows = dis.select("ttr", "length", pairs).select("ttr", "length", "p.*") \
        .filter(finite("diff"))
    rows = rows.withColumn("bin", F.floor(F.col("diff") / width))
    return rows.groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.sum("length").alias("total_days"),
        (weighted_mean("ttr", "length") * 100).alias("ttr_pct"))


def local_lines(sums: DataFrame, by, grid, span: float = 0.75) -> DataFrame:
    """Kernel-weighted local lines from sums per bin, at each point of `grid`.

    `sums` has one row per group and bin: `mid`, the bin's middle, the count
    `n`, and the sums of w, wx, wxx, wy, wxy and wyy. The bins nearest to a
    point that hold the share `span` of the rows set the width of its tri-cube
    kernel; a bin's rows all get the weight of its middle. `se` takes the
    variance of a row as inverse to its weight; it is NULL where the kernel
    holds two rows or less. A point whose rows don't vary in x gets their mean.
    """
    x0 = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x")
    at = sums.select("*", x0).withColumn("d", F.abs(F.col("mid")
                                                    - F.col("x")))
    # As many rows as there are bins.
    w = Window.partitionBy(*by, "x")
    near = w.orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"__upto": F.sum("n").over(near),
                         "__all": F.sum("n").over(w)})
    enough = F.col("__upto") >= F.lit(span) * F.col("__all")
    at = at.withColumn("h", F.min(F.when(enough, F.col("d"))).over(w))
    # A little wider than the last bin it needs, so that this one counts.
    ratio = F.col("d") / (F.col("h") * 1.001)
    k = F.when(F.col("h") == 0, (F.col("d") == 0).cast("double")).when(
        ratio < 1, F.pow(1 - F.pow(ratio, 3), 3)).otherwise(0.0)
    x, kk = F.col("x"), F.col("k") * F.col("k")
    u1 = F.col("wx") - x * F.col("w")
    u2 = F.col("wxx") - 2 * x * F.col("wx") + x * x * F.col("w")
    k_ = F.col("k")
    s = at.withColumn("k", k).groupBy(*by, "x").agg(
        F.sum(k_ * F.col("n")).alias("n"), F.sum(k_ * F.col("w")).alias("s0"),
        F.sum(k_ * u1).alias("s1"), F.sum(k_ * u2).alias("s2"),
        F.sum(k_ * F.col("wy")).alias("t0"),
        F.sum(k_ * (F.col("wxy") - x * F.col("wy"))).alias("t1"),
        F.sum(k_ * F.col("wyy")).alias("yy"),
        F.sum(kk * F.col("w")).alias("q0"), F.sum(kk * u1).alias("q1"),
        F.sum(kk * u2).alias("q2"))
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    det = s0 * s2 - s1 * s1
    s = s.withColumn("det", F.when(det > s0 * s2 * 1e-9, det))
    flat = F.col("det").isNull()
    s = s.withColumns({
        "fit": F.when(flat, F.try_divide(t0, s0))
        .otherwise((s2 * t0 - s1 * t1) / F.col("det")),
        "slope": F.when(~flat, (s0 * t1 - s1 * t0) / F.col("det"))})
    rest = F.greatest(F.col("yy") - F.col("fit") * t0
                      - F.coalesce("slope", F.lit(0.0)) * t1, F.lit(0.0))
    spread = F.when(flat, F.try_divide(F.col("q0"), s0 * s0)).otherwise(
        (s2 * s2 * F.col("q0") - 2 * s1 * s2 * F.col("q1")
         + s1 * s1 * F.col("q2")) / (F.col("det") * F.col("det")))
    return s.select(*by, "x", "fit", F.when(F.col("n") > 2, F.sqrt(
        rest / (F.col("n") - 2) * F.greatest(spread, F.lit(0.0))))
        .alias("se"))


def agreement_smooth(dis: DataFrame, events, width: float = 1.0,
                     upto: float = 50.0, span: float = 0.75) -> DataFrame:
    """Local regression of time in range, weighted by length, and of each
    event's rate on the mean absolute difference in percent, for every
    algorithm: (model, outcome, x, fit, se). Trajectories that differ by more
    than `upto` stay out, as they do in the finished figure. The regression
    works on sums per bin, so it is as small for any number of rows."""
    pairs = F.explode(F.array(*[F.struct(
        F.lit(n).alias("model"), (F.col(f"{a}_diff") * 100).alias("dx"))
        for a, n in P.MODEL_NAMES.items()])).alias("p")
    rows = dis.select("ttr", "length", *events, pairs).select("*", "p.*") \
        .filter(F.col("dx").between(0.0, upto))
    last = int(upto / width) - 1
    rows = rows.withColumn("bin", F.least(F.floor(F.col("dx") / width),
                                          F.lit(last)))
    outcomes = {"ttr": (F.col("ttr") * 100, F.col("length")),
                **{e: (F.col(e), F.lit(1)) for e in events}}
    x, each = F.col("dx"), []
    for name, (y, w) in outcomes.items():
        y, w = y.cast("double"), w.cast("double")
        terms = {"w": w, "wx": w * x, "wxx": w * x * x, "wy": w * y,
                 "wxy": w * x * y, "wyy": w * y * y}
        each.append(F.struct(
            F.lit(name).alias("outcome"),
            F.count_if(y.isNotNull()).alias("n"),
            *[F.sum(F.when(y.isNotNull(), t)).alias(c)
              for c, t in terms.items()]))
    sums = rows.groupBy("model", "bin").agg(F.array(*each).alias("__o"))
    sums = sums.select("model", ((F.col("bin") + 0.5) * width).alias("mid"),
                       F.inline("__o")).filter("n > 0")
    grid = [i * width for i in range(last + 2)]
    return local_lines(sums, ["model", "outcome"], grid, span)


def classification_table(metrics: DataFrame) -> DataFrame:
    """Sensitivity and specificity with limits as text, one row per
    algorithm, from metrics named `ALGO/classification/stat[_lower|_upper]`."""
    rows = metrics.filter(metric_part("metric", "group") == "classification")
    rows = rows.select(metric_part("metric", "algorithm").alias("algorithm"),
                       metric_part("metric", "statistic").alias("statistic"),
                       metric_part("metric", "bound").alias("bound"), "value")
    rows = rows.filter(F.col("statistic").isin("sensitivity", "specificity"))
    wide = rows.groupBy("algorithm", "statistic").pivot(
        "bound", ["value", "lower", "upper"]).agg(F.first("value"))
    text = wide.select(
        map_codes("algorithm", P.ALGORITHM_NAMES).alias("algorithm"),
        "statistic", fmt_ci("value", "lower", "upper").alias("text"))
    return pivot(text, ["algorithm"], "statistic", "text",
                 ["sensitivity", "specificity"])
