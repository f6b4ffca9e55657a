"""Building trajectories: trimming, splitting, merging events, imputing and
interpolating ordered histories.

Functions take `keys` (the subject), `order` (the day and any tiebreak) and a
`scan`, which decides how ordered columns are computed for keys of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark import params as P
from trajspark.functions.columns import (any_of, col, in_range,
                                         relative_change, row_sum, truth)
from trajspark.operators.scan import (PLAIN, lag, last_known, lead,
                                      next_known, remaining_sum, running_sum)

KEYS = ("trial", "subjid")
ORDER = ("study_day",)
DAY = "study_day"
TRAJ = "trajid"
# Trajectory numbers rise with the day, so this orders a subject as the day
# does, and the same sort serves scans by subject and by trajectory.
NESTED = (TRAJ, DAY)


def renumber(df: DataFrame, keys=KEYS, order=NESTED, group: str = TRAJ,
             scan=PLAIN) -> DataFrame:
    """Number the groups of a key 0, 1, ... in row order."""
    df = scan.add(df, keys, order, __before=lag(group))
    df = df.withColumn("__new",
                       truth(F.col(group) > F.col("__before")).cast("long"))
    df = scan.add(df, keys, order, __no=running_sum("__new"))
    return (df.drop("__before", "__new", group)
            .withColumnRenamed("__no", group))


def gap(df: DataFrame, keys, order, out: str, scan=PLAIN,
        fill: int | None = 0) -> DataFrame:
    """Days since the previous row of the key."""
    df = scan.add(df, keys, order, __prev=lag(DAY))
    c = F.col(DAY) - F.col("__prev")
    if fill is not None:
        c = F.coalesce(c, F.lit(fill))
    return df.withColumn(out, c).drop("__prev")


def trailing_mean(df: DataFrame, keys, order, column: str, out: str,
                  n: int = 3, scale: float = 7.0, scan=PLAIN) -> DataFrame:
    """Mean of the known values among the n rows before this one, scaled."""
    back = {f"__l{i}": lag(column, i) for i in range(1, n + 1)}
    df = scan.add(df, keys, order, **back)
    known = sum([F.col(c).isNotNull().cast("int") for c in back], F.lit(0))
    total = row_sum(reversed(list(back)))
    return (df.withColumn(out, F.when(known > 0, total / known * scale))
            .drop(*back))


def trailing_count(df: DataFrame, keys, order, column: str, out: str,
                   n: int = 3, scan=PLAIN) -> DataFrame:
    back = {f"__l{i}": lag(F.col(column).isNotNull().cast("long"), i)
            for i in range(1, n + 1)}
    df = scan.add(df, keys, order, **back)
    return df.withColumn(out, row_sum(back)).drop(*back)


def neighbour_zero(df: DataFrame, keys, order, column: str, out: str,
                   scan=PLAIN) -> DataFrame:
    df = scan.add(df, keys, order, __p=lag(column), __n=lead(column))
    return (df.withColumn(out, truth(F.col("__p") == 0)
                          | truth(F.col("__n") == 0))
            .drop("__p", "__n"))


def fill_forward(df: DataFrame, keys, order, cols, scan=PLAIN) -> DataFrame:
    filled = scan.add(df, keys, order,
                      **{f"__f_{c}": last_known(c) for c in cols})
    return _replace(filled, df.columns, cols, "__f_")


def fill_backward(df: DataFrame, keys, order, cols, scan=PLAIN) -> DataFrame:
    filled = scan.add(df, keys, order,
                      **{f"__f_{c}": next_known(c) for c in cols})
    return _replace(filled, df.columns, cols, "__f_")


def _replace(df: DataFrame, columns, cols, prefix: str) -> DataFrame:
    return df.select(*[F.col(prefix + c).alias(c) if c in cols else F.col(c)
                       for c in columns])


def fill_distance(df: DataFrame, keys, order, column: str, out: str,
                  scan=PLAIN) -> DataFrame:
    """Days between a row and the row a backward fill would take from."""
    source = F.when(F.col(column).isNotNull(), F.col(DAY))
    df = scan.add(df, keys, order, __src=next_known(source))
    return df.withColumn(out, F.col("__src") - F.col(DAY)).drop("__src")


def remaining_count(df: DataFrame, keys, order, column: str, out: str,
                    scan=PLAIN) -> DataFrame:
    known = F.col(column).isNotNull().cast("long")
    return scan.add(df, keys, order, **{out: remaining_sum(known)})


def trim_to_observed(df: DataFrame, keys=KEYS, order=(), value: str = "value",
                     scan=PLAIN) -> DataFrame:
    """Rows between the first and last known value of the key."""
    seen = F.when(F.col(value).isNotNull(), F.col(DAY))
    df = scan.group(df, keys, order, __first=F.min(seen),
                    __last=F.max(seen))
    return (df.filter(F.col(DAY).between(F.col("__first"), F.col("__last")))
            .drop("__first", "__last"))


def drop_groups_with(df: DataFrame, keys, cond: Column,
                     scan=PLAIN) -> DataFrame:
    """Remove every key that has a row meeting the condition."""
    df = scan.group(df, keys, __bad=F.max(truth(cond).cast("int")))
    return df.filter(F.col("__bad") == 0).drop("__bad")


def first_event_between(df: DataFrame, keys=KEYS, order=NESTED,
                        value: str = "value", scan=PLAIN) -> DataFrame:
    """Of the event rows between two measurements keep the first."""
    known = F.col(value).isNotNull()
    df = scan.add(df, keys, order, __was=lag(known))
    return df.filter(known | truth(F.col("__was"))).drop("__was")


def drop_far_events(df: DataFrame, events, keys=KEYS, order=NESTED,
                    max_gap: int = 90, value: str = "value",
                    scan=PLAIN) -> DataFrame:
    """Remove unmeasured event rows too long after the previous row."""
    df = gap(df, keys, order, "__gap", scan)
    far = (F.col(value).isNull() & any_of(events)
           & (F.col("__gap") > max_gap))
    return df.filter(~far).drop("__gap")


def drop_short(df: DataFrame, keys=KEYS, order=NESTED, min_rows: int = 2,
               scan=PLAIN) -> DataFrame:
    """Remove trajectories with fewer rows, then renumber."""
    df = scan.group(df, [*keys, TRAJ], [DAY], __rows=F.count(F.lit(1)))
    df = df.filter(F.col("__rows") >= min_rows).drop("__rows")
    return renumber(df, keys, order, scan=scan)


def min_observed(df: DataFrame, keys=KEYS, value: str = "value", n: int = 1,
                 scan=PLAIN) -> DataFrame:
    """Trajectories with more than n known values."""
    df = scan.group(df, [*keys, TRAJ], [DAY], __known=F.count(value))
    return df.filter(F.col("__known") > n).drop("__known")


def drop_incomplete_events(df: DataFrame, events, keys=KEYS,
                           value: str = "value", dose: str = "dose",
                           scan=PLAIN) -> DataFrame:
    """Remove rows of events that do not split a trajectory when value or
    dose is missing, unless the row is the last of its trajectory."""
    if not events:
        return df
    df = scan.group(df, [*keys, TRAJ], [DAY], __last=F.max(DAY))
    gone = ((F.col(DAY) != F.col("__last")) & any_of(events)
            & (F.col(value).isNull() | F.col(dose).isNull()))
    return df.filter(~gone).drop("__last")


# Splitting.

def split_at_flag(df: DataFrame, flag: str, reason, keys=KEYS,
                  order=ORDER, observed: str | None = None,
                  scan=PLAIN) -> DataFrame:
    """Cut histories at flagged rows and drop what is flagged.

    A piece starts after a flagged row (or at the first row) and ends before
    one (or at the last row). Pieces of one row are dropped. Existing
    trajectories also start and end a piece. Pieces without a reason get
    `reason` on their last observed row.
    """
    keys, order = list(keys), list(order)
    f = F.col("__flag")
    df = df.withColumn("__flag", truth(F.col(flag).cast("boolean")))
    nested = TRAJ in df.columns
    within = [*keys, TRAJ] if nested else keys
    df = scan.add(df, within, order, __prior=lag(f), __after=lead(f))
    rows, order = order, ([TRAJ, *order] if nested else order)
    start = (F.col("__prior").isNull() | F.col("__prior")) & ~f
    end = (F.col("__after").isNull() | F.col("__after")) & ~f
    if nested:
        df = scan.add(df, keys, order, __tp=lag(TRAJ), __tn=lead(TRAJ))
        start = start | ~F.col(TRAJ).eqNullSafe(F.col("__tp"))
        end = end | ~F.col(TRAJ).eqNullSafe(F.col("__tn"))
    df = df.withColumns({"__start": start, "__end": end})
    df = scan.add(df, keys, order,
                  __s=running_sum(F.col("__start").cast("long")),
                  __e=running_sum(F.col("__end").cast("long")))
    df = df.filter((F.col("__s") >= F.col("__e"))
                   & ~(F.col("__start") & F.col("__end")) & ~f)
    df = df.drop("__flag", "__prior", "__after", "__tp", "__tn", "__start",
                 "__end", "__e")
    df = renumber(df, keys, order, "__s", scan)
    df = df.drop(TRAJ).withColumnRenamed("__s", TRAJ)
    return _give_reason(df, reason, keys, rows, observed, scan)


def _give_reason(df, reason, keys, order, observed, scan) -> DataFrame:
    if "termination" not in df.columns:
        df = df.withColumn("termination", F.lit(None).cast("string"))
    seen = F.lit(True) if observed is None else truth(F.col(observed) == "Y")
    known = F.lit(True) if observed is None else F.col(observed).isNotNull()
    df = scan.group(df, [*keys, TRAJ], order,
                    __last=F.max(F.when(seen, F.col(DAY))),
                    __set=F.count("termination"))
    last = truth((F.col(DAY) == F.col("__last")) & known)
    return (df.withColumn("termination",
                          F.when(last & (F.col("__set") == 0),
                                 reason if isinstance(reason, Column)
                                 else F.lit(reason))
                          .otherwise(F.col("termination")))
            .drop("__last", "__set"))


def split_at_events(df: DataFrame, events, keys=KEYS, order=NESTED,
                    scan=PLAIN) -> DataFrame:
    """A row with a splitting event closes its trajectory."""
    keys, order = list(keys), list(order)
    df = df.withColumn("__ev", any_of(events))
    df = scan.add(df, keys, order,
                  __cum=running_sum(F.col("__ev").cast("long")))
    df = df.withColumn(
        "__t", F.col(TRAJ) + F.col("__cum") - F.col("__ev").cast("long"))
    df = renumber(df.drop("__cum"), keys, order, "__t", scan)
    df = df.drop(TRAJ).withColumnRenamed("__t", TRAJ)
    df = df.withColumn("termination",
                       F.when(F.col("__ev"), F.lit(P.ADVERSE_EVENT))
                       .otherwise(F.col("termination"))).drop("__ev")
    df = scan.group(df, [*keys, TRAJ], [DAY], __last=F.max(DAY),
                    __set=F.count("termination"))
    extra = (F.col(DAY) != F.col("__last")) & (F.col("__set") > 1)
    return (df.withColumn("termination",
                          F.when(~extra, F.col("termination")))
            .drop("__last", "__set"))


def split_at_gaps(df: DataFrame, keys=KEYS, order=ORDER, max_gap: int = 90,
                  scan=PLAIN) -> DataFrame:
    """Start a new trajectory after more than `max_gap` days without a row.
    Without trajectories the whole history of a key counts as one."""
    keys, order = list(keys), list(order)
    if TRAJ in df.columns:
        order = [TRAJ, *order]
    else:
        df = df.withColumn(TRAJ, F.lit(0).cast("long"))
    if "termination" not in df.columns:
        df = df.withColumn("termination", F.lit(None).cast("string"))
    df = scan.add(df, keys, order, __tp=lag(TRAJ), __dp=lag(DAY))
    same = truth(F.col("__tp") == F.col(TRAJ))
    df = df.withColumn(
        "__gap", same & truth(F.col(DAY) - F.col("__dp") > max_gap))
    first = (~same | F.col("__gap")).cast("long")
    df = scan.add(df, keys, order, __no=running_sum(first),
                  __next=lead("__gap"))
    return (df.withColumn("termination",
                          F.when(truth(F.col("__next")), F.lit(P.TIME_GAP))
                          .otherwise(F.col("termination")))
            .withColumn(TRAJ, F.col("__no") - 1)
            .drop("__tp", "__dp", "__gap", "__no", "__next"))


def cut_unintuitive(df: DataFrame, keys=KEYS, order=(DAY,),
                    value: str = "value", dose: str = "dose",
                    scan=PLAIN) -> DataFrame:
    """Cut where a high value was followed by a raised dose, or a low value
    by a lowered one, without an earlier large change that explains it."""
    within = [*keys, TRAJ]
    df = scan.add(df, within, order, __nd=lead(dose))
    change = relative_change("__nd", dose)
    change = F.when((F.col(dose) == 0) & (F.col("__nd") == 0), F.lit(1.0)) \
        .otherwise(F.coalesce(change, F.lit(1.0)))
    df = df.withColumn("__ch", change)
    df = scan.add(df, within, order, __pch=lag("__ch"))
    before = F.coalesce(F.col("__pch"), F.lit(1.0))
    raised = ((F.col(value) > 3.0) & (F.col("__ch") > 1.0) & (before > 0.8))
    lowered = ((F.col(value) < 2.0) & (F.col("__ch") < 1.0) & (before < 1.2))
    df = (df.withColumn("__odd", truth(raised) | truth(lowered))
          .drop("__nd", "__ch", "__pch"))
    return split_at_flag(df, "__odd", P.UNINTUITIVE, keys, order,
                         scan=scan).drop("__odd")


# Merging events and imputing.

def day_aggregate(events: DataFrame, event_cols, keys=KEYS,
                  score: str = "rankin") -> DataFrame:
    """One row per key and day with at least one event: summed flags and the
    highest score."""
    out = events.groupBy(*keys, DAY).agg(
        *[F.sum(c).alias(c) for c in event_cols], F.max(score).alias(score))
    return out.filter(any_of(event_cols))


def collapse_days(df: DataFrame, keys, sums, how: str = "sum") -> DataFrame:
    """One row per key, trajectory and day. Numbers add up by default, NULL
    when all are NULL; of several reasons the last in the alphabet stays.
    Rows clustered by key beforehand are not shuffled again."""
    f = F.sum if how == "sum" else F.avg
    aggs = [f(c).alias(c) for c in sums]
    if "termination" in df.columns:
        aggs.append(F.max("termination").alias("termination"))
    by = [*keys, TRAJ, DAY] if TRAJ in df.columns else [*keys, DAY]
    return df.groupBy(*by).agg(*aggs)


def merge_events(visits: DataFrame, events: DataFrame, event_cols, keys=KEYS,
                 max_gap: int = 90, tiebreak: str = "seq",
                 scan=PLAIN) -> DataFrame:
    """Place point events into the visit histories.

    Events need flag columns, an `event_day` and a `rankin` score; a stroke
    without a score counts as 3. Visits of a day sort before its events.
    """
    keys = list(keys)
    visits = visits.filter(F.col("value_type") == "Y")
    events = (events
              .withColumn("rankin", F.coalesce(
                  F.col("rankin"), F.when(F.col("stroke") >= 1, F.lit(3.0))))
              .filter(F.col("event_day").isNotNull())
              .withColumn(DAY, F.col("event_day").cast("int")))
    # Events of subjects without visits get no trajectory below and go.
    daily = day_aggregate(events, event_cols, keys)
    both = visits.unionByName(daily, allowMissingColumns=True)
    both = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long")
                             for c in event_cols})
    order = [DAY, F.col(tiebreak).asc_nulls_last()]
    both = scan.add(both, keys, order, __t=last_known(TRAJ))
    both = (both.filter(F.col("__t").isNotNull())
            .withColumn(TRAJ, F.col("__t")).drop("__t"))
    sums = ["value", "dose", "interrupt_flag", "rankin", *event_cols]
    merged = collapse_days(both, keys, sums)
    merged = first_event_between(merged, keys, scan=scan)
    return drop_far_events(merged, event_cols, keys, max_gap=max_gap,
                           scan=scan)


def impute(df: DataFrame, event_cols, keys=KEYS, order=ORDER,
           value: str = "value", dose: str = "dose",
           others=("interrupt_flag", "rankin"), scan=PLAIN) -> DataFrame:
    """Fill doses backward per subject, then everything forward per
    trajectory; drop rows that stay incomplete; blank again what an event row
    never had."""
    event = any_of(event_cols)
    df = df.withColumns({"__nov": F.col(value).isNull() & event,
                         "__nod": F.col(dose).isNull() & event})
    df = fill_backward(df, keys, [TRAJ, *order], [dose], scan)
    cols = [value, dose, *[c for c in others if c in df.columns]]
    df = fill_forward(df, [*keys, TRAJ], order, cols, scan)
    df = df.filter(F.col(value).isNotNull() & F.col(dose).isNotNull())
    return df.withColumns({
        value: F.when(~F.col("__nov"), F.col(value)),
        dose: F.when(~F.col("__nod"), F.col(dose)),
    }).drop("__nov", "__nod")


def merge_baseline(df: DataFrame, baseline: DataFrame, cols,
                   key: str = "subjid", yes_no_cols=()) -> DataFrame:
    """Static columns by subject. A plain equi-join: the planner broadcasts
    the baseline only when its statistics allow it."""
    from trajspark.operators.relational import yn_to_int
    side = yn_to_int(baseline.select(key, *cols), yes_no_cols)
    return df.join(side, key, "left")


def split_subjects(df: DataFrame, test_trial: str, val_trial: str,
                   fraction: float = 0.2, seed: int = 42,
                   keys=KEYS) -> DataFrame:
    """Label rows train, val or test; one trial is the test set and the first
    floor(fraction * n) subjects of another, by a seeded hash, validate.

    The cut is found from counts per hash bucket, so only one bucket is
    ranked and no task sees all subjects.
    """
    trial, subject = keys
    h = F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.lit(seed).cast("string"), F.col(subject).cast("string"))),
        1, 8), 16, 10).cast("long")
    ids = (df.filter(F.col(trial) == val_trial).select(subject).distinct()
           .withColumn("__h", h)
           .withColumn("__b", F.shiftright("__h", 20)))    # 4096 buckets
    counts = ids.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__all", F.lit(1))
    counts = PLAIN.add(counts, ["__all"], ["__b"], __upto=running_sum("__n"))
    take = ids.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction))).scalar()
    # 4096 rows at most.
    plan = counts.select(
        "__b", take.alias("__take"),
        (F.col("__upto") - F.col("__n")).alias("__before"),
        "__upto")
    marked = ids.join(F.broadcast(plan), "__b")
    inside = F.col("__upto") <= F.col("__take")
    edge = ~inside & (F.col("__before") < F.col("__take"))
    w = Window.partitionBy("__b").orderBy("__h", subject)
    cut = (marked.filter(edge).withColumn("__r", F.row_number().over(w))
           .filter(F.col("__before") + F.col("__r") <= F.col("__take"))
           .select(subject))
    val = marked.filter(inside).select(subject).unionByName(cut)
    val = val.withColumn("__val", F.lit(True))
    return (df.join(val, subject, "left")
            .withColumn("split", F.when(F.col(trial) == test_trial, "test")
                        .when(F.col("__val"), "val").otherwise("train"))
            .drop("__val").select(*df.columns, "split"))


# Interpolation and time in range.

def interpolate_daily(df: DataFrame, keys=KEYS, value: str = "value",
                      scan=PLAIN) -> DataFrame:
    """A row for every day of a trajectory, the value interpolated linearly.
    Days before the first known value stay NULL, days after the last keep it.

    Each row expands to the days up to the next row, so the grid needs no
    join and a long trajectory spreads over its rows.
    """
    df = intervals(df, keys, value, scan)
    day = F.col("__day")
    days = F.sequence(F.col(DAY),
                      F.coalesce(F.col("__next_day") - 1, F.col(DAY)))
    out = df.withColumn("__day", F.explode(days))
    v = F.coalesce(F.when(day == F.col(DAY), F.col(value)), value_on(day))
    return out.select(*keys, TRAJ, day.alias(DAY), v.alias(value),
                      (day == F.col(DAY)).alias("is_visit"))


def intervals(df: DataFrame, keys=KEYS, value: str = "value",
              scan=PLAIN) -> DataFrame:
    """For every row the next day and the line through the known values
    around the span from this row to the next."""
    within = [*keys, TRAJ]
    known = F.when(F.col(value).isNotNull(),
                   F.struct(F.col(DAY).alias("d"), F.col(value).alias("v")))
    df = scan.add(df, within, [DAY], __next_day=lead(DAY),
                  __lo=last_known(known), __ahead=next_known(known))
    df = scan.add(df, within, [DAY], __hi=lead("__ahead"))
    lo, hi = F.col("__lo"), F.col("__hi")
    # Two rows of one day have no line between them.
    slope = F.try_divide(hi["v"] - lo["v"], hi["d"] - lo["d"])
    return df.withColumns({
        "__ld": lo["d"], "__lv": lo["v"], "__hd": hi["d"], "__hv": hi["v"],
        "__slope": F.when(lo.isNotNull(), F.coalesce(slope, F.lit(0.0))),
    }).drop("__ahead", "__lo", "__hi")


def value_on(day: Column) -> Column:
    """Interpolated value on a day of the span described by `intervals`."""
    return F.when(day == F.col("__hd"), F.col("__hv")).otherwise(
        F.col("__slope") * (day - F.col("__ld")) + F.col("__lv"))


def mark_in_range(spans: DataFrame, lo: float, hi: float) -> DataFrame:
    """Add `__a` and `__b`, the first and last day after this row and up to
    the next one whose interpolated value lies in [lo, hi]; NULL for none.

    A straight line is in range on one run of days. The ends of the run are
    solved for, then each is corrected by at most one day with the formula
    the daily grid uses, so both forms agree to the day.
    """
    first, last = F.col(DAY) + 1, F.col("__next_day")
    slope, base = F.col("__slope"), F.col("__lv")
    rising, flat = slope > 0, F.coalesce(slope, F.lit(0.0)) == 0
    far = F.lit(1.0e9)      # keeps a nearly flat line inside the int range

    def crossing(level):
        at = (level - base) / F.when(slope != 0, slope)
        return F.greatest(-far, F.least(far, at))

    enter = F.when(rising, F.lit(lo)).otherwise(F.lit(hi))
    leave = F.when(rising, F.lit(hi)).otherwise(F.lit(lo))
    x = F.when(flat, first).otherwise(
        F.ceil(crossing(enter)) + F.col("__ld"))
    y = F.when(flat, last).otherwise(
        F.floor(crossing(leave)) + F.col("__ld"))
    spans = spans.withColumns({
        "__x": F.greatest(first, F.least(x, last + 1)),
        "__y": F.least(last, F.greatest(y, first - 1))})

    x, y = F.col("__x"), F.col("__y")

    def ok(day):
        return in_range(value_on(day), lo, hi)

    spans = spans.withColumns({
        "__x": F.when((x > first) & ok(x - 1), x - 1)
        .when((x <= last) & ok(x), x).otherwise(x + 1),
        "__y": F.when((y < last) & ok(y + 1), y + 1)
        .when((y >= first) & ok(y), y).otherwise(y - 1)})
    # Before the first known value only that value's own day can count.
    unknown = F.col("__lv").isNull()
    spans = spans.withColumns({"__x": F.when(unknown, last).otherwise(x),
                               "__y": F.when(unknown, last).otherwise(y)})
    fits = (x >= first) & (y <= last) & (x <= y) & ok(x) & ok(y)
    return spans.withColumns({"__a": F.when(fits, x),
                              "__b": F.when(fits, y)}).drop("__x", "__y")


def with_days_in_range(df: DataFrame, keys=KEYS, lo: float = 2.0,
                       hi: float = 3.0, value: str = "value",
                       scan=PLAIN) -> DataFrame:
    """Add `__in`, the days in range that a row accounts for: those after it
    up to the next row, and its own day where it opens the trajectory."""
    given = df.columns
    spans = mark_in_range(intervals(df, keys, value, scan), lo, hi)
    after = F.coalesce(F.col("__b") - F.col("__a") + 1, F.lit(0))
    spans = scan.add(spans, [*keys, TRAJ], [DAY], __prev=lag(DAY))
    own = F.when(F.col("__prev").isNull(),
                 in_range(F.col(value), lo, hi).cast("int")).otherwise(0)
    return spans.select(*given, (after + own).alias("__in"))


def ttr_aggs() -> dict:
    """Aggregates over a trajectory of rows with `__in`."""
    length = F.max(DAY) - F.min(DAY)
    return {"ttr": F.sum("__in") / (length + 1), "length": length}


def time_in_range(df: DataFrame, keys=KEYS, lo: float = 2.0, hi: float = 3.0,
                  value: str = "value", scan=PLAIN) -> DataFrame:
    """Share of days in range per trajectory, days without a value counting
    as out. Works on visits: no day is materialised."""
    rows = with_days_in_range(df.select(*keys, TRAJ, DAY, value), keys, lo,
                              hi, value, scan)
    return rows.groupBy(*keys, TRAJ).agg(
        *[e.alias(n) for n, e in ttr_aggs().items()])


def trajectory_stats(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rows, first and last day and length in days of each trajectory."""
    return df.groupBy(*keys, TRAJ).agg(
        F.count(F.lit(1)).alias("rows"), F.min(DAY).alias("first_day"),
        F.max(DAY).alias("last_day"),
        (F.max(DAY) - F.min(DAY)).alias("length"))


def mark_first(df: DataFrame, keys=(*KEYS, TRAJ), order=ORDER,
               out: str = "is_first", scan=PLAIN) -> DataFrame:
    df = scan.add(df, keys, order, __p=lag(F.lit(True)))
    return df.withColumn(out, F.col("__p").isNull()).drop("__p")


def before_gap(df: DataFrame, keys, order, flag: str, out: str,
               scan=PLAIN) -> DataFrame:
    df = scan.add(df, keys, order, **{out: lead(flag)})
    return df.withColumn(out, truth(col(out)))
