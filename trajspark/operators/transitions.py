"""Semi-Markov transitions: options, elapsed days, rewards, end flags and
sampling weights."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.columns import (any_of, decision_code, finite,
                                         hash_uniform, relative_change,
                                         row_sum)
from trajspark.operators.features import StateBuilder, bounded_collect
from trajspark.operators.scan import (CHUNKED, PLAIN, add_by_key,
                                      last_known, lead, running_sum)
from trajspark.operators.trajectories import (DAY, KEYS, ORDER, TRAJ,
                                              drop_incomplete_events,
                                              intervals, mark_in_range,
                                              min_observed)
from trajspark.params import Params
from trajspark.session import cut_lineage

WITHIN = [*KEYS, TRAJ]


def observed_decision(df: DataFrame, dose: str = "dose",
                      scan=PLAIN) -> DataFrame:
    """Relative dose change to the next visit and its option code."""
    df = scan.add(df, WITHIN, ORDER, __next=lead(dose))
    return (df.withColumn("dose_ratio", relative_change("__next", dose))
            .withColumn("option", decision_code("dose_ratio"))
            .drop("__next"))


def option_means(df: DataFrame) -> DataFrame:
    """Mean finite dose ratio of each option; needs `observed_decision`."""
    return (df.filter(finite("dose_ratio") & F.col("option").isNotNull())
            .groupBy("option").agg(F.avg("dose_ratio").alias("ratio")))


def elapsed(df: DataFrame, scan=PLAIN) -> DataFrame:
    """k, the days to the next visit of the trajectory."""
    df = scan.add(df, WITHIN, ORDER, __next=lead(DAY))
    return df.withColumn("k", F.col("__next") - F.col(DAY)).drop("__next")


def _geometric(first: Column, last: Column, gamma: float) -> Column:
    """Sum of gamma^t for t = first..last."""
    if gamma == 1.0:
        return (last - first + 1).cast("double")
    g = F.lit(float(gamma))
    return (F.pow(g, first) - F.pow(g, last + 1)) / F.lit(1.0 - gamma)


def transition_reward(df: DataFrame, events, gamma: float = 0.99,
                      value_reward: float = 1.0, event_reward: float = 0.0,
                      lo: float = 2.0, hi: float = 3.0, value: str = "value",
                      scan=PLAIN) -> DataFrame:
    """Discounted reward of the days after a visit up to the next one.

    The in-range days of the span are one run, so their discounted sum is a
    geometric series; nothing expands to days. The last visit has none.
    """
    given = df.columns
    df = df.withColumn("__ev", any_of(events).cast("double"))
    df = intervals(df, KEYS, value, scan)
    df = scan.add(df, WITHIN, ORDER, __evn=lead("__ev"))
    day, nxt = F.col(DAY), F.col("__next_day")
    df = mark_in_range(df, lo, hi)
    start = day + 1
    inside = F.coalesce(_geometric(F.col("__a") - start, F.col("__b") - start,
                                   gamma), F.lit(0.0))
    event = F.col("__evn") * F.pow(F.lit(float(gamma)), nxt - day - 1)
    reward = inside * value_reward + event * event_reward
    return df.withColumn("reward", F.when(nxt.isNotNull(), reward)) \
        .select(*given, "reward")


def transition_reward_daily(df: DataFrame, events, gamma: float = 0.99,
                            value_reward: float = 1.0,
                            event_reward: float = 0.0, lo: float = 2.0,
                            hi: float = 3.0, scan=PLAIN) -> DataFrame:
    """The same reward summed over an explicit daily grid; a check on
    `transition_reward` for small tables."""
    from trajspark.functions.columns import in_range
    from trajspark.operators.trajectories import value_on
    spans = intervals(df.withColumn("__ev", any_of(events).cast("double")),
                      KEYS, "value", scan)
    spans = scan.add(spans, WITHIN, ORDER, __evn=lead("__ev"))
    days = spans.withColumn("__d", F.explode_outer(F.when(
        F.col("__next_day").isNotNull(),
        F.sequence(F.col(DAY) + 1, F.col("__next_day")))))
    d = F.col("__d")
    hit = in_range(value_on(d), lo, hi).cast("double") * value_reward
    ev = F.when(d == F.col("__next_day"), F.col("__evn")).otherwise(0.0)
    r = (hit + ev * event_reward) * F.pow(F.lit(float(gamma)),
                                          d - F.col(DAY) - 1)
    return days.groupBy(*WITHIN, DAY).agg(
        F.sum(F.when(d.isNotNull(), r)).alias("reward"))


def done_flag(df: DataFrame, value: str = "value", dose: str = "dose",
              scan=PLAIN) -> DataFrame:
    """1 when the next row is the last one of the trajectory with both value
    and dose."""
    full = F.col(value).isNotNull() & F.col(dose).isNotNull()
    df = scan.group(df, WITHIN, ORDER, __last=F.max(F.when(full, F.col(DAY))))
    mark = F.coalesce((F.col(DAY) == F.col("__last")).cast("int"), F.lit(0))
    df = scan.add(df.withColumn("__mark", mark), WITHIN, ORDER,
                  done=lead("__mark"))
    return df.drop("__last", "__mark")


def sample_weight(df: DataFrame, mode: str = "event", factor: float = 1.0,
                  events=(), scan=PLAIN) -> DataFrame:
    """Relative sampling weight: by inverse option frequency, or a factor for
    trajectories with an event."""
    if mode == "option":
        counts = (df.filter(F.col("option").isNotNull()).groupBy("option")
                  .agg(F.count(F.lit(1)).alias("__n")))
        # At most seven options.
        top = counts.agg(F.max("__n")).scalar()
        w = counts.select("option",
                          (top / F.col("__n")).alias("sample_weight"))
        return df.join(F.broadcast(w), "option", "left")
    df = scan.group(df, WITHIN, ORDER, __any=F.sum(row_sum(events)))
    return (df.withColumn("sample_weight", F.when(F.col("__any") > 0,
                                           F.lit(float(factor)))
                          .otherwise(1.0)).drop("__any"))


def normalise_weight(df: DataFrame, weight: str = "sample_weight",
                     out: str = "sample_prob") -> DataFrame:
    """Divide by the total, a scalar subquery and not a global window."""
    total = df.agg(F.sum(weight)).scalar()
    return df.withColumn(out, F.col(weight) / total)


def eligible_rows(df: DataFrame, params: Params = Params(),
                  min_length: int | None = None, scan=PLAIN) -> DataFrame:
    """Trajectories long enough, without incomplete rows of events that do
    not split."""
    n = params.min_train_length if min_length is None else min_length
    df = min_observed(df, KEYS, n=n, scan=scan)
    loose = [e for e in params.events_kept
             if e not in params.events_splitting]
    return drop_incomplete_events(df, loose, KEYS, scan=scan)


def whole(df: DataFrame, names) -> Column:
    """Whether none of the columns is NULL or NaN, as `na.drop` has it."""
    kinds = dict(df.dtypes)
    return reduce(lambda a, b: a & b, [
        F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float")
        else F.col(c).isNotNull() for c in names])


def build_transitions(df: DataFrame, params: Params = Params(),
                      fitted: StateBuilder | None = None,
                      min_length: int | None = None,
                      weight_mode: str = "event", factor: float = 1.0,
                      scan=PLAIN):
    """The transition table and the fitted state builder.

    Columns: keys, k, option, reward, not_done, sample_prob, the state and
    the next state (prefix `next_`). Rows with anything missing are left out.
    """
    # The fit and the features read these rows several times.
    rows = cut_lineage(eligible_rows(df, params, min_length, scan))
    fitted = fitted or StateBuilder(params).fit(rows, scan)
    states = decision_states(rows, fitted, params, weight_mode, factor, scan)
    return whole_pairs(with_next(states, fitted.state_names(), scan)), fitted


def decision_states(rows: DataFrame, fitted: StateBuilder,
                    params: Params = Params(), weight_mode: str = "event",
                    factor: float = 1.0, scan=PLAIN, also=()) -> DataFrame:
    """The state of every eligible row with k, option, reward, not_done,
    sample_weight and the columns `also`."""
    facts = elapsed(observed_decision(rows, scan=scan), scan)
    facts = transition_reward(facts, params.events_evaluated, params.discount,
                              params.value_reward, params.event_reward,
                              scan=scan)
    facts = done_flag(facts, scan=scan)
    facts = sample_weight(facts, weight_mode, factor,
                          params.events_evaluated, scan)
    facts = facts.withColumn("not_done", 1.0 - F.col("done"))
    # The state is worked out on the same rows, so nothing has to be joined.
    return fitted.transform(facts, scan, ["k", "option", "reward", "not_done",
                                          "sample_weight", *also])


def with_next(out: DataFrame, names, scan=PLAIN) -> DataFrame:
    """The next state of the trajectory beside each, and whether they are
    whole."""
    # Whether the next state is whole is one column, so the total weight reads
    # none of the others.
    return scan.add(out.withColumn("__whole", whole(out, names)), WITHIN,
                    ORDER, __next_whole=lead("__whole"),
                    **{f"next_{c}": lead(c) for c in names})


def whole_pairs(out: DataFrame) -> DataFrame:
    """Transitions from `with_next`: state and next state are whole."""
    # A row with k has a reward; filtering on k keeps the longer expression
    # out of pushed-down predicates.
    out = out.filter("__whole AND __next_whole") \
        .drop("__whole", "__next_whole") \
        .na.drop(subset=["k", "option", "not_done", "sample_weight"])
    return normalise_weight(out).drop("sample_weight")


def missing_states(df: DataFrame, state: DataFrame, events,
                   names) -> DataFrame:
    """One row: visits without an event whose state has a gap."""
    joined = df.select(*WITHIN, DAY, any_of(events).alias("__ev")) \
        .join(state, [*WITHIN, DAY])
    gaps = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    return joined.agg(F.count_if(gaps & ~F.col("__ev")).alias("missing"))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int = 42,
                    keys=(*WITHIN, DAY), buckets: int = 1024
                    ) -> DataFrame:
    """n draws with replacement, row by row with probability by weight.

    Draws are first shared among hash buckets by a multinomial, then placed
    inside a bucket by sorting them among the running weights. `draws` counts
    how often a row was taken. A draw depends on the seed and the number of
    buckets, not on settings of the session.
    """
    b = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int")
    rows = df.filter(F.col(weight) > 0).withColumn("__b", b)
    totals = bounded_collect(rows.groupBy("__b").agg(
        F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")),
        buckets, "buckets").sort_values("__b")
    p = totals["w"].to_numpy(dtype=float)
    share = np.random.default_rng(seed).multinomial(n, p / p.sum())
    totals["take"] = share
    plan = df.sparkSession.createDataFrame(
        totals[["__b", "w", "take"]].astype({"take": "int64"}),
        "__b int, __w double, __take long")

    step = add_by_key(rows, ["__b"], list(keys), __upto=running_sum(weight))
    starts = step.select("__b", (F.col("__upto") - F.col(weight)).alias("__at"),
                         F.lit(0).alias("__kind"), F.struct(*keys)
                         .alias("__row"))
    draws = (plan.filter("__take > 0")
             .withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"),
                                                     F.col("__take"))))
             .select("__b", (hash_uniform(["__b", "__i"], seed)
                             * F.col("__w")).alias("__at"),
                     F.lit(1).alias("__kind"),
                     F.lit(None).cast(starts.schema["__row"].dataType)
                     .alias("__row")))
    # A row with much weight draws often: its bucket may be hot.
    placed = CHUNKED.add(
        starts.unionByName(draws), ["__b"], ["__at", "__kind"],
        __hit=last_known("__row"))
    hits = (placed.filter("__kind = 1").groupBy("__hit")
            .agg(F.count(F.lit(1)).alias("draws"))
            .select("__hit.*", "draws"))
    return df.join(hits, list(keys))
