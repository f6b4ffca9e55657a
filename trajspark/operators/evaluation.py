"""Comparing policies with observed decisions off-line."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import (constant_policy, cut, decision_code,
                                         feasible, finite, hash_uniform,
                                         in_range, poisson_cuts, rule_policy,
                                         truth)
from trajspark.operators.relational import any_by, keep_ids, neg_corr
from trajspark.operators.scan import (PLAIN, add_by_key, lag, lead,
                                      running_sum)
from trajspark.operators.trajectories import (DAY, KEYS, ORDER, TRAJ,
                                              ttr_aggs, with_days_in_range)
from trajspark.operators.transitions import observed_decision
from trajspark.params import AGREEMENT_THRESHOLDS, DAYS_PER_YEAR

WITHIN = [*KEYS, TRAJ]
ALGOS = ("policy", "threshold", "random", "maintain")
#: Trajectories whose draws a task holds at once.
DRAWN = 256


def _options(df: DataFrame, observed: str, ratio: str | None = None,
             weighted: bool = False) -> DataFrame:
    """One value about the seven options: sorted codes with weights and,
    given the dose ratios, the map from code to mean ratio."""
    share = F.col("n") if weighted else F.lit(1)
    mean = F.avg(F.when(finite(ratio), F.col(ratio))) if ratio \
        else F.lit(None).cast("double")
    per = (df.filter(F.col(observed).isNotNull())
           .groupBy(F.col(observed).cast("int").alias("code"))
           .agg(F.count(F.lit(1)).alias("n"), mean.alias("mean")))
    return per.agg(F.struct(
        F.array_sort(F.collect_list(F.struct(
            "code", share.cast("double").alias("w")))).alias("codes"),
        F.map_from_entries(F.collect_list(F.struct("code", "mean")))
        .alias("means")).alias("options"))


def _draw(keys, seed, weighted: bool = False) -> Column:
    """A code from `__codes`, picked by a hash of the row."""
    u = hash_uniform(keys, seed)
    if not weighted:
        at = F.floor(u * F.size("__codes")) + 1
        return F.element_at(F.col("__codes.code"), at.cast("int"))
    total = F.aggregate("__codes", F.lit(0.0), lambda a, x: a + x["w"])
    pick = F.aggregate(
        "__codes",
        F.struct((u * total).alias("left"),
                 F.lit(None).cast("int").alias("k")),
        lambda a, x: F.struct(
            (a["left"] - x["w"]).alias("left"),
            F.when(a["k"].isNull() & (a["left"] < x["w"]), x["code"])
            .otherwise(a["k"]).alias("k")))
    return pick["k"]


def random_policy(df: DataFrame, observed: str = "option",
                  out: str = "random_action", weighted: bool = False,
                  seed: int = 42, keys=(*WITHIN, DAY)) -> DataFrame:
    """An observed option at random, uniformly or by frequency. The draw is a
    hash of the row keys, so it does not depend on partitioning."""
    one = _options(df, observed, weighted=weighted)
    return (df.withColumn("__codes", one.scalar()["codes"])
            .withColumn(out, _draw(keys, seed, weighted)).drop("__codes"))


def compare_policies(df: DataFrame, action: Column | str,
                     means: DataFrame | None = None, seed: int = 42,
                     subset: DataFrame | None = None, extra=(),
                     scan=PLAIN) -> DataFrame:
    """One row per visit: the observed decision and what the policy, the
    rule, chance and doing nothing would have done, with differences of the
    relative doses.

    `action` gives the policy's option code. `means` maps codes to doses
    (option, ratio) and is computed from the rows when missing. `subset`
    keeps only its subjects.
    """
    df = df.withColumn("policy_action",
                       (F.col(action) if isinstance(action, str) else action)
                       .cast("int"))
    df = observed_decision(df, scan=scan)
    one = _options(df, "option", "dose_ratio")
    given = None if means is None else means.agg(F.map_from_entries(
        F.collect_list(F.struct("option", "ratio"))).alias("m"))
    df = scan.add(df, WITHIN, ORDER, next_value=lead("value"),
                  previous_value=lag("value"))
    df = df.withColumnsRenamed({"option": "observed_action",
                                "dose_ratio": "observed_quant"})
    df = df.withColumn("__options", one.scalar()).withColumns({
        "__codes": F.col("__options.codes"),
        "__means": F.col("__options.means") if given is None
        else given.scalar()})
    df = df.withColumns({
        "random_action": _draw((*WITHIN, DAY), seed),
        "next_in_range": in_range("next_value").cast("int"),
        "threshold_quant": rule_policy("value"),
        "threshold_action": decision_code(rule_policy("value")),
        "maintain_action": constant_policy()})
    df = df.withColumns({
        f"{a}_quant": F.try_element_at("__means", F.col(f"{a}_action"))
        for a in ("policy", "random", "maintain")})
    diffs = {f"{a}_diff": F.col(f"{a}_quant") - F.col("observed_quant")
             for a in ALGOS}
    df = df.withColumns(diffs).withColumns({
        f"{a}_eq": truth(F.abs(F.col(f"{a}_diff")) <= 0.05).cast("int")
        for a in ALGOS})
    if subset is not None:
        df = keep_ids(df, subset, "subjid")
    return df.select(
        *WITHIN, DAY, "value", "next_value", "previous_value",
        "next_in_range", "observed_action", "observed_quant",
        *[f"{a}_{x}" for a in ALGOS
          for x in ("action", "quant", "diff", "eq")], *extra)


def disagreement(compared: DataFrame, event_cols=(),
                 events: DataFrame | None = None,
                 scan=PLAIN) -> DataFrame:
    """One row per trajectory: mean agreement and mean absolute difference of
    each algorithm, time in range, length, and whether events happened.

    Event flags are columns of `compared`, which makes this one pass; give
    `events` to read them from other rows.
    """
    aggs = {}
    for a in ALGOS:
        aggs[f"{a}_eq"] = F.avg(f"{a}_eq")
        aggs[f"{a}_diff"] = F.avg(F.abs(F.col(f"{a}_diff")))
    aggs |= ttr_aggs()
    if events is None:
        aggs |= {e: F.max(truth(F.col(e) > 0).cast("int"))
                 for e in event_cols}
    out = with_days_in_range(compared, scan=scan).groupBy(*WITHIN).agg(
        *[e.alias(n) for n, e in aggs.items()])
    if events is not None:
        out = out.join(any_by(events, WITHIN, event_cols), WITHIN, "left")
    if event_cols:
        out = out.withColumn("any_event", F.greatest(
            F.lit(0), *[F.col(e) for e in event_cols]))
    return out


def hierarchical_ttr(compared: DataFrame, scan=PLAIN) -> DataFrame:
    """Visit rows with the time in range and length of their trajectory."""
    rows = with_days_in_range(compared, scan=scan)
    rows = scan.group(rows, WITHIN, ORDER, __days=F.sum("__in"),
                      __first=F.min(DAY), __last=F.max(DAY))
    length = F.col("__last") - F.col("__first")
    return rows.withColumns({"ttr": F.col("__days") / (length + 1),
                             "length": length}) \
        .drop("__in", "__days", "__first", "__last")


def reasonable_share(df: DataFrame, action: str = "policy_action") -> DataFrame:
    """Share of actions that raise a low value, hold one in range and lower a
    high one."""
    v, a = F.col("value"), F.col(action)
    good = ((v.between(2.0, 3.0) & (a == 3)) | ((v < 2.0) & (a > 3))
            | ((v > 3.0) & (a < 3)))
    return df.agg(F.avg(truth(good).cast("double")).alias("share"))


def classification(df: DataFrame, algos=ALGOS,
                   truth_col: str = "next_in_range") -> DataFrame:
    """Does agreement predict a next value in range? Counts, sensitivity,
    specificity and Youden's index, exact and by direction, one row per
    algorithm from a single pass."""
    y = truth(F.col(truth_col) == 1)
    o = F.col("observed_action")
    aggs = [F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg")]
    for a in algos:
        p = F.col(f"{a}_action")
        same = truth(o == p)
        side = truth(((o < 3) & (p < 3)) | ((o == 3) & (p == 3))
                     | ((o > 3) & (p > 3)))
        for tag, hit in (("", same), ("_dir", side)):
            aggs += [F.count_if(y & hit).alias(f"{a}_tp{tag}"),
                     F.count_if(~y & ~hit).alias(f"{a}_tn{tag}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(a).alias("algorithm"),
        *[F.col(f"{a}_{k}").alias(k)
          for k in ("tp", "tn", "tp_dir", "tn_dir")]) for a in algos]))
    out = one.select("n_pos", "n_neg", rows.alias("r")) \
        .select("r.algorithm", "n_pos", "n_neg", "r.tp", "r.tn", "r.tp_dir",
                "r.tn_dir")
    for tag in ("", "_dir"):
        out = out.withColumns({
            f"sensitivity{tag}": F.try_divide(f"tp{tag}", "n_pos"),
            f"specificity{tag}": F.try_divide(f"tn{tag}", "n_neg")})
        out = out.withColumn(f"jindex{tag}", F.col(f"sensitivity{tag}")
                             + F.col(f"specificity{tag}") - 1)
    return out


def with_intervals(classified: DataFrame, alpha: float = 0.05,
                   compat: bool = False) -> DataFrame:
    """Exact binomial limits for the few rows of `classification`, in long
    form: algorithm, statistic, value, lower, upper."""
    from trajspark.functions.special import binomial_interval
    rows = []
    for r in classified.collect():      # one row per algorithm
        for tag in ("", "_dir"):
            for stat, hit, n in (("sensitivity", "tp", "n_pos"),
                                 ("specificity", "tn", "n_neg")):
                lo, hi = binomial_interval(r[hit + tag], r[n], alpha, compat)
                rows.append((r["algorithm"], stat + tag, r[stat + tag],
                             lo, hi))
    return classified.sparkSession.createDataFrame(
        rows, "algorithm string, statistic string, value double, "
              "lower double, upper double")


def _unpivot_diffs(dis: DataFrame, keep) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(
        F.lit(a).alias("algorithm"), F.col(f"{a}_diff").alias("diff"))
        for a in ALGOS]))
    return dis.select(*keep, pairs.alias("p")).select(*keep, "p.*")


def at_agreement(dis: DataFrame, events,
                 thresholds=AGREEMENT_THRESHOLDS) -> DataFrame:
    """Outcomes among trajectories that agree within each threshold, for all
    algorithms and thresholds in one pass. Every trajectory lists the
    thresholds it meets, so no threshold grid is joined."""
    events = [*events, "any_event"]
    long = _unpivot_diffs(dis, ["ttr", "length", *events])
    levels = F.array(*[F.lit(t) for t in thresholds])
    met = F.filter(levels, lambda t: F.col("diff") < t)
    # The NULL level counts all trajectories of an algorithm.
    hits = long.withColumn("threshold", F.explode(
        F.array_append(met, F.lit(None).cast("double"))))
    days = F.sum("length")
    varies = F.col("threshold").isNotNull()
    x, y = F.when(varies, F.col("diff")), F.when(varies, F.col("ttr"))
    out = hits.groupBy("algorithm", "threshold").agg(
        F.try_divide(F.sum(F.col("ttr") * F.col("length")), days)
        .alias("ttr"),
        *[F.try_divide(F.sum(e) * DAYS_PER_YEAR, days)
          .alias(f"{e}_per_year") for e in events],
        F.count(F.lit(1)).alias("trajectories"),
        days.alias("total_days"),
        F.when(F.sum(x) > 0, neg_corr(x, y)).alias("consistency"))
    # At most nine rows per algorithm are left.
    total = F.max(F.when(~varies, F.col("trajectories"))).over(
        Window.partitionBy("algorithm"))
    return (out.withColumn("share", F.col("trajectories") / total)
            .filter(varies))


def wis_trajectories(df: DataFrame, behaviour: str, policies: dict,
                     reward: str = "reward", gamma: float = 0.99,
                     scan=PLAIN) -> DataFrame:
    """Importance weight of each policy and discounted return by trajectory.
    `policies` maps names to the column with the probability of the observed
    option."""
    df = scan.group(df, WITHIN, ORDER, __start=F.min(DAY))
    t = F.col(DAY) - F.col("__start")
    return df.groupBy(*WITHIN).agg(
        *[F.product(F.col(c) / F.col(behaviour)).alias(f"{n}_weight")
          for n, c in policies.items()],
        F.sum(F.pow(F.lit(gamma), t) * F.col(reward)).alias("value"))


def wis(trajectories: DataFrame, names) -> DataFrame:
    """Weighted importance sampling value per policy; the clinician's weight
    is one everywhere."""
    one = trajectories.agg(
        F.avg("value").alias("clinician"),
        *[F.try_divide(F.sum(F.col(f"{n}_weight") * F.col("value")),
                       F.sum(f"{n}_weight")).alias(n) for n in names])
    return one.unpivot([], ["clinician", *names], "policy", "value")


def bootstrap(trajectories: DataFrame, names, n: int = 1000, seed: int = 42,
              keys=WITHIN) -> DataFrame:
    """Resampled WIS values, one row per replicate and policy.

    Each trajectory draws its own Poisson(1) count in every replicate. One
    md5 of its key and the number of four replicates holds four draws of 32
    bits, so any engine can repeat them. A task weighs the counts of a few
    trajectories at once by one matrix product and sends one row per
    replicate.
    """
    values = ["value", *[f"{p}_weight" for p in names]]
    blocks = [f"{seed}|{b}".encode() for b in range((n - 1) // 4 + 1)]
    cuts = np.array(poisson_cuts(), np.uint32)
    sums = ["value", *[f"{p}_{x}" for p in names for x in ("weight", "sum")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, drawn = np.zeros((n, len(sums))), np.zeros(n, np.int64)
        known = None    # how many rows have the cell; no rows, no replicates
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False)
                                 for c in batch.columns[1:]])
            ok = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False)
                                  for c in batch.columns[1:]])
            # Value, then of each policy its weight and weight times value.
            x, ok = (np.column_stack([t[:, 0], *[
                y for i in range(1, len(values))
                for y in (t[:, i], t[:, i] * t[:, 0])]]) for t in (x, ok))
            x = np.where(ok, x, 0.0)
            if len(ok):
                known = ok.sum(0) + (0 if known is None else known)
            keys = [k.encode() for k in batch.column(0).to_pylist()]
            for lo in range(0, len(keys), DRAWN):
                part = keys[lo:lo + DRAWN]
                bits = b"".join([hashlib.md5(b + k).digest()
                                 for k in part for b in blocks])
                u = np.frombuffer(bits, ">u4").astype(np.uint32) \
                    .reshape(len(part), -1)[:, :n]
                count = np.searchsorted(cuts, u, "right")
                drawn += count.sum(0)
                with np.errstate(invalid="ignore"):
                    total += count.T.astype(float) @ x[lo:lo + DRAWN]
        if known is not None:
            cells = [pa.array(t) if k else pa.nulls(n, pa.float64())
                     for t, k in zip(total.T.copy(), known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(1, n + 1), pa.int32()), pa.array(drawn),
                 *cells], ["replicate", "__n", *[f"__{s}" for s in sums]])

    # A null key is left out, as `concat_ws` has it.
    text = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string")
                                         for k in keys])
    cells = ", ".join(f"`__{s}` double" for s in sums)
    found = trajectories.select(
        text.alias("__key"), *[F.col(c).cast("double") for c in values]) \
        .mapInArrow(run, f"replicate int, __n long, {cells}")
    means = [F.try_divide(F.sum("__value"), F.sum("__n")).alias("clinician")]
    means += [F.try_divide(F.sum(f"__{p}_sum"), F.sum(f"__{p}_weight"))
              .alias(p) for p in names]
    return found.groupBy("replicate").agg(*means).unpivot(
        ["replicate"], ["clinician", *names], "policy", "value")


def bootstrap_interval(replicates: DataFrame, lower: float = 0.025,
                       upper: float = 0.975) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(lower), F.lit(upper)))
    return (replicates.groupBy("policy").agg(q.alias("q"))
            .select("policy", F.col("q")[0].alias("lower"),
                    F.col("q")[1].alias("upper")))


def action_change(a: DataFrame, b: DataFrame, column: str = "policy_action",
                  keys=(*WITHIN, DAY)) -> DataFrame:
    """Mean absolute change of the selected actions between two runs."""
    both = a.select(*keys, F.col(column).alias("__a")).join(
        b.select(*keys, F.col(column).alias("__b")), list(keys))
    return both.agg(F.avg(F.abs(F.col("__a") - F.col("__b")))
                    .alias("action_change"))


# Class-probability metrics: `p` holds the probabilities, `y` the class.

def coverage(df: DataFrame, tau: float, p: str = "p",
             y: str = "y") -> DataFrame:
    """Share of rows whose class is in the feasible set."""
    hit = F.element_at(feasible(p, tau), F.col(y) + 1)
    return df.agg(F.avg(hit.cast("double")).alias("coverage"))


def multi_f1(df: DataFrame, tau: float, p: str = "p",
             y: str = "y") -> DataFrame:
    """Macro F1 with the feasible set as a multi-label prediction."""
    rows = df.select(F.col(y).alias("y"),
                     F.posexplode(feasible(p, tau)).alias("cls", "hit"))
    return _macro_f1(rows, F.col("hit"), F.col("y") == F.col("cls"), "cls")


def _macro_f1(rows: DataFrame, said: Column, is_it: Column,
              cls: str) -> DataFrame:
    per = rows.groupBy(cls).agg(F.count_if(said & is_it).alias("tp"),
                                F.count_if(said).alias("said"),
                                F.count_if(is_it).alias("are"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"),
                                 F.col("said") + F.col("are")), F.lit(0.0))
    return per.agg(F.avg(f1).alias("f1"))


def contiguity(df: DataFrame, tau: float, p: str = "p") -> DataFrame:
    """Share of rows whose feasible set has no hole."""
    at = F.filter(F.transform(feasible(p, tau),
                              lambda ok, i: F.when(ok, i)),
                  lambda i: i.isNotNull())
    whole = (F.array_max(at) - F.array_min(at) + 1) == F.size(at)
    return df.agg(F.avg(whole.cast("double")).alias("contiguity"))


def calibration_error(df: DataFrame, width: float = 0.1, p: str = "p",
                      y: str = "y") -> DataFrame:
    """Expected calibration error over classes and right-closed probability
    bins; a probability of zero falls in none."""
    n = round(1 / width)
    bounds = [round(i * width, 2) for i in range(n + 1)]
    mids = [i * width + width / 2 for i in range(n)]
    rows = df.select(F.col(y).alias("y"),
                     F.posexplode(p).alias("cls", "prob"))
    rows = rows.withColumn("mid", cut("prob", bounds, mids)).na.drop()
    per = rows.groupBy("cls", "mid").agg(
        F.avg((F.col("y") == F.col("cls")).cast("double")).alias("rate"),
        F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.abs(F.col("mid") - F.col("rate")) * F.col("n"))
                    / F.sum("n")).alias("ece"))


def accuracy(df: DataFrame, pred: Column, y: str = "y") -> DataFrame:
    return df.agg(F.avg((pred == F.col(y)).cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, pred: Column, y: str = "y") -> DataFrame:
    """F1 averaged over the classes that occur or are predicted."""
    pairs = df.select(F.col(y).cast("int").alias("y"),
                      pred.cast("int").alias("z"))
    rows = pairs.groupBy("y", "z").count()      # a confusion matrix
    said = rows.groupBy(F.col("z").alias("cls")).agg(
        F.sum("count").alias("said"), F.sum(F.when(F.col("y") == F.col("z"),
                                                   F.col("count"))
                                            .otherwise(0)).alias("tp"))
    are = rows.groupBy(F.col("y").alias("cls")).agg(
        F.sum("count").alias("are"))
    z = F.lit(0)
    both = said.join(are, "cls", "full_outer").select(
        F.coalesce("tp", z).alias("tp"), F.coalesce("said", z).alias("said"),
        F.coalesce("are", z).alias("are"))
    return both.agg(F.avg(2 * F.col("tp") / (F.col("said") + F.col("are")))
                    .alias("f1"))


def auroc_ovr(df: DataFrame, p: str = "p", y: str = "y",
              scan=None) -> DataFrame:
    """Macro average of one-vs-rest areas under the curve.

    Scores are counted first, then a running count of negatives over distinct
    scores gives the rank sums. The key is the class, of which there are few,
    so a large table takes the chunked scan.
    """
    rows = df.select(F.col(y).alias("y"), F.posexplode(p)
                     .alias("cls", "score"))
    is_it = (F.col("y") == F.col("cls")).cast("long")
    counts = rows.groupBy("cls", "score").agg(
        F.sum(is_it).alias("pos"), F.sum(1 - is_it).alias("neg"))
    run = add_by_key(counts, ["cls"], ["score"], scan,
                     upto=running_sum("neg"))
    below = F.col("upto") - F.col("neg")
    per = run.groupBy("cls").agg(
        (F.sum(F.col("pos") * (below + F.col("neg") / 2))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return per.agg(F.avg("auc").alias("auroc"))


def spearman(df: DataFrame, a: str, b: str, scan=None) -> DataFrame:
    """Correlation of average ranks. Ranks are worked out per distinct value;
    pairs are counted before they are joined to them."""
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).na.drop() \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    weighted = lambda c: pairs.groupBy(c).agg(F.sum("n").alias("n"))
    ra = _ranks(weighted("a"), "a", "ra", scan)
    rb = _ranks(weighted("b"), "b", "rb", scan)
    j = pairs.join(ra, "a").join(rb, "b")
    n, x, yy = F.col("n"), F.col("ra"), F.col("rb")
    s = j.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"),
              F.sum(n * yy).alias("y"), F.sum(n * x * x).alias("xx"),
              F.sum(n * yy * yy).alias("yy"), F.sum(n * x * yy).alias("xy"))
    num = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    den = F.sqrt(F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * \
        F.sqrt(F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    return s.select(F.try_divide(num, den).alias("spearman"))


def _ranks(counts: DataFrame, c: str, out: str, scan) -> DataFrame:
    counts = counts.withColumn("__all", F.lit(1))
    run = add_by_key(counts, ["__all"], [c], scan, __upto=running_sum("n"))
    return run.select(c, (F.col("__upto") - F.col("n")
                          + (F.col("n") + 1) / 2).alias(out))
