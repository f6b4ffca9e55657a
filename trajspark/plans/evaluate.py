"""Evaluation bundles: many metrics as one (metric, value) table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.columns import argmax
from trajspark.operators import evaluation as ev
from trajspark.operators import linear as li
from trajspark.operators import regression as rg
from trajspark.operators import transitions as tn
from trajspark.operators.features import StateBuilder
from trajspark.operators.scan import PLAIN
from trajspark.operators.trajectories import DAY
from trajspark.params import Params
from trajspark.session import cut_lineage

WITHIN = ev.WITHIN


def _metric(df: DataFrame, name: str, column: str) -> DataFrame:
    return df.select(F.lit(name).alias("metric"),
                     F.col(column).cast("double").alias("value"))


def _long(df: DataFrame, prefix, columns) -> DataFrame:
    """Metrics `prefix/column` from a table with one row per prefix."""
    pairs = F.explode(F.array(*[F.struct(
        F.concat(prefix, F.lit("/" + c)).alias("metric"),
        F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(pairs.alias("m")).select("m.*")


def evaluate_behaviour(df: DataFrame, p: str = "p", y: str = "y",
                       taus=(0.2, 0.3)) -> DataFrame:
    """Metrics of class probabilities against observed options."""
    rows = cut_lineage(df.select(F.col(p).alias("p"), F.col(y).cast("int")
                                 .alias("y"), argmax(p).alias("z"))
                       .filter(F.col("y").isNotNull()))
    parts = [_metric(ev.accuracy(rows, F.col("z")), "accuracy", "accuracy"),
             _metric(ev.auroc_ovr(rows), "auroc", "auroc"),
             _metric(ev.macro_f1(rows, F.col("z")), "f1", "f1"),
             _metric(ev.spearman(rows, "y", "z"), "rank_corr", "spearman"),
             _metric(ev.calibration_error(rows), "calibration_error", "ece")]
    for t in taus:
        parts += [_metric(ev.coverage(rows, t), f"bcq_coverage_{t}",
                          "coverage"),
                  _metric(ev.multi_f1(rows, t), f"multi_f1_{t}", "f1"),
                  _metric(ev.contiguity(rows, t), f"consistency_{t}",
                          "contiguity")]
    return reduce(DataFrame.unionByName, parts)


def evaluate_policy(df: DataFrame, action, events, prefix: str = "",
                    importance: DataFrame | None = None, names=(),
                    all_metrics: bool = True, tests: bool = False,
                    bootstrap: int = 0, subset=None,
                    scan=PLAIN) -> DataFrame:
    """Metrics of a policy over trajectories with event flags.

    `importance` is the output of `wis_trajectories` for the policies in
    `names`; `prefix` is put before every metric, such as "val/".
    """
    compared = cut_lineage(ev.compare_policies(df, action, extra=events,
                                               subset=subset, scan=scan))
    parts = [_metric(ev.reasonable_share(compared),
                     "proportion_reasonable_actions", "share")]
    if importance is not None:
        w = ev.wis(importance, list(names))
        parts.append(w.select(F.concat(F.lit("wis/"), "policy",
                                       F.lit("_value")).alias("metric"),
                              "value"))
        if bootstrap:
            ci = ev.bootstrap_interval(ev.bootstrap(
                importance, list(names), bootstrap))
            for side in ("lower", "upper"):
                parts.append(ci.select(
                    F.concat(F.lit("wis/"), "policy",
                             F.lit(f"_value_ci_{side}")).alias("metric"),
                    F.col(side).alias("value")))
    if all_metrics or tests:
        dis = cut_lineage(ev.disagreement(compared, events, scan=scan))
    if all_metrics:
        c = ev.classification(compared)
        for tag in ("", "_dir"):
            cols = [f"{s}{tag}" for s in ("sensitivity", "specificity",
                                          "jindex")]
            part = _long(c, F.concat(F.upper("algorithm"), F.lit(
                f"/classification{tag}")), cols)
            parts.append(part.withColumn("metric", F.regexp_replace(
                "metric", "_dir$", "")))
        a = ev.at_agreement(dis, events)
        parts.append(_long(a, F.concat_ws("_", F.col("threshold"), F.upper(
            "algorithm")), [x for x in a.columns
                            if x not in ("algorithm", "threshold")]))
        s = rg.agreement_associations(dis, ev.ALGOS)
        parts.append(_long(s, F.concat(F.upper("algorithm"), F.lit(
            "/linear_models")), ["association", "at_agreement"]))
    if tests:
        t = rg.contrast_tests(dis, events)
        parts.append(_long(t, F.col("threshold").cast("string"),
                           [x for x in t.columns if x != "threshold"]))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("metric", F.concat(F.lit(prefix), "metric"))


def learned_policy(df: DataFrame, params: Params = Params(), folds: int = 2,
                   tau: float = 0.3, min_length: int | None = None,
                   scan=PLAIN, **fit) -> tuple[DataFrame, DataFrame]:
    """A policy learned from trajectories and applied to the same ones.

    Returns the eligible rows with `policy_action` (NULL where the state has a
    gap) and, for `evaluate_policy`, the importance of every trajectory: the
    weights `policy` (softmax of the masked scores), `policy_hard` and
    `threshold`, and the discounted reward. Each subject is scored by models
    that have learned from others only.
    """
    rows = cut_lineage(tn.eligible_rows(df, params, min_length, scan))
    fitted = StateBuilder(params).fit(rows, scan)
    names = fitted.state_names()
    # States are worked out once, for the transitions and for scoring.
    table = cut_lineage(tn.with_next(tn.decision_states(
        rows.withColumn("measured", F.col("value")), fitted, params, scan=scan,
        also=["measured"]), names, scan))
    transitions = tn.whole_pairs(table.drop("measured"))
    states = table.select(*WITHIN, DAY, "option", "reward", "measured", *names)
    scored = li.cross_fitted(transitions, states, names,
                             folds=folds, tau=tau, gamma=params.discount,
                             seed=params.seed, **fit)
    probs = cut_lineage(li.policy_probs(scored, tau, value="measured").select(
        *WITHIN, DAY, "option", "reward", "policy_action", "behaviour_prob",
        "policy_prob", "policy_hard_prob", "threshold_prob"))
    # Only transitions count: visits whose next state is complete as well.
    played = probs.join(transitions.select(*WITHIN, DAY), [*WITHIN, DAY],
                        "left_semi")
    importance = cut_lineage(ev.wis_trajectories(
        played, "behaviour_prob",
        {n: f"{n}_prob" for n in ("policy", "policy_hard", "threshold")},
        gamma=params.discount, scan=scan))
    chosen = probs.select(*WITHIN, DAY, "policy_action")
    return rows.join(chosen, [*WITHIN, DAY], "left"), importance
