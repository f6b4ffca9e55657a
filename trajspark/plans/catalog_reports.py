"""Catalogue, second part: policy evaluation, reports and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark import params as P
from trajspark.functions import columns as fc
from trajspark.operators import evaluation as ev
from trajspark.operators import linear as li
from trajspark.operators import mixed as mx
from trajspark.operators import policies as po
from trajspark.operators import regression as rg
from trajspark.operators import relational as rel
from trajspark.operators import reports as rp
from trajspark.operators import trajectories as tr
from trajspark.operators import transitions as tn
from trajspark.plans import audits as au
from trajspark.plans import pipeline as pl
from trajspark.plans import sqltext as q
from trajspark.plans.catalog import (BL, EV, EVENTS, KEYS, PARAMS, V, _DEC,
                                     _MEDS, _SPAN, T, base, meds, on_base,
                                     on_visits, query, scan_of, transitions)
from trajspark.session import cut_lineage
from trajspark.sources import adapter

WITHIN = [*KEYS, "trajid"]
ADV = PARAMS.events_evaluated
_CODE = """CASE WHEN {0} < 0.8 THEN 0 WHEN {0} < 0.9 THEN 1 WHEN {0} < 1 THEN 2
 WHEN {0} = 1 THEN 3 WHEN {0} <= 1.1 THEN 4 WHEN {0} <= 1.2 THEN 5
 WHEN {0} > 1.2 THEN 6 END"""


def stand_in_policy():
    """A fixed value-based policy in place of a trained one."""
    v = F.col("value")
    return (F.when(v < 1.8, 5).when(v < 2.2, 4).when(v <= 2.8, 3)
            .when(v <= 3.5, 2).when(v > 3.5, 1).otherwise(3))


_POLICY = """CASE WHEN value < 1.8 THEN 5 WHEN value < 2.2 THEN 4
 WHEN value <= 2.8 THEN 3 WHEN value <= 3.5 THEN 2 WHEN value > 3.5 THEN 1
 ELSE 3 END"""

_U = "('0x' || substr(md5('42|' || trial || '|' || subjid || '|' || trajid " \
    "|| '|' || study_day), 1, 8))::BIGINT / 4294967296.0"

CMP = f"""{_DEC}, om AS (SELECT option_, avg(ratio) AS m FROM opt WHERE option_
 IS NOT NULL AND ratio < 1e299 GROUP BY 1),
 codes AS (SELECT list(option_ ORDER BY option_) AS cs FROM (SELECT DISTINCT
 option_ FROM opt WHERE option_ IS NOT NULL)),
 cm0 AS (SELECT opt.*, lead(value) OVER {q.WK} AS next_value, {_POLICY}
 AS policy_action, CASE WHEN value <= 1.5 THEN 1.15 WHEN value < 2 THEN 1.1
 WHEN value <= 3 THEN 1.0 WHEN value < 5 THEN 0.9 WHEN value >= 5 THEN 0.85
 ELSE 1.0 END AS threshold_quant, cs[1 + CAST(floor({_U} * len(cs)) AS INT)]
 AS random_action, 3 AS maintain_action FROM opt, codes),
 cm1 AS (SELECT cm0.*, {_CODE.format("threshold_quant")} AS threshold_action,
 a.m - ratio AS policy_diff, threshold_quant - ratio AS threshold_diff,
 b.m - ratio AS random_diff, c.m - ratio AS maintain_diff,
 CASE WHEN next_value BETWEEN 2 AND 3 THEN 1 ELSE 0 END AS next_in_range
 FROM cm0 LEFT JOIN om a ON a.option_ = policy_action LEFT JOIN om b
 ON b.option_ = random_action LEFT JOIN om c ON c.option_ = 3),
 cmp AS (SELECT *, {", ".join(
     f"CASE WHEN abs({a}_diff) <= 0.05 THEN 1 ELSE 0 END AS {a}_eq"
     for a in ev.ALGOS)} FROM cm1)"""

TTR = f"""{_SPAN}, ttr AS (SELECT trial, subjid, trajid, avg(CASE WHEN x BETWEEN
 2 AND 3 THEN 1.0 ELSE 0.0 END) AS ttr, max(d) - min(d) AS length FROM days
 GROUP BY ALL)"""

DIS = f"""{CMP}, {TTR}, dm AS (SELECT trial, subjid, trajid, {", ".join(
    f"avg({a}_eq) AS {a}_eq, avg(abs({a}_diff)) AS {a}_diff"
    for a in ev.ALGOS)} FROM cmp GROUP BY ALL),
 dis AS (SELECT dm.*, ttr.ttr, ttr.length, e.* EXCLUDE (trial, subjid,
 trajid), greatest(stroke, hem_stroke, major_bleed) AS any_event FROM dm
 JOIN ttr USING (trial, subjid, trajid) JOIN (SELECT trial, subjid, trajid,
 CAST(max(stroke) > 0 AS INT) AS stroke, CAST(max(hem_stroke) > 0 AS INT)
 AS hem_stroke, CAST(max(major_bleed) > 0 AS INT) AS major_bleed FROM traj
 GROUP BY ALL) e USING (trial, subjid, trajid))"""


def compared(spark, sf, extra=(), subset=None) -> DataFrame:
    return ev.compare_policies(T(spark, sf), stand_in_policy(),
                               subset=subset, extra=extra,
                               scan=scan_of(spark, sf))


def disagreements(spark, sf) -> DataFrame:
    return ev.disagreement(compared(spark, sf, extra=ADV), ADV,
                           scan=scan_of(spark, sf))


def finite_only(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.when(fc.finite(c), F.col(c)) for c in cols})


def _fin(c):
    return f"CASE WHEN abs({c}) < 1e200 THEN {c} END AS {c}"


DIFFS = [f"{a}_diff" for a in ev.ALGOS]
_ROWKEY = "trial:s subjid:l trajid:l study_day:l "


@query("random_policy", _ROWKEY + "random_action:l", q.W_T + f""", {CMP}
 SELECT trial, subjid, trajid, study_day, random_action FROM cmp""")
def _(spark, sf):
    d = on_base(spark, sf, lambda s, d: tn.observed_decision(d, scan=s))
    return ev.random_policy(d)


@query("random_policy_weighted", _ROWKEY + "random_action:l", q.W_T
       + f""", {_DEC}, c AS (SELECT option_, count(*) AS n FROM opt WHERE
 option_ IS NOT NULL GROUP BY 1), w AS (SELECT option_, sum(n) OVER (ORDER BY
 option_) AS hi, sum(n) OVER (ORDER BY option_) - n AS lo, sum(n) OVER ()
 AS total FROM c) SELECT trial, subjid, trajid, study_day, w.option_
 AS random_action FROM (SELECT *, {_U} AS u FROM opt) o JOIN w
 ON o.u * w.total >= w.lo AND o.u * w.total < w.hi""")
def _(spark, sf):
    d = on_base(spark, sf, lambda s, d: tn.observed_decision(d, scan=s))
    return ev.random_policy(d, weighted=True)


@query("compare_policies", _ROWKEY + "next_in_range:l observed_action:l "
       + " ".join(f"{a}_action:l {a}_diff:d {a}_eq:l" for a in ev.ALGOS),
       q.W_T + f", {CMP} SELECT * EXCLUDE ({', '.join(DIFFS)}), "
       f"option_ AS observed_action, {', '.join(map(_fin, DIFFS))} FROM cmp")
def _(spark, sf):
    return finite_only(compared(spark, sf), DIFFS)


@query("compare_policies_subset", _ROWKEY + "policy_action:l policy_eq:l",
       q.W_T + f""", {CMP}, {q.BL} SELECT * FROM cmp WHERE subjid IN (SELECT
 subjid FROM bl WHERE weight IS NOT NULL)""")
def _(spark, sf):
    keep = BL(spark, sf).filter("weight is not null")
    return compared(spark, sf, subset=keep)


@query("disagreement", "trial:s subjid:l trajid:l " + " ".join(
    f"{a}_eq:d {a}_diff:d" for a in ev.ALGOS)
    + " ttr:d length:l stroke:l hem_stroke:l major_bleed:l any_event:l",
    q.W_T + f", {DIS} SELECT * EXCLUDE ({', '.join(DIFFS)}), "
    f"{', '.join(map(_fin, DIFFS))} FROM dis")
def _(spark, sf):
    return finite_only(disagreements(spark, sf), DIFFS)


@query("hierarchical_ttr", _ROWKEY + "policy_action:l ttr:d length:l",
       q.W_T + f""", {CMP}, {TTR} SELECT cmp.trial, cmp.subjid, cmp.trajid,
 study_day, policy_action, ttr, length FROM cmp LEFT JOIN ttr
 USING (trial, subjid, trajid)""")
def _(spark, sf):
    return ev.hierarchical_ttr(compared(spark, sf), scan_of(spark, sf))


@query("reasonable_share", "share:d", q.W_T + f""", {CMP} SELECT avg(CASE WHEN
 (value BETWEEN 2 AND 3 AND policy_action = 3) OR (value < 2 AND policy_action
 > 3) OR (value > 3 AND policy_action < 3) THEN 1.0 ELSE 0.0 END) AS share
 FROM cmp""")
def _(spark, sf):
    return ev.reasonable_share(compared(spark, sf))


def _class_sql():
    parts = []
    for a in ev.ALGOS:
        p = f"{a}_action"
        same = f"coalesce(option_ = {p}, FALSE)"
        side = (f"coalesce((option_ < 3 AND {p} < 3) OR (option_ = 3 AND {p} "
                f"= 3) OR (option_ > 3 AND {p} > 3), FALSE)")
        parts.append(f"""SELECT '{a}' AS algorithm,
 count(*) FILTER (next_in_range = 1) AS n_pos,
 count(*) FILTER (next_in_range = 0) AS n_neg,
 count(*) FILTER (next_in_range = 1 AND {same}) AS tp,
 count(*) FILTER (next_in_range = 0 AND NOT {same}) AS tn,
 count(*) FILTER (next_in_range = 1 AND {side}) AS tp_dir,
 count(*) FILTER (next_in_range = 0 AND NOT {side}) AS tn_dir FROM cmp""")
    return " UNION ALL ".join(parts)


@query("classification", "algorithm:s n_pos:l n_neg:l tp:l tn:l tp_dir:l "
       "tn_dir:l sensitivity:d specificity:d jindex:d jindex_dir:d",
       q.W_T + f""", {CMP}, c AS ({_class_sql()}) SELECT *, tp / n_pos
 AS sensitivity, tn / n_neg AS specificity, tp / n_pos + tn / n_neg - 1
 AS jindex, tp_dir / n_pos + tn_dir / n_neg - 1 AS jindex_dir FROM c""")
def _(spark, sf):
    return ev.classification(compared(spark, sf))


@query("classification_intervals", None)
def _(spark, sf):
    return ev.with_intervals(ev.classification(compared(spark, sf)))


@query("classification_table", None)
def _(spark, sf):
    c = ev.with_intervals(ev.classification(compared(spark, sf)))
    c = c.filter("statistic in ('sensitivity', 'specificity')")
    parts = F.explode(F.array(*[F.struct(
        F.concat(F.upper("algorithm"), F.lit("/classification/"), "statistic",
                 F.lit(suffix)).alias("metric"), F.col(c_).alias("value"))
        for suffix, c_ in (("", "value"), ("_lower", "lower"),
                           ("_upper", "upper"))])).alias("m")
    return rp.classification_table(c.select(parts).select("m.*"))


@query("metric_parts", "metric:s algorithm:s statistic:s bound:s", """SELECT
 metric, split_part(metric, '/', 1) AS algorithm, regexp_replace(split_part(
 metric, '/', 3), '_(lower|upper)$', '') AS statistic, CASE WHEN metric LIKE
 '%\\_lower' ESCAPE '\\' THEN 'lower' WHEN metric LIKE '%\\_upper' ESCAPE '\\'
 THEN 'upper' ELSE 'value' END AS bound FROM (SELECT DISTINCT
 upper(event_type) || '/classification/s' || CAST(user_id % 3 AS VARCHAR) ||
 CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_lower' ELSE '_upper' END
 AS metric FROM events)""")
def _(spark, sf):
    u = F.col("user_id") % 3
    metric = F.concat(F.upper("event_type"), F.lit("/classification/s"),
                      u.cast("string"), F.when(u == 0, "")
                      .when(u == 1, "_lower").otherwise("_upper"))
    m = adapter.table(spark, sf, "events").select(
        metric.alias("metric")).distinct()
    return m.select("metric", *[
        fc.metric_part("metric", p).alias(p)
        for p in ("algorithm", "statistic", "bound")])


_LEVELS = ", ".join(map(str, P.AGREEMENT_THRESHOLDS))
_LONG = " UNION ALL ".join(
    f"SELECT '{a}' AS algorithm, {a}_diff AS diff, * FROM dis"
    for a in ev.ALGOS)


@query("at_agreement", "algorithm:s threshold:d ttr:d stroke_per_year:d "
       "any_event_per_year:d trajectories:l total_days:l share:d "
       "consistency:d", q.W_T + f""", {DIS}, lg AS ({_LONG}), ag AS (SELECT
 algorithm, t AS threshold, sum(ttr * length) / nullif(sum(length), 0) AS ttr,
 sum(stroke) * 365.25 / nullif(sum(length), 0) AS stroke_per_year,
 sum(any_event) * 365.25 / nullif(sum(length), 0) AS any_event_per_year,
 count(*) AS trajectories, sum(length) AS total_days, count(*) / (SELECT
 count(*) FROM dis) AS share, count(DISTINCT diff) AS nd, count(DISTINCT ttr)
 AS nt, sum(diff) AS sd, covar_pop(diff, ttr) / nullif(stddev_pop(diff)
 * stddev_pop(ttr), 0) AS r FROM lg, (SELECT unnest([{_LEVELS}]) AS t)
 WHERE diff < t GROUP BY algorithm, t)
 SELECT *, CASE WHEN sd > 0 AND nd > 1 AND nt > 1 THEN -r END AS consistency
 FROM ag""")
def _(spark, sf):
    return ev.at_agreement(disagreements(spark, sf), ADV)


@query("agreement_associations", "algorithm:s association:d at_agreement:d",
       q.W_T + f""", {DIS}, lg AS ({" UNION ALL ".join(
           f"SELECT '{a}' AS algorithm, {a}_eq AS eq, ttr, length FROM dis"
           for a in ev.ALGOS)}), m AS (SELECT algorithm, sum(length) AS s,
 sum(length * eq) / sum(length) AS mx, sum(length * ttr) / sum(length) AS my
 FROM lg GROUP BY algorithm), b AS (SELECT lg.algorithm, any_value(mx) AS mx,
 any_value(my) AS my, sum(length * (eq - mx) * (ttr - my)) / nullif(sum(length
 * (eq - mx) * (eq - mx)), 0) AS slope FROM lg JOIN m USING (algorithm)
 GROUP BY lg.algorithm) SELECT algorithm, slope AS association, my + slope *
 (1 - mx) AS at_agreement FROM b""")
def _(spark, sf):
    return rg.agreement_associations(disagreements(spark, sf), ev.ALGOS)


@query("agreement_slopes", "algorithm:s association:d at_agreement:d",
       q.W_T + f""", {CMP}, {TTR}, pt AS (SELECT trial, subjid, trajid,
 {", ".join(f"avg(CASE WHEN {a}_diff IS NOT NULL THEN CAST(abs({a}_diff) < 0.05 AS INT) END) AS {a}_eq" for a in ev.ALGOS)}
 FROM cmp GROUP BY ALL), ok AS (SELECT * FROM pt JOIN ttr USING (trial,
 subjid, trajid) WHERE {" AND ".join(f"{a}_eq IS NOT NULL" for a in ev.ALGOS)}),
 lg AS ({" UNION ALL ".join(
     f"SELECT '{a}' AS algorithm, {a}_eq AS eq, ttr, length FROM ok"
     for a in ev.ALGOS)}), m AS (SELECT algorithm, sum(length * eq)
 / sum(length) AS mx, sum(length * ttr) / sum(length) AS my FROM lg
 GROUP BY algorithm), b AS (SELECT lg.algorithm, any_value(mx) AS mx,
 any_value(my) AS my, sum(length * (eq - mx) * (ttr - my)) / nullif(sum(length
 * (eq - mx) * (eq - mx)), 0) AS slope FROM lg JOIN m USING (algorithm)
 GROUP BY lg.algorithm) SELECT algorithm, slope AS association, my + slope *
 (1 - mx) AS at_agreement FROM b""")
def _(spark, sf):
    return rg.agreement_slopes(ev.hierarchical_ttr(compared(spark, sf), scan_of(spark, sf)),
                               ev.ALGOS)


@query("contrast_tests", "threshold:d ttr_t:d dof:l any_event_z:d "
       "major_bleed_z:d", q.W_T + f""", {DIS}, r AS (SELECT t AS threshold,
 CAST(policy_diff < t AS INT) AS p, CAST(threshold_diff < t AS INT) AS h,
 ttr AS y, CAST(length AS DOUBLE) AS w, any_event, major_bleed FROM dis,
 (SELECT unnest([{_LEVELS}]) AS t) WHERE abs(policy_diff) < 1e200
 AND abs(threshold_diff) < 1e200), m AS (SELECT threshold, count(*) AS n,
 sum(w) AS sw, sum(w * p) / sum(w) AS mp, sum(w * h) / sum(w) AS mh,
 sum(w * y) / sum(w) AS my FROM r GROUP BY threshold),
 c AS (SELECT r.threshold, any_value(n) AS n, sum(w * (p - mp) * (p - mp))
 AS pp, sum(w * (h - mh) * (h - mh)) AS hh, sum(w * (p - mp) * (h - mh))
 AS ph, sum(w * (p - mp) * (y - my)) AS py, sum(w * (h - mh) * (y - my))
 AS hy, sum(w * (y - my) * (y - my)) AS yy FROM r JOIN m USING (threshold)
 GROUP BY r.threshold), b AS (SELECT *, CASE WHEN pp * hh - ph * ph > pp * hh
 * 1e-12 THEN pp * hh - ph * ph END AS det FROM c), s AS (SELECT *,
 (hh * py - ph * hy) / det AS bp, (pp * hy - ph * py) / det AS bh FROM b),
 z AS (SELECT threshold, {", ".join(
     f"count(*) FILTER (p = {i} AND h = {j}) AS n{i}{j}, "
     f"sum(any_event) FILTER (p = {i} AND h = {j}) AS a{i}{j}, "
     f"sum(major_bleed) FILTER (p = {i} AND h = {j}) AS g{i}{j}"
     for i in (0, 1) for j in (0, 1))} FROM r GROUP BY threshold)
 SELECT s.threshold, n - 3 AS dof, (bp - bh) / sqrt((yy - bp * py - bh * hy)
 / (n - 3) * (pp + hh + 2 * ph) / det) AS ttr_t, {", ".join(
     f"CASE WHEN {' AND '.join(f'{k}{c} > 0 AND {k}{c} < n{c}' for c in ('00', '01', '10', '11'))} THEN "
     f"(ln({k}10 / (n10 - {k}10)) - ln({k}01 / (n01 - {k}01))) / sqrt("
     f"1 / {k}10 + 1 / (n10 - {k}10) + 1 / {k}01 + 1 / (n01 - {k}01)) END "
     f"AS {name}" for k, name in (("a", "any_event_z"),
                                  ("g", "major_bleed_z")))}
 FROM s JOIN z USING (threshold)""")
def _(spark, sf):
    return rg.contrast_tests(disagreements(spark, sf), ADV)


@query("contrast_p_values", None)
def _(spark, sf):
    return rg.with_p_values(rg.contrast_tests(disagreements(spark, sf), ADV))


_WIS = f""", {CMP}, wr AS (SELECT *, 0.1 + (study_day % 7) / 10.0 AS pb,
 0.1 + ((subjid + study_day) % 5) / 10.0 AS ps, CAST(threshold_action =
 option_ AS INT) AS ph, CASE WHEN value BETWEEN 2 AND 3 THEN 1.0 ELSE 0.0 END
 AS reward, study_day - min(study_day) OVER {q.K} AS t FROM cmp
 WHERE option_ IS NOT NULL), wt AS (SELECT trial, subjid, trajid,
 product(ps / pb) AS soft_weight, product(ph / pb) AS rule_weight,
 sum(pow(0.99, t) * reward) AS value FROM wr GROUP BY ALL)"""


def importance(spark, sf) -> DataFrame:
    rows = compared(spark, sf).filter("observed_action is not null")
    rows = rows.withColumns({
        "pb": F.lit(0.1) + (F.col("study_day") % 7) / 10.0,
        "ps": F.lit(0.1) + ((F.col("subjid") + F.col("study_day")) % 5) / 10.0,
        "ph": (F.col("threshold_action") == F.col("observed_action"))
        .cast("double"),
        "reward": fc.in_range("value").cast("double")})
    return ev.wis_trajectories(rows, "pb", {"soft": "ps", "rule": "ph"},
                               scan=scan_of(spark, sf))


@query("wis_trajectories", "trial:s subjid:l trajid:l soft_weight:d "
       "rule_weight:d value:d", q.W_T + _WIS + " SELECT * FROM wt")
def _(spark, sf):
    return importance(spark, sf)


@query("wis", "policy:s value:d", q.W_T + _WIS + """ SELECT 'clinician'
 AS policy, avg(value) AS value FROM wt UNION ALL SELECT 'soft',
 sum(soft_weight * value) / sum(soft_weight) FROM wt UNION ALL SELECT 'rule',
 sum(rule_weight * value) / sum(rule_weight) FROM wt""")
def _(spark, sf):
    return ev.wis(importance(spark, sf), ["soft", "rule"])


def _drawn(i):
    u = f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT / 4294967296.0"
    steps = " ".join(f"WHEN {u} < {b!r}::DOUBLE THEN {k}"
                     for k, b in enumerate(fc.poisson_bounds()))
    return f"SELECT *, block * 4 + {i} AS rep, CASE {steps} END AS c FROM bk"


@query("bootstrap", "policy:s lower:d upper:d", q.W_T + _WIS + f""", bk AS
 (SELECT *, md5('42|' || block || '|' || trial || '|' || subjid || '|' ||
 trajid) AS h FROM wt, (SELECT unnest(range(250)) AS block)), dr AS
 ({" UNION ALL ".join(_drawn(i) for i in range(4))}), rp AS (SELECT rep,
 sum(c * value) / sum(c) AS clinician, sum(c * soft_weight * value)
 / nullif(sum(c * soft_weight), 0) AS soft, sum(c * rule_weight * value)
 / nullif(sum(c * rule_weight), 0) AS rule FROM dr GROUP BY rep)
 """ + " UNION ALL ".join(
     f"SELECT '{p}' AS policy, quantile_cont({p}, 0.025) AS lower, "
     f"quantile_cont({p}, 0.975) AS upper FROM rp"
     for p in ("clinician", "soft", "rule")))
def _(spark, sf):
    reps = ev.bootstrap(importance(spark, sf), ["soft", "rule"], 1000)
    return ev.bootstrap_interval(reps)


@query("action_change", "action_change:d", q.W_T + f""", {CMP} SELECT
 avg(abs(policy_action - threshold_action)) AS action_change FROM cmp""")
def _(spark, sf):
    c = cut_lineage(compared(spark, sf))
    b = c.withColumn("policy_action", F.col("threshold_action"))
    return ev.action_change(c, b)


# Class-probability metrics on embedding scores.

_EM = """WITH em AS (SELECT vec_id, label % 7 AS y, list_transform(
 embedding[1:7], lambda x: exp(8 * CAST(x AS DOUBLE))) AS e FROM embeddings),
 pr AS (SELECT vec_id, y, list_transform(e, lambda x: x / list_sum(e)) AS p
 FROM em), ex AS (SELECT vec_id, y, unnest(range(7)) AS cls, unnest(p)
 AS prob, list_max(p) AS top FROM pr) """
_PRED = """, pd AS (SELECT vec_id, any_value(y) AS y, min(cls) FILTER
 (prob = top) AS z FROM ex GROUP BY vec_id)"""


def scored(spark, sf) -> DataFrame:
    e = adapter.table(spark, sf, "embeddings")
    x = F.transform(F.slice("embedding", 1, 7),
                    lambda v: v.cast("double") * 8)
    return e.select("vec_id", fc.softmax(x).alias("p"),
                    (F.col("label") % 7).alias("y"))


@query("coverage", "coverage:d", _EM + """SELECT avg(CAST(prob / top > 0.3
 AS INT)) AS coverage FROM ex WHERE cls = y""")
def _(spark, sf):
    return ev.coverage(scored(spark, sf), 0.3)


@query("multi_f1", "f1:d", _EM + """, c AS (SELECT cls, sum(CAST(prob / top >
 0.3 AND cls = y AS INT)) AS tp, sum(CAST(prob / top > 0.3 AS INT)) AS said,
 sum(CAST(cls = y AS INT)) AS are FROM ex GROUP BY cls) SELECT avg(coalesce(
 2 * tp / nullif(said + are, 0), 0)) AS f1 FROM c""")
def _(spark, sf):
    return ev.multi_f1(scored(spark, sf), 0.3)


@query("contiguity", "contiguity:d", _EM + """, f AS (SELECT vec_id, max(cls)
 - min(cls) + 1 = count(*) AS ok FROM ex WHERE prob / top > 0.3
 GROUP BY vec_id) SELECT avg(CAST(ok AS INT)) AS contiguity FROM f""")
def _(spark, sf):
    return ev.contiguity(scored(spark, sf), 0.3)


@query("calibration_error", "ece:d", _EM + """, b AS (SELECT cls,
 (ceil(prob * 10) - 1) / 10 + 0.05 AS mid, avg(CAST(cls = y AS INT)) AS rate,
 count(*) AS n FROM ex WHERE prob > 0 GROUP BY ALL) SELECT sum(abs(mid - rate)
 * n) / sum(n) AS ece FROM b""")
def _(spark, sf):
    return ev.calibration_error(scored(spark, sf))


@query("accuracy", "accuracy:d", _EM + _PRED + """ SELECT avg(CAST(y = z
 AS INT)) AS accuracy FROM pd""")
def _(spark, sf):
    return ev.accuracy(scored(spark, sf), fc.argmax("p"))


@query("macro_f1", "f1:d", _EM + _PRED + """, c AS (SELECT cls, (SELECT
 count(*) FROM pd WHERE y = cls AND z = cls) AS tp, (SELECT count(*) FROM pd
 WHERE y = cls) AS are, (SELECT count(*) FROM pd WHERE z = cls) AS said FROM
 (SELECT unnest(range(7)) AS cls)) SELECT avg(2 * tp / (said + are)) AS f1
 FROM c WHERE said + are > 0""")
def _(spark, sf):
    return ev.macro_f1(scored(spark, sf), fc.argmax("p"))


@query("auroc_ovr", "auroc:d", _EM + """, r AS (SELECT cls, CAST(y = cls
 AS INT) AS pos, rank() OVER (PARTITION BY cls ORDER BY prob) + (count(*) OVER
 (PARTITION BY cls, prob) - 1) / 2.0 AS rk FROM ex), a AS (SELECT cls,
 (sum(rk) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos)
 * (count(*) - sum(pos)), 0) AS auc FROM r GROUP BY cls) SELECT avg(auc)
 AS auroc FROM a""")
def _(spark, sf):
    return ev.auroc_ovr(scored(spark, sf))


@query("spearman", "spearman:d", _EM + _PRED + """, r AS (SELECT rank() OVER
 (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER
 (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS b FROM pd)
 SELECT corr(a, b) AS spearman FROM r""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("z", fc.argmax("p"))
    return ev.spearman(rows, "y", "z")


@query("masked_policy", "vec_id:l action:l best_share:d", _EM + """, f AS
 (SELECT vec_id, cls, prob, CASE WHEN prob / top > 0.3 THEN CAST((vec_id * 31
 + cls * 17) % 23 AS DOUBLE) ELSE -1e8 END AS qv FROM ex), g AS (SELECT *,
 max(qv) OVER (PARTITION BY vec_id) AS best FROM f) SELECT vec_id, min(cls)
 AS action, max(prob) FILTER (qv = best) AS best_share FROM g WHERE qv = best
 GROUP BY vec_id""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("q", F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda c: ((F.col("vec_id") * 31 + c * 17) % 23).cast("double")))
    rows = rows.withColumn("m", fc.masked_q("q", "p", 0.3))
    share = F.array_max(F.zip_with(
        "m", "p", lambda m, p: F.when(m == F.array_max("m"), p)))
    return rows.select("vec_id", fc.argmax("m").alias("action"),
                       share.alias("best_share"))


@query("ordinal_probs", "seq:l p0:d p1:d p2:d", q.W_V + """, c AS (SELECT seq,
 1 / (1 + exp(-(2.0 - value) / 0.5)) AS a, 1 / (1 + exp(-(3.0 - value) / 0.5))
 AS b FROM v WHERE value IS NOT NULL), r AS (SELECT seq, a - 0 + 1e-8 AS x,
 b - a + 1e-8 AS y, 1 - b + 1e-8 AS z FROM c) SELECT seq, x / (x + y + z)
 AS p0, y / (x + y + z) AS p1, z / (x + y + z) AS p2 FROM r""")
def _(spark, sf):
    cuts = F.array(F.lit(2.0), F.lit(3.0))
    p = fc.ordinal_probs("value", F.lit(0.5), cuts)
    rows = V(spark, sf).filter("value is not null").select(
        "seq", p.alias("p"))
    return rows.select("seq", *[F.col("p")[i].alias(f"p{i}")
                                for i in range(3)])


@query("score_mlp", "vec_id:l s0:d s1:d", """SELECT vec_id,
 greatest(list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS
 DOUBLE))), 0) * 2 + 0.5 AS s0, greatest(list_sum(list_transform(
 embedding[5:8], lambda x: CAST(x AS DOUBLE))), 0) * 3 - 1 AS s1
 FROM embeddings""")
def _(spark, sf):
    w1 = [[1.0 if i // 4 == j else 0.0 for j in range(2)] for i in range(8)]
    weights = [(w1, [0.0, 0.0]), ([[2.0, 0.0], [0.0, 3.0]], [0.5, -1.0])]
    e = adapter.table(spark, sf, "embeddings")
    x = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double"))
    s = e.select("vec_id", x.alias("x")).withColumn(
        "s", po.score_mlp(weights, "x"))
    return s.select("vec_id", F.col("s")[0].alias("s0"),
                    F.col("s")[1].alias("s1"))


# Model-input tables.

_TTE = """te AS (SELECT subjid, coalesce(min(study_day) FILTER (stroke +
 major_bleed + sys_emb > 0), max(study_day)) AS time_to_event,
 CAST(count(*) FILTER (stroke + major_bleed + sys_emb > 0) > 0 AS INT)
 AS composite_outcome FROM traj GROUP BY subjid)"""


def tte(spark, sf) -> DataFrame:
    d = T(spark, sf)
    return rp.time_to_event(d, d)


@query("time_to_event", "subjid:l time_to_event:l composite_outcome:l",
       q.W_T + f", {_TTE} SELECT * FROM te")
def _(spark, sf):
    return tte(spark, sf)


_PAT = """pat AS (SELECT c_custkey AS subjid, c_nationkey AS centre, n_name
 AS country, 40 + c_custkey % 50 AS age, CAST(45 + c_custkey % 80 AS DOUBLE)
 AS weight, CAST(c_custkey % 2 = 0 AS INT) AS male, CAST(c_custkey % 10 IN
 (6, 9) AS INT) AS white, CAST(c_custkey % 3 = 0 AS INT) AS warfuse,
 CAST(c_custkey % 5 = 0 AS INT) AS smoker, CAST(c_custkey % 7 = 0 AS INT)
 AS alcohol, CAST(c_custkey % 4 = 0 AS INT) AS hf, CAST(c_custkey % 11 = 0
 AS INT) AS prior_stroke, CAST(c_custkey % 6 = 0 AS INT) AS diab,
 CAST(c_custkey % 8 = 0 AS INT) AS hypt, CAST(c_custkey % 9 = 0 AS INT)
 AS amiod, CAST(c_custkey % 13 = 0 AS INT) AS insulin, c_custkey % 2 + 1
 AS arm FROM customer JOIN nation ON c_nationkey = n_nationkey),
 cen AS (SELECT n_nationkey AS centre, CAST(n_nationkey % 3 = 1 AS INT)
 AS sechosp, CAST(n_nationkey % 2 = 1 AS INT) AS acclinic FROM nation
 WHERE n_nationkey < 20),
 gdp AS (SELECT n_name AS country, 1000 + (n_nationkey * 7919) % 5000 AS gdp
 FROM nation WHERE n_nationkey < 22),
 hea AS (SELECT n_name AS country, 60.0 + n_nationkey % 15 AS dale,
 n_nationkey * 3.5 AS hsp FROM nation WHERE n_nationkey > 3),
 cty AS (SELECT coalesce(g.country, h.country) AS country, CAST(gdp >
 (SELECT quantile_cont(gdp, 0.55) FROM gdp) AS INT) AS highincome, dale, hsp
 FROM gdp g FULL JOIN hea h ON g.country = h.country),
 chr AS (SELECT pat.* EXCLUDE (arm), coalesce(sechosp, 0) AS sechosp,
 coalesce(acclinic, 0) AS acclinic, highincome, dale, hsp FROM pat
 LEFT JOIN cen USING (centre) LEFT JOIN cty USING (country))"""


def patients(spark, sf) -> DataFrame:
    c = adapter.table(spark, sf, "customer")
    n = adapter.table(spark, sf, "nation")
    k = F.col("c_custkey")
    two = lambda m: F.when(k % m == 0, 2).otherwise(1)
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("subjid"), F.col("c_nationkey").alias("centre"),
        F.col("n_name").alias("country"), (40 + k % 50).alias("age"),
        (45 + k % 80).cast("double").alias("weight"),
        (k % 2 + 1).alias("sex"), (k % 10).alias("ethnic"),
        F.when(k % 3 == 0, "Experienced").otherwise("Naive")
        .alias("oac_history"),
        two(5).alias("tobacco"), two(7).alias("alcohol_use"),
        two(4).alias("heart_failure"), two(11).alias("stroke_hx"),
        two(6).alias("diabetes"), two(8).alias("hypertension"),
        (k % 9 == 0).cast("int").alias("amiodarone"),
        (k % 13 == 0).cast("int").alias("insulin_use"),
        (k % 2 + 1).alias("arm"))


def centres(spark, sf) -> DataFrame:
    n = adapter.table(spark, sf, "nation").filter("n_nationkey < 20")
    k = F.col("n_nationkey")
    return n.select(k.alias("centre"), (k % 3 + 1).alias("location"),
                    (k % 2).alias("clinic"))


def countries(spark, sf) -> DataFrame:
    n = adapter.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    gdp = n.filter("n_nationkey < 22").select(
        F.col("n_name").alias("country"),
        (1000 + (k * 7919) % 5000).alias("gdp"))
    health = n.filter("n_nationkey > 3").select(
        F.col("n_name").alias("country"), (60.0 + k % 15).alias("dale"),
        (k * 3.5).alias("hsp"))
    return rp.country_table(gdp, health)


def chars(spark, sf) -> DataFrame:
    return rp.characteristics(patients(spark, sf), centres(spark, sf),
                              countries(spark, sf))


_CHR = "subjid:l centre:l country:s age:l weight:d " + " ".join(
    f"{c}:l" for c in rp.FLAG_COLS) + \
    " sechosp:l acclinic:l highincome:l dale:d hsp:d"


@query("characteristics", _CHR, f"WITH {_PAT} SELECT * FROM chr")
def _(spark, sf):
    return chars(spark, sf)


_CT = f""", {CMP}, {_TTE}, {_PAT}, {_MEDS}, bo AS (SELECT cmp.* FROM cmp JOIN te
 USING (subjid) WHERE composite_outcome = 0 OR study_day <= time_to_event),
 sc AS (SELECT subjid, avg(CAST(abs(threshold_diff) <= 0.05 AS INT))
 AS algorithm_consistency FROM bo WHERE abs(threshold_diff) < 1e200
 GROUP BY subjid), ct AS (SELECT sc.*, chr.* EXCLUDE (subjid), med.* EXCLUDE
 (subjid), te.* EXCLUDE (subjid), avg(algorithm_consistency) OVER (PARTITION
 BY centre) AS centre_algorithm_consistency FROM sc LEFT JOIN chr
 USING (subjid) LEFT JOIN med USING (subjid) LEFT JOIN te USING (subjid))"""


def consistency(spark, sf) -> DataFrame:
    c = ev.hierarchical_ttr(compared(spark, sf), scan_of(spark, sf))
    return rp.consistency_table(c, "threshold_diff", chars(spark, sf),
                                meds(spark, sf), tte(spark, sf))


@query("consistency_table", _CHR + " beta_blocker:l asa:l ace:l statin:l "
       "time_to_event:l composite_outcome:l algorithm_consistency:d "
       "centre_algorithm_consistency:d", q.W_T + _CT + " SELECT * FROM ct")
def _(spark, sf):
    return consistency(spark, sf)


_TT = f""", {CMP}, {TTR}, {_PAT}, fr AS (SELECT * FROM cmp JOIN ttr USING (trial,
 subjid, trajid) WHERE abs(threshold_diff) < 1e200), pj AS (SELECT subjid,
 trajid, avg(ttr) AS ttr, avg(length) AS length FROM fr GROUP BY ALL),
 st AS (SELECT subjid, sum(ttr * length) / nullif(sum(length), 0) AS ttr
 FROM pj GROUP BY subjid), sc AS (SELECT subjid, avg(CAST(abs(threshold_diff)
 <= 0.05 AS INT)) AS algorithm_consistency FROM fr GROUP BY subjid),
 tt AS (SELECT st.*, algorithm_consistency, chr.* EXCLUDE (subjid),
 avg(algorithm_consistency) OVER (PARTITION BY centre)
 AS centre_algorithm_consistency FROM st LEFT JOIN sc USING (subjid)
 LEFT JOIN chr USING (subjid))"""


def ttr_inputs(spark, sf) -> DataFrame:
    c = ev.hierarchical_ttr(compared(spark, sf), scan_of(spark, sf))
    return rp.ttr_table(c, "threshold_diff", chars(spark, sf))


@query("ttr_table", _CHR + " ttr:d algorithm_consistency:d "
       "centre_algorithm_consistency:d", q.W_T + _TT + " SELECT * FROM tt")
def _(spark, sf):
    return ttr_inputs(spark, sf)


@query("centre_table", "centre:l algorithm_consistency_mean:d "
       "algorithm_consistency_count:l ttr_mean:d ttr_count:l", q.W_T + _TT
       + """ SELECT centre, avg(algorithm_consistency)
 AS algorithm_consistency_mean, count(algorithm_consistency)
 AS algorithm_consistency_count, avg(ttr) AS ttr_mean, count(ttr) AS ttr_count
 FROM tt GROUP BY centre""")
def _(spark, sf):
    return rp.centre_table(ttr_inputs(spark, sf))


_CENS = "cens AS (SELECT subjid, max(study_day) AS censor_day FROM v " \
    "GROUP BY subjid)"


def censoring(spark, sf) -> DataFrame:
    return V(spark, sf).groupBy("subjid").agg(
        F.max("study_day").alias("censor_day"))


def centre_country(spark, sf) -> DataFrame:
    return chars(spark, sf).select("centre", "sechosp", "acclinic",
                                   "highincome").distinct()


def control_tte(spark, sf) -> DataFrame:
    return rp.control_tte_table(patients(spark, sf), meds(spark, sf),
                                centre_country(spark, sf), EV(spark, sf),
                                censoring(spark, sf))


@query("control_tte_table", "subjid:l centre:l age:l weight:d male:l hf:l "
       "asa:l sechosp:l highincome:l time_to_event:l composite_outcome:l",
       q.W_EV + f""", {_PAT}, {_MEDS}, {_CENS}, cc AS (SELECT DISTINCT centre,
 sechosp, acclinic, highincome FROM chr) SELECT pat.*, med.* EXCLUDE (subjid),
 cc.* EXCLUDE (centre), coalesce(event_day, censor_day) AS time_to_event,
 CAST(event_day IS NOT NULL AS INT) AS composite_outcome FROM pat
 LEFT JOIN med USING (subjid) LEFT JOIN cc USING (centre) LEFT JOIN (SELECT
 subjid, event_day FROM ev WHERE event_name IN ('Major Bleeding',
 'Ischemic Stroke', 'Systemic Embolism', 'Cardiovascular Death')) e
 USING (subjid) LEFT JOIN cens USING (subjid) WHERE arm = 2 AND asa IS NOT
 NULL AND sechosp IS NOT NULL AND highincome IS NOT NULL AND
 coalesce(event_day, censor_day) IS NOT NULL""")
def _(spark, sf):
    return control_tte(spark, sf)


# Summaries, audits and heatmaps.

_REG = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def summary_rows(spark, sf) -> DataFrame:
    b = BL(spark, sf).withColumns({
        "age": fc.recode_capped("age", ">89", 90),
        "diabetes": fc.yes_no("diabetes")})
    return tr.merge_baseline(T(spark, sf), b,
                             ["age", "weight", "sex", "diabetes", "region"])


_SUM = ("trial:s pairs:l subjects:l trajectories:l length_mean:d length_sd:d "
        "values_mean:d values_sd:d stroke_per_100y:d hosp_per_100y:d "
        "ttr_pct:d age_mean:d age_sd:d weight_mean:d weight_sd:d sex_pct:d "
        "diabetes_pct:d region_africa_pct:d region_middle_east_pct:d")


@query("cohort_summary", _SUM, q.W_T + f""", {TTR}, {q.BL}, sn AS (SELECT
 trial, subjid, trajid, max(study_day) - min(study_day) AS len, sum(stroke)
 AS stroke, sum(hosp) AS hosp FROM traj GROUP BY ALL), a AS (SELECT trial,
 count(*) AS pairs, count(DISTINCT subjid) AS subjects FROM traj
 GROUP BY trial), b AS (SELECT trial, count(*) AS trajectories, avg(len)
 AS length_mean, stddev_samp(len) AS length_sd, sum(stroke) * 100 / (sum(len)
 / 365.25) AS stroke_per_100y, sum(hosp) * 100 / (sum(len) / 365.25)
 AS hosp_per_100y FROM sn GROUP BY trial), c AS (SELECT trial, avg(n)
 AS values_mean, stddev_samp(n) AS values_sd FROM (SELECT trial, subjid,
 count(value) AS n FROM traj GROUP BY ALL) GROUP BY trial), d AS (SELECT
 trial, avg(ttr) * 100 AS ttr_pct FROM ttr GROUP BY trial), e AS (SELECT
 trial, avg(ag) AS age_mean, stddev_samp(ag) AS age_sd, avg(weight)
 AS weight_mean, stddev_samp(weight) AS weight_sd, avg(sex) * 100 AS sex_pct,
 avg(CAST(diabetes = 'Y' AS INT)) * 100 AS diabetes_pct, avg(CAST(region =
 'AFRICA' AS INT)) * 100 AS region_africa_pct, avg(CAST(region =
 'MIDDLE EAST' AS INT)) * 100 AS region_middle_east_pct FROM (SELECT DISTINCT
 trial, subjid FROM traj) JOIN (SELECT *, CASE WHEN age = '>89' THEN 90 ELSE
 CAST(age AS INT) END AS ag FROM bl) USING (subjid) GROUP BY trial) SELECT *
 FROM a JOIN b USING (trial) JOIN c USING (trial) JOIN d USING (trial) JOIN e
 USING (trial)""")
def _(spark, sf):
    return rp.cohort_summary(summary_rows(spark, sf), ["stroke", "hosp"],
                             levels={"region": _REG},
                             scan=scan_of(spark, sf))


@query("cohort_summary_text", None)
def _(spark, sf):
    s = rp.cohort_summary(summary_rows(spark, sf), ["stroke", "hosp"],
                          levels={"region": _REG})
    return rel.transpose(rp.format_summary(s), "trial")


@query("follow_up", "median_follow_up_months:d", q.W_T + """SELECT median(s)
 / 30.4375 AS median_follow_up_months FROM (SELECT max(study_day)
 - min(study_day) AS s FROM traj GROUP BY trial, subjid)""")
def _(spark, sf):
    return rp.median_follow_up_months(T(spark, sf))


@query("control_summary", "event_name:s n:l per_100y:d", q.W_EV + f""", {_PAT},
 {_CENS}, tt AS (SELECT subjid, censor_day AS time_to_event FROM cens WHERE
 subjid % 2 = 1), f AS (SELECT subjid, first(event_name ORDER BY event_day
 NULLS LAST, event_name) AS event_name FROM ev WHERE subjid IN (SELECT subjid
 FROM tt) GROUP BY subjid) SELECT event_name, count(*) AS n, count(*) /
 (SELECT sum(time_to_event) / 365.25 FROM tt) * 100 AS per_100y FROM f
 GROUP BY event_name""")
def _(spark, sf):
    t = censoring(spark, sf).filter("subjid % 2 = 1") \
        .withColumnRenamed("censor_day", "time_to_event")
    return rp.control_summary(patients(spark, sf), EV(spark, sf), t,
                              list(P.EVENT_NAMES.values()))


def _stat(c, p):
    return (f"min({c}) AS {p}min, quantile_cont({c}, 0.25) AS {p}q25, "
            f"quantile_cont({c}, 0.5) AS {p}q50, avg({c}) AS {p}mean, "
            f"quantile_cont({c}, 0.75) AS {p}q75, max({c}) AS {p}max")


def _audit_sql():
    """The ten steps from one chain of tables. Rows are counted over each
    step, and statistics over its trajectories."""
    steps = {"prepared": "pv", "presets": "un0", "union": "un",
             "events": "merged", "split_events": "ses", "impute": "imp",
             "split_gaps": "sgs", "baseline": "base", "prune": "pr"}
    groups = ["ENGAGE", "ROCKET_AF", "RELY", "ARISTOTLE"]
    static = list(PARAMS.static_cols)
    rows = {"rows": "TRUE", "null_values": "{s} AND value IS NULL",
            "zero_values": "{s} AND value = 0",
            "null_doses": "{s} AND dose IS NULL",
            "zero_doses": "{s} AND dose = 0", "negative_doses": "dose < 0"}
    split = " + ".join(PARAMS.events_splitting)
    ctes = [f"""base AS (SELECT sgs.*, {", ".join("bl." + {"continent":
 "region"}.get(c, c) + " AS " + c for c in static)} FROM sgs LEFT JOIN bl
 ON sgs.subjid = bl.subjid)""",
            f"gs AS (SELECT unnest({groups}) AS g)"]
    per, out = [], []
    for step, src in steps.items():
        early = step in ("prepared", "presets", "union")
        seen = "coalesce(value_type = 'Y', FALSE)" if early else "TRUE"
        ev = [f"NULL AS {e}" if early else f"sum({e}) AS {e}" for e in EVENTS]
        keys = "trial, subjid" + ("" if step == "prepared" else ", trajid")
        most = "NULL" if early else f"count(*) FILTER ({split} > 0)"
        per.append(f"""SELECT '{step}' AS step, trial, subjid, count(value)
 AS entries, max(study_day) - min(study_day) AS days, count(dose) AS doses,
 count(*) FILTER (dose IS NULL) AS open_doses, {most} AS splits,
 {", ".join(ev)} FROM {src} WHERE {seen} GROUP BY {keys}""")
        more = {f"null_{c}": f"{c} IS NULL" for c in static} \
            if step == "baseline" else {}
        for m, cond in {**rows, **more}.items():
            out.append(f"""SELECT '{step}' AS step, '{m}' AS metric, g AS grp,
 (SELECT count(*) FILTER ({cond.format(s=seen)}) FROM {src} WHERE trial = g)
 AS value FROM gs""")
    ctes.append("per AS (" + " UNION ALL ".join(per) + ")")
    sums = ", ".join(f"sum({e}) AS {e}" for e in EVENTS)
    rate = ", ".join(f"sum({e}) / count(*) AS {e}_per_subject"
                     for e in EVENTS)
    ctes.append(f"""ps AS (SELECT step, trial, subjid, count(*)
 AS trajectories, sum(entries) AS entries, sum(doses) AS doses,
 sum(open_doses) AS open_doses, {sums} FROM per GROUP BY ALL)""")
    ctes.append(f"""pt AS (SELECT step, trial, count(*) AS subjects,
 sum(trajectories) AS trajectories, avg(entries) AS values_per_subject,
 avg(doses) AS doses_per_subject, count(*) FILTER (open_doses > 0)
 AS subjects_with_null_dose, {sums}, {rate} FROM ps GROUP BY step, trial)""")
    ctes.append(f"""pq AS (SELECT step, trial, {_stat("entries", "entries_")},
 {_stat("days", "days_")} FROM per GROUP BY step, trial)""")
    pick = "SELECT step, '{m}', trial, {m} FROM {t}"
    out += [pick.format(m=m, t="pt") for m in (
        "subjects", "trajectories", "values_per_subject",
        "doses_per_subject", "subjects_with_null_dose")]
    out += [pick.format(m=m, t="pt") + f" WHERE {m} IS NOT NULL" for m in (
        *EVENTS, *[f"{e}_per_subject" for e in EVENTS])]
    out += [pick.format(m=f"{c}_{s}", t="pq") for c in ("entries", "days")
            for s in ("min", "q25", "q50", "mean", "q75", "max")]
    out.append("SELECT step, 'max_splitting_events', 'all', max(splits) FROM "
               "per WHERE splits IS NOT NULL GROUP BY step")
    # What single steps add.
    one = "SELECT '{}', '{}', 'all', {} FROM {}"
    ctes.append(f"""e0 AS (SELECT trial, {", ".join(
        f"sum(CAST(event_name = '{n}' AS INT)) AS {f}"
        for f, n in q._EVN.items())} FROM ev GROUP BY trial),
 e1 AS (SELECT e0.*, n FROM e0 JOIN (SELECT trial, count(DISTINCT subjid)
 AS n FROM pv GROUP BY trial) USING (trial)),
 bx AS (SELECT * FROM bl WHERE subjid IN (SELECT subjid FROM v)),
 de AS (SELECT *, count(dose) OVER (PARTITION BY trial, subjid ORDER BY
 study_day, seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS e FROM pv
 WHERE trial IN ('ENGAGE', 'ROCKET_AF')),
 du AS (SELECT {_stat("dose", "dose_")}, count(dose) AS dose_n,
 stddev_samp(dose) AS dose_sd FROM un),
 ga AS (SELECT trial, first_value(CASE WHEN dose IS NOT NULL THEN study_day
 END IGNORE NULLS) OVER (PARTITION BY trial, subjid ORDER BY study_day ROWS
 BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - study_day AS gap FROM ses),
 gq AS (SELECT trial, {_stat("gap", "gap_")} FROM ga WHERE gap > 0
 GROUP BY trial),
 ids AS (SELECT DISTINCT subjid, ('0x' || substr(md5('42|' || subjid), 1, 8))
 ::BIGINT AS h FROM pr WHERE trial = 'ARISTOTLE'), va AS (SELECT subjid,
 row_number() OVER (ORDER BY h, subjid) <= floor(0.2 * count(*) OVER ())
 AS val FROM ids), sp AS (SELECT trial, pr.subjid, CASE WHEN trial = 'RELY'
 THEN 'test' WHEN val THEN 'val' ELSE 'train' END AS split FROM pr
 LEFT JOIN va ON pr.subjid = va.subjid)""")
    out += [f"SELECT 'prepared', 'event_rows', g, (SELECT count(*) FROM ev "
            "WHERE trial = g) FROM gs",
            one.format("prepared", "baseline_rows", "count(*)", "bx")]
    out += [one.format("prepared", f"{n}_subjects", "count(DISTINCT subjid)",
                       t) for n, t in (("visit", "pv"), ("event", "ev"),
                                       ("baseline", "bx"))]
    out += [f"SELECT 'prepared', '{e}', trial, {e} FROM e1" for e in EVENTS]
    out += [f"SELECT 'prepared', '{e}_per_subject', trial, {e} / n FROM e1"
            for e in EVENTS]
    out += [f"SELECT 'prepared', 'entries_before_{i}', trial, count(*) FILTER"
            f" (e = {i}) FROM de WHERE value_type = 'Y' GROUP BY trial"
            for i in range(4)]
    out += [one.format("union", f"dose_{c}", f"dose_{c}", "du") for c in (
        "n", "sd", "min", "q25", "q50", "mean", "q75", "max")]
    out.append("SELECT 'events', 'max_rows_per_day', 'all', max(n) FROM "
               "(SELECT count(*) AS n FROM merged GROUP BY trial, subjid, "
               "study_day)")
    out += [f"SELECT 'impute', 'gap_{c}', trial, gap_{c} FROM gq"
            for c in ("min", "q25", "q50", "q75", "max")]
    out += ["SELECT 'splits', 'split_rows', g, (SELECT count(*) FROM sp WHERE "
            "split = g) FROM (SELECT unnest(['train', 'val', 'test']) AS g)",
            "SELECT 'splits', 'misplaced_rows', g, (SELECT count(*) FROM sp "
            "WHERE split = g AND (split = 'test') <> (trial = 'RELY') OR "
            "split = g AND g = 'val' AND trial <> 'ARISTOTLE') "
            "FROM (SELECT unnest(['train', 'val', 'test']) AS g)",
            "SELECT 'splits', 'shared_subjects', 'all', count(*) FROM (SELECT "
            "subjid FROM sp WHERE split <> 'test' GROUP BY subjid "
            "HAVING min(split) <> max(split))"]
    return (q.computed_once(q.upto("full") + ", " + ", ".join(ctes)) + " "
            + " UNION ALL ".join(out))


@query("audit_report", "step:s metric:s grp:s value:d", _audit_sql())
def _(spark, sf):
    _, report = au.run_audited(V(spark, sf), EV(spark, sf), BL(spark, sf),
                               PARAMS)
    return report.withColumnRenamed("group", "grp")


@query("daily_entry_audit", "trial:s entries:l n:l", q.W_V + """SELECT trial,
 e AS entries, count(*) AS n FROM (SELECT *, count(dose) OVER (PARTITION BY
 trial, subjid ORDER BY study_day, seq ROWS BETWEEN 3 PRECEDING AND 1
 PRECEDING) AS e FROM v WHERE trial IN ('ENGAGE', 'ROCKET_AF')) WHERE
 value_type = 'Y' GROUP BY ALL""")
def _(spark, sf):
    rows = on_visits(spark, sf, lambda s, v: tr.trailing_count(
        v.filter(F.col("trial").isin(*PARAMS.daily_dose_trials)), KEYS,
        ["study_day", "seq"], "dose", "entries", scan=s))
    return rows.filter("value_type = 'Y'").groupBy("trial", "entries").agg(
        F.count(F.lit(1)).alias("n"))


@query("imputation_audit", "metric:s grp:s value:d", q.W_T + f""", g AS (SELECT
 trial, first_value(CASE WHEN dose IS NOT NULL THEN study_day END IGNORE
 NULLS) OVER (PARTITION BY trial, subjid ORDER BY study_day ROWS BETWEEN
 CURRENT ROW AND UNBOUNDED FOLLOWING) - study_day AS gap FROM traj), s AS
 (SELECT trial, {_stat("gap", "gap_")} FROM g WHERE gap > 0 GROUP BY trial)
 """ + " UNION ALL ".join(
     f"SELECT 'gap_{n}' AS metric, trial AS grp, gap_{n} AS value FROM s"
     for n in ("min", "q25", "q50", "q75", "max")))
def _(spark, sf):
    return rp.imputation_audit(T(spark, sf), scan=scan_of(spark, sf)) \
        .withColumnRenamed("group", "grp")


_LAB = "['" + "', '".join(P.ACTION_LABELS) + "']"
_VB = """CASE WHEN value < 1.5 THEN '< 1.5' WHEN value < 2 THEN '1.5 - 2'
 WHEN value <= 3 THEN '2 - 3' WHEN value <= 3.5 THEN '3 - 3.5'
 WHEN value > 3.5 THEN '> 3.5' END"""


def _heat_sql(by=""):
    g = f"{by}, " if by else ""
    levels = ("(SELECT unnest(['ENGAGE', 'RELY', 'ROCKET_AF', 'ARISTOTLE']) "
              "AS trial) CROSS JOIN ") if by else ""
    on = "c.value_bin = g.value_bin AND c.action = g.action" + (
        f" AND c.{by} = g.{by}" if by else "")
    part = "PARTITION BY " + (f"g.{by}, " if by else "") + "g.value_bin"
    pick = f"g.{by}, " if by else ""
    vb = "['" + "', '".join(P.VALUE_LABELS) + "']"
    return f""", {_DEC}, c AS (SELECT {g} {_VB} AS value_bin,
 ({_LAB})[option_ + 1] AS action, count(*) AS n FROM opt WHERE value IS NOT
 NULL AND option_ IS NOT NULL GROUP BY ALL), g AS (SELECT * FROM {levels}
 (SELECT unnest({vb}) AS value_bin) CROSS JOIN (SELECT unnest({_LAB})
 AS action)) SELECT {pick} g.value_bin, g.action, coalesce(n, 0) AS n,
 coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER ({part}), 0) AS share
 FROM g LEFT JOIN c ON {on}"""


@query("heatmap", "value_bin:s action:s n:l share:d", q.W_T + _heat_sql())
def _(spark, sf):
    return rp.heatmap(on_base(
        spark, sf, lambda s, d: tn.observed_decision(d, scan=s)), "option")


@query("heatmap_by_trial", "trial:s value_bin:s action:s n:l share:d",
       q.W_T + _heat_sql("trial"))
def _(spark, sf):
    d = on_base(spark, sf, lambda s, d: tn.observed_decision(d, scan=s))
    return rp.heatmap(d, "option", "trial",
                      ["ENGAGE", "RELY", "ROCKET_AF", "ARISTOTLE"])


_TH = f""", t1 AS (SELECT *, lead(dose) OVER {q.WK} AS nd, lead(value) OVER
 {q.WK} AS nv FROM traj), t2 AS (SELECT *, CASE WHEN dose <> 0 THEN nd / dose
 WHEN dose = 0 AND nd > 0 THEN 1e300 END AS ratio, nv - value AS ch FROM t1),
 th AS (SELECT trial, CASE WHEN value > 0 AND value <= 1 THEN '< 1'
 WHEN value > 1 AND value <= 2 THEN '[1, 2)' WHEN value > 2 AND value <= 3
 THEN '[2, 3]' WHEN value > 3 AND value <= 4 THEN '(3, 4]' WHEN value > 4
 THEN '> 4' END AS value_bin, ({_LAB})[1 + CASE WHEN ratio - 1 = 0 THEN 3
 WHEN ratio - 1 <= -0.2 THEN 0 WHEN ratio - 1 <= -0.1 THEN 1 WHEN ratio - 1
 <= 0 THEN 2 WHEN ratio - 1 <= 0.1 THEN 4 WHEN ratio - 1 <= 0.2 THEN 5 ELSE 6
 END] AS dose_change, CASE WHEN ch <= -1 THEN 'Decrease > 1.0' WHEN ch <=
 -0.25 THEN 'Decrease < 1.0' WHEN ch <= 0.25 THEN 'Approx. Same' WHEN ch <= 1
 THEN 'Increase < 1.0' ELSE 'Increase > 1.0' END AS value_change FROM t2
 WHERE value IS NOT NULL AND ratio IS NOT NULL AND ch IS NOT NULL)"""


@query("dose_change_heatmap", "trial:s value_bin:s dose_change:s n:l share:d",
       q.W_T + _TH + """ SELECT *, n / sum(n) OVER (PARTITION BY trial,
 value_bin) AS share FROM (SELECT trial, value_bin, dose_change, count(*) AS n
 FROM th WHERE value_bin IS NOT NULL GROUP BY ALL)""")
def _(spark, sf):
    return rp.transition_heatmaps(T(spark, sf), scan=scan_of(spark, sf))[0]


@query("value_change_heatmap", "trial:s dose_change:s value_change:s n:l "
       "share:d", q.W_T + _TH + """ SELECT *, n / sum(n) OVER (PARTITION BY
 trial, dose_change) AS share FROM (SELECT trial, dose_change, value_change,
 count(*) AS n FROM th GROUP BY ALL)""")
def _(spark, sf):
    return rp.transition_heatmaps(T(spark, sf), scan=scan_of(spark, sf))[1]


_NAMES = {a: n for a, n in P.MODEL_NAMES.items()}


@query("agreement_curve", "model:s bin:l trajectories:l total_days:l "
       "ttr_pct:d", q.W_T + f""", {DIS}, lg AS ({" UNION ALL ".join(
           f"SELECT '{n}' AS model, {a}_diff * 100 AS diff, ttr, length "
           f"FROM dis" for a, n in _NAMES.items())}) SELECT model, floor(diff)
 AS bin, count(*) AS trajectories, sum(length) AS total_days, sum(ttr
 * length) / nullif(sum(length), 0) * 100 AS ttr_pct FROM lg WHERE diff <
 1e200 GROUP BY ALL""")
def _(spark, sf):
    return rp.agreement_curve(disagreements(spark, sf))


_OUT = {"ttr": ("ttr * 100", "length"), "any_event": ("any_event", "1"),
        **{e: (e, "1") for e in ADV}}


@query("agreement_smooth", "model:s outcome:s x:d fit:d se:d", q.W_T + f"""
 , {DIS}, lg AS ({" UNION ALL ".join(
     f"SELECT '{n}' AS model, '{o}' AS outcome, {a}_diff * 100 AS x, "
     f"CAST({y} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w FROM dis "
     f"WHERE {a}_diff * 100 BETWEEN 0 AND 50"
     for a, n in _NAMES.items() for o, (y, w) in _OUT.items())}),
 bs AS (SELECT model, outcome, least(floor(x), 49) + 0.5 AS mid, count(*)
 AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy,
 sum(w * x * y) AS wxy, sum(w * y * y) AS wyy FROM lg WHERE y IS NOT NULL
 GROUP BY ALL), ax AS (SELECT *, abs(mid - x0) AS d FROM bs, (SELECT
 unnest(range(51)) AS x0)), ay AS (SELECT *, sum(n) OVER (PARTITION BY model,
 outcome, x0 ORDER BY d) AS upto, sum(n) OVER (PARTITION BY model, outcome,
 x0) AS total FROM ax), az AS (SELECT *, min(d) FILTER (upto >= 0.75 * total)
 OVER (PARTITION BY model, outcome, x0) AS h FROM ay), ak AS (SELECT *, CASE
 WHEN h = 0 THEN CAST(d = 0 AS INT) WHEN d / (h * 1.001) < 1 THEN
 pow(1 - pow(d / (h * 1.001), 3), 3) ELSE 0 END AS k FROM az), sm AS (SELECT model, outcome, x0, sum(k * n) AS n,
 sum(k * w) AS s0, sum(k * (wx - x0 * w)) AS s1, sum(k * (wxx - 2 * x0 * wx
 + x0 * x0 * w)) AS s2, sum(k * wy) AS t0, sum(k * (wxy - x0 * wy)) AS t1,
 sum(k * wyy) AS yy, sum(k * k * w) AS q0, sum(k * k * (wx - x0 * w)) AS q1,
 sum(k * k * (wxx - 2 * x0 * wx + x0 * x0 * w)) AS q2 FROM ak GROUP BY ALL),
 dt AS (SELECT *, CASE WHEN s0 * s2 - s1 * s1 > s0 * s2 * 1e-9 THEN s0 * s2
 - s1 * s1 END AS det FROM sm), ft AS (SELECT *, CASE WHEN det IS NULL THEN
 t0 / nullif(s0, 0) ELSE (s2 * t0 - s1 * t1) / det END AS fit, coalesce((s0
 * t1 - s1 * t0) / det, 0) AS slope, CASE WHEN det IS NULL THEN q0
 / nullif(s0 * s0, 0) ELSE (s2 * s2 * q0 - 2 * s1 * s2 * q1 + s1 * s1 * q2)
 / (det * det) END AS spread FROM dt) SELECT model, outcome, x0 AS x, fit,
 CASE WHEN n > 2 THEN sqrt(greatest(yy - fit * t0 - slope * t1, 0) / (n - 2)
 * greatest(spread, 0)) END AS se FROM ft""")
def _(spark, sf):
    return rp.agreement_smooth(disagreements(spark, sf),
                               [*ADV, "any_event"])


# Regressions and learned policies.

_LINE = """m AS (SELECT count(*) AS n, sum(w) AS s, sum(w * x) / sum(w) AS mx,
 sum(w * y) / sum(w) AS my FROM r), c AS (SELECT any_value(n) AS n,
 any_value(s) AS s, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx)
 * (x - mx)) AS xx, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (y - my)
 * (y - my)) AS yy FROM r, m), b AS (SELECT *, xy / xx AS slope, (yy - xy * xy
 / xx) / (n - 2) AS s2 FROM c), o AS (SELECT '{x}' AS term, slope AS estimate,
 sqrt(s2 / xx) AS std_error FROM b UNION ALL SELECT 'intercept', my - slope
 * mx, sqrt(s2 * (1 / s + mx * mx / xx)) FROM b) SELECT *, estimate
 / std_error AS statistic FROM o"""


@query("wls", "term:s estimate:d std_error:d statistic:d", q.W_T + f""",
 {DIS}, r AS (SELECT threshold_eq AS x, ttr AS y, CAST(length AS DOUBLE) AS w
 FROM dis WHERE length > 0), """ + _LINE.format(x="threshold_eq"))
def _(spark, sf):
    return rg.wls(disagreements(spark, sf).filter("length > 0"), "ttr",
                  ["threshold_eq"], "length")


@query("wls_centres", "term:s estimate:d std_error:d statistic:d", q.W_T + _TT
       + """, r AS (SELECT avg(algorithm_consistency) AS x, avg(ttr) AS y,
 CAST(count(ttr) AS DOUBLE) AS w FROM tt GROUP BY centre), """
       + _LINE.format(x="algorithm_consistency_mean"))
def _(spark, sf):
    c = rp.centre_table(ttr_inputs(spark, sf))
    return rg.wls(c, "ttr_mean", ["algorithm_consistency_mean"], "ttr_count")


def _logit_sql(steps: int) -> str:
    """Newton steps from zero for an intercept and a slope."""
    out = ", z0 AS (SELECT 0.0 AS b0, 0.0 AS b1, 1.0 AS w, 0.0 AS wx, 1.0 AS wxx)"
    for i in range(steps):
        out += f""", g{i} AS (SELECT sum(y - p) AS s0, sum((y - p) * x) AS s1,
 sum(p * (1 - p)) AS w, sum(p * (1 - p) * x) AS wx, sum(p * (1 - p) * x * x)
 AS wxx FROM (SELECT x, y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM r, z{i})),
 z{i + 1} AS (SELECT b0 + (wxx * s0 - wx * s1) / (w * wxx - wx * wx) AS b0,
 b1 + (w * s1 - wx * s0) / (w * wxx - wx * wx) AS b1, g{i}.w, g{i}.wx, g{i}.wxx
 FROM (SELECT b0, b1 FROM z{i}), g{i})"""
    return out


@query("logit", "term:s estimate:d std_error:d statistic:d", q.W_T + f""",
 {DIS}, r AS (SELECT CAST(policy_eq AS DOUBLE) AS x, CAST(any_event AS DOUBLE)
 AS y FROM dis WHERE policy_eq IS NOT NULL AND any_event IS NOT NULL)"""
       + _logit_sql(12) + """ SELECT term, estimate, std_error, estimate
 / std_error AS statistic FROM (SELECT 'intercept' AS term, b0 AS estimate,
 sqrt(wxx / (w * wxx - wx * wx)) AS std_error FROM z12 UNION ALL SELECT
 'policy_eq', b1, sqrt(w / (w * wxx - wx * wx)) FROM z12)""")
def _(spark, sf):
    return rg.logit(disagreements(spark, sf), "any_event", ["policy_eq"])


_XS = ["age", "weight", "male", "hf", "diab", "sechosp",
       "centre_algorithm_consistency"]


# All covariates of subjects, centres and countries.
_ALL = ["age", "weight", *rp.FLAG_COLS, "centre_algorithm_consistency",
        "sechosp", "acclinic", "highincome", "dale", "hsp"]


@query("random_intercept", None)
def _(spark, sf):
    """Centres within countries."""
    d = ttr_inputs(spark, sf).withColumns({
        "ttr": F.col("ttr") * 100,
        "centre_algorithm_consistency":
            F.col("centre_algorithm_consistency") * 10})
    return mx.mixed_model(d, "ttr", _ALL, ["centre", "country"])


def survival(spark, sf) -> DataFrame:
    """Subjects with their centres, covariates and times to an event."""
    return cut_lineage(consistency(spark, sf).withColumn(
        "centre_algorithm_consistency",
        F.col("centre_algorithm_consistency") * 10))


_COX = [*_ALL, "beta_blocker", "asa", "ace", "statin"]


@query("cox_ph", None)
def _(spark, sf):
    return rg.cox_ph(survival(spark, sf), "time_to_event",
                     "composite_outcome", _XS)


@query("cox_centres", None)
def _(spark, sf):
    """All covariates and a random centre."""
    return mx.cox_groups(survival(spark, sf), "time_to_event",
                         "composite_outcome", _COX, "centre")


@query("coef_table", None)
def _(spark, sf):
    return rg.coef_table(rg.cox_ph(survival(spark, sf), "time_to_event",
                                   "composite_outcome", _XS),
                         exponentiate=True)


def tabular(spark, sf) -> DataFrame:
    """Transitions over binned states, from the short base."""
    def rows(scan, v):
        d = base(v, scan)
        d = po.discretise(d, {"value": P.AUDIT_VALUE_BOUNDS,
                              "dose": P.DOSE_BOUNDS})
        d = tn.elapsed(tn.observed_decision(d, scan=scan), scan)
        d = tn.transition_reward(d, ADV, scan=scan)
        d = tn.done_flag(d, scan=scan)
        d = scan.add(d, WITHIN, ["study_day"],
                     next_state=tn.lead("state"))
        return d.filter("k is not null and option is not null").select(
            *WITHIN, "study_day", "state", "option", "k", "reward",
            (1.0 - F.col("done")).alias("not_done"), "next_state")
    return on_visits(spark, sf, rows)


_MODEL = f""", {_DEC}, {_SPAN}, dn1 AS (SELECT *, max(CASE WHEN value IS NOT
 NULL AND dose IS NOT NULL THEN study_day END) OVER {q.K} AS ld FROM opt),
 dn AS (SELECT *, lead(CASE WHEN study_day = ld THEN 1 ELSE 0 END) OVER {q.WK}
 AS done, lead(study_day) OVER {q.WK} - study_day AS k, CASE WHEN value > 0
 AND value <= 1 THEN 1 WHEN value > 1 AND value <= 2 THEN 2 WHEN value > 2
 AND value <= 3 THEN 3 WHEN value > 3 AND value <= 4 THEN 4 WHEN value > 4
 THEN 5 ELSE 0 END * 11 + CASE {" ".join(
     f"WHEN dose > {a} AND dose <= {b} THEN {i + 1}" for i, (a, b) in
     enumerate(zip(P.DOSE_BOUNDS[:-1], P.DOSE_BOUNDS[1:])))} ELSE 0 END
 AS state FROM dn1), ns AS (SELECT *, lead(state) OVER {q.WK} AS next_state
 FROM dn), rd AS (SELECT a.trial, a.subjid, a.trajid, a.pv AS study_day,
 sum(CASE WHEN x BETWEEN 2 AND 3 THEN pow(0.99, d - pv - 1) ELSE 0.0 END)
 AS reward FROM (SELECT *, lag(visit_day) OVER (PARTITION BY trial, subjid,
 trajid ORDER BY d) AS pv FROM days) a WHERE pv IS NOT NULL GROUP BY ALL),
 mdl AS (SELECT state, option_ AS option, next_state, count(*) AS n,
 sum(reward) AS r, sum((1 - done) * pow(0.99, k)) AS d FROM ns JOIN rd
 USING (trial, subjid, trajid, study_day) WHERE k IS NOT NULL AND option_ IS
 NOT NULL GROUP BY ALL)"""


@query("empirical_model", "state:l option:l next_state:l n:l r:d d:d",
       q.W_T + _MODEL + " SELECT * FROM mdl")
def _(spark, sf):
    return po.empirical_model(tabular(spark, sf))


_STEP = """, rel_ AS (SELECT state, option, sum(n) AS n, sum(n) / max(sum(n))
 OVER (PARTITION BY state) AS rel FROM mdl GROUP BY state, option)"""


def _q_sql(steps: int, tau: float = 0.3, t: str = "q", v: str = "v") -> str:
    out = f", {t}0 AS (SELECT state, option, n, rel, 0.0 AS q FROM rel_)"
    for i in range(steps):
        out += f""", {v}{i} AS (SELECT state, max(q) AS vv FROM {t}{i}
 WHERE rel >= {tau} GROUP BY state), {t}{i + 1} AS (SELECT m.state, m.option,
 any_value(p.n) AS n, any_value(p.rel) AS rel, (sum(m.r) + sum(m.d
 * coalesce(vv, 0))) / sum(m.n) AS q FROM mdl m JOIN {t}{i} p ON m.state =
 p.state AND m.option = p.option LEFT JOIN {v}{i} ON {v}{i}.state =
 m.next_state GROUP BY m.state, m.option)"""
    return out


@query("fitted_q", "state:l option:l n:l q:d", q.W_T + _MODEL + _STEP
       + _q_sql(6) + " SELECT state, option, n, q FROM q6")
def _(spark, sf):
    return po.fitted_q(tabular(spark, sf), 0.3, 0.99, 6)


@query("greedy_policy", "state:l policy_action:l", q.W_T + _MODEL + _STEP
       + _q_sql(6) + """ SELECT state, first(option ORDER BY q DESC, option)
 AS policy_action FROM q6 WHERE rel > 0.3 GROUP BY state""")
def _(spark, sf):
    return po.greedy_policy(po.fitted_q(tabular(spark, sf), 0.3, 0.99, 6))


@query("q_grid_values", "run:s value:d", q.W_T + _MODEL + _STEP
       + _q_sql(4, 0.2) + _q_sql(4, 0.6, "p", "w") + " UNION ALL".join(
           f""" SELECT 'tau={tau},gamma=0.99' AS run, sum(v * n) / sum(n)
 AS value FROM (SELECT max(q) AS v, sum(n) AS n FROM {t}4 GROUP BY state)"""
           for tau, t in ((0.2, "q"), (0.6, "p"))))
def _(spark, sf):
    return po.q_grid(tabular(spark, sf), (0.2, 0.6), (0.99,), 4)


@query("q_grid", None)
def _(spark, sf):
    t = cut_lineage(tabular(spark, sf))
    return po.select_run(po.q_grid(t, (0.2, 0.3), (0.99,), 4))


def linear_rows(spark, sf) -> DataFrame:
    """Transitions with the measurement as the only feature."""
    def rows(scan, v):
        d = base(v, scan)
        d = tn.elapsed(tn.observed_decision(d, scan=scan), scan)
        d = tn.done_flag(tn.transition_reward(d, ADV, scan=scan), scan=scan)
        return scan.add(d, WITHIN, ["study_day"],
                        next_value=tn.lead("value")).withColumn(
            "not_done", 1.0 - F.col("done"))
    return on_visits(spark, sf, rows)


def _linear_sql(steps: int) -> str:
    """Steps from zero: regressions of reward plus discounted best score."""
    out = f""", {_DEC}, {_SPAN}, dn1 AS (SELECT *, max(CASE WHEN value IS NOT
 NULL AND dose IS NOT NULL THEN study_day END) OVER {q.K} AS ld FROM opt),
 dn AS (SELECT *, lead(CASE WHEN study_day = ld THEN 1 ELSE 0 END) OVER {q.WK}
 AS done, lead(study_day) OVER {q.WK} - study_day AS k, lead(value) OVER {q.WK}
 AS y FROM dn1), rd AS (SELECT a.trial, a.subjid, a.trajid, a.pv AS study_day,
 sum(CASE WHEN x BETWEEN 2 AND 3 THEN pow(0.99, d - pv - 1) ELSE 0.0 END)
 AS reward FROM (SELECT *, lag(visit_day) OVER (PARTITION BY trial, subjid,
 trajid ORDER BY d) AS pv FROM days) a WHERE pv IS NOT NULL GROUP BY ALL),
 r AS (SELECT option_ AS option, value AS x, y, reward, (1 - done)
 * pow(0.99, k) AS d FROM dn JOIN rd USING (trial, subjid, trajid, study_day)
 WHERE k IS NOT NULL AND option_ IS NOT NULL AND value IS NOT NULL AND y IS
 NOT NULL), l0 AS (SELECT DISTINCT option AS o, 0.0 AS w0, 0.0 AS w1 FROM r)"""
    for i in range(steps):
        out += f""", t{i} AS (SELECT option, x, any_value(reward)
 + any_value(d) * max(w0 + w1 * y) AS t FROM (SELECT *, row_number() OVER ()
 AS id FROM r), l{i} GROUP BY id, option, x), l{i + 1} AS (SELECT option AS o,
 regr_intercept(t, x) AS w0, regr_slope(t, x) AS w1 FROM t{i} GROUP BY 1)"""
    return out


@query("linear_q_steps", "option:l feature:s weight:d n:l", q.W_T
       + _linear_sql(3) + """, c AS (SELECT option, count(*) AS n FROM r
 GROUP BY 1) SELECT o AS option, 'intercept' AS feature, w0 AS weight, n FROM
 l3 JOIN c ON c.option = o UNION ALL SELECT o, 'value', w1, n FROM l3 JOIN c
 ON c.option = o""")
def _(spark, sf):
    rows = cut_lineage(li.q_rows(linear_rows(spark, sf), ["value"]))
    return li.q_passes(rows, ["value"], 3).table(spark)


@query("linear_q", None)
def _(spark, sf):
    """Learned on all state columns until it stays."""
    out, fitted = transitions(spark, sf)
    t, xs = cut_lineage(out), fitted.state_names()
    return li.linear_q(t, xs, behaviour=po.fit_behaviour(t, xs)).table(spark)


@query("behaviour_model", None)
def _(spark, sf):
    from trajspark.plans.evaluate import evaluate_behaviour
    out, fitted = transitions(spark, sf)
    t, xs = cut_lineage(out), fitted.state_names()
    model = po.fit_behaviour(t, xs)
    p = po.behaviour_probs(model, t, xs).withColumnRenamed("option", "y")
    return evaluate_behaviour(p)


# Probabilities and scores as whole numbers of the keys: given, not learned.
_GIVEN = f""", {_DEC}, {_SPAN}, rd AS (SELECT a.trial, a.subjid, a.trajid, a.pv
 AS study_day, sum(CASE WHEN x BETWEEN 2 AND 3 THEN pow(0.99, d - pv - 1) ELSE
 0.0 END) AS reward FROM (SELECT *, lag(visit_day) OVER (PARTITION BY trial,
 subjid, trajid ORDER BY d) AS pv FROM days) a WHERE pv IS NOT NULL GROUP BY
 ALL), gv AS (SELECT trial, subjid, trajid, study_day, option_ AS option,
 value, reward, list_transform(range(7), lambda a: 1 + (study_day * 3 + a * 5
 + subjid) % 7) AS n, list_transform(range(7), lambda a: ((subjid * 7
 + study_day * 3 + a * 5) % 11) / 2.0) AS s FROM opt JOIN rd USING (trial,
 subjid, trajid, study_day) WHERE option_ IS NOT NULL AND value IS NOT NULL),
 ga AS (SELECT *, list_transform(n, lambda x: x / list_sum(n)) AS p,
 list_transform(range(7), lambda a: CASE WHEN n[a + 1] / list_max(n) > 0.3
 THEN s[a + 1] ELSE -1e8 END) AS mq FROM gv), gb AS (SELECT *,
 list_transform(mq, lambda x: exp(x - list_max(mq))) AS e,
 list_position(mq, list_max(mq)) - 1 AS policy_action, CASE WHEN value <= 1.5
 THEN 5 WHEN value < 2 THEN 4 WHEN value <= 3 THEN 3 WHEN value < 5 THEN 2
 ELSE 1 END AS rule FROM ga), pp AS (SELECT trial, subjid, trajid, study_day,
 reward, policy_action, p[option + 1] AS behaviour_prob, e[option + 1]
 / list_sum(e) AS policy_prob, CAST(policy_action = option AS DOUBLE)
 AS policy_hard_prob, CAST(rule = option AS DOUBLE) AS threshold_prob FROM gb)"""
_PROBS = ["behaviour_prob", "policy_prob", "policy_hard_prob",
          "threshold_prob"]
POLICIES = ["policy", "policy_hard", "threshold"]


def given_probs(spark, sf) -> DataFrame:
    def rows(scan, v):
        d = tn.observed_decision(base(v, scan), scan=scan)
        return tn.transition_reward(d, ADV, scan=scan)
    d = on_visits(spark, sf, rows).filter(
        "option IS NOT NULL AND value IS NOT NULL AND reward IS NOT NULL")
    n = F.array(*[1 + (F.col("study_day") * 3 + 5 * a + F.col("subjid")) % 7
                  for a in range(7)])
    total = F.aggregate("__n", F.lit(0).cast("long"), lambda x, y: x + y)
    d = d.withColumn("__n", n.cast("array<bigint>")).withColumns({
        "p": F.transform("__n", lambda x: x / total),
        "q": F.array(*[((F.col("subjid") * 7 + F.col("study_day") * 3 + 5 * a)
                        % 11) / 2.0 for a in range(7)])})
    return li.policy_probs(d)


@query("policy_probs", "trial:s subjid:l trajid:l study_day:l policy_action:l "
       + " ".join(f"{c}:d" for c in _PROBS), q.W_T + _GIVEN
       + " SELECT * FROM pp")
def _(spark, sf):
    return given_probs(spark, sf)


def ratios(spark, sf, rows: DataFrame) -> DataFrame:
    return ev.wis_trajectories(
        rows, "behaviour_prob", {n: f"{n}_prob" for n in POLICIES},
        scan=scan_of(spark, sf))


@query("wis_ratios", "policy:s value:d", q.W_T + _GIVEN + f""", wt AS (SELECT
 {", ".join(f"product({n}_prob / behaviour_prob) AS {n}" for n in POLICIES)},
 sum(pow(0.99, study_day - a) * reward) AS value FROM (SELECT *, min(study_day)
 OVER {q.K} AS a FROM pp) GROUP BY trial, subjid, trajid) SELECT 'clinician'
 AS policy, avg(value) AS value FROM wt {" ".join(
     f"UNION ALL SELECT '{n}', sum({n} * value) / sum({n}) FROM wt"
     for n in POLICIES)}""")
def _(spark, sf):
    return ev.wis(ratios(spark, sf, given_probs(spark, sf)), POLICIES)


@query("evaluate_policy", None)
def _(spark, sf):
    from trajspark.plans.evaluate import learned_policy, evaluate_policy
    d = cut_lineage(pl.build_trajectories(V(spark, sf), EV(spark, sf),
                                          BL(spark, sf), PARAMS))
    scan = scan_of(spark, sf)
    rows, importance = learned_policy(d, PARAMS, min_length=1, scan=scan)
    return evaluate_policy(rows, "policy_action", ADV, importance=importance,
                           names=POLICIES, tests=True,
                           bootstrap=PARAMS.bootstrap, scan=scan)
