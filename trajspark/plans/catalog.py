"""Every operator as a query over the driver tables, with the same question
in SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark import params as P
from trajspark.functions import columns as fc
from trajspark.operators import evaluation as ev
from trajspark.operators import features as fe
from trajspark.operators import relational as rel
from trajspark.operators import trajectories as tr
from trajspark.operators import transitions as tn
from trajspark.operators.scan import PLAIN, by_key, choose_scan
from trajspark.params import VALUE_DOSE, Params
from trajspark.plans import pipeline as pl
from trajspark.plans import sqltext as q
from trajspark.sources import adapter

QUERIES: dict = {}
SQL: dict[str, str] = {}

KEYS = ["trial", "subjid"]
RAW = ["study_day", "seq"]
PARAMS = Params()
EVENTS = PARAMS.events_kept
VISIT = ("trial:s subjid:l study_day:l value:d dose:d value_type:s "
         "interrupt_flag:d seq:l")
BASE = ("trial:s subjid:l trajid:l study_day:l value:d dose:d death:l "
        "stroke:l major_bleed:l minor_bleed:l hem_stroke:l hosp:l sys_emb:l")
MERGED = BASE + " interrupt_flag:d rankin:d termination:s"
FULL = MERGED + (" sex:l age:l weight:d continent:s country:s smoke:s "
                 "diabetes:l")


def typed(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        c = F.col(name)
        if kind in q.DIGITS:
            c = F.round(c.cast("double"), q.DIGITS[kind]) + F.lit(0.0)
        else:
            c = c.cast({"l": "long", "s": "string"}[kind])
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, columns: str | None, sql: str | None = None):
    """Register a query; `sql` None means rows are checked by tests only."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df if columns is None else typed(df, columns)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = q.typed(sql, columns)
        return fn
    return register


V, EV, BL = adapter.visits, adapter.events, adapter.baseline


def with_flags(visits: DataFrame) -> DataFrame:
    return visits.withColumns({
        f: (F.col("seq") % m == r).cast("int")
        for f, (m, r) in q.FLAG_RULES.items()})


def base(visits: DataFrame, scan=PLAIN) -> DataFrame:
    """Observed visits, one row per day, cut at gaps."""
    rows = scan.cluster(visits.filter(F.col("value_type") == "Y"), ["subjid"])
    rows = with_flags(rows)
    rows = tr.collapse_days(rows, KEYS, ["value", "dose", *q.FLAG_RULES])
    return tr.split_at_gaps(rows, KEYS, scan=scan).drop("termination")


def on_visits(spark, sf, fn, *more) -> DataFrame:
    """Per-subject work on raw visits (and further tables)."""
    return by_key(fn, [V(spark, sf), *more], KEYS)


def on_base(spark, sf, fn) -> DataFrame:
    return on_visits(spark, sf, lambda scan, v: fn(scan, base(v, scan)))


def scan_of(spark, sf):
    """The scan for work that mixes subjects with whole-table steps."""
    return choose_scan([V(spark, sf)], KEYS)


def T(spark, sf) -> DataFrame:
    return on_base(spark, sf, lambda scan, d: d)


# Filters, unions and joins.

@query("trim_to_observed", VISIT, q.W_V + """SELECT * FROM (SELECT *,
 min(CASE WHEN value IS NOT NULL THEN study_day END) OVER k AS a,
 max(CASE WHEN value IS NOT NULL THEN study_day END) OVER k AS b FROM v
 WINDOW k AS (PARTITION BY trial, subjid)) WHERE study_day BETWEEN a AND b""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.trim_to_observed(v, scan=s))


@query("drop_outlier_subjects", VISIT, q.W_V + """SELECT * FROM v WHERE
 NOT EXISTS (SELECT 1 FROM v AS hi WHERE hi.trial = v.trial
 AND hi.subjid = v.subjid AND hi.dose >= 140)""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.drop_groups_with(
        v, KEYS, F.col("dose") >= 140, s))


@query("semi_join_subjects", "trial:s subjid:l event_name:s event_day:l",
       q.W_EV + """SELECT * FROM ev WHERE subjid IN (SELECT subjid FROM v
       WHERE value >= 4.5)""")
def _(spark, sf):
    return rel.keep_ids(EV(spark, sf), V(spark, sf).filter("value >= 4.5"),
                        "subjid")


@query("anti_join_subjects", "trial:s subjid:l event_name:s event_day:l",
       q.W_EV + """SELECT * FROM ev WHERE subjid NOT IN (SELECT subjid FROM v
       WHERE value >= 4.5)""")
def _(spark, sf):
    return rel.drop_ids(EV(spark, sf), V(spark, sf).filter("value >= 4.5"),
                        "subjid")


@query("union_trials", "trial:s subjid:l study_day:l value:d dose:d seq:l",
       q.W_V + """, u AS (SELECT trial, subjid, study_day, value, dose, seq
 FROM v WHERE trial IN ('ENGAGE', 'ROCKET_AF') UNION ALL SELECT trial, subjid, study_day,
 value, NULL, seq FROM v WHERE trial = 'RELY' UNION ALL SELECT trial, subjid,
 study_day, NULL, dose, seq FROM v WHERE trial = 'ARISTOTLE')
 SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS hi
 WHERE hi.trial = u.trial AND hi.subjid = u.subjid AND hi.dose >= 140)""")
def _(spark, sf):
    def union(scan, v):
        pick = lambda t, *c: v.filter(F.col("trial").isin(t)).select(*c)
        key = ["trial", "subjid", "study_day", "seq"]
        return pl.union_trials(
            pick(["ENGAGE", "ROCKET_AF"], *key, "value", "dose"),
            pick(["RELY"], *key, "value"),
            pick(["ARISTOTLE"], *key, "dose"), scan=scan)
    return on_visits(spark, sf, union)


@query("truncate_after", "trial:s subjid:l study_day:l seq:l", q.W_EV + """
 SELECT v.* FROM v LEFT JOIN (SELECT subjid, min(event_day) AS e FROM ev
 GROUP BY subjid) x ON v.subjid = x.subjid WHERE e IS NULL OR
 study_day <= e""")
def _(spark, sf):
    ends = EV(spark, sf).groupBy("subjid").agg(F.min("event_day").alias("e"))
    return rel.truncate_after(V(spark, sf), ends, "subjid", "study_day", "e")


@query("complete_cases", "subjid:l age:l weight:d", q.W_BL + """SELECT subjid,
 CASE WHEN age = '>89' THEN 90 ELSE CAST(age AS INT) END AS age, weight
 FROM bl WHERE weight IS NOT NULL""")
def _(spark, sf):
    b = BL(spark, sf).withColumn("age", fc.recode_capped("age", ">89", 90))
    return rel.complete_cases(b, ["age", "weight"], only_finite=False)


_LINKER = """lk AS (SELECT c_custkey AS subjid, c_nationkey * 1000
 + c_custkey % 1000 AS linked_id FROM customer WHERE c_custkey % 5 <> 0)"""


def linker(spark, sf) -> DataFrame:
    c = adapter.table(spark, sf, "customer")
    return c.filter("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("subjid"),
        (F.col("c_nationkey").cast("long") * 1000 + F.col("c_custkey") % 1000)
        .alias("linked_id"))


@query("link_subjects", "centre:l linked_id:l study_day:l value:d seq:l",
       q.W_V + f""", {_LINKER} SELECT linked_id // 1000 AS centre, linked_id,
 study_day, value, seq FROM v JOIN lk ON v.subjid = lk.subjid""")
def _(spark, sf):
    return rel.link_subjects(V(spark, sf), linker(spark, sf))


@query("link_events", "centre:l linked_id:l event_name:s event_day:l",
       q.W_EV + f""", {_LINKER} SELECT CASE WHEN length(CAST(linked_id AS
 VARCHAR)) > 3 THEN CAST(left(CAST(linked_id AS VARCHAR),
 length(CAST(linked_id AS VARCHAR)) - 3) AS BIGINT) END AS centre, linked_id,
 event_name, event_day FROM ev LEFT JOIN lk ON ev.subjid = lk.subjid""")
def _(spark, sf):
    out = rel.link_subjects(EV(spark, sf), linker(spark, sf), how="left")
    return out.withColumn("centre", fc.centre_id_text("linked_id"))


@query("right_join", "subjid:l trial:s trial_events:s event_name:s",
       q.W_EV + """, a AS (SELECT subjid, min(trial) AS trial FROM v
 WHERE value > 4 GROUP BY subjid) SELECT ev.subjid, a.trial,
 ev.trial AS trial_events, ev.event_name FROM a RIGHT JOIN ev
 ON a.subjid = ev.subjid""")
def _(spark, sf):
    a = V(spark, sf).filter("value > 4").groupBy("subjid").agg(
        F.min("trial").alias("trial"))
    return rel.right_join(a, EV(spark, sf), "subjid", "_events")


@query("outer_coalesce", "nation:l customers:l suppliers:l", """SELECT
 coalesce(a.n, b.n) AS nation, customers, suppliers FROM (SELECT c_nationkey
 AS n, count(*) AS customers FROM customer WHERE c_nationkey < 18 GROUP BY 1)
 a FULL JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier
 WHERE s_nationkey > 5 GROUP BY 1) b ON a.n = b.n""")
def _(spark, sf):
    c = adapter.table(spark, sf, "customer").filter("c_nationkey < 18")
    s = adapter.table(spark, sf, "supplier").filter("s_nationkey > 5")
    a = c.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers"))
    b = s.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("suppliers"))
    return rel.outer_coalesce(a, b, ["nation"])


@query("star_join", "subjid:l country:s centre:l n:l", q.W_V + """SELECT
 v.subjid, n_name AS country, c_nationkey AS centre, count(*) AS n FROM v
 LEFT JOIN customer ON v.subjid = c_custkey LEFT JOIN nation
 ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, sf):
    # Counting first keeps the fact side small before it meets the dimensions.
    per = rel.group_size(V(spark, sf), ["subjid"])
    c = adapter.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subjid"),
        F.col("c_nationkey").alias("centre"))
    n = adapter.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("centre"), F.col("n_name").alias("country"))
    return rel.star_join(per, [(c, "subjid"), (n, "centre")])


@query("join_all", "subjid:l visits:l events:l weight:d", q.W_EV
       + f""", {q.BL} SELECT a.subjid, visits, events, weight FROM (SELECT
 subjid, count(*) AS visits FROM v GROUP BY 1) a JOIN (SELECT subjid,
 count(*) AS events FROM ev GROUP BY 1) b USING (subjid) JOIN bl
 USING (subjid)""")
def _(spark, sf):
    return rel.join_all([
        rel.group_size(V(spark, sf), ["subjid"], "visits"),
        rel.group_size(EV(spark, sf), ["subjid"], "events"),
        BL(spark, sf)], "subjid")


@query("overlap_count", "shared:l", q.W_EV + """SELECT count(*) AS shared FROM
 (SELECT subjid FROM v WHERE value > 4.5 INTERSECT SELECT subjid FROM ev
 WHERE rankin >= 3)""")
def _(spark, sf):
    return rel.overlap_count(V(spark, sf).filter("value > 4.5"),
                             EV(spark, sf).filter("rankin >= 3"), "subjid")


# Column operators.

@query("event_indicators", "trial:s subjid:l event_day:l death:l stroke:l "
       "hem_stroke:l major_bleed:l minor_bleed:l hosp:l sys_emb:l "
       "cardio_death:l", q.W_EV + "SELECT trial, subjid, event_day, " +
       ", ".join(f"CASE WHEN event_name = '{n}' THEN 1 ELSE 0 END AS {f}"
                 for f, n in P.EVENT_NAMES.items()) + " FROM ev")
def _(spark, sf):
    return rel.indicators(EV(spark, sf), "event_name", P.EVENT_NAMES)


@query("dummies", "subjid:l AFRICA:l AMERICA:l ASIA:l EUROPE:l "
       "MIDDLE_EAST:l", q.W_BL + "SELECT subjid, " + ", ".join(
           f"CASE WHEN region = '{r}' THEN 1 ELSE 0 END AS "
           f"{r.replace(' ', '_')}" for r in
           ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
       + " FROM bl")
def _(spark, sf):
    out = rel.dummies(BL(spark, sf), "region")
    return out.withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST")


@query("recode_and_flags", "subjid:l age:l diabetes:l ever_smoked:l heavy:l "
       "centre:l label:s", q.W_BL + """SELECT subjid, CASE WHEN age = '>89'
 THEN 90 ELSE CAST(age AS INT) END AS age, CASE diabetes WHEN 'Y' THEN 1
 ELSE 0 END AS diabetes, CASE WHEN smoke IN ('CURRENT SMOKER',
 'FORMER SMOKER') THEN 1 ELSE 0 END AS ever_smoked, CASE WHEN coalesce(
 weight >= 100, FALSE) THEN 1 ELSE 0 END AS heavy, subjid // 1000 AS centre,
 concat_ws('.', subjid, sex) AS label FROM bl""")
def _(spark, sf):
    b = BL(spark, sf).withColumn("age", fc.recode_capped("age", ">89", 90))
    b = rel.yn_to_int(b, ["diabetes"])
    b = rel.flags(b, {
        "ever_smoked": F.col("smoke").isin("CURRENT SMOKER", "FORMER SMOKER"),
        "heavy": F.col("weight") >= 100})
    return b.withColumns({"centre": fc.centre_id("subjid"),
                          "label": fc.trajectory_label("subjid", "sex")})


def _cut_sql(c, bounds, labels):
    whens = " ".join(
        f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{lab}'"
        for lo, hi, lab in zip(bounds[:-1], bounds[1:], labels))
    return f"CASE {whens} END"


@query("binning", "seq:l dose_bin:s value_bin:s", q.W_V + f"""SELECT seq,
 {_cut_sql("dose", P.DOSE_BOUNDS, P.DOSE_LABELS)} AS dose_bin,
 CASE WHEN value < 1.5 THEN '< 1.5' WHEN value < 2 THEN '1.5 - 2'
 WHEN value <= 3 THEN '2 - 3' WHEN value <= 3.5 THEN '3 - 3.5'
 WHEN value > 3.5 THEN '> 3.5' END AS value_bin FROM v""")
def _(spark, sf):
    return V(spark, sf).select("seq", fe.dose_bin().alias("dose_bin"),
                               fc.value_bin("value").alias("value_bin"))


@query("clean_values", "seq:l dose:d value:d rounded:d capped:l discount:d",
       q.W_V + """SELECT seq, CASE WHEN dose % 0.5 <> 0 OR dose = 99 THEN NULL
 ELSE abs(dose) * 7 END AS dose, CASE WHEN value = 0 THEN NULL ELSE value END
 AS value, round_even(value / 3, 1) AS rounded, least(seq % 3, 1) AS capped,
 pow(0.99, seq % 30) AS discount FROM v""")
def _(spark, sf):
    d = F.col("dose")
    return V(spark, sf).select(
        "seq", (F.abs(fc.null_if("dose", (d % 0.5 != 0) | (d == 99))) * 7)
        .alias("dose"),
        fc.null_if("value", F.col("value") == 0).alias("value"),
        F.bround(F.col("value") / 3, 1).alias("rounded"),
        F.least(F.col("seq") % 3, F.lit(1)).alias("capped"),
        F.pow(F.lit(0.99), F.col("seq") % 30).alias("discount"))


@query("decode_text", "c_custkey:l name:s", """SELECT c_custkey, trim(c_name)
 AS name FROM customer""")
def _(spark, sf):
    c = adapter.table(spark, sf, "customer")
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")).cast("binary")
    return c.select("c_custkey", fc.decode_text(raw).alias("name"))


@query("replace_values", "subjid:l smoke:s", q.W_BL + """SELECT subjid,
 CASE smoke WHEN 'NEVER' THEN 'NO' WHEN 'FORMER SMOKER' THEN 'YES' ELSE smoke
 END AS smoke FROM bl""")
def _(spark, sf):
    return rel.replace_values(BL(spark, sf), "smoke",
                              {"NEVER": "NO", "FORMER SMOKER": "YES"})


@query("rule_policy", "seq:l factor:d code:l", q.W_V + """SELECT seq,
 CASE WHEN value <= 1.5 THEN 1.15 WHEN value < 2 THEN 1.1 WHEN value <= 3
 THEN 1.0 WHEN value < 5 THEN 0.9 WHEN value >= 5 THEN 0.85 ELSE 1.0 END
 AS factor, CASE WHEN value <= 1.5 THEN 5 WHEN value < 2 THEN 4
 WHEN value <= 3 THEN 3 WHEN value < 5 THEN 2 WHEN value >= 5 THEN 1 ELSE 0
 END AS code FROM v""")
def _(spark, sf):
    return V(spark, sf).select("seq", fc.rule_policy("value").alias("factor"),
                               fc.rule_policy_code("value").alias("code"))


@query("melt", "subjid:l name:s x:d", q.W_BL + """SELECT subjid, 'sex' AS name,
 CAST(sex AS DOUBLE) AS x FROM bl UNION ALL SELECT subjid, 'weight', weight
 FROM bl""")
def _(spark, sf):
    b = BL(spark, sf).withColumn("sex", F.col("sex").cast("double"))
    return rel.melt(b, ["subjid"], ["sex", "weight"], "name", "x")


@query("pivot", "trial:s Y:l N:l", q.W_V + """SELECT trial,
 count(*) FILTER (value_type = 'Y') AS Y, count(*) FILTER (value_type = 'N')
 AS N FROM v GROUP BY trial""")
def _(spark, sf):
    counts = rel.value_counts(V(spark, sf), ["trial", "value_type"])
    return rel.pivot(counts, ["trial"], "value_type", "n", ["Y", "N"])


@query("transpose", "metric:s ENGAGE:s RELY:s ROCKET_AF:s ARISTOTLE:s",
       q.W_V + """, s AS (SELECT trial, count(*) AS n, max(study_day) AS last
 FROM v GROUP BY trial), m AS (SELECT trial, 'n' AS metric, CAST(n AS VARCHAR)
 AS x FROM s UNION ALL SELECT trial, 'last', CAST(last AS VARCHAR) FROM s)
 SELECT metric, max(x) FILTER (trial = 'ENGAGE') AS ENGAGE,
 max(x) FILTER (trial = 'RELY') AS RELY, max(x) FILTER (trial = 'ROCKET_AF')
 AS ROCKET_AF, max(x) FILTER (trial = 'ARISTOTLE') AS ARISTOTLE FROM m
 GROUP BY metric""")
def _(spark, sf):
    s = V(spark, sf).groupBy("trial").agg(
        F.count(F.lit(1)).alias("n"), F.max("study_day").alias("last"))
    return rel.transpose(s, "trial",
                         ["ENGAGE", "RELY", "ROCKET_AF", "ARISTOTLE"])


# Aggregates.

@query("day_aggregate_events", "trial:s subjid:l study_day:l rankin:d "
       "death:l stroke:l major_bleed:l minor_bleed:l hem_stroke:l hosp:l "
       "sys_emb:l", q.upto("events").replace("merged AS", "merged0 AS")
       + "SELECT * FROM ed")
def _(spark, sf):
    e = rel.indicators(EV(spark, sf), "event_name", P.EVENT_NAMES)
    e = e.filter("event_day is not null").withColumn(
        "study_day", F.col("event_day")).withColumn(
        "rankin", fc.default_when("rankin", F.col("stroke") >= 1, 3.0))
    return tr.day_aggregate(e, EVENTS)


@query("collapse_days", "trial:s subjid:l study_day:l value:d dose:d",
       q.W_V + """SELECT trial, subjid, study_day, sum(value) AS value,
 sum(dose) AS dose FROM v GROUP BY ALL""")
def _(spark, sf):
    return tr.collapse_days(V(spark, sf), KEYS, ["value", "dose"])


@query("collapse_days_mean", "trial:s subjid:l study_day:l value:d dose:d",
       q.W_V + """SELECT trial, subjid, study_day, avg(value) AS value,
 avg(dose) AS dose FROM v GROUP BY ALL""")
def _(spark, sf):
    return tr.collapse_days(V(spark, sf), KEYS, ["value", "dose"], "avg")


@query("n_distinct", "trial:s n:l", q.W_V + """SELECT trial,
 count(DISTINCT subjid) AS n FROM v GROUP BY trial""")
def _(spark, sf):
    return rel.n_distinct(V(spark, sf), ["trial"], "subjid")


@query("describe_by", "trial:s n:l min:d q25:d q50:d q75:d max:d mean:d",
       q.W_V + """SELECT trial, count(value) AS n, min(value) AS "min",
 quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
 quantile_cont(value, 0.75) AS q75, max(value) AS "max", avg(value) AS mean
 FROM v GROUP BY trial""")
def _(spark, sf):
    return rel.describe_by(V(spark, sf), ["trial"], "value")


@query("median_range", "median_range:d", q.W_V + """SELECT median(s)
 AS median_range FROM (SELECT max(study_day) - min(study_day) AS s FROM v
 GROUP BY trial, subjid)""")
def _(spark, sf):
    return rel.median_range(V(spark, sf), KEYS, "study_day")


@query("share_within", "trial:s event_name:s n:l share:d", q.W_EV + """SELECT
 *, n / sum(n) OVER (PARTITION BY trial) AS share FROM (SELECT trial,
 event_name, count(*) AS n FROM ev GROUP BY ALL)""")
def _(spark, sf):
    return rel.share_within(EV(spark, sf), ["trial"], ["event_name"])


@query("mean_sd", "trial:s mean:d sd:d", q.W_V + """SELECT trial, avg(dose)
 AS mean, stddev_samp(dose) AS sd FROM v GROUP BY trial""")
def _(spark, sf):
    return rel.mean_sd(V(spark, sf), ["trial"], "dose")


@query("pct_by", "trial:s interrupt_flag:d", q.W_V + """SELECT trial,
 avg(interrupt_flag) * 100 AS interrupt_flag FROM v GROUP BY trial""")
def _(spark, sf):
    return rel.pct_by(V(spark, sf), ["trial"], ["interrupt_flag"])


@query("null_report", "trial:s value_nulls:l dose_nulls:l value_groups:l "
       "dose_groups:l", q.W_V + """SELECT trial, sum(a) AS value_nulls, sum(b)
 AS dose_nulls, count(*) FILTER (a > 0) AS value_groups, count(*) FILTER
 (b > 0) AS dose_groups FROM (SELECT trial, subjid, count(*) FILTER (value IS
 NULL) AS a, count(*) FILTER (dose IS NULL) AS b FROM v GROUP BY ALL)
 GROUP BY trial""")
def _(spark, sf):
    return rel.null_report(V(spark, sf), ["trial"], ["subjid"],
                           ["value", "dose"])


@query("weighted_mean", "trial:s wm:d", q.W_V + """SELECT trial,
 sum(value * dose) / sum(dose) FILTER (value IS NOT NULL) AS wm FROM v
 WHERE value IS NOT NULL GROUP BY trial""")
def _(spark, sf):
    rows = V(spark, sf).filter("value is not null")
    return rows.groupBy("trial").agg(
        rel.weighted_mean("value", "dose").alias("wm"))


@query("product_by", "trial:s subjid:l share:d", q.W_V + """SELECT trial,
 subjid, product(share) AS share FROM (SELECT *, 1 - 1.0 / (2 + seq % 7)
 AS share FROM v) GROUP BY ALL""")
def _(spark, sf):
    rows = V(spark, sf).withColumn(
        "share", 1 - F.lit(1.0) / (2 + F.col("seq") % 7))
    return rel.product_by(rows, KEYS, ["share"])


@query("neg_corr", "trial:s r:d", q.W_V + """SELECT trial, -corr(value, dose)
 AS r FROM v GROUP BY trial""")
def _(spark, sf):
    return V(spark, sf).groupBy("trial").agg(
        rel.neg_corr("value", "dose").alias("r"))


@query("above_percentile", "c_custkey:l high:l", """SELECT c_custkey,
 CASE WHEN c_acctbal > (SELECT quantile_cont(c_acctbal, 0.55) FROM customer)
 THEN 1 ELSE 0 END AS high FROM customer""")
def _(spark, sf):
    return rel.above_percentile(adapter.table(spark, sf, "customer"),
                                "c_acctbal", 0.55, "high")


@query("first_record", "trial:s subjid:l value:d dose:d", q.W_V + """SELECT
 trial, subjid, first(value ORDER BY study_day, seq) FILTER (value IS NOT
 NULL) AS value, first(dose ORDER BY study_day, seq) FILTER (dose IS NOT NULL)
 AS dose FROM v GROUP BY ALL""")
def _(spark, sf):
    rows = V(spark, sf).select(*KEYS, "study_day", "seq", "value", "dose")
    return rel.first_record(rows, KEYS, RAW)


@query("first_row", VISIT, q.W_V + """SELECT * FROM v QUALIFY row_number()
 OVER (PARTITION BY trial, subjid ORDER BY study_day, seq) = 1""")
def _(spark, sf):
    return rel.dedupe(V(spark, sf), KEYS, RAW, "first")


@query("last_row", VISIT, q.W_V + """SELECT * FROM v QUALIFY row_number()
 OVER (PARTITION BY trial, subjid ORDER BY study_day DESC, seq DESC) = 1""")
def _(spark, sf):
    return rel.dedupe(V(spark, sf), KEYS, RAW, "last")


@query("dedupe_rows", "trial:s event_name:s rankin:d", q.W_EV + """SELECT
 DISTINCT trial, event_name, rankin FROM ev""")
def _(spark, sf):
    return rel.dedupe(EV(spark, sf).select("trial", "event_name", "rankin"))


_MEDS = """meds AS (SELECT o_custkey AS subjid, CAST(o_orderkey % 3 = 0 AS
 INT) AS beta_blocker, CAST(o_orderkey % 4 = 0 AS INT) AS asa,
 CAST(o_orderkey % 5 = 0 AS INT) AS ace, CAST(o_orderkey % 7 = 0 AS INT)
 AS statin FROM orders), med AS (SELECT subjid, least(sum(beta_blocker), 1)
 AS beta_blocker, least(sum(asa), 1) AS asa, least(sum(ace), 1) AS ace,
 least(sum(statin), 1) AS statin FROM meds GROUP BY subjid)"""
MED_COLS = ["beta_blocker", "asa", "ace", "statin"]


def meds(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    rows = adapter.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subjid"),
        *[(k % m == 0).cast("int").alias(c)
          for c, m in zip(MED_COLS, (3, 4, 5, 7))])
    return rel.any_medication(rows, "subjid", MED_COLS)


@query("any_medication", "subjid:l beta_blocker:l asa:l ace:l statin:l",
       f"WITH {_MEDS} SELECT * FROM med")
def _(spark, sf):
    return meds(spark, sf)


@query("any_event_by_trajectory", "trial:s subjid:l trajid:l stroke:l "
       "hosp:l", q.W_T + """SELECT trial, subjid, trajid, CAST(max(stroke) > 0
 AS INT) AS stroke, CAST(max(hosp) > 0 AS INT) AS hosp FROM traj
 GROUP BY ALL""")
def _(spark, sf):
    return rel.any_by(T(spark, sf), [*KEYS, "trajid"], ["stroke", "hosp"])


@query("event_rates", "trial:s subjects:l years:d stroke:l major_bleed:l "
       "stroke_per_subject:d major_bleed_per_subject:d stroke_per_100y:d "
       "major_bleed_per_100y:d", q.W_T + """, s AS (SELECT trial, subjid,
 trajid, max(study_day) - min(study_day) AS d, sum(stroke) AS stroke,
 sum(major_bleed) AS major_bleed FROM traj GROUP BY ALL), a AS (SELECT trial,
 count(DISTINCT subjid) AS subjects, sum(d) / 365.25 AS years, sum(stroke)
 AS stroke, sum(major_bleed) AS major_bleed FROM s GROUP BY trial)
 SELECT *, stroke / subjects AS stroke_per_subject, major_bleed / subjects
 AS major_bleed_per_subject, stroke * 100 / years AS stroke_per_100y,
 major_bleed * 100 / years AS major_bleed_per_100y FROM a""")
def _(spark, sf):
    return rel.event_rates(T(spark, sf), ["trial"], "subjid",
                           ["stroke", "major_bleed"], ["trajid"], "study_day")


@query("ordinal_cutpoints", "code:l cutpoint:d", q.W_V + """, c AS (SELECT
 seq % 7 AS code, count(*) AS n FROM v WHERE value > 2 GROUP BY 1), p AS
 (SELECT code, sum(n) OVER (ORDER BY code) / sum(n) OVER () AS p FROM c)
 SELECT code, ln(p / (1 - p)) AS cutpoint FROM p WHERE p < 1""")
def _(spark, sf):
    rows = V(spark, sf).filter("value > 2").withColumn(
        "code", F.col("seq") % 7)
    return rel.ordinal_cutpoints(rows, "code")


@query("mean_count", "trial:s value_mean:d value_count:l dose_mean:d "
       "dose_count:l", q.W_V + """SELECT trial, avg(value) AS value_mean,
 count(value) AS value_count, avg(dose) AS dose_mean, count(dose)
 AS dose_count FROM v GROUP BY trial""")
def _(spark, sf):
    return rel.mean_count(V(spark, sf), ["trial"], ["value", "dose"])


@query("with_group_mean", "subjid:l centre:l centre_weight:d", q.W_BL +
       """SELECT subjid, subjid // 100 AS centre, avg(weight) OVER (PARTITION
 BY subjid // 100) AS centre_weight FROM bl""")
def _(spark, sf):
    b = BL(spark, sf).withColumn(
        "centre", F.floor(F.col("subjid") / 100).cast("long"))
    return rel.with_group_mean(b, "centre", "weight", "centre_weight")


# All trials and events, and one of each that has no rows.
_GRID = {"trial": ["ENGAGE", "ROCKET_AF", "RELY", "ARISTOTLE", "NONE"],
         "event_name": [*P.EVENT_NAMES.values(), "Never"]}


@query("complete_grid", "trial:s event_name:s n:l", q.W_EV + f"""SELECT
 t.trial, e.event_name, coalesce(c.n, 0) AS n FROM (SELECT unnest(
 {_GRID["trial"]}) AS trial) t CROSS JOIN (SELECT unnest({_GRID["event_name"]})
 AS event_name) e LEFT JOIN (SELECT trial, event_name, count(*) AS n FROM ev
 GROUP BY ALL) c ON t.trial = c.trial AND e.event_name = c.event_name""")
def _(spark, sf):
    counts = rel.value_counts(EV(spark, sf), ["trial", "event_name"])
    return rel.complete_grid(counts, _GRID)


@query("average_rank", "trial:s value:d n:l rank:d", q.W_V + """, r AS
 (SELECT trial, value, rank() OVER (PARTITION BY trial ORDER BY value)
 + (count(*) OVER (PARTITION BY trial, value) - 1) / 2.0 AS rank FROM v
 WHERE value IS NOT NULL) SELECT trial, value, count(*) AS n, max(rank)
 AS rank FROM r GROUP BY trial, value""")
def _(spark, sf):
    return rel.average_rank(V(spark, sf).filter("value is not null"),
                            "value", ["trial"])


@query("best_run", "run:s iteration:l score:d", """, """.strip(", ") + """
 SELECT event_type AS run, user_id AS iteration, score FROM (SELECT
 event_type, user_id, avg(value) AS score FROM events GROUP BY ALL)
 WHERE user_id >= 9 ORDER BY score DESC, run, iteration LIMIT 1""")
def _(spark, sf):
    runs = adapter.table(spark, sf, "events").groupBy(
        F.col("event_type").alias("run"),
        F.col("user_id").alias("iteration")).agg(
        F.avg("value").alias("score"))
    return rel.best_run(runs, "score", "max", 10)


# Ordered columns.

_PREV = "(PARTITION BY trial, subjid ORDER BY study_day, seq " \
    "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
_FWD = "(PARTITION BY trial, subjid ORDER BY study_day, seq " \
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_UPTO = "(PARTITION BY trial, subjid ORDER BY study_day, seq " \
    "ROWS UNBOUNDED PRECEDING)"


@query("rolling_prev3_dose", "seq:l weekly:d", q.W_V + f"""SELECT seq,
 7 * avg(dose) OVER {_PREV} AS weekly FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.trailing_mean(
        v, KEYS, RAW, "dose", "weekly", scan=s))


@query("trailing_count", "seq:l entries:l", q.W_V + f"""SELECT seq,
 count(dose) OVER {_PREV} AS entries FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.trailing_count(
        v, KEYS, RAW, "dose", "entries", scan=s))


@query("fill_backward", "seq:l dose:d", q.W_V + f"""SELECT seq,
 first_value(dose IGNORE NULLS) OVER {_FWD} AS dose FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.fill_backward(
        v, KEYS, RAW, ["dose"], s))


@query("fill_forward", "seq:l dose:d value:d", q.W_V + f"""SELECT seq,
 last_value(dose IGNORE NULLS) OVER {_UPTO} AS dose,
 last_value(value IGNORE NULLS) OVER {_UPTO} AS value FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.fill_forward(
        v, KEYS, RAW, ["dose", "value"], s))


@query("fill_distance", "seq:l gap:l", q.W_V + f"""SELECT seq, first_value(
 CASE WHEN dose IS NOT NULL THEN study_day END IGNORE NULLS) OVER {_FWD}
 - study_day AS gap FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.fill_distance(
        v, KEYS, RAW, "dose", "gap", s))


@query("neighbour_zero", "seq:l near:l", q.W_V + """SELECT seq,
 CAST(coalesce(lag(dose) OVER w = 0, FALSE) OR coalesce(lead(dose) OVER w = 0,
 FALSE) AS INT) AS near FROM v WINDOW w AS (PARTITION BY trial, subjid
 ORDER BY study_day, seq)""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.neighbour_zero(
        v, KEYS, RAW, "dose", "near", s))


@query("remaining_count", "seq:l left_over:l", q.W_V + f"""SELECT seq,
 count(value) OVER {_FWD} AS left_over FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.remaining_count(
        v, KEYS, RAW, "value", "left_over", s))


@query("gap_days", "seq:l days:l", q.W_V + """SELECT seq, coalesce(study_day -
 lag(study_day) OVER (PARTITION BY trial, subjid ORDER BY study_day, seq), 0)
 AS days FROM v""")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.gap(v, KEYS, RAW, "days", s))


@query("duration", "trial:s subjid:l study_day:l duration:l", q.W_T
       + f"""SELECT trial, subjid, study_day, coalesce(study_day -
 lag(study_day) OVER {q.WS}, study_day) AS duration FROM traj""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: fe.duration(d, scan=s))


_PV = ", ".join(
    "coalesce(" + ", ".join(f"lag(value, {j}) OVER {q.WS}"
                            for j in range(i, 0, -1)) + f", value) AS "
    f"value_prev_{i}" for i in range(1, 5))


@query("prev_values", "trial:s subjid:l study_day:l value_prev_1:d "
       "value_prev_2:d value_prev_3:d value_prev_4:d",
       q.W_T + f"SELECT trial, subjid, study_day, {_PV} FROM traj")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: fe.prev_values(d, "value", scan=s))


@query("crossed_flags", "trial:s subjid:l study_day:l prev_1_crossed:l "
       "prev_2_crossed:l prev_3_crossed:l prev_4_crossed:l", q.W_T
       + "SELECT trial, subjid, study_day, " + ", ".join(
           f"CAST(coalesce(lag(trajid, {i}) OVER {q.WS}, 0) <> trajid AS INT)"
           f" AS prev_{i}_crossed" for i in range(1, 5)) + " FROM traj")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: fe.crossed_flags(d, scan=s))


@query("ever_event", "trial:s subjid:l study_day:l stroke_flag:l "
       "hosp_flag:l", q.W_T + f"""SELECT trial, subjid, study_day,
 least(sum(stroke) OVER {q.WS}, 1) AS stroke_flag, least(sum(hosp) OVER
 {q.WS}, 1) AS hosp_flag FROM traj""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: fe.ever_event(
        d, ["stroke", "hosp"], scan=s))


# Trajectories.

@query("split_at_gaps", BASE, q.W_T + "SELECT * FROM traj")
def _(spark, sf):
    return T(spark, sf)


@query("split_at_flag", VISIT + " trajid:l termination:s", q.W_V
       + ", v2 AS (SELECT *, CAST(NULL AS VARCHAR) AS termination FROM v), "
       + q.split_flag("v2", "cut_", "interrupt_flag <> 0 OR value IS NULL",
                      "STOP", "study_day, seq", q._VCOLS, observed=True)
       + " SELECT * FROM cut_")
def _(spark, sf):
    return on_visits(spark, sf, lambda s, v: tr.split_at_flag(
        v.withColumn("stop", (F.col("interrupt_flag") != 0)
                     | F.col("value").isNull()),
        "stop", "STOP", KEYS, RAW, "value_type", s))


_TC = "trial, subjid, study_day, value, dose, death, stroke, major_bleed, " \
    "minor_bleed, hem_stroke, hosp, sys_emb"


@query("split_at_flag_nested", BASE + " termination:s", q.W_T
       + ", t2 AS (SELECT *, CAST(NULL AS VARCHAR) AS termination "
         "FROM traj), " + q.split_flag(
             "t2", "cut_", "value > 4", "HIGH", "study_day", _TC,
             nested=True) + " SELECT * FROM cut_")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.split_at_flag(
        d.withColumn("high", F.col("value") > 4), "high", "HIGH", scan=s))


_STEP = lambda step: (lambda spark, sf: pl.build_trajectories(
    V(spark, sf), EV(spark, sf), BL(spark, sf), PARAMS, upto=step))
_VT = VISIT + " trajid:l termination:s"


def _preset(fn):
    def run(spark, sf):
        b = pl.complete_baseline(BL(spark, sf))
        v = V(spark, sf).filter("study_day >= 0").join(
            b.select("subjid"), "subjid", "left_semi")
        return by_key(lambda s, d: fn(pl.mark_trial_end(d, s), s), [v], KEYS)
    return run


query("preset_daily", _VT, q.upto("daily") + "SELECT * FROM daily")(
    _preset(pl.preset_daily_dose))
query("preset_avg", _VT, q.upto("avg") + "SELECT * FROM avg_dose")(
    _preset(pl.preset_avg_dose))
query("preset_weekly", _VT, q.upto("weekly") + "SELECT * FROM weekly")(
    _preset(pl.preset_weekly_dose))
query("clean_trials", _VT, q.computed_once(q.upto("union"))
      + "SELECT * FROM un")(_STEP("union"))
query("merge_events", MERGED, q.upto("events") + "SELECT * FROM merged")(
    _STEP("events"))
query("split_at_events", MERGED, q.upto("split_events")
      + "SELECT * FROM ses")(_STEP("split_events"))
query("impute", MERGED, q.upto("impute") + "SELECT * FROM imp")(
    _STEP("impute"))
query("pipeline_gaps", MERGED, q.upto("split_gaps") + "SELECT * FROM sgs")(
    _STEP("split_gaps"))
query("build_trajectories", FULL, q.upto("full") + "SELECT * FROM fulltab")(
    lambda spark, sf: pl.build_trajectories(V(spark, sf), EV(spark, sf),
                                            BL(spark, sf), PARAMS))


@query("merge_baseline", "trial:s subjid:l study_day:l seq:l sex:l weight:d "
       "diabetes:l smoke:s", q.W_V + f""", {q.BL} SELECT trial, v.subjid,
 study_day, seq, sex, weight, CASE diabetes WHEN 'Y' THEN 1 ELSE 0 END
 AS diabetes, smoke FROM v LEFT JOIN bl ON v.subjid = bl.subjid""")
def _(spark, sf):
    return tr.merge_baseline(V(spark, sf), BL(spark, sf),
                             ["sex", "weight", "diabetes", "smoke"],
                             yes_no_cols=["diabetes"])


@query("first_event_between", "trial:s subjid:l study_day:l value:d",
       q.W_T + f"""SELECT trial, subjid, study_day, value FROM (SELECT *,
 lag(value IS NOT NULL) OVER {q.WS} AS pm FROM traj) WHERE value IS NOT NULL
 OR coalesce(pm, FALSE)""")
def _(spark, sf):
    return on_base(spark, sf,
                   lambda s, d: tr.first_event_between(d, scan=s))


@query("drop_far_events", "trial:s subjid:l study_day:l value:d", q.W_T
       + f"""SELECT trial, subjid, study_day, value FROM (SELECT *,
 study_day - lag(study_day) OVER {q.WS} AS gp FROM traj) WHERE NOT (value IS
 NULL AND death + stroke + major_bleed + minor_bleed + hem_stroke + hosp
 + sys_emb > 0 AND coalesce(gp, 0) > 30)""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.drop_far_events(
        d, EVENTS, max_gap=30, scan=s))


@query("drop_short", BASE, q.W_T + f"""SELECT * REPLACE (dense_rank() OVER
 (PARTITION BY trial, subjid ORDER BY trajid) - 1 AS trajid) FROM (SELECT *,
 count(*) OVER {q.K} AS n FROM traj) WHERE n >= 3""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.drop_short(d, min_rows=3,
                                                         scan=s))


@query("min_observed", BASE, q.W_T + f"""SELECT * FROM (SELECT *,
 count(value) OVER {q.K} AS n FROM traj) WHERE n > 2""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.min_observed(d, n=2, scan=s))


@query("drop_incomplete_events", BASE, q.W_T + f"""SELECT * FROM (SELECT *,
 max(study_day) OVER {q.K} AS ld FROM traj) WHERE NOT (study_day <> ld
 AND minor_bleed > 0 AND (value IS NULL OR dose IS NULL))""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.drop_incomplete_events(
        d, ["minor_bleed"], scan=s))


@query("cut_unintuitive", BASE + " termination:s", q.W_T + f""", c1 AS (SELECT
 *, lead(dose) OVER {q.WK} AS nd FROM traj), c2 AS (SELECT *, CASE WHEN dose
 <> 0 THEN coalesce(nd / dose, 1.0) WHEN dose = 0 AND nd > 0 THEN 1e300
 ELSE 1.0 END AS ch FROM c1), c3 AS (SELECT *, coalesce(lag(ch) OVER {q.WK},
 1.0) AS pch, CAST(NULL AS VARCHAR) AS termination FROM c2), """
       + q.split_flag("c3", "cut_", "(value > 3 AND ch > 1 AND pch > 0.8) OR "
                      "(value < 2 AND ch < 1 AND pch < 1.2)",
                      "UNINTUITIVE_DECISION", "study_day", _TC, nested=True)
       + " SELECT * FROM cut_")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.cut_unintuitive(d, scan=s))


@query("split_subjects", "trial:s subjid:l study_day:l split:s", q.W_T + """,
 ids AS (SELECT DISTINCT subjid, ('0x' || substr(md5('42|' || subjid), 1, 8))
 ::BIGINT AS h FROM traj WHERE trial = 'ARISTOTLE'), r AS (SELECT subjid,
 row_number() OVER (ORDER BY h, subjid) <= floor(0.2 * count(*) OVER ())
 AS val FROM ids) SELECT trial, traj.subjid, study_day, CASE WHEN
 trial = 'RELY' THEN 'test' WHEN val THEN 'val' ELSE 'train' END AS split
 FROM traj LEFT JOIN r ON traj.subjid = r.subjid""")
def _(spark, sf):
    return tr.split_subjects(T(spark, sf), "RELY", "ARISTOTLE")


_SPAN = f"""sp1 AS (SELECT *, lead(study_day) OVER {q.WK} AS nd,
 last_value(CASE WHEN value IS NOT NULL THEN study_day END IGNORE NULLS) OVER
 (PARTITION BY trial, subjid, trajid ORDER BY study_day ROWS UNBOUNDED
 PRECEDING) AS d0, last_value(value IGNORE NULLS) OVER (PARTITION BY trial,
 subjid, trajid ORDER BY study_day ROWS UNBOUNDED PRECEDING) AS v0,
 first_value(CASE WHEN value IS NOT NULL THEN study_day END IGNORE NULLS)
 OVER (PARTITION BY trial, subjid, trajid ORDER BY study_day ROWS BETWEEN
 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS d1, first_value(value IGNORE NULLS)
 OVER (PARTITION BY trial, subjid, trajid ORDER BY study_day ROWS BETWEEN
 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS v1 FROM traj),
 sp2 AS (SELECT *, CASE WHEN v0 IS NOT NULL THEN coalesce((v1 - v0)
 / (d1 - d0), 0.0) END AS sl FROM sp1),
 days AS (SELECT trial, subjid, trajid, study_day AS visit_day, nd, d, CASE
 WHEN d = study_day AND value IS NOT NULL THEN value WHEN d = d1 THEN v1 ELSE
 sl * (d - d0) + v0 END AS x FROM (SELECT *, unnest(range(study_day,
 coalesce(nd, study_day + 1))) AS d FROM sp2))"""


@query("interpolate_daily", "trial:s subjid:l trajid:l study_day:l value:e",
       q.W_T + f""", {_SPAN} SELECT trial, subjid, trajid, d AS study_day,
 x AS value FROM days""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.interpolate_daily(d, scan=s))


@query("time_in_range", "trial:s subjid:l trajid:l ttr:d length:l", q.W_T
       + f""", {_SPAN} SELECT trial, subjid, trajid, avg(CASE WHEN x BETWEEN 2
 AND 3 THEN 1.0 ELSE 0.0 END) AS ttr, max(d) - min(d) AS length FROM days
 GROUP BY ALL""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tr.time_in_range(d, scan=s))


@query("trajectory_stats", "trial:s n:l min:d q25:d q50:d q75:d max:d mean:d",
       q.W_T + """SELECT trial, count(*) AS n, min(len) AS "min",
 quantile_cont(len, 0.25) AS q25, quantile_cont(len, 0.5) AS q50,
 quantile_cont(len, 0.75) AS q75, max(len) AS "max", avg(len) AS mean FROM
 (SELECT trial, max(study_day) - min(study_day) AS len FROM traj
 GROUP BY trial, subjid, trajid) GROUP BY trial""")
def _(spark, sf):
    return rel.describe_by(tr.trajectory_stats(T(spark, sf)), ["trial"],
                           "length")


@query("sessionise_events", "user_id:l session:l events:l start:s total:d",
       """WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w)
 > 21600 THEN 1 ELSE 0 END AS cut_ FROM events WINDOW w AS (PARTITION BY
 user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(cut_) OVER (PARTITION
 BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id,
 session, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S')
 AS start, sum(value) AS total FROM s GROUP BY user_id, session""")
def _(spark, sf):
    from trajspark.streaming.sessions import sessions
    out = sessions(adapter.table(spark, sf, "events"), "user_id", "ts",
                   hours=6)
    return out.withColumn("start", F.date_format("start",
                                                 "yyyy-MM-dd HH:mm:ss"))


# Features and transitions.

def _uniform_sql(rows: str) -> str:
    return f"""h AS (SELECT x, count(*) AS n FROM ({rows}) WHERE x IS NOT NULL
 GROUP BY x), hc AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto FROM h),
 tot AS (SELECT sum(n) AS total, count(*) AS d FROM h),
 refs AS (SELECT i, i / (d - 1.0) AS r, i / (d - 1.0) * (total - 1) AS at_
 FROM (SELECT total, d, unnest(range(d)) AS i FROM tot)),
 qs AS (SELECT i, r, (SELECT min(x) FROM hc WHERE upto > floor(at_)) AS lo,
 (SELECT min(x) FROM hc, tot WHERE upto > least(floor(at_) + 1, total - 1))
 AS hi, at_ - floor(at_) AS f FROM refs),
 qt AS (SELECT i, r, lo + f * (hi - lo) AS qv FROM qs),
 fw AS (SELECT h.x, max(i) AS j FROM h JOIN qt ON qv <= h.x GROUP BY h.x),
 bw AS (SELECT h.x, min(i) AS j FROM h JOIN qt ON qv >= h.x GROUP BY h.x),
 um AS (SELECT h.x, CASE WHEN h.x = (SELECT max(qv) FROM qt) THEN 1.0
 WHEN h.x = (SELECT min(qv) FROM qt) THEN 0.0 ELSE 0.5 * (
 a.r + coalesce((h.x - a.qv) / nullif(a2.qv - a.qv, 0) * (a2.r - a.r), 0)
 + b.r - coalesce((b.qv - h.x) / nullif(b.qv - b2.qv, 0) * (b.r - b2.r), 0))
 END AS u FROM h JOIN fw ON fw.x = h.x JOIN qt a ON a.i = fw.j
 LEFT JOIN qt a2 ON a2.i = fw.j + 1 JOIN bw ON bw.x = h.x
 JOIN qt b ON b.i = bw.j LEFT JOIN qt b2 ON b2.i = bw.j - 1)"""


@query("quantile_uniform", "trial:s subjid:l study_day:l u:d", q.W_T
       + ", " + _uniform_sql("SELECT round_even(value, 1) AS x FROM traj")
       + """ SELECT trial, subjid, study_day, u FROM traj LEFT JOIN um
 ON um.x = round_even(value, 1)""")
def _(spark, sf):
    d = T(spark, sf).withColumn("value", F.bround("value", 1))
    return fe.QuantileUniform("value").fit(d).transform(d, "u")


@query("quantile_continuous", "event_id:l u:d", """
 WITH h AS (SELECT value AS x, count(*) AS n FROM events WHERE value IS NOT
 NULL GROUP BY value), hc AS (SELECT x, sum(n) OVER (ORDER BY x) AS upto FROM h),
 tot AS (SELECT sum(n) - 1 AS t, count(*) - 1 AS m FROM h),
 refs AS (SELECT i, i * t // m AS low, i * t % m / m AS f, t FROM (SELECT m, t,
 unnest(range(m + 1)) AS i FROM tot)),
 qs AS (SELECT i, f, a.x AS lo, low, t FROM refs ASOF JOIN hc a ON low + 1 <=
 a.upto), qt AS (SELECT i, lo + f * (b.x - lo) AS qv FROM (SELECT *, least(low
 + 2, t + 1) AS up FROM qs) ASOF JOIN hc b ON up <= b.upto),
 kn AS (SELECT qv, min(i) AS lo, max(i) AS hi FROM qt GROUP BY qv),
 um AS (SELECT h.x, CASE WHEN h.x = a.qv AND a.lo = 0 THEN 0.0 WHEN b.qv IS
 NULL THEN 1.0 WHEN h.x = a.qv THEN (a.lo + a.hi) / 2.0 / m ELSE (a.hi + (h.x
 - a.qv) / (b.qv - a.qv) * (b.lo - a.hi)) / m END AS u FROM h ASOF JOIN kn a
 ON h.x >= a.qv ASOF LEFT JOIN kn b ON h.x < b.qv, tot)
 SELECT event_id, u FROM events LEFT JOIN um ON um.x = events.value""")
def _(spark, sf):
    d = adapter.table(spark, sf, "events")
    return fe.QuantileUniform("value").fit(d).transform(d, "u")


@query("min_max", "trial:s subjid:l study_day:l value:d dose:d", q.W_T + """
 SELECT trial, subjid, study_day, (value - min(value) OVER ())
 / (max(value) OVER () - min(value) OVER ()) AS value,
 (dose - min(dose) OVER ()) / (max(dose) OVER () - min(dose) OVER ()) AS dose
 FROM traj""")
def _(spark, sf):
    d = T(spark, sf)
    return fe.MinMax(("value", "dose")).fit(d).transform(d)


@query("one_hot", "subjid:l region_AMERICA:l region_ASIA:l region_EUROPE:l "
       "region_MIDDLE_EAST:l smoke_FORMER_SMOKER:l smoke_NEVER:l", q.W_BL
       + "SELECT subjid, " + ", ".join(
           f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS "
           f"{c}_{v.replace(' ', '_')}" for c, v in (
               ("region", "AMERICA"), ("region", "ASIA"),
               ("region", "EUROPE"), ("region", "MIDDLE EAST"),
               ("smoke", "FORMER SMOKER"), ("smoke", "NEVER")))
       + " FROM bl")
def _(spark, sf):
    b = BL(spark, sf)
    return fe.OneHotDropFirst(("region", "smoke")).fit(b).transform(b)


_DEC = f"""dec1 AS (SELECT *, lead(dose) OVER {q.WK} AS nd FROM traj),
 dec AS (SELECT * EXCLUDE (nd), CASE WHEN dose <> 0 THEN nd / dose WHEN dose
 = 0 AND nd = 0 THEN 1.0 WHEN dose = 0 AND nd > 0 THEN 1e300 END AS ratio
 FROM dec1), opt AS (SELECT *, CASE WHEN ratio < 0.8 THEN 0 WHEN ratio < 0.9
 THEN 1 WHEN ratio < 1 THEN 2 WHEN ratio = 1 THEN 3 WHEN ratio <= 1.1 THEN 4
 WHEN ratio <= 1.2 THEN 5 WHEN ratio > 1.2 THEN 6 END AS option_ FROM dec)"""


@query("observed_decision", "trial:s subjid:l trajid:l study_day:l option:l",
       q.W_T + f""", {_DEC} SELECT trial, subjid, trajid, study_day,
 option_ AS option FROM opt""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tn.observed_decision(d, scan=s))


@query("option_means", "option:l ratio:d", q.W_T + f""", {_DEC} SELECT
 option_ AS option, avg(ratio) AS ratio FROM opt WHERE option_ IS NOT NULL
 AND ratio < 1e299 GROUP BY option_""")
def _(spark, sf):
    return tn.option_means(on_base(
        spark, sf, lambda s, d: tn.observed_decision(d, scan=s)))


@query("elapsed", "trial:s subjid:l trajid:l study_day:l k:l", q.W_T
       + f"""SELECT trial, subjid, trajid, study_day, lead(study_day) OVER
 {q.WK} - study_day AS k FROM traj""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tn.elapsed(d, s))


_DONE = f"""dn1 AS (SELECT *, max(CASE WHEN value IS NOT NULL AND dose IS NOT
 NULL THEN study_day END) OVER {q.K} AS ld FROM traj), dn AS (SELECT *,
 lead(CASE WHEN study_day = ld THEN 1 ELSE 0 END) OVER {q.WK} AS done
 FROM dn1)"""


@query("done_flag", "trial:s subjid:l trajid:l study_day:l done:l", q.W_T
       + f""", {_DONE} SELECT trial, subjid, trajid, study_day, done
 FROM dn""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tn.done_flag(d, scan=s))


_REW = f"""{_SPAN}, evs AS (SELECT trial, subjid, trajid, study_day, CASE WHEN
 stroke + hem_stroke + major_bleed > 0 THEN 1.0 ELSE 0.0 END AS e FROM traj),
 alld AS (SELECT a.*, lag(visit_day) OVER (PARTITION BY a.trial, a.subjid,
 a.trajid ORDER BY d) AS pv FROM days a), rw AS (SELECT a.trial, a.subjid,
 a.trajid, a.pv AS study_day, sum(((CASE WHEN x BETWEEN 2 AND 3 THEN 1.0 ELSE
 0.0 END) + coalesce(e, 0) * -0.5) * pow(0.99, d - pv - 1)) AS reward
 FROM alld a LEFT JOIN evs b ON a.trial = b.trial AND a.subjid = b.subjid
 AND a.trajid = b.trajid AND a.d = b.study_day WHERE pv IS NOT NULL
 GROUP BY ALL)"""


@query("transition_reward", "trial:s subjid:l trajid:l study_day:l reward:e",
       q.W_T + f""", {_REW} SELECT t.trial, t.subjid, t.trajid, t.study_day,
 reward FROM traj t LEFT JOIN rw ON t.trial = rw.trial AND t.subjid =
 rw.subjid AND t.trajid = rw.trajid AND t.study_day = rw.study_day""")
def _(spark, sf):
    return on_base(spark, sf, lambda s, d: tn.transition_reward(
        d, PARAMS.events_evaluated, 0.99, 1.0, -0.5, scan=s))


@query("sample_weight_option", "trial:s subjid:l trajid:l study_day:l "
       "option:l sample_prob:d", q.W_T + f""", {_DEC}, c AS (SELECT option_,
 count(*) AS n FROM opt WHERE option_ IS NOT NULL GROUP BY 1), w AS (SELECT
 option_, (SELECT max(n) FROM c) / n AS w FROM c) SELECT trial, subjid,
 trajid, study_day, opt.option_ AS option, 1000 * w / sum(w) OVER ()
 AS sample_prob FROM opt JOIN w ON opt.option_ = w.option_""")
def _(spark, sf):
    d = on_base(spark, sf, lambda s, d: tn.observed_decision(d, scan=s))
    d = tn.sample_weight(d.filter("option is not null"), "option")
    return tn.normalise_weight(d).withColumn(
        "sample_prob", F.col("sample_prob") * 1000)


@query("sample_weight_event", "trial:s subjid:l trajid:l study_day:l "
       "sample_prob:d", q.W_T + f""", w AS (SELECT *, CASE WHEN sum(stroke
 + hem_stroke + major_bleed) OVER {q.K} > 0 THEN 5.0 ELSE 1.0 END AS w
 FROM traj) SELECT trial, subjid, trajid, study_day, 1000 * w / sum(w) OVER ()
 AS sample_prob FROM w""")
def _(spark, sf):
    d = on_base(spark, sf, lambda s, d: tn.sample_weight(
        d, "event", 5.0, PARAMS.events_evaluated, s))
    return tn.normalise_weight(d).withColumn(
        "sample_prob", F.col("sample_prob") * 1000)


_ST = [*[f"{c}_prev_{i}" for c in ("value", "dose") for i in range(1, 5)]]
_STATE_SQL = (q.W_T.replace("traj AS (", "traj0 AS (", 1) + f""",
 r1 AS (SELECT *, count(value) OVER {q.K} AS kn FROM traj0), r2 AS (SELECT *,
 max(study_day) OVER {q.K} AS ld FROM r1 WHERE kn > 1), traj AS (SELECT *
 EXCLUDE (kn, ld) FROM r2 WHERE NOT (study_day <> ld AND minor_bleed > 0 AND
 (value IS NULL OR dose IS NULL))), """
    + _uniform_sql("SELECT round_even(value, 1) AS x FROM traj")
    + f""", s1 AS (SELECT t.* REPLACE (um.u AS value, (dose - min(dose)
 OVER ()) / (max(dose) OVER () - min(dose) OVER ()) AS dose) FROM traj t
 LEFT JOIN um ON um.x = round_even(t.value, 1)), s2 AS (SELECT *,
 {", ".join("coalesce(" + ", ".join(f"lag({c}, {j}) OVER {q.WS}" for j in range(i, 0, -1)) + f", {c}) AS {c}_prev_{i}" for c in ("value", "dose") for i in range(1, 5))},
 {", ".join(f"CAST(coalesce(lag(trajid, {i}) OVER {q.WS}, 0) <> trajid AS INT) AS prev_{i}_crossed" for i in range(1, 5))}
 FROM s1), s3 AS (SELECT *, {", ".join(f"lead({c}) OVER {q.WK} AS next_{c}" for c in ("value", "dose", *_ST))}
 FROM s2), {_DEC}, {_DONE}, {_REW.replace("* -0.5", "* 0.0")},
 tr AS (SELECT s3.*, option_ AS option, d.done, w.reward, lead(s3.study_day)
 OVER (PARTITION BY s3.trial, s3.subjid, s3.trajid ORDER BY s3.study_day)
 - s3.study_day AS k FROM s3 JOIN opt USING (trial, subjid, trajid, study_day)
 JOIN dn d USING (trial, subjid, trajid, study_day) LEFT JOIN rw w
 USING (trial, subjid, trajid, study_day)),
 ok AS (SELECT * FROM tr WHERE option IS NOT NULL AND k IS NOT NULL AND done
 IS NOT NULL AND value IS NOT NULL AND dose IS NOT NULL AND next_value IS NOT
 NULL AND next_dose IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL AND next_{c} IS NOT NULL" for c in _ST)})
 SELECT *, 1 - done AS not_done, 1000.0 / count(*) OVER () AS sample_prob
 FROM ok""")


@query("build_transitions", "trial:s subjid:l trajid:l study_day:l k:l "
       "option:l reward:e not_done:l sample_prob:d value:d dose:d "
       + " ".join(f"{c}:d" for c in _ST) + " prev_1_crossed:l "
       "prev_4_crossed:l next_value:d next_dose:d next_value_prev_1:d",
       _STATE_SQL)
def _(spark, sf):
    out, _ = tn.build_transitions(T(spark, sf), VALUE_DOSE, min_length=1,
                                  scan=scan_of(spark, sf))
    return out.withColumn("sample_prob", F.col("sample_prob") * 1000)


def transitions(spark, sf, params=PARAMS):
    d = pl.build_trajectories(V(spark, sf), EV(spark, sf), BL(spark, sf),
                              params)
    return tn.build_transitions(d, params, min_length=1,
                                scan=scan_of(spark, sf))


@query("build_transitions_full", None)
def _(spark, sf):
    return transitions(spark, sf)[0]


@query("weighted_sample", None)
def _(spark, sf):
    d = on_base(spark, sf, lambda s, d: tn.observed_decision(d, scan=s))
    d = tn.sample_weight(d.filter("option is not null"), "option")
    return tn.weighted_sample(d, "sample_weight", 1000)


# The rest of the catalogue lives next door and registers itself here.
from trajspark.plans import catalog_reports, catalog_sources  # noqa: E402,F401
