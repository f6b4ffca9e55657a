"""SQL fragments that state the same inputs and splits in plain SQL, for
checking results against another engine."""

from __future__ import annotations

import re

FLAGS = ("death", "stroke", "major_bleed", "minor_bleed", "hem_stroke",
         "hosp", "sys_emb")

_SEG = """CASE c.c_mktsegment WHEN 'BUILDING' THEN 'ENGAGE'
 WHEN 'MACHINERY' THEN 'ROCKET_AF' WHEN 'HOUSEHOLD' THEN 'RELY'
 ELSE 'ARISTOTLE' END"""

V = f"""v AS (SELECT {_SEG} AS trial, o.o_custkey AS subjid,
 CAST(floor(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE))
   / 3.0) AS INT) AS study_day,
 CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN o.o_orderkey % 31 = 0 THEN 0.0
   ELSE CAST(8 + (o.o_orderkey * 37) % 43 AS DOUBLE) / 10 END AS value,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
   WHEN o.o_orderkey % 13 IN (0, 1) THEN 0.0
   WHEN o.o_orderkey % 997 = 0 THEN 150.0
   WHEN o.o_orderkey % 401 = 0 THEN 99.0
   ELSE CAST(CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY',
     'HOUSEHOLD') THEN 0.5 ELSE 2.5 END AS DOUBLE)
     * CAST(4 + (o.o_orderkey * 17) % 16 AS DOUBLE) END AS dose,
 CASE WHEN o.o_orderkey % 19 = 0 THEN 'N' ELSE 'Y' END AS value_type,
 CAST(CASE WHEN o.o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS DOUBLE)
   AS interrupt_flag,
 o.o_orderkey AS seq
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

EV = """ev AS (SELECT v.trial, v.subjid,
 CASE v.seq % 7 WHEN 0 THEN 'All Cause Death' WHEN 1 THEN 'Ischemic Stroke'
   WHEN 2 THEN 'Major Bleeding' WHEN 3 THEN 'Minor Bleeding'
   WHEN 4 THEN 'Hemorrhagic Stroke' WHEN 5 THEN 'Hospitalization'
   ELSE 'Systemic Embolism' END AS event_name,
 CASE WHEN v.seq % 31 = 0 THEN NULL
   ELSE CAST(v.study_day + (v.seq * 7) % 120 AS INT) END AS event_day,
 CASE WHEN v.seq % 4 = 0 THEN CAST(v.seq % 5 AS DOUBLE) ELSE NULL END
   AS rankin FROM v WHERE v.seq % 6 = 0)"""

BL = """bl AS (SELECT c.c_custkey AS subjid, CAST(c.c_custkey % 2 AS INT) AS sex,
 CASE WHEN c.c_custkey % 29 = 0 THEN '>89'
   ELSE CAST(40 + c.c_custkey % 50 AS VARCHAR) END AS age,
 CASE WHEN c.c_custkey % 41 = 0 THEN NULL
   ELSE CAST(45 + c.c_custkey % 80 AS DOUBLE) END AS weight,
 r.r_name AS region, n.n_name AS country,
 CASE c.c_custkey % 3 WHEN 0 THEN 'NEVER' WHEN 1 THEN 'FORMER SMOKER'
   ELSE 'CURRENT SMOKER' END AS smoke,
 CASE WHEN c.c_custkey % 4 = 0 THEN 'Y' ELSE 'N' END AS diabetes
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey)"""

# Event flags that the short base derives from the order keys.
FLAG_RULES = {"death": (97, 5), "stroke": (17, 1), "major_bleed": (13, 3),
              "minor_bleed": (11, 4), "hem_stroke": (19, 2), "hosp": (23, 6),
              "sys_emb": (29, 7)}

OBS = "obs AS (SELECT trial, subjid, study_day, sum(value) AS value, " \
    "sum(dose) AS dose, " + ", ".join(
        f"sum(CASE WHEN seq % {m} = {r} THEN 1 ELSE 0 END) AS {f}"
        for f, (m, r) in FLAG_RULES.items()) + \
    " FROM v WHERE value_type = 'Y' GROUP BY trial, subjid, study_day)"

TRAJ = """gp AS (SELECT *, study_day - lag(study_day) OVER (
   PARTITION BY trial, subjid ORDER BY study_day) AS days FROM obs),
traj AS (SELECT * EXCLUDE (days), CAST(sum(CASE WHEN days > 90 THEN 1 ELSE 0
   END) OVER (PARTITION BY trial, subjid ORDER BY study_day) AS BIGINT)
   AS trajid FROM gp)"""

W_V = f"WITH {V} "
W_EV = f"WITH {V}, {EV} "
W_BL = f"WITH {BL} "
W_T = f"WITH {V}, {OBS}, {TRAJ} "

WK = "(PARTITION BY trial, subjid, trajid ORDER BY study_day)"
WS = "(PARTITION BY trial, subjid ORDER BY study_day)"
K = "(PARTITION BY trial, subjid, trajid)"


def split_flag(src: str, dst: str, flag: str, reason: str, order: str,
               keep: str, nested: bool = False, observed: bool = False,
               p: str = "f") -> str:
    """CTEs that cut `src` at a boolean expression."""
    within = "trial, subjid" + (", trajid" if nested else "")
    st = "((pf IS NULL OR pf) AND NOT fl)"
    en = "((nf IS NULL OR nf) AND NOT fl)"
    extra = ""
    if nested:
        extra = (f", lag(trajid) OVER (PARTITION BY trial, subjid ORDER BY "
                 f"{order}) AS tp, lead(trajid) OVER (PARTITION BY trial, "
                 f"subjid ORDER BY {order}) AS tn")
        st = f"({st} OR tp IS DISTINCT FROM trajid)"
        en = f"({en} OR tn IS DISTINCT FROM trajid)"
    seen = "coalesce(value_type = 'Y', FALSE)" if observed else "TRUE"
    known = "value_type IS NOT NULL" if observed else "TRUE"
    return f"""{p}0 AS (SELECT *, coalesce({flag}, FALSE) AS fl FROM {src}),
{p}1 AS (SELECT *, lag(fl) OVER (PARTITION BY {within} ORDER BY {order})
   AS pf, lead(fl) OVER (PARTITION BY {within} ORDER BY {order}) AS nf
   {extra} FROM {p}0),
{p}2 AS (SELECT *, {st} AS st, {en} AS en FROM {p}1),
{p}3 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY
   trial, subjid ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS sc,
   sum(CASE WHEN en THEN 1 ELSE 0 END) OVER (PARTITION BY trial, subjid
   ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS ec FROM {p}2),
{p}4 AS (SELECT *, dense_rank() OVER (PARTITION BY trial, subjid ORDER BY sc)
   - 1 AS tnew FROM {p}3 WHERE sc >= ec AND NOT (st AND en) AND NOT fl),
{p}5 AS (SELECT *, max(CASE WHEN {seen} THEN study_day END) OVER (PARTITION BY
   trial, subjid, tnew) AS ld, count(termination) OVER (PARTITION BY trial,
   subjid, tnew) AS ct FROM {p}4),
{dst} AS (SELECT {keep}, CAST(tnew AS BIGINT) AS trajid,
   CASE WHEN ld = study_day AND {known} AND ct = 0 THEN '{reason}'
   ELSE termination END AS termination FROM {p}5)"""


_VCOLS = "trial, subjid, study_day, value, dose, value_type, " \
    "interrupt_flag, seq"
_RAW = "study_day, seq"

# Complete baselines, then the observed period and the end of the trial.
PREP = f"""{BL.replace("bl AS", "bl0 AS", 1)},
bl AS (SELECT * REPLACE (CASE WHEN age = '>89' THEN 90 ELSE CAST(age AS INT)
   END AS age) FROM bl0 WHERE weight IS NOT NULL),
pv1 AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN study_day END) OVER
   (PARTITION BY trial, subjid) AS fd, max(CASE WHEN value IS NOT NULL THEN
   study_day END) OVER (PARTITION BY trial, subjid) AS xd FROM v
   WHERE study_day >= 0 AND subjid IN (SELECT subjid FROM bl)),
pv2 AS (SELECT *, max(CASE WHEN value IS NOT NULL AND value_type = 'Y' THEN
   study_day END) OVER (PARTITION BY trial, subjid) AS lo FROM pv1
   WHERE study_day BETWEEN fd AND xd),
pv AS (SELECT {_VCOLS}, CASE WHEN value_type = 'Y' AND study_day = lo THEN
   'TRIAL_TERMINATION' END AS termination FROM pv2)"""

_NEAR = f"""(coalesce(lag(dose) OVER (PARTITION BY trial, subjid ORDER BY
   {_RAW}) = 0, FALSE) OR coalesce(lead(dose) OVER (PARTITION BY trial, subjid
   ORDER BY {_RAW}) = 0, FALSE))"""

DAILY = f"""da1 AS (SELECT * REPLACE (CASE WHEN dose % 0.5 <> 0 OR dose = 99
   THEN NULL ELSE dose END AS dose) FROM pv
   WHERE trial IN ('ENGAGE', 'ROCKET_AF')),
da2 AS (SELECT * REPLACE (7.0 * avg(dose) OVER (PARTITION BY trial, subjid
   ORDER BY {_RAW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS dose)
   FROM da1),
da3 AS (SELECT * REPLACE (CASE WHEN value = 0 THEN NULL ELSE value END
   AS value) FROM da2 WHERE value_type = 'Y'),
da4 AS (SELECT *, {_NEAR} AS near FROM da3),
{split_flag("da4", "daily", "(coalesce(dose = 0, FALSE) AND near) OR value IS NULL", "DOSE_INR_INTERRUPTION", _RAW, _VCOLS, observed=True, p="dx")}"""

AVG = f"""av1 AS (SELECT * REPLACE (dose * 7 AS dose) FROM pv
   WHERE trial = 'RELY'),
{split_flag("av1", "av2", "interrupt_flag <> 0", "TRIAL_INTERRUPTION", _RAW, _VCOLS, observed=True, p="ax")},
avg_dose AS (SELECT * FROM av2 WHERE value_type = 'Y')"""

WEEKLY = f"""we1 AS (SELECT * REPLACE (first_value(abs(dose) IGNORE NULLS)
   OVER (PARTITION BY trial, subjid ORDER BY {_RAW} ROWS BETWEEN CURRENT ROW
   AND UNBOUNDED FOLLOWING) AS dose) FROM pv WHERE trial = 'ARISTOTLE'),
we2 AS (SELECT * FROM we1 WHERE value IS NOT NULL AND dose IS NOT NULL
   AND value_type = 'Y'),
we3 AS (SELECT *, {_NEAR} AS near FROM we2),
{split_flag("we3", "weekly", "dose = 0 AND near", "DOSE_INR_INTERRUPTION", _RAW, _VCOLS, observed=True, p="wx")}"""

UNION = """un0 AS MATERIALIZED (SELECT * FROM daily UNION ALL
   SELECT * FROM avg_dose UNION ALL SELECT * FROM weekly),
un AS (SELECT * FROM un0 WHERE NOT EXISTS (SELECT 1 FROM un0 AS hi
   WHERE hi.trial = un0.trial AND hi.subjid = un0.subjid AND hi.dose >= 140))"""

_EVN = {"death": "All Cause Death", "stroke": "Ischemic Stroke",
        "major_bleed": "Major Bleeding", "minor_bleed": "Minor Bleeding",
        "hem_stroke": "Hemorrhagic Stroke", "hosp": "Hospitalization",
        "sys_emb": "Systemic Embolism"}
_FL = ", ".join(FLAGS)
_ANY = "(" + " + ".join(FLAGS) + ")"
_SPLIT = "(" + " + ".join(f for f in FLAGS if f != "minor_bleed") + ")"

MERGE = f"""ed AS (SELECT trial, subjid, event_day AS study_day,
   {", ".join(f"sum(CASE WHEN event_name = '{n}' THEN 1 ELSE 0 END) AS {f}"
              for f, n in _EVN.items())},
   max(coalesce(rankin, CASE WHEN event_name = 'Ischemic Stroke' THEN 3.0 END))
   AS rankin FROM ev WHERE event_day IS NOT NULL
   GROUP BY trial, subjid, event_day),
mu AS (SELECT trial, subjid, study_day, value, dose, interrupt_flag,
   CAST(NULL AS DOUBLE) AS rankin, seq, trajid, termination,
   {", ".join(f"0 AS {f}" for f in FLAGS)} FROM un
   UNION ALL SELECT trial, subjid, study_day, NULL, NULL, NULL, rankin, NULL,
   NULL, NULL, {_FL} FROM ed),
mf AS (SELECT * REPLACE (last_value(trajid IGNORE NULLS) OVER (PARTITION BY
   trial, subjid ORDER BY study_day, seq NULLS LAST ROWS UNBOUNDED PRECEDING)
   AS trajid) FROM mu),
mc AS (SELECT trial, subjid, trajid, study_day, sum(value) AS value,
   sum(dose) AS dose, sum(interrupt_flag) AS interrupt_flag,
   sum(rankin) AS rankin, {", ".join(f"sum({f}) AS {f}" for f in FLAGS)},
   max(termination) AS termination FROM mf WHERE trajid IS NOT NULL
   GROUP BY trial, subjid, trajid, study_day),
mr AS (SELECT *, lag(value IS NOT NULL) OVER {WS} AS pm FROM mc),
mg AS (SELECT * EXCLUDE (pm) FROM mr WHERE value IS NOT NULL
   OR coalesce(pm, FALSE)),
mh AS (SELECT *, coalesce(study_day - lag(study_day) OVER {WS}, 0) AS gp
   FROM mg),
merged AS (SELECT * EXCLUDE (gp) FROM mh WHERE NOT (value IS NULL
   AND {_ANY} > 0 AND gp > 90))"""

SPLIT_EVENTS = f"""se1 AS (SELECT *, {_SPLIT} > 0 AS ie FROM merged),
se2 AS (SELECT *, trajid + sum(CASE WHEN ie THEN 1 ELSE 0 END) OVER (PARTITION
   BY trial, subjid ORDER BY study_day ROWS UNBOUNDED PRECEDING)
   - CASE WHEN ie THEN 1 ELSE 0 END AS tn FROM se1),
se3 AS (SELECT * REPLACE (CASE WHEN ie THEN 'ADVERSE_EVENT' ELSE termination
   END AS termination, CAST(dense_rank() OVER (PARTITION BY trial, subjid
   ORDER BY tn) - 1 AS BIGINT) AS trajid) FROM se2),
se4 AS (SELECT *, max(study_day) OVER {K} AS ld, count(termination) OVER {K}
   AS ct FROM se3),
ses AS (SELECT * EXCLUDE (ie, tn, ld, ct) REPLACE (CASE WHEN ld <> study_day
   AND ct > 1 THEN NULL ELSE termination END AS termination) FROM se4)"""

IMPUTE = f"""im1 AS (SELECT *, value IS NULL AND {_ANY} > 0 AS nov,
   dose IS NULL AND {_ANY} > 0 AS nod FROM ses),
im2 AS (SELECT * REPLACE (first_value(dose IGNORE NULLS) OVER (PARTITION BY
   trial, subjid ORDER BY study_day ROWS BETWEEN CURRENT ROW AND UNBOUNDED
   FOLLOWING) AS dose) FROM im1),
im3 AS (SELECT * REPLACE (
   {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY trial, subjid, trajid ORDER BY study_day ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("value", "dose", "interrupt_flag", "rankin"))}) FROM im2),
imp AS (SELECT * EXCLUDE (nov, nod) REPLACE (CASE WHEN NOT nov THEN value END
   AS value, CASE WHEN NOT nod THEN dose END AS dose) FROM im3
   WHERE value IS NOT NULL AND dose IS NOT NULL)"""

SPLIT_GAPS = f"""sg1 AS (SELECT *, study_day - lag(study_day) OVER {WK} > 90
   AS isgap, row_number() OVER {WK} = 1 AS isfirst FROM imp),
sg2 AS (SELECT *, sum(CASE WHEN isfirst OR isgap THEN 1 ELSE 0 END) OVER {WS}
   - 1 AS tn, lead(isgap) OVER {WS} AS nextgap FROM sg1),
sgs AS (SELECT * EXCLUDE (isgap, isfirst, tn, nextgap) REPLACE (
   CAST(tn AS BIGINT) AS trajid, CASE WHEN coalesce(nextgap, FALSE) THEN
   'TIME_GAP' ELSE termination END AS termination) FROM sg2)"""

PRUNE = f"""pr1 AS (SELECT *, count(*) OVER {K} AS n FROM sgs),
pr AS (SELECT * EXCLUDE (n) REPLACE (CAST(dense_rank() OVER (PARTITION BY
   trial, subjid ORDER BY trajid) - 1 AS BIGINT) AS trajid) FROM pr1
   WHERE n >= 2)"""

FULL = f"""fulltab AS (SELECT pr.*, bl.sex, bl.age, bl.weight,
   bl.region AS continent, bl.country, bl.smoke,
   CASE bl.diabetes WHEN 'Y' THEN 1 ELSE 0 END AS diabetes
   FROM pr LEFT JOIN bl ON pr.subjid = bl.subjid)"""

CHAIN = [PREP, DAILY, AVG, WEEKLY, UNION, MERGE, SPLIT_EVENTS, IMPUTE,
         SPLIT_GAPS, PRUNE, FULL]


def upto(step: str) -> str:
    """WITH clause of the pipeline up to a step."""
    names = ["prep", "daily", "avg", "weekly", "union", "events",
             "split_events", "impute", "split_gaps", "prune", "full"]
    return f"WITH {V}, {EV}, " + ", ".join(CHAIN[:names.index(step) + 1]) + " "


# Decimals by column kind. Half of a power of 0.99 ends in a 5 right after an
# even number of decimals, so discounted rewards are rounded at an odd one.
DIGITS = {"d": 6, "e": 7}


def computed_once(sql: str) -> str:
    """Each named table is worked out once, however often it is used."""
    return re.sub(r"(\b\w+) AS \(\s*SELECT", r"\1 AS MATERIALIZED (SELECT",
                  sql)


def typed(sql: str, columns: str) -> str:
    """Cast and round the result to the declared columns."""
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        if kind in DIGITS:
            out.append(f"round(CAST({name} AS DOUBLE), {DIGITS[kind]}) + 0.0 "
                       f"AS {name}")
        else:
            t = {"l": "BIGINT", "s": "VARCHAR"}[kind]
            out.append(f"CAST({name} AS {t}) AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) q"
