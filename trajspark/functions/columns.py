"""Column expressions: every function maps Columns to a Column and stays in
whole-stage codegen or in Spark's array functions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark import params as P


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truth(cond: Column) -> Column:
    """A comparison with NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def nan_to_null(c) -> Column:
    """NaN sorts above every number in Spark, so it never enters as a value."""
    return F.when(~F.isnan(col(c)), col(c))


def decode_text(c) -> Column:
    """Bytes to trimmed text: UTF-8 where valid, ISO-8859-1 otherwise."""
    c = col(c)
    utf8 = F.try_validate_utf8(c.cast("string"))
    return F.trim(F.coalesce(utf8, F.decode(c.cast("binary"), "ISO-8859-1")))


def recode_capped(c, token: str, value: int) -> Column:
    """A capped number such as ">89" becomes `value`, the rest is cast."""
    c = col(c)
    return F.when(c == token, F.lit(value)).otherwise(c.try_cast("int"))


def null_if(c, cond: Column) -> Column:
    return F.when(~truth(cond), col(c))


def default_when(c, cond: Column, value) -> Column:
    return F.coalesce(col(c), F.when(cond, F.lit(value)))


def row_sum(cols) -> Column:
    """Sum across columns, NULL counting as zero."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def any_of(cols) -> Column:
    return row_sum(cols) > 0


def finite(c) -> Column:
    c = col(c)
    return truth(~F.isnan(c) & (F.abs(c) < F.lit(P.INF)))


def yes_no(c) -> Column:
    return F.when(col(c) == "Y", 1).when(col(c) == "N", 0)


def cut(c, bounds, labels=None, right: bool = True) -> Column:
    """Bin label of a value, NULL outside the bounds; labels default to the
    bin number. Intervals are closed on the right, or on the left."""
    c = col(c).cast("double")
    labels = list(range(len(bounds) - 1)) if labels is None else labels
    out = None
    for lo, hi, label in zip(bounds[:-1], bounds[1:], labels):
        low = F.lit(float(lo))
        high = F.lit(float(hi))
        inside = ((c > low) & (c <= high)) if right else \
            ((c >= low) & (c < high))
        out = F.when(inside, F.lit(label)) if out is None else \
            out.when(inside, F.lit(label))
    return out


def value_bin(c) -> Column:
    """Left-closed bins, except that 3 and 3.5 belong to the bin below."""
    c = col(c)
    names = P.VALUE_LABELS
    return (F.when(c < 1.5, names[0]).when(c < 2.0, names[1])
            .when(c <= 3.0, names[2]).when(c <= 3.5, names[3])
            .when(c > 3.5, names[4]))


def relative_change(after, before) -> Column:
    """after / before with 0/0 = 1 and x/0 = infinity."""
    after, before = col(after), col(before)
    return (F.when(before != 0, after / before)
            .when((before == 0) & (after == 0), F.lit(1.0))
            .when((before == 0) & (after > 0), F.lit(P.INF))
            .when((before == 0) & (after < 0), F.lit(-P.INF)))


def decision_code(ratio) -> Column:
    """Relative dose change to the option code 0..6; NULL stays NULL."""
    r = col(ratio)
    return (F.when(r < 0.8, 0).when(r < 0.9, 1).when(r < 1.0, 2)
            .when(r == 1.0, 3).when(r <= 1.1, 4).when(r <= 1.2, 5)
            .when(r > 1.2, 6))


def map_codes(c, mapping: dict) -> Column:
    """Values looked up in a small fixed mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[col(c)]


def in_range(c, lo: float = 2.0, hi: float = 3.0) -> Column:
    return truth(col(c).between(lo, hi))


def centre_id(c) -> Column:
    """The centre is the subject id without its last three digits."""
    return F.floor(col(c) / 1000).cast("long")


def centre_id_text(c) -> Column:
    s = col(c).cast("string")
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - 3, F.lit(0))) \
        .try_cast("long")


def trajectory_label(subject, trajectory) -> Column:
    return F.concat_ws(".", col(subject), col(trajectory))


def fmt_mean_sd(mean, sd) -> Column:
    return F.format_string("%.1f (%.1f)", col(mean), col(sd))


def fmt_pct(share, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", col(share) * 100)


def fmt_ci(value, lower, upper) -> Column:
    return F.format_string("%.1f%% (%.1f%%, %.1f%%)", col(value) * 100,
                           col(lower) * 100, col(upper) * 100)


def metric_part(c, part: str) -> Column:
    """A piece of a metric name `algo/group/stat[_lower|_upper]`."""
    c = col(c)
    if part == "algorithm":
        return F.split(c, "/")[0]
    if part == "group":
        return F.split(c, "/")[1]
    stat = F.element_at(F.split(c, "/"), -1)
    if part == "statistic":
        return F.regexp_replace(stat, "_(lower|upper)$", "")
    suffix = F.regexp_extract(stat, "_(lower|upper)$", 1)
    return F.when(suffix == "", "value").otherwise(suffix)


# Rule-based, constant and hashed policies.

def rule_policy(value) -> Column:
    """Relative dose the rule prescribes for a measurement."""
    v = col(value)
    return (F.when(v <= 1.5, 1.15).when(v < 2.0, 1.10).when(v <= 3.0, 1.0)
            .when(v < 5.0, 0.9).when(v >= 5.0, 0.85).otherwise(1.0))


def rule_policy_code(value) -> Column:
    v = col(value)
    return (F.when(v <= 1.5, 5).when(v < 2.0, 4).when(v <= 3.0, 3)
            .when(v < 5.0, 2).when(v >= 5.0, 1).otherwise(0))


def constant_policy(code: int = 3) -> Column:
    return F.lit(code)


def hash_uniform(cols, seed) -> Column:
    """A number in [0, 1) fixed by the key columns and the seed, so a task
    that runs again draws the same."""
    text = F.concat_ws("|", F.lit(seed).cast("string"),
                       *[col(c).cast("string") for c in cols])
    hex8 = F.substring(F.md5(text), 1, 8)
    return F.conv(hex8, 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_bounds() -> list:
    """The distribution function of Poisson(1) at 0, 1, ..., up to the count
    at which a double can't tell it from 1."""
    import math
    cdf, out = 0.0, []
    while True:
        more = cdf + math.exp(-1.0) / math.factorial(len(out))
        if more == cdf:
            return out
        cdf = more
        out.append(cdf)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inverting its distribution function."""
    bounds = poisson_bounds()
    out = F.lit(len(bounds))
    for k, bound in reversed(list(enumerate(bounds))):
        out = F.when(u < F.lit(bound), F.lit(k)).otherwise(out)
    return out


def poisson_cuts() -> list[int]:
    """`poisson_bounds` among numbers of 32 bits, as far as they reach: the
    count is how many of these a number is not below."""
    import math
    cuts = [math.ceil(b * 2.0 ** 32) for b in poisson_bounds()]
    return [c for c in cuts if c < 2 ** 32]


def poisson_hex(hex8: Column) -> Column:
    """`poisson_one` of 32 bits as eight lowercase hex digits, over 2^32.
    Digits of one length are in the order of their numbers, so none is
    converted."""
    below = poisson_cuts()
    out = F.lit(len(below))
    for k, c in reversed(list(enumerate(below))):
        out = F.when(hex8 < F.lit(f"{c:08x}"), F.lit(k)).otherwise(out)
    return out


# Class-score vectors (arrays of doubles).

def argmax(v) -> Column:
    v = col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v) -> Column:
    v = col(v)
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def feasible(p, tau: float, strict: bool = True) -> Column:
    """Which options reach the share `tau` of the most likely one. Scoring
    compares strictly, training includes equality."""
    p = col(p)
    top = F.array_max(p)
    if strict:
        return F.transform(p, lambda x: x / top > tau)
    return F.transform(p, lambda x: x / top >= tau)


def masked_q(q, p, tau: float, strict: bool = True) -> Column:
    return F.zip_with(col(q), feasible(p, tau, strict),
                      lambda x, ok: F.when(ok, x).otherwise(F.lit(-1e8)))


def ordinal_probs(loc, scale, cutpoints) -> Column:
    """Class probabilities of an ordinal logistic model."""
    loc, scale, cuts = col(loc), col(scale), col(cutpoints)
    cdf = F.concat(
        F.array(F.lit(0.0)),
        F.transform(cuts, lambda c: 1 / (1 + F.exp(-(c - loc) / scale))),
        F.array(F.lit(1.0)))
    raw = F.zip_with(F.slice(cdf, F.lit(2), F.size(cdf) - 1),
                     F.slice(cdf, F.lit(1), F.size(cdf) - 1),
                     lambda hi, lo: hi - lo + 1e-8)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)
