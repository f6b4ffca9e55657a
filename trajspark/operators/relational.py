"""Filters, joins, unions, grouped statistics and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import col, finite, truth, yes_no
from trajspark.operators.scan import PLAIN, add_by_key, lag, running_sum
from trajspark.operators.selection import quantile, summarise


def require_columns(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def cast_cols(df: DataFrame, types: dict) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def keys_first(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def indicators(df: DataFrame, column: str, values: dict,
               drop: bool = False) -> DataFrame:
    """0/1 columns, one for each named value of a category column."""
    out = df.withColumns({
        name: truth(F.col(column) == v).cast("int")
        for name, v in values.items()})
    return out.drop(column) if drop else out


def dummies(df: DataFrame, column: str, levels=None,
            prefix: str | None = None) -> DataFrame:
    """Indicator per level; levels found in the data when not given. The
    result is as wide as there are levels: give them for an open column."""
    if levels is None:
        found = df.select(column).na.drop().distinct().collect()
        levels = sorted(r[0] for r in found)
    name = (lambda v: f"{prefix}{v}") if prefix else str
    return df.withColumns({
        name(v): truth(F.col(column) == v).cast("int") for v in levels})


def flags(df: DataFrame, exprs: dict) -> DataFrame:
    return df.withColumns({n: truth(e).cast("int") for n, e in exprs.items()})


def replace_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    return df.replace(mapping, subset=[column])


def yn_to_int(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: yes_no(c) for c in cols})


def complete_cases(df: DataFrame, cols, only_finite: bool = False) -> DataFrame:
    out = df.na.drop(subset=list(cols))
    if only_finite:
        out = out.filter(reduce(lambda a, b: a & b,
                                [finite(c) for c in cols]))
    return out


def select_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


# Joins. None carries a forced broadcast: table statistics and adaptive
# execution broadcast a side that is small enough and split skewed ones. Id
# sides are made distinct first, which combines repeats before the shuffle.

def keep_ids(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    return df.join(ids.select(*on).distinct(), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    return df.join(ids.select(*on).distinct(), on, "left_anti")


def join_all(dfs, on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "inner"), dfs)


def outer_coalesce(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, on, "full_outer")


def star_join(fact: DataFrame, dims) -> DataFrame:
    return reduce(lambda f, d: f.join(d[0], d[1], "left"), dims, fact)


def right_join(a: DataFrame, b: DataFrame, on: str,
               suffix: str) -> DataFrame:
    clash = {c: c + suffix for c in b.columns if c in a.columns and c != on}
    return a.join(b.withColumnsRenamed(clash), on, "right")


def link_subjects(df: DataFrame, linker: DataFrame, key: str = "subjid",
                  linked: str = "linked_id", how: str = "inner") -> DataFrame:
    """Attach the linked subject id and the centre it encodes."""
    return (df.join(linker.select(key, linked), key, how)
            .withColumn("centre", F.floor(F.col(linked) / 1000)
                        .cast("long")))


def complete_grid(df: DataFrame, levels: dict, fill: int = 0) -> DataFrame:
    """Every combination of the listed levels, missing ones filled. The grid
    is made of literals only."""
    grid = df.sparkSession.range(1).select()
    for c, values in levels.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values]))
                           .alias(c))
    rest = [c for c in df.columns if c not in levels]
    return (grid.join(df, list(levels), "left")
            .select(*levels, *[F.coalesce(F.col(c), F.lit(fill)).alias(c)
                               for c in rest]))


def with_group_agg(df: DataFrame, keys, aggs: dict, scan=PLAIN) -> DataFrame:
    return scan.group(df, keys, **aggs)


def with_group_mean(df: DataFrame, group: str, column: str,
                    out: str) -> DataFrame:
    """Attach the group mean through an aggregate that is combined before the
    shuffle, so a group of any size fits."""
    means = df.groupBy(group).agg(F.avg(column).alias(out))
    return df.join(means, group, "inner")


# Unions and sets.

def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def overlap_count(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """One row: how many ids occur on both sides."""
    on = [on] if isinstance(on, str) else list(on)
    return (a.select(*on).distinct().intersect(b.select(*on).distinct())
            .agg(F.count(F.lit(1)).alias("shared")))


def assert_disjoint(a: DataFrame, b: DataFrame, on) -> None:
    shared = overlap_count(a, b, on).first()["shared"]
    if shared:
        raise AssertionError(f"{shared} ids occur on both sides")


# Grouped statistics.

def group_size(df: DataFrame, keys, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


value_counts = group_size


def n_distinct(df: DataFrame, keys, column: str, out: str = "n",
               approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(f(column).alias(out))


def describe_by(df: DataFrame, by, column: str) -> DataFrame:
    """min, quartiles with linear interpolation, max and mean by group, for
    groups of any size."""
    kind = df.schema[column].dataType
    return summarise(df, by, column, [.25, .5, .75]).select(
        *by, "n", F.col("min").cast(kind), F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"),
        F.col("max").cast(kind), "mean")


def median_range(df: DataFrame, keys, order: str) -> DataFrame:
    spans = df.groupBy(*keys).agg(
        (F.max(order) - F.min(order)).alias("span"))
    return quantile(spans, "span", 0.5).withColumnRenamed(
        "q", "median_range")


def share_within(df: DataFrame, parent, cols) -> DataFrame:
    """Count of each combination and its share inside the parent group.
    The window runs over counts, not over rows."""
    w = Window.partitionBy(*parent)
    return (df.groupBy(*parent, *cols).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / F.sum("n").over(w)))


def mean_sd(df: DataFrame, by, column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"),
                               F.stddev_samp(column).alias("sd"))


def pct_by(df: DataFrame, by, cols) -> DataFrame:
    return df.groupBy(*by).agg(
        *[(F.avg(F.col(c).cast("double")) * 100).alias(c) for c in cols])


def null_report(df: DataFrame, by, group, cols) -> DataFrame:
    """Null counts per column, and how many groups have at least one."""
    per = df.groupBy(*by, *group).agg(
        *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return per.groupBy(*by).agg(
        *[F.sum(c).alias(f"{c}_nulls") for c in cols],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_groups")
          for c in cols])


def weighted_mean(x, w) -> Column:
    return F.try_divide(F.sum(col(x) * col(w)), F.sum(col(w)))


def mean_count(df: DataFrame, by, cols) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.count(c).alias(f"{c}_count")]
    return df.groupBy(*by).agg(*aggs)


def product_by(df: DataFrame, keys, cols) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.product(c).alias(c) for c in cols])


def neg_corr(x, y) -> Column:
    """Negated correlation, NULL where a side does not vary."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return -F.try_divide(F.covar_pop(a, b),
                         F.stddev_pop(a) * F.stddev_pop(b))


def above_percentile(df: DataFrame, column: str, p: float,
                     out: str) -> DataFrame:
    cut = quantile(df, column, p).scalar()
    return df.withColumn(out, (F.col(column) > cut).cast("int"))


def first_record(df: DataFrame, keys, order) -> DataFrame:
    """Per key the first non-null value of each column, in row order. A
    two-stage aggregate: no row of a key waits in a window."""
    pos = F.struct(*order)
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(c)
            for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*aggs)


def dedupe(df: DataFrame, keys=None, order=None,
           keep: str = "first") -> DataFrame:
    if keys is None:
        return df.dropDuplicates()
    return (first_row if keep == "first" else last_row)(df, keys, order)


def first_row(df: DataFrame, keys, order) -> DataFrame:
    """Whole first row of a key, as an aggregate that combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def last_row(df: DataFrame, keys, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def any_medication(df: DataFrame, key: str, cols) -> DataFrame:
    return df.groupBy(key).agg(
        *[F.least(F.sum(c), F.lit(1)).cast("int").alias(c) for c in cols])


def any_by(df: DataFrame, keys, cols) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.max(truth(F.col(c) > 0).cast("int")).alias(c) for c in cols])


def event_rates(df: DataFrame, by, subject: str, events, trajectory,
                order: str, digits: float = 100.0) -> DataFrame:
    """Counts, rate per subject and rate per 100 subject-years."""
    spans = df.groupBy(*by, subject, *trajectory).agg(
        (F.max(order) - F.min(order)).alias("__days"),
        *[F.sum(e).alias(e) for e in events])
    sums = spans.groupBy(*by).agg(
        F.count_distinct(subject).alias("subjects"),
        (F.sum("__days") / 365.25).alias("years"),
        *[F.sum(e).alias(e) for e in events])
    return sums.select(
        *by, "subjects", "years", *events,
        *[F.try_divide(F.col(e), F.col("subjects")).alias(f"{e}_per_subject")
          for e in events],
        *[F.try_divide(F.col(e) * digits, F.col("years"))
          .alias(f"{e}_per_100y") for e in events])


def ordinal_cutpoints(df: DataFrame, column: str) -> DataFrame:
    """Logit of the cumulative share of every level but the last."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    levels = add_by_key(counts.withColumn("__all", F.lit(1)), ["__all"],
                        [column], cum=running_sum("count"))
    total = counts.agg(F.sum("count")).scalar()
    p = F.col("cum") / F.col("__total")
    return (levels.withColumn("__total", total)
            .filter(F.col("cum") < F.col("__total"))
            .select(column, F.ln(p / (1 - p)).alias("cutpoint")))


def best_run(runs: DataFrame, metric: str, mode: str = "max",
             min_iter: int = 1, run: str = "run",
             iteration: str = "iteration") -> DataFrame:
    """The run and iteration with the best metric, ties to the first run and
    iteration. Iterations below `min_iter - 1` do not count."""
    ok = runs.filter((F.col(iteration) >= min_iter - 1) &
                     F.col(metric).isNotNull())
    value = F.col(metric) if mode == "min" else -F.col(metric)
    pick = F.struct(value.alias("v"), F.col(run), F.col(iteration),
                    F.col(metric))
    best = ok.agg(F.min(pick).alias("b"))
    return best.select(F.col(f"b.{run}"), F.col(f"b.{iteration}"),
                       F.col(f"b.{metric}"))


# Reshaping.

def melt(df: DataFrame, ids, values, variable: str = "variable",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def pivot(df: DataFrame, rows, column: str, value: str,
          levels=None) -> DataFrame:
    return df.groupBy(*rows).pivot(column, levels).agg(F.first(value))


def transpose(df: DataFrame, key: str, levels=None) -> DataFrame:
    """Columns become rows; values are read as text."""
    values = [c for c in df.columns if c != key]
    text = df.select(key, *[F.col(c).cast("string").alias(c) for c in values])
    return pivot(melt(text, [key], values, "metric"), ["metric"], key,
                 "value", levels)


def truncate_after(df: DataFrame, ends: DataFrame, key, order: str,
                   end: str) -> DataFrame:
    """Rows up to and including the end day of their subject."""
    joined = df.join(ends, key, "left")
    return (joined.filter(F.col(end).isNull() | (F.col(order) <= F.col(end)))
            .drop(end))


def average_rank(df: DataFrame, column: str, by=(), scan=None) -> DataFrame:
    """Average rank of each distinct value with its count. Ranks come from a
    running count over distinct values."""
    by = list(by)
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    keys = by or ["__all"]
    if not by:
        counts = counts.withColumn("__all", F.lit(1))
    out = add_by_key(counts, keys, [column], scan, __upto=running_sum("n"))
    out = out.withColumn("rank", F.col("__upto") - F.col("n")
                         + (F.col("n") + 1) / 2)
    return out.select(*by, column, "n", "rank")


def previous(df: DataFrame, keys, order, column: str, out: str, n: int = 1,
             scan=PLAIN) -> DataFrame:
    return scan.add(df, keys, order, **{out: lag(column, n)})
