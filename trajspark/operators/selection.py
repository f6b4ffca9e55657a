"""Exact quantiles of groups of any size, by counting and narrowing.

Values are counted once. Groups of few distinct values are finished from their
counts. In the others every wanted rank has a range of values that holds it;
each pass cuts the ranges at values of a mergeable sketch, weighs the cells
between the cuts, and keeps the cell with the rank. The cuts only decide how
fast a range shrinks, the counts what is in it, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.scan import join_null_safe
from trajspark.session import cut_lineage

#: Distinct values of a group, or of a range, that one task may hold.
HELD = 100_000
#: Ranges are cut at this many values; ranges are copied to so many salts.
CUTS, SALTS = 64, 32


def _counts(df: DataFrame, by, column: str) -> DataFrame:
    """Distinct values x of each group and how often they occur. A group's
    missing values are one row of it."""
    x = F.col(column).cast("double").alias("x")
    return df.select(*by, x).groupBy(*by, "x").agg(
        F.count(F.lit(1)).alias("n"))


def _places(probabilities) -> list:
    """Expressions for position, lower and upper rank of each probability
    among `total` ordered values, numbered from 0."""
    out = []
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("total") - 1)
        out.append((at, F.floor(at), F.ceil(at)))
    return out


def _inside(counts: DataFrame, ranges: DataFrame, by) -> DataFrame:
    """Values strictly inside the ranges of their group. All values of a group
    share a key, so they are dealt to salts and the ranges copied to each."""
    salted = counts.withColumn(
        "__salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
    copies = ranges.withColumn("__salt", F.explode(F.sequence(
        F.lit(0), F.lit(SALTS - 1))))
    both = join_null_safe(salted, copies, [*by, "__salt"], "inner")
    return both.filter(
        (F.col("a").isNull() | (F.col("x") > F.col("a")))
        & (F.col("b").isNull() | (F.col("x") < F.col("b")))).drop("__salt")


def _narrowed(counts: DataFrame, ranks: DataFrame, by):
    """One pass: ranks that met a cut with their value, and the other ranks
    in smaller ranges."""
    seg = [*by, "a", "b"]
    ranges = ranks.select(*seg).distinct()
    share = [i / CUTS for i in range(1, CUTS + 1)]
    finite = F.when(~F.isnan("x"), F.col("x"))
    cuts = _inside(counts, ranges, by).groupBy(*seg).agg(F.array_distinct(
        F.percentile_approx(finite, share, 20 * CUTS)).alias("cuts"))
    cuts = cut_lineage(cuts)
    rows = _inside(counts, cuts, by)
    # Cell 2 k lies between cut k - 1 and cut k (from 0), cell 2 k + 1 is the
    # value of cut k.
    below = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    on = F.array_contains("cuts", F.col("x")).cast("int")
    cells = rows.withColumn("cell", below * 2 + on).groupBy(*seg, "cell").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    # At most 2 x CUTS + 1 rows a range.
    w = Window.partitionBy(*seg).orderBy("cell")
    cells = cells.withColumn("upto", F.sum("n").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = join_null_safe(cells, cuts, seg, "inner")
    found = join_null_safe(ranks.drop("d"), cells, seg, "inner").filter(
        (F.col("rank") < F.col("upto"))
        & (F.col("rank") >= F.col("upto") - F.col("n")))
    k = F.floor(F.col("cell") / 2).cast("int")
    cut_k = F.get("cuts", k)
    found = cut_lineage(found.select(
        *by, "want", "d", (F.col("rank") - F.col("upto") + F.col("n"))
        .alias("rank"), F.when(F.col("cell") % 2 == 1, cut_k).alias("x"),
        F.coalesce(F.get("cuts", k - 1), "a").alias("a"),
        F.coalesce(cut_k, "b").alias("b"), (F.col("cell") % 2).alias("met")))
    return (found.filter("met = 1").select(*by, "want", "x"),
            found.filter("met = 0").select(*seg, "want", "rank", "d"))


def _finished(counts: DataFrame, ranks: DataFrame, by, held: int
              ) -> DataFrame:
    """Values of the ranks: (by, want, x)."""
    # NaN is one value and never cut: the range above the last cut holds it.
    out, ready = None, ranks.filter(F.col("d") <= held)
    wide = ranks.filter(F.col("d") > held)
    while not wide.isEmpty():
        met, left = _narrowed(counts, wide, by)
        out = met if out is None else out.unionByName(met)
        ready = ready.unionByName(left.filter(F.col("d") <= held))
        wide = left.filter(F.col("d") > held)
    ranks, seg = ready, [*by, "a", "b"]
    rows = _inside(counts, ranks.select(*seg).distinct(), by)
    # A range has at most `held` values left.
    w = Window.partitionBy(*seg).orderBy("x")
    rows = rows.withColumn("upto", F.sum("n").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    last = join_null_safe(ranks, rows, seg, "inner").filter(
        (F.col("rank") < F.col("upto"))
        & (F.col("rank") >= F.col("upto") - F.col("n"))) \
        .select(*by, "want", "x")
    return last if out is None else out.unionByName(last)


def summarise(df: DataFrame, by, column: str, probabilities,
              held: int | None = None) -> DataFrame:
    """One row per group: n, min, max, mean and `q`, the exact quantiles in
    the order of `probabilities`, interpolated between neighbours.

    NULL doesn't count; a group without values has n = 0 and NULL elsewhere,
    as has an empty table when `by` is empty. NaN is larger than any number.
    Keys may be NULL. Memory of a task is bounded by `held` distinct values,
    however many rows a group or a value has.
    """
    by, held = list(by), HELD if held is None else max(held, 1)
    keys = by or ["__all"]
    if not by:
        df = df.withColumn("__all", F.lit(1))
    counts = cut_lineage(_counts(df, keys, column))
    known = F.when(F.col("x").isNotNull(), F.col("n"))
    stats = [F.coalesce(F.sum(known), F.lit(0).cast("long")).alias("n"),
             F.min("x").alias("min"), F.max("x").alias("max"),
             F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum(known))
             .alias("mean")]
    sizes = counts.groupBy(*keys).agg(F.count("x").alias("d"),
                                      F.sum(known).alias("total"))
    large = sizes.filter(F.col("d") > held)
    quantiles = F.percentile("x", F.array(*map(F.lit, probabilities)),
                             F.col("n")).alias("q")
    if large.isEmpty():
        return counts.groupBy(*by).agg(*stats, quantiles)

    large = cut_lineage(large)
    small = join_null_safe(counts, large.select(*keys), keys, "left_anti") \
        .groupBy(*keys).agg(*stats, quantiles)
    places = _places(probabilities)
    wants = F.array_distinct(F.array(*[r for _, *lr in places for r in lr]))
    nothing = F.lit(None).cast("double")
    ranks = large.select(*keys, F.explode(wants).alias("want"), "d",
                         nothing.alias("a"), nothing.alias("b")) \
        .withColumn("rank", F.col("want"))
    values = _finished(counts.filter("x IS NOT NULL"), ranks, keys, held)
    # Two values for each probability.
    values = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct("want", "x"))).alias("at"))
    q = []
    for at, lo, hi in places:
        a, b = F.col("at")[lo], F.col("at")[hi]
        q.append(F.when((lo == hi) | (a == b), a)
                 .otherwise((hi - at) * a + (at - lo) * b))
    wide = join_null_safe(large, values, keys, "inner").select(
        *keys, F.array(*q).alias("q"))
    rest = join_null_safe(counts, large.select(*keys), keys, "left_semi") \
        .groupBy(*keys).agg(*stats)
    out = small.unionByName(join_null_safe(rest, wide, keys, "inner"))
    return out.select(*by, "n", "min", "max", "mean", "q")


def quantile(df: DataFrame, column: str, p: float,
             held: int | None = None) -> DataFrame:
    """One row with the exact quantile of a whole column as `q`."""
    return summarise(df, [], column, [p], held).select(F.col("q")[0]
                                                       .alias("q"))
