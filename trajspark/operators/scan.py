"""Ordered calculations within keys, for keys of any size.

`PLAIN` writes ordinary windows: one shuffle by key, one sort, everything in a
single pass. It needs the rows of a key to fit one task.

`CHUNKED` computes the same columns when a single key may hold a large part of
the table. Rows are range-partitioned by (key, order), so Spark splits a hot
key over many tasks; windows run inside a chunk, one summary row per (key,
chunk) carries the running state, and the carried state is joined back.

`choose_scan` and `by_key` count rows per key, and only keys with more than
`HOT_ROWS` rows take the chunked path. Both paths give the same rows, for a
null key too, so the limit is a matter of speed alone. Operators are written
against the common interface and do not know on which they run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.columns import col
from trajspark.session import cut_lineage

HOT_ROWS = 2_000_000


def join_null_safe(df: DataFrame, other: DataFrame, keys, how: str = "left"
                   ) -> DataFrame:
    """Join on keys of which null equals null; `other` adds its rest."""
    other = other.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(other, on, how).drop(*[f"__k_{k}" for k in keys])


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column
    n: int = 1


def lag(c, n: int = 1) -> Spec:
    return Spec("lag", col(c), n)


def lead(c, n: int = 1) -> Spec:
    return Spec("lead", col(c), n)


def running_sum(c) -> Spec:
    """Sum from the first row of the key up to this row."""
    return Spec("sum", col(c))


def remaining_sum(c) -> Spec:
    """Sum from this row to the last row of the key."""
    return Spec("rsum", col(c))


def last_known(c) -> Spec:
    """Forward fill: latest non-null value up to this row."""
    return Spec("ffill", col(c))


def next_known(c) -> Spec:
    """Backward fill: first non-null value from this row on."""
    return Spec("bfill", col(c))


def _from_here(column: str, w) -> Column:
    """First non-null value of a column from this row on. A frame that begins
    here and ends with the key would be read again for every row."""
    return F.coalesce(F.col(column),
                      F.expr(f"lead(`{column}`) IGNORE NULLS").over(w))


def _reversed(part):
    """The rows from the last one of `part` up to this one, by `__rn`."""
    return Window.partitionBy(*part).orderBy(F.col("__rn").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)


class PlainScan:
    """Window functions over whole keys."""

    def add(self, df: DataFrame, keys, order, **specs: Spec) -> DataFrame:
        given = df.columns
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        ahead = {f"__v_{n}": s.value for n, s in specs.items()
                 if s.kind == "bfill"}
        df = df.withColumns(ahead) if ahead else df
        cols = {}
        for name, s in specs.items():
            if s.kind == "lag":
                c = F.lag(s.value, s.n).over(w)
            elif s.kind == "lead":
                c = F.lead(s.value, s.n).over(w)
            elif s.kind == "sum":
                c = F.sum(s.value).over(upto)
            elif s.kind == "rsum":
                c = s.value
            elif s.kind == "ffill":
                c = F.last(s.value, ignorenulls=True).over(upto)
            else:
                c = _from_here(f"__v_{name}", w)
            cols[name] = c
        back = {n: F.sum(n).over(_reversed(keys))
                for n, s in specs.items() if s.kind == "rsum"}
        if back:
            df = df.withColumns(
                cols | {"__rn": F.row_number().over(w)}).withColumns(back)
        else:
            df = df.withColumns(cols)
        new = [n for n in specs if n not in given]
        return df.select(*given, *new)

    def group(self, df: DataFrame, keys, order=(), **aggs: Column
              ) -> DataFrame:
        """Aggregates of a key on each of its rows. `order` changes no value;
        it names the sort that neighbouring scans need anyway, so that one
        sort serves all of them."""
        w = Window.partitionBy(*keys)
        if order:
            w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                              Window.unboundedFollowing)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})

    def cluster(self, df: DataFrame, keys) -> DataFrame:
        """Bring keys together once, ahead of aggregates and windows that
        would otherwise each ask for their own shuffle."""
        return df.repartition(*keys)


class ChunkedScan:
    """The same columns with a key spread over range-partitioned chunks."""

    def __init__(self, chunks: int | None = None):
        self.chunks = chunks

    def _chunk(self, df: DataFrame, keys, order) -> DataFrame:
        conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
        n = self.chunks or max(int(conf), 2)
        ordered = [F.col(k).asc_nulls_first() for k in keys]
        for o in order:
            ordered.append(o if isinstance(o, Column)
                           else F.col(o).asc_nulls_first())
        cut = df.repartitionByRange(n, *ordered) \
            .withColumn("__chunk", F.spark_partition_id())
        # The chunk number is written down before use: a lost executor
        # cannot change it.
        return cut_lineage(cut)

    def add(self, df: DataFrame, keys, order, **specs: Spec) -> DataFrame:
        given = df.columns
        tmp = {f"__v_{n}": s.value for n, s in specs.items()}
        df = self._chunk(df.withColumns(tmp), keys, order)
        part = [*keys, "__chunk"]
        w = Window.partitionBy(*part).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = w.rowsBetween(Window.unboundedPreceding,
                              Window.unboundedFollowing)

        near = max([s.n for s in specs.values()
                    if s.kind in ("lag", "lead")], default=0)
        cols, back = {}, {}
        carried = []
        for name, s in specs.items():
            v = F.col(f"__v_{name}")
            if s.kind == "lag":
                cols[f"__in_{name}"] = F.lag(v, s.n).over(w)
            elif s.kind == "lead":
                cols[f"__in_{name}"] = F.lead(v, s.n).over(w)
            elif s.kind == "sum":
                cols[f"__in_{name}"] = F.sum(v).over(upto)
            elif s.kind == "rsum":
                back[f"__in_{name}"] = F.sum(v).over(_reversed(part))
            elif s.kind == "ffill":
                cols[f"__in_{name}"] = F.last(v, ignorenulls=True).over(upto)
                cols[f"__e_{name}"] = F.last(v, ignorenulls=True).over(whole)
                carried.append(F.any_value(f"__e_{name}").alias(f"__c_{name}"))
            else:
                cols[f"__in_{name}"] = _from_here(f"__v_{name}", w)
                cols[f"__e_{name}"] = F.first(v, ignorenulls=True).over(whole)
                carried.append(F.any_value(f"__e_{name}").alias(f"__c_{name}"))
            if s.kind in ("sum", "rsum"):
                carried.append(F.sum(v).alias(f"__c_{name}"))
        if near or back:
            cols["__rn"] = F.row_number().over(w)
        if near:
            cols["__n"] = F.count(F.lit(1)).over(whole)
            for name, s in specs.items():
                v = F.struct(F.col("__rn"), F.col(f"__v_{name}").alias("v"))
                if s.kind == "lag":
                    edge = F.col("__rn") > F.col("__n") - s.n
                elif s.kind == "lead":
                    edge = F.col("__rn") <= s.n
                else:
                    continue
                # At most n rows per chunk are collected.
                carried.append(F.array_sort(F.collect_list(F.when(edge, v)))
                               .alias(f"__c_{name}"))
        inside = df.withColumns(cols)
        inside = inside.withColumns(back) if back else inside
        summary = inside.groupBy(*part).agg(
            F.count(F.lit(1)).alias("__rows"), *carried)

        over = Window.partitionBy(*keys).orderBy("__chunk")
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        after = over.rowsBetween(1, Window.unboundedFollowing)
        state = []
        for name, s in specs.items():
            c = F.col(f"__c_{name}")
            if s.kind == "sum":
                e = F.sum(c).over(before)
            elif s.kind == "rsum":
                e = F.sum(c).over(after)
            elif s.kind == "ffill":
                e = F.last(c, ignorenulls=True).over(before)
            elif s.kind == "bfill":
                e = F.first(c, ignorenulls=True).over(after)
            elif s.kind == "lag":
                # Every chunk has a row, so n chunks hold the n rows needed.
                e = F.flatten(F.collect_list(c).over(over.rowsBetween(-s.n,
                                                                      -1)))
            else:
                e = F.flatten(F.collect_list(c).over(over.rowsBetween(1,
                                                                      s.n)))
            state.append(e.alias(f"__s_{name}"))
        state = summary.select(*part, *state)

        joined = join_null_safe(inside, state, part)
        out = {}
        for name, s in specs.items():
            here, past = F.col(f"__in_{name}"), F.col(f"__s_{name}")
            if s.kind in ("sum", "rsum"):
                out[name] = F.when(
                    here.isNotNull() | past.isNotNull(),
                    F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)))
            elif s.kind in ("ffill", "bfill"):
                out[name] = F.coalesce(here, past)
            elif s.kind == "lag":
                # -1 is the nearest row before the chunk.
                back = F.least(F.col("__rn") - s.n - 1, F.lit(-1))
                out[name] = F.when(F.col("__rn") > s.n, here).otherwise(
                    F.try_element_at(past, back.cast("int"))["v"])
            else:
                fwd = F.col("__rn") + s.n - F.col("__n")
                at = F.greatest(fwd, F.lit(1)).cast("int")
                out[name] = F.when(fwd <= 0, here).otherwise(
                    F.try_element_at(past, at)["v"])
        keep = [c for c in given if c not in out]
        return joined.withColumns(out).select(*keep, *out)

    def cluster(self, df: DataFrame, keys) -> DataFrame:
        """A hot key is never gathered."""
        return df

    def group(self, df: DataFrame, keys, order=(), **aggs: Column
              ) -> DataFrame:
        df = cut_lineage(df)
        per = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
        return join_null_safe(df.drop(*aggs), per, list(keys))


class SplitScan:
    """Plain windows for most keys, chunks for the given hot ones.

    `keys` are the columns of `hot`; the keys of a calculation contain them.
    """

    def __init__(self, hot: DataFrame, keys, chunks: int | None = None):
        self.hot, self.keys = hot, list(keys)
        self.chunked = ChunkedScan(chunks)

    def _both(self, df: DataFrame, fn) -> DataFrame:
        cold = join_null_safe(df, self.hot, self.keys, "left_anti")
        warm = join_null_safe(df, self.hot, self.keys, "left_semi")
        return fn(PLAIN, cold).unionByName(fn(self.chunked, warm))

    def add(self, df: DataFrame, keys, order, **specs: Spec) -> DataFrame:
        if not set(self.keys) <= set(keys):
            return self.chunked.add(df, keys, order, **specs)
        return self._both(df, lambda s, d: s.add(d, keys, order, **specs))

    def group(self, df: DataFrame, keys, order=(), **aggs: Column
              ) -> DataFrame:
        return self.chunked.group(df, keys, order, **aggs)

    def cluster(self, df: DataFrame, keys) -> DataFrame:
        return df


PLAIN = PlainScan()
CHUNKED = ChunkedScan()
# Tables found to have no hot key, so that a report that uses one table many
# times counts it once. A stale entry costs speed, no rows.
_COLD: set[tuple] = set()


def hot_keys(dfs, keys, limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows, or None."""
    dfs = [d.select(*keys) for d in dfs]
    seen = (dfs[0].sparkSession.sparkContext.applicationId, limit,
            *[d.semanticHash() for d in dfs])
    if seen in _COLD:
        return None
    counts = dfs[0]
    for d in dfs[1:]:
        counts = counts.unionByName(d)
    hot = (counts.groupBy(*keys).count().filter(F.col("count") > limit)
           .select(*keys))
    if hot.isEmpty():
        _COLD.add(seen)
        return None
    return cut_lineage(hot)


def by_key(fn, dfs, keys, limit: int | None = None,
           chunks: int | None = None) -> DataFrame:
    """Run `fn(scan, *dfs)`, with hot keys on the chunked path.

    `fn` must treat keys independently, so running it on two disjoint sets of
    keys and joining the results up is the same as running it once.
    """
    dfs = list(dfs)
    hot = hot_keys(dfs, keys, limit or HOT_ROWS)
    if hot is None:
        return fn(PLAIN, *dfs)
    cold = [join_null_safe(d, hot, keys, "left_anti") for d in dfs]
    warm = [join_null_safe(d, hot, keys, "left_semi") for d in dfs]
    return fn(PLAIN, *cold).unionByName(fn(ChunkedScan(chunks), *warm))


def choose_scan(dfs, keys, limit: int | None = None,
                chunks: int | None = None):
    """One scan for a whole job over these tables: plain windows, and chunks
    for just the keys that are too large for a task."""
    hot = hot_keys(list(dfs), keys, limit or HOT_ROWS)
    return PLAIN if hot is None else SplitScan(hot, keys, chunks)


def add_by_key(df: DataFrame, keys, order, scan=None, **specs: Spec
               ) -> DataFrame:
    """Ordered columns with the scan chosen by the size of the keys."""
    if scan is not None:
        return scan.add(df, keys, order, **specs)
    return by_key(lambda s, d: s.add(d, keys, order, **specs), [df], keys)
