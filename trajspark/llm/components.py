"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import kept


def _state(edges: DataFrame):
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(h)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges` (a, b): the smallest id that links reach.

    Each round keeps at most as many edges as there were. Neighbours are reduced to their minimum before the shuffle
    and never gathered; the joins with these minima have one row per node, so a hot node's edges can be split. Ends
    when a round changes nothing. An edge from a node to itself, or with a null, says nothing and is left out.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(),
                 "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.where("a > b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            low.select("a", F.col("m").alias("b"))).distinct()
        edges = kept(small, "edges")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
