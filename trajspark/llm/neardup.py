"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import kept
from trajspark.llm.components import components

COSINE = 0.93
#: A pair at just the threshold is missed with at most this probability.
MISS = 1e-5
#: Vectors of a label that share a bucket by chance, about; rows of one tile of a bucket.
CHANCE, TILE = 16, 512


def plan(largest: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables for labels of at most `largest` vectors."""
    bits = max(4, math.ceil(math.log2(max(largest, 2) / CHANCE)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return min(bits, 31), math.ceil(math.log(miss) / math.log1p(-same))


def links_of_tile(ids, weight, x, signs, side, table, cosine):
    """Of a tile, or two: the weight of new links of each row, and each row's smallest linked id within the tile."""
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    near = x[a] @ x[b].T >= cosine
    near &= ids[a][:, None] != ids[b][None, :]
    i, j = np.nonzero(near)
    fresh = ~(signs[a[i], :table] == signs[b[j], :table]).any(1)  # not met in an earlier table
    count = np.zeros(len(ids))
    np.add.at(count, a[i[fresh]], weight[b[j[fresh]]])
    if b is not a:
        np.add.at(count, b[j[fresh]], weight[a[i[fresh]]])
    root = np.arange(len(ids))
    while len(i):  # smallest row that links reach
        low = np.minimum(root[a[i]], root[b[j]])
        new = root.copy()
        np.minimum.at(new, a[i], low)
        np.minimum.at(new, b[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return count.astype(np.int64), ids[root]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, seed: int = 0) -> DataFrame:
    """One row per vector: id, n_links, component_id (the smallest id that links reach) and kept.

    Vectors are compared if their labels and sizes are equal and the label isn't null. Null, empty and zero vectors and
    those with null or non-finite components link with nothing; each is its own component. Rows that repeat id, label
    and vector are one vector; ids are taken to be unique otherwise. Equal vectors count as one while searching. Each
    bucket is compared in tiles, each pair counted in the first table in which it meets; tasks return sums and
    spanning links, never all pairs. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          F.col(label_col).alias("label")).distinct()
    sound = (F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull()
             & F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
             & F.exists("v", lambda y: y != 0))
    rows = kept(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    one = rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    one = kept(one.withColumn("place", F.xxhash64("label", F.size("v"))), "distinct")
    largest = one.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, cosine)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(1)
            size = np.diff(v.offsets.to_numpy())
            flat, at = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
            out = np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(size).tolist():
                h = planes.setdefault(d, np.random.default_rng([seed, d]).normal(size=(d, tables * bits)))
                here = np.flatnonzero(size == d)
                x = flat[at[here][:, None] + np.arange(d)]
                side = ((x / np.abs(x).max(1, keepdims=True)) @ h > 0).reshape(len(here), tables, bits)
                out[here] = side @ (1 << np.arange(bits)).astype(np.int32)
            signs = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables, pa.int32()),
                                             pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], ["place", "v", "rep", "n", "signs"])

    signed = kept(one.select("place", "v", "rep", "n").mapInArrow(
        sign, f"place bigint, v array<double>, rep {kind}, n bigint, signs array<int>"), "signed")
    bucket = ["place", "tbl", "sign"]
    narrow = signed.select("place", F.posexplode("signs").alias("tbl", "sign"))
    large = narrow.groupBy(*bucket).count().where(F.col("count") > TILE).select(
        *bucket, F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    put = signed.select("place", "v", "rep", "n", "signs", F.posexplode("signs").alias("tbl", "sign")).join(
        large, bucket, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    put = put.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), "tiles").cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    put = put.select(*bucket, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "n", "v", "signs")
    group = [*bucket, "one", "two"]
    put = put.repartition(*group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(t: pa.Table):
            keys = np.stack([t[c].to_numpy() for c in group])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [t.num_rows]])
            ids, n, side = (t[c].to_numpy() for c in ("rep", "n", "side"))
            v = t["v"].combine_chunks()
            flat, at = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(v.offsets.to_numpy()))])
            signs = t["signs"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2 or keys[3, a] != keys[4, a] and len(np.unique(side[a:b])) < 2:
                    continue
                x = flat[at[a]:at[b]].reshape(b - a, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                count, root = links_of_tile(ids[a:b], n[a:b], x, signs[a:b], side[a:b], int(keys[1, a]), cosine)
                hit = np.flatnonzero((count > 0) | (root != ids[a:b]))
                out.append((ids[a:b][hit], count[hit], root[hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)],
                                                 ["id", "n", "root"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest else t
            last = {c: t[c][-1] for c in group}  # the last group may go on in the next batch
            same = np.all([t[c].to_numpy() == last[c].as_py() for c in group], axis=0)
            cut = int(np.argmax(same))
            rest = t.slice(cut)
            if cut:
                yield from work(t.slice(0, cut).combine_chunks())
        if rest:
            yield from work(rest.combine_chunks())

    found = kept(put.mapInArrow(compare, f"id {kind}, n bigint, root {kind}"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("links")).withColumnRenamed("id", "rep")
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (one.join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
             .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    good = rows.where("sound").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    bad = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("id").alias(id_col), "n_links", "component_id",
                                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
