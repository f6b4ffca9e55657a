"""Mixing sources to target weights by Pfair scheduling: blocks with release times and deadlines, the earliest first.

Block j of a source of weight w may start at slot floor(j / w) and must end by ceil((j + 1) / w). Taking the released
block with the earliest deadline meets all of them, so that after any t slots a source has had w * t blocks, give or
take less than one. Weights are exact: releases and deadlines are worked out in whole numbers of any size, so nothing
drifts however many slots there are. A phase ends when a source has no block left. What is scheduled at one place are
blocks, not documents: 8 bytes each, and none in phases of a single source.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajspark.llm.common import kept
from trajspark.llm.exact import LOCATOR, located

#: Documents of a block; slots of a period where weights are rounded to one.
BLOCK, PERIOD = 16, 1000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as integers of at least 1 that add up to the period, or to the number of sources if that is more."""
    names, total = sorted(weights), sum(weights.values())
    period = max(period, len(names))
    exact = {s: weights[s] / total * period for s in names}
    out = {s: max(1, int(exact[s])) for s in names}
    left = period - sum(out.values())
    while left:
        step = 1 if left > 0 else -1  # there are more slots than sources if some are to go back
        able = [s for s in names if out[s] + step >= 1]
        for s in sorted(able, key=lambda s: (step * (out[s] - exact[s]), s))[:abs(left)]:
            out[s] += step
            left -= step
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The same weights, unrounded, as whole numbers in the same proportions."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in parts.values()))
    out = {s: int(x * common) for s, x in parts.items()}
    divisor = math.gcd(*out.values())
    return {s: a // divisor for s, a in out.items()}


def dealt(share: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end: of the released blocks the one with the earliest deadline."""
    total = sum(share.values())
    # A source's next block alone competes: (release, source) until released, then (deadline, source).
    waiting, ready, seen, t = [(0, s) for s in sorted(share)], [], dict.fromkeys(share, 0), 0
    while True:
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-((seen[s] + 1) * -total // share[s]), s))
        s = heapq.heappop(ready)[1]
        yield s
        seen[s] += 1
        heapq.heappush(waiting, (seen[s] * total // share[s], s))
        t += 1


def pfair(share: dict[str, int]) -> list[str]:
    """The source of each slot of one period."""
    return list(islice(dealt(share), sum(share.values())))


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None):
    """(source, first block, first slot, slots after that of its blocks) of each source and phase.

    Weights are taken as they are, or rounded to shares of a period. Slots are left out, None, where one source is alone.
    """
    left, done, slot, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while left := {s: n for s, n in left.items() if n}:
        live = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or {s: blocks[s] for s in left}
        if len(live) == 1:
            s = next(iter(live))
            out.append((s, done[s], slot, None))
            slot, left[s] = slot + left[s], 0
            continue
        places = {s: array("q") for s in live}
        for t, s in enumerate(dealt(shares(live, period) if period else whole(live))):
            if len(places[s]) == left[s]:
                break
            places[s].append(t)
        for s, p in places.items():
            if len(p):
                out.append((s, done[s], slot, np.array(p, np.int64)))
            left[s] -= len(p)
            done[s] += len(p)
        slot += t
    return out


def label(source: Column) -> Column:
    """A source as text; null is a source of its own."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, keys: list[str] | None = None,
             source_col: str = "source", block: int = BLOCK, period: int | None = None, seed: int = 0,
             by: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: its `keys`, source, `number` within the source, `block`, `slot` and `position`.

    Documents are numbered in a seeded random order (by a hash of the keys, or of those in `by`, and then by the keys;
    repeated rows tie and may swap). Without
    weights, sources weigh the square root of their documents. Sources without a weight, or with 0, come after all
    others, in proportion to their size; weights of sources without documents are left out. Once a source ends, the
    others go on by their weights, so every document gets a place. A null source is a source. Weights are exact; with a
    `period`, they are rounded to shares of it. Counts per source and slots of blocks are at one place; numbers come from counts of hash buckets, so no source gathers in a task. An empty table gives none.
    """
    keys = keys or ["doc_id"]
    rows = docs.select(*keys, F.col(source_col).alias("source"), label(F.col(source_col)).alias("__s"))
    count = {r["__s"]: r["n"] for r in rows.groupBy("__s").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = {s: n ** 0.5 for s, n in count.items()} if weights is None else {
        "null" if s is None else f"={s}": w for s, w in weights.items() if w > 0}
    plan = phases({s: -(-n // block) for s, n in count.items()}, {s: w for s, w in target.items() if s in count}, period)
    held = docs.sparkSession.sparkContext.broadcast(plan)  # 8 bytes for each block
    buckets = F.create_map(*(F.lit(x) for s, n in count.items() for x in (s, max(1, n // max(256, int(n ** 0.5))))))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(by or keys)), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("__u", unit).withColumn(
        "__b", F.floor(F.col("__u") * (F.try_element_at(buckets, "__s") if count else F.lit(1))))
    each = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("n"))
    each = each.select("__s", "__b", (F.sum("n").over(W.partitionBy("__s").orderBy("__b")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("__s", "__b").orderBy("__u", *keys)))
    ranked = ranked.join(each, ["__s", "__b"]).withColumn("number", F.col("r") + F.col("before") - 1)
    ranked = ranked.select(*keys, "source", "number", "__s")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list] = {}
        for s, first, begin, places in held.value:
            of.setdefault(s, []).append((first, begin, places))
        for batch in batches:
            number = batch.column(len(keys) + 1).to_numpy()
            name = batch.column(len(keys) + 2).to_numpy(zero_copy_only=False)
            slot = np.zeros(len(number), np.int64)
            for s in set(name.tolist()):
                here = np.flatnonzero(name == s)
                j = number[here] // block
                starts = np.array([x[0] for x in of[s]])
                phase = np.searchsorted(starts, j, "right") - 1
                for p in np.unique(phase).tolist():
                    first, begin, places = of[s][p]
                    k = j[phase == p] - first
                    slot[here[phase == p]] = begin + (k if places is None else places[k])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(number // block), pa.array(slot), pa.array(slot * block + number % block)],
                [*batch.schema.names[:-1], "block", "slot", "position"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(put, f"{kinds}, block bigint, slot bigint, position bigint")


def placed(rows: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id",
           source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """Locator and `position` of each of the located rows. The order goes by the id alone, so that it is the same wherever
    the rows are stored; the locator only breaks ties of repeated ids."""
    return schedule(rows, weights, [id_col, *LOCATOR], source_col, block, by=[id_col]).select(*LOCATOR, "position")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id",
          source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """`docs`, all rows and columns, in the order of `placed`: partition by partition and row by row."""
    rows = located(docs)
    places = kept(placed(rows, weights, id_col, source_col, block), "places")
    out = rows.join(places.withColumnRenamed("position", "__position"), LOCATOR)
    return out.repartitionByRange("__position").sortWithinPartitions("__position").select(*docs.columns)
