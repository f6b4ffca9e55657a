"""Best-fit packing by exact-complement hashing over counts of lengths.

Tokenising, numbering and placing run in tasks over narrow rows. What is planned at one place are counts per length, at
most as many as a sequence has tokens: combinations of two, three and four lengths that fill a sequence exactly are
taken under the counts, and best fit places the rest.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajspark.llm.common import WORDS_BYTES, kept, offsets_of, slices
from trajspark.llm.exact import LOCATOR, located
from trajspark.llm.words import LOWER, SPACE, words_of

CAPACITY, END_ID = 2048, 0
#: Words whose ids a task remembers; beyond it, it starts anew.
REMEMBERED = 400_000
#: Classes of bytes between which a tokenizer of words, digits and marks always cuts: ASCII letters, digits and marks;
#: 9: never cut there (the apostrophe belongs to endings, other bytes are looked at by the tokenizer alone).
KIND = np.full(256, 9, np.uint8)
for _b in range(0x21, 0x7F):
    KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 9 if _b == 0x27 else 3
TOGETHER = 256


def cuts(data: np.ndarray) -> np.ndarray:
    """Before which bytes the tokenizer cuts for sure, by the classes of the two bytes around."""
    kind = KIND[data]
    # Letters of two bytes that begin with C3 are letters throughout, but for the two signs.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    out = np.zeros(len(data), bool)
    a, b = kind[:-1], kind[1:]
    out[1:] = (a != 9) & (b != 9) & ((a != b) | (a == 2))
    return out


class Encoder:
    """Ids of texts by a tokenizer that lower-cases, cuts at white space and between letters, digits and marks, and ends
    each such word with tokens of their own (`</w>`): each new word is encoded once, and many at a time.

    Slices that hold a special token's text are encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words and how many each has."""
        groups = [texts[i:i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        flats, sizes = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups],
                                                                     add_special_tokens=False)):
            flat = np.array(e.ids, np.int32)
            last = np.flatnonzero(self.ends[flat]) + 1
            if len(last) != len(group):  # some are more than one word to the tokenizer
                each = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch(group, add_special_tokens=False)]
                flat, last = np.concatenate(each), np.cumsum([len(x) for x in each])
            flats.append(flat)
            sizes.append(np.diff(last, prepend=0))
        return np.concatenate(flats), np.concatenate(sizes)

    def _forget(self):
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes; the number of each word
        self.begin, self.size, self.pool, self.used = (np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64),
                                                       np.zeros(1 << 14, np.int32), 0)

    def _learn(self, keys: np.ndarray, texts: list[str]):
        flat, size = self._words(texts)
        n, m = len(self.known), len(keys)
        for name, need in (("begin", n + m), ("size", n + m), ("pool", self.used + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        self.begin[n:n + m] = self.used + np.cumsum(size) - size
        self.size[n:n + m] = size
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.place = np.insert(self.place, at, np.arange(n, n + m))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts, and where each text begins and the last ends."""
        _, raw = offsets_of(column)
        lower = LOWER[raw].tobytes()
        if any(x in lower for x in self.special):
            ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(
                [x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate(ids), np.cumsum([0, *map(len, ids)])
        w = words_of(column, SPACE, cuts=cuts)
        keys, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~np.isin(keys, self.known, assume_unique=True))
        if len(new):
            raw = w.data.tobytes()
            at = first[new]
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
        word = self.place[np.searchsorted(self.known, keys)][which]
        size = self.size[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.begin[word] - ends[:-1], size)]
        return ids, ends[w.first()]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each worker process: the next task goes on with it."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` tokens of each text and its end: id, piece, start, length, ids_crc32,
    `ids` if asked for, and the piece's number `rank` among those of its length in its partition `part`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", WORDS_BYTES):
            flat, at = encoder.encode(batch.column(1))
            tokens = np.insert(flat, at[1:], END_ID).astype("<u4")
            at = at + np.arange(len(at))
            many = -(-np.diff(at) // capacity)
            doc = np.repeat(np.arange(batch.num_rows), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            begin = at[doc] + piece * capacity
            length = np.minimum(begin + capacity, at[doc + 1]) - begin
            crc = [zlib.crc32(tokens[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(length, minlength=capacity + 1)
            out = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity),
                   pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(rank)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, begin[-1:] + length[-1:]), pa.int32()),
                                                    pa.array(tokens.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint"
    schema += ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)
            .withColumnRenamed("id", id_col))


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just these) over all pieces; there are at most a few for each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []

    def take(*lengths: int) -> bool:
        need = np.bincount(lengths, minlength=capacity + 1)
        k = int((left[need > 0] // need[need > 0]).min())
        if k:
            left[need > 0] -= k * need[need > 0]
            out.append((lengths, k))
        return k > 0

    def pair(total: int, most: int):
        """Two available lengths with this sum, the larger first and at most `most`; the most abundant ones."""
        b = np.arange(max(1, -(-total // 2)), min(most, total - 1) + 1)
        if len(b):
            has = np.where(b == total - b, left[b] // 2, np.minimum(left[b], left[total - b]))
            i = int(has.argmax())
            if has[i]:
                return int(b[i]), int(total - b[i])
        return None

    for a in range(capacity, 0, -1):
        if not left[a]:
            continue
        gap = capacity - a
        if gap == 0 or gap <= a and left[gap]:
            take(*([a, gap] if gap else [a]))
        while left[a] and (found := pair(gap, a)):
            if not take(a, *found):
                break
        for b in np.flatnonzero(left[:min(a, gap) + 1])[::-1].tolist():
            while left[a] and left[b] and (found := pair(gap - b, b)):
                if not take(a, b, *found):
                    break
            if not left[a]:
                break
    open_: dict[int, list[list]] = defaultdict(list)  # space left: [lengths, sequences]
    for a in np.flatnonzero(left)[::-1].tolist():
        n = int(left[a])
        while n and (fits := [r for r in open_ if r >= a]):
            space = min(fits)
            lengths, k = open_[space].pop()
            if not open_[space]:
                del open_[space]
            k, rest = min(k, n), k - min(k, n)
            if rest:
                open_[space].append([lengths, rest])
            open_[space - a].append([(*lengths, a), k])
            n -= k
        each = capacity // a
        for size, k in ((each, n // each), (n % each, 1)):
            if size and k:
                open_[capacity - size * a].append([(a,) * size, k])
    return out + [(tuple(x), k) for xs in open_.values() for x, k in xs]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         with_ids: bool = False, positions: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every piece with its sequence and its place there: id, piece, start, length, ids_crc32 (ids), sequence_id, offset.

    Null and empty texts are one piece with the end alone. Ties between pieces of one length go by their place in the
    input; repeated rows and null ids are packed like others; an empty table gives no piece. Only id and text are read.
    Pieces of a frequent length are numbered in the tasks that cut them, so no length gathers in one task.

    With `positions`, which gives locator and `position` (unique) of each of the located rows, ties go by position
    and piece, equal lengths of a sequence follow each other, and sequences are numbered by their earliest piece. Numbers then come from ranges of
    positions: no length and no order of sequences gathers in one task either.
    """
    spark = docs.sparkSession
    if positions:
        rows = located(docs)
        place_of = kept(positions(rows), "positions")
        step = width(place_of.count())
        named = rows.select(F.struct(F.col(id_col).alias("id"), *LOCATOR).alias("row"), F.col(text_col).alias("text"))
        cut = pieces(named, tokenizer, "row", "text", capacity, with_ids).withColumns(
            {x: F.col(f"row.{x}") for x in ("id", *LOCATOR)})
        cut = cut.join(place_of, LOCATOR).drop("row", "part", "rank", *LOCATOR).withColumnsRenamed({"id": id_col})
        cut = cut.withColumn("part", F.floor(F.col("position") / F.lit(step)))
        order = W.partitionBy("length", "part").orderBy("position", "piece")
        cut = kept(cut.withColumn("rank", (F.row_number().over(order) - 1).cast("long")), "pieces")
    else:
        cut = kept(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n"))
                           .alias("before"))
    many = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity
    used, rows, sequence = defaultdict(int), [], 0
    for lengths, k in combinations(many, capacity):
        offset = 0
        for x, same in groupby(lengths) if positions else ((x, [x]) for x in lengths):
            m = len(list(same))
            rows.append((x << 44 | used[x], sequence, offset, m))
            used[x] += k * m
            offset += x * m
        sequence += k
    plan = spark.sparkContext.broadcast(np.array(sorted(rows), np.int64).reshape(-1, 4))
    numbered = (cut.join(before, ["length", "part"]).withColumn("number", F.col("rank") + F.col("before"))
                .drop("rank", "before", "part"))
    head = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *["position"] * bool(positions)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset, m = plan.value.T
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (len(head), len(head) + 1))
            row = np.searchsorted(key, length << 44 | number, "right") - 1
            after, rank = np.divmod((length << 44 | number) - key[row], m[row])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(head)], pa.array(sequence[row] + after),
                                              pa.array(offset[row] + rank * length)], [*head, "sequence_id", "offset"])

    types = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in head)
    out = numbered.select(*head, F.col("length").alias("__length"), F.col("number").alias("__number")).mapInArrow(
        place, f"{types}, sequence_id bigint, offset bigint")
    return in_order(kept(out, "sequences"), step).drop("position") if positions else out


def width(n: int) -> int:
    """Positions of a range, so that neither the ranges nor the places in one grow in proportion to all."""
    return max(256, int(n ** 0.5))


def in_order(packed: DataFrame, step: int) -> DataFrame:
    """The same pieces, with sequences numbered anew in the order of their earliest piece."""
    first = packed.groupBy("sequence_id").agg(F.min(F.struct("position", "piece")).alias("first"))
    first = kept(first.withColumn("part", F.floor(F.col("first.position") / F.lit(step))), "firsts")
    counts = sorted(first.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one for each range
    before = dict(zip([r["part"] for r in counts], np.cumsum([0] + [r["n"] for r in counts]).tolist()))
    before = first.sparkSession.createDataFrame(list(before.items()), "part bigint, before bigint")
    rank = F.row_number().over(W.partitionBy("part").orderBy("first"))
    new = first.withColumn("r", rank).join(before, "part").select(
        "sequence_id", (F.col("r") - 1 + F.col("before")).alias("__new"))
    return packed.join(new, "sequence_id").withColumn("sequence_id", F.col("__new")).select(*packed.columns)
