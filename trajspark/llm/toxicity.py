"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy.

A word's vector is the sum of hashed rows: two for the word, so that a rare word that shares one of them with a telling
word isn't mistaken for it, and one for each of its beginnings of 5 to 9 bytes, since inflected and compound words are
mostly unseen. Filters of one to three words run over the whole text; of each filter the largest response counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm.common import WORDS_BYTES, kept, offsets_of, slices
from trajspark.llm.jaccard import bitmap
from trajspark.llm.words import PUNCTUATION, U, words_of
from trajspark.operators.scan import add_by_key, lag, running_sum

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
PREFIXES = (5, 6, 7, 8, 9)
#: Labels of a shard, until there are so many shards; beyond that shards grow with the labels.
ROWS, SHARDS = 8192, 256
#: Documents and bytes of text, or one document, that a shard learns from in random order before it goes on to the next.
WINDOW, WINDOW_BYTES = 4096, 8 << 20
#: Rows of the embedding that are averaged together.
PART = 2048
CUT = 0.5
#: Places whose windows are worked out at once. No result depends on it.
PLACES = 1 << 14


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed rows of each word, one column per word, and the index of each text's first word."""
    w = words_of(column, PUNCTUATION)
    low = U(BUCKETS // 2 - 1)
    rows = [w.hash & low, ((w.hash >> U(32)) & low) + U(BUCKETS // 2)]
    for size in PREFIXES:
        h = w.prefix(size)
        rows.append(np.where(h > 0, (h & U(BUCKETS - 1)) + U(BUCKETS), U(2 * BUCKETS)))  # the last row is zero
    return np.array(rows).astype(np.int32).reshape(len(rows), -1), w.first()


def buckets_of(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """`buckets` of a batch's texts, worked out for a few at a time."""
    at = batch.schema.get_field_index(text)
    ids, firsts = zip(*(buckets(part.column(at)) for part in slices([batch], text, WORDS_BYTES)))
    begin = np.cumsum([0] + [x.shape[1] for x in ids])
    return np.hstack(ids), np.concatenate([*(f[:-1] + b for f, b in zip(firsts, begin)), begin[-1:]])


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray   # DIM x (width, place in the window, filter)
    bias: np.ndarray
    weight: np.ndarray
    intercept: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 0) -> Model:
        r = np.random.default_rng(seed)
        many = len(WIDTHS) * FILTERS
        rows = r.normal(0, 0.05, (2 * BUCKETS + 1, DIM)).astype(np.float32)
        rows[-1] = 0
        return cls(rows,
                   r.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32), np.zeros(many, np.float32),
                   np.full(many, 0.3, np.float32), 0.0)

    def placed(self, ids, first):
        """The words' vectors, some places apart between texts; where each text begins, and the place of each word."""
        rows, pad = len(first) - 1, max(WIDTHS) - 1
        size = np.diff(first)
        begin = first[:-1] + pad * np.arange(rows)
        place = np.arange(ids.shape[1]) + np.repeat(pad * np.arange(rows), size)
        word = self.embedding[ids[0]]
        for k in ids[1:]:
            word += self.embedding[k]
        x = np.zeros((ids.shape[1] + pad * rows + pad, DIM), np.float32)
        x[place] = word
        return x, begin, place

    def responses(self, x) -> np.ndarray:
        """Of every filter in the window that begins at each place but the last ones."""
        y = x @ self.filters
        n, at, out = len(x) - max(WIDTHS) + 1, 0, []
        for w in WIDTHS:
            total = y[:n, at:at + FILTERS].copy()
            for k in range(1, w):
                total += y[k:k + n, at + k * FILTERS:at + (k + 1) * FILTERS]
            out.append(total)
            at += w * FILTERS
        return np.hstack(out)

    def pooled(self, ids, first):
        """Largest response of every filter in every text, and the word where it begins (in padded places)."""
        x, begin, place = self.placed(ids, first)
        z = self.responses(x)
        if not len(begin):
            return np.zeros((0, z.shape[1]), np.float32), x, z, begin, place
        return np.maximum.reduceat(z, begin, axis=0), x, z, begin, place

    def strongest(self, x, begin):
        """Largest response of every filter in every text, and the padded place where it first begins."""
        pad = max(WIDTHS) - 1
        n = len(x) - pad
        top = np.full((len(begin), len(self.bias)), -np.inf, np.float32)
        top_at = np.zeros(top.shape, np.int64)
        for lo in range(0, n, PLACES):
            hi = min(lo + PLACES, n)
            z = self.responses(x[lo:hi + pad])
            for i in range(np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi)):
                a, b = max(begin[i], lo) - lo, (min(begin[i + 1], hi) if i + 1 < len(begin) else hi) - lo
                at = z[a:b].argmax(0)
                here = z[a + at, np.arange(len(at))]
                more = here > top[i]
                top[i, more], top_at[i, more] = here[more], (at + a + lo)[more]
        return top, top_at

    def scores(self, ids, first) -> np.ndarray:
        x, begin, _ = self.placed(ids, first)
        pad = max(WIDTHS) - 1
        n = len(x) - pad
        top = np.full((len(begin), len(self.bias)), -np.inf, np.float32)
        for lo in range(0, n, PLACES):
            hi = min(lo + PLACES, n)
            here = slice(np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi))
            z = self.responses(x[lo:hi + pad])
            top[here] = np.maximum(top[here], np.maximum.reduceat(z, np.maximum(begin[here], lo) - lo, axis=0))
        top = np.maximum(top + self.bias, 0)
        return 1 / (1 + np.exp(-(top @ self.weight + self.intercept).astype(np.float64)))


class Learner:
    """A model that learns: Adagrad on log loss."""

    def __init__(self, model: Model):
        self.model, self.intercept = model, np.zeros(1)
        self.speed = [np.full_like(x, 1e-3) for x in (model.embedding, *self.dense())]

    def dense(self) -> list[np.ndarray]:
        m = self.model
        return [m.filters, m.bias, m.weight, self.intercept]

    def state(self) -> np.ndarray:
        """All but the embedding and its speed, as one array."""
        return np.concatenate([x.ravel() for x in (*self.dense(), *self.speed[1:])]).astype(np.float64)

    def resume(self, state: np.ndarray) -> None:
        at = 0
        for x in (*self.dense(), *self.speed[1:]):
            x[...] = state[at:at + x.size].reshape(x.shape)
            at += x.size
        self.model.intercept = float(self.intercept[0])

    def copy(self) -> Learner:
        out = Learner.__new__(Learner)
        m = self.model
        out.model = Model(m.embedding.copy(), m.filters.copy(), m.bias.copy(), m.weight.copy(), m.intercept)
        out.intercept, out.speed = self.intercept.copy(), [x.copy() for x in self.speed]
        return out

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray, batch: int = 32,
              rate: float = 0.08) -> None:
        """One pass over the texts in this order."""
        m, speed = self.model, self.speed

        def move(x, speed, grad, rows=...):
            speed[rows] += grad ** 2
            x[rows] -= rate * grad / np.sqrt(speed[rows])

        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            ids = np.hstack([texts[i] for i in part])
            first = np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in part])])
            x, begin, place = m.placed(ids, first)
            top, top_at = m.strongest(x, begin)
            live = top + m.bias > 0
            act = np.where(live, top + m.bias, 0)
            p = 1 / (1 + np.exp(-(act @ m.weight + m.intercept)))
            out = ((p - labels[part]) / len(part)).astype(np.float32)
            back = out[:, None] * m.weight * live
            g_filters, where, grads, at = np.zeros_like(m.filters), [], [], 0
            for j, w in enumerate(WIDTHS):
                f = slice(j * FILTERS, (j + 1) * FILTERS)
                for k in range(w):
                    c = slice(at + k * FILTERS, at + (k + 1) * FILTERS)
                    here = top_at[:, f] + k
                    g_filters[:, c] = (x[here] * back[:, f, None]).sum(0).T
                    where.append(here.ravel())
                    grads.append((m.filters[:, c].T * back[:, f, None]).reshape(-1, DIM))
                at += w * FILTERS
            places, which = np.unique(np.concatenate(where), return_inverse=True)
            g = np.zeros((len(places), DIM), np.float32)
            np.add.at(g, which, np.concatenate(grads))
            word = np.searchsorted(place, places)
            hit = np.flatnonzero((np.append(place, -1)[word] == places) & (np.abs(g).sum(1) != 0))  # none between texts
            for k in ids:
                rows, which = np.unique(k[word[hit]], return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, which, g[hit])
                move(m.embedding, speed[0], grad, rows)
            m.embedding[-1] = 0
            move(m.filters, speed[1], g_filters)
            move(m.weight, speed[3], act.T @ out)
            move(m.bias, speed[2], back.sum(0))
            move(self.intercept, speed[4], np.array([out.sum()]))
            m.intercept = float(self.intercept[0])


def packed(docs: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """Documents (id, text, lang) with their text compressed: all whose id is in `known`, and few others."""
    bits = 1 << min(27, max(15, 4 + count.bit_length()))  # 16 MB at most
    held = docs.sparkSession.sparkContext.broadcast(bitmap(known, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for k, b in held.value.items():
            flags[(k - 1) * 32768:k * 32768] = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[:bits]
        for batch in batches:
            place = batch.column(3).to_numpy()
            for part in slices([batch.filter(pa.array(flags[place]))], "text"):
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(x) for x in texts], pa.int64()),
                     pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in texts], pa.binary())],
                    ["id", "lang", "size", "packed"])

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("lang", T.StringType()),
                           T.StructField("size", T.LongType()), T.StructField("packed", T.BinaryType())])
    return docs.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(bits))).mapInArrow(run, schema)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts in the place of size and packed bytes, `WORDS_BYTES` at a time, or one row."""
    for batch in batches:
        size = batch.column(0).to_numpy()
        ends = np.append(0, np.cumsum(size))
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS_BYTES, "right")) - 1)
            texts = [pa.decompress(x.as_buffer(), int(n), codec="zstd", asbytes=True) if n else b""
                     for x, n in zip(batch.column(1)[lo:hi], size[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).view(pa.string()), *batch.slice(lo, hi - lo).columns[2:]],
                                             ["text", *batch.schema.names[2:]])
            lo = hi


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Words and labels of the rows that a shard learns from together, in an order that depends on them alone."""
    texts, labels, held = [], [], 0

    def window():
        y = np.array(labels)
        order = np.lexsort([[zlib.crc32(x.tobytes()) for x in texts], y])
        return [texts[i] for i in order], y[order]

    for batch in unpacked(batches):
        size = np.diff(offsets_of(batch.column(0))[0])
        ids, first = buckets(batch.column(0))
        for i, label in enumerate(batch.column(1).to_pylist()):
            if texts and (len(texts) == WINDOW or held + size[i] > WINDOW_BYTES):
                yield window()
                texts, labels, held = [], [], 0
            texts.append(ids[:, first[i]:first[i + 1]])
            labels.append(label)
            held += size[i]
    if texts:
        yield window()


SENT = "part int, shard int, rows binary, cells binary"


def sent(rows: np.ndarray, cells: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """What a shard sends: cells of some rows of the embedding, by parts of it, and `rest` as one more part."""
    cut = np.searchsorted(rows, np.arange(0, 2 * BUCKETS + 1 + PART, PART))
    found = [(-1, np.zeros(1, np.int32).tobytes(), rest.tobytes())]
    found += [(i, rows[a:b].astype(np.int32).tobytes(), cells[a:b].tobytes())
              for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
    part, at, values = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(part), pa.int32()),
         pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["part", "shard", "rows", "cells"])


def gathered(df: DataFrame, kind: type, own: type, mean: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums over the shards, or means over those that sent a row; of each part its rows and their cells.

    kind, own: of the cells of the embedding and of the rest. Shards are added up in their order. The driver gets no more
    than the embedding has rows.
    """
    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        part = table["part"][0].as_py()
        base, numbers = max(part, 0) * PART, own if part < 0 else kind
        total, many = None, np.zeros(PART, np.int64)
        for at, cells in zip(table["rows"], table["cells"]):
            at = np.frombuffer(at.as_buffer(), np.int32) - base
            cells = np.frombuffer(cells.as_buffer(), numbers).reshape(len(at), -1)
            if total is None:
                total = np.zeros((1 if part < 0 else PART, cells.shape[1]), np.float64 if mean else numbers)
            total[at] += cells
            many[at] += 1
        at = np.flatnonzero(many)
        out = (total[at] / many[at, None]).astype(numbers) if mean else total[at]
        return pa.table([pa.array([part], pa.int32()), pa.array([(at + base).astype(np.int32).tobytes()]),
                         pa.array([out.tobytes()])], ["part", "rows", "cells"])

    got = df.groupBy("part").applyInArrow(add, "part int, rows binary, cells binary").toArrow()
    found = {}
    for part, at, cells in zip(*(got[c].to_pylist() for c in ("part", "rows", "cells"))):
        at = np.frombuffer(at, np.int32)
        found[part] = at, np.frombuffer(cells, own if part < 0 else kind).reshape(len(at), -1)
    return found


def fit(rows: DataFrame, rounds: int = 3, passes: int = 2, seed: int = 0) -> Model | None:
    """A model of all `rows` (size, packed, label), of which each partition is a shard. None if there aren't two labels.

    In each round every shard learns from the same start, in some passes over each window, and what its rows of the
    embedding and the other parameters came to is averaged over the shards that moved them, the speeds of Adagrad too. One
    dimension of the embedding starts from each bucket's log odds in the texts.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros((2 * BUCKETS + 1, 2), np.int64), np.zeros(2, np.int64)
        for texts, labels in windows(batches):
            sizes += np.bincount(labels, minlength=2)
            for ids, label in zip(texts, labels):
                seen[np.unique(ids), label] += 1
        if sizes.any():
            at = np.flatnonzero(seen.any(1))
            yield sent(at, seen[at], sizes)

    found = gathered(rows.mapInArrow(count, SENT), np.int64, np.int64, False)
    sizes = found.pop(-1, (0, np.zeros((1, 2))))[1].T
    if not sizes.all():
        return None
    seen = np.zeros((2, 2 * BUCKETS + 1))
    for at, cells in found.values():
        seen[:, at] = cells.T
    m = Model.new(seed)
    share = (seen + 0.5) / (sizes + 1)
    m.embedding[:, 0] = np.where(seen.sum(0) > 1, np.clip(np.log(share[1] / share[0]), -4, 4) / 4, 0)
    m.embedding[-1] = 0
    learner = Learner(m)
    for done in range(0, rounds * passes, passes):
        held = rows.sparkSession.sparkContext.broadcast(learner)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            new = None
            for texts, labels in windows(batches):
                new = new or held.value.copy()
                r = np.random.default_rng(seed)
                for order in [r.permutation(len(texts)) for _ in range(done + passes)][done:]:
                    new.learn(texts, labels, order)
            if new:
                old = held.value
                pairs = (new.model.embedding, old.model.embedding), (new.speed[0], old.speed[0])
                at = np.flatnonzero(np.any([(a != b).any(1) for a, b in pairs], axis=0))
                yield sent(at, np.hstack([a[at] for a, _ in pairs]), new.state())

        found = gathered(rows.mapInArrow(learn, SENT), np.float32, np.float64, True)
        held.destroy()
        learner.resume(found.pop(-1)[1][0])
        for at, cells in found.values():
            m.embedding[at], learner.speed[0][at] = cells[:, :DIM], cells[:, DIM:]
    return m


def thresholds(checks: DataFrame) -> dict[str | None, float]:
    """A threshold for each language of `checks` (lang, score, label) that has both labels: the cut with the fewest errors
    on these rows, halfway between its neighbours, of equal ones the nearest to 0.5."""
    label = F.col("label")
    counts = kept(checks.groupBy("lang", "score").agg(F.sum(1 - label).alias("clean"), F.sum(label).alias("toxic")), "cuts")
    cuts = add_by_key(counts, ["lang"], ["score"], clean_upto=running_sum("clean"), toxic_upto=running_sum("toxic"),
                      before=lag("score"))
    edge = F.coalesce((F.col("before") + F.col("score")) / 2, F.lit(0.0))
    # Errors of the cut below each score, less all clean rows: toxic rows below it that are missed, clean ones it spares.
    errors = F.col("toxic_upto") - F.col("toxic") - F.col("clean_upto") + F.col("clean")
    best = cuts.groupBy("lang").agg(
        F.min(F.struct(errors.alias("errors"), F.abs(edge - CUT).alias("off"), edge.alias("edge"))).alias("best"),
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean > 0 AND toxic > 0")
    return {r["lang"]: min(tuple(r["best"]), (r["toxic"] - r["clean"], 1 - CUT, 1.0))[2] for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          label_col: str = "toxic") -> Model | None:
    """Fits on all labelled documents but every fifth, which calibrate the thresholds.

    Rows without id or label are left out. None if there aren't two labels to learn from. The model depends on the rows
    and the number of shards, not on where the rows are: a hash of the id deals them.
    """
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int")
                                                           .alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).where("label IN (0, 1)")
    count = known.count()
    n = max(1, min(-(-count // ROWS), SHARDS))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    kind = docs.select("id").union(known.select("id")).schema["id"].dataType  # hashes go by the type
    docs, known = (x.withColumn("id", F.col("id").cast(kind)) for x in (docs, known))
    texts = packed(docs, known, count)
    rows = texts.join(known, "id").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).cast("int")) \
        .repartitionById(n, "shard").sortWithinPartitions("shard", F.xxhash64("id", F.lit(2)), F.xxhash64("packed")) \
        .select("size", "packed", "label", "lang", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("test")) \
        .persist(StorageLevel.DISK_ONLY)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            ids, first = buckets(batch.column(0))
            found = [held.value.scores(ids[:, a:b], np.array([0, b - a]))[0] for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.float64()), batch.column(1)],
                                             ["lang", "score", "label"])

    try:
        m = fit(rows.where("NOT test").select("size", "packed", "label"))
        if m is not None:
            held = docs.sparkSession.sparkContext.broadcast(m)
            checks = rows.where("test").select("size", "packed", "label", "lang")
            m.thresholds = thresholds(checks.mapInArrow(scores, "lang string, score double, label int"))
            held.destroy()
    finally:
        rows.unpersist()
    return m


def score(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str | None = "lang",
          names: tuple[str, str] = ("score", "rejected"), keep_text: bool = True) -> DataFrame:
    """`docs` with the score (0 to 1) of each whole text and whether it reaches the threshold of its language.

    The score depends on the text alone; null counts as empty and gets a score as well. A language without a threshold
    of its own, null too, uses 0.5. Without a model all scores are 0. Columns of `docs` with the names of the two new
    ones must be renamed by the caller through `names`. Narrow: no shuffle.
    """
    old = docs.columns
    if set(names) & set(old):
        raise ValueError(f"docs has a column of {names} already; give other names")
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, text_col):
            s = m.scores(*buckets_of(batch, text_col)) if m else np.zeros(batch.num_rows)
            lang = batch.column(batch.schema.get_field_index(lang_col)).to_pylist() if lang_col else [None] * len(s)
            cut = np.array([m.thresholds.get(x, CUT) if m else CUT for x in lang])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(s >= cut)],
                                             [*old, *names])
            yield out if keep_text else out.drop_columns(text_col)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()),
                           T.StructField(names[1], T.BooleanType())])
    if not keep_text:
        schema = T.StructType([x for x in schema.fields if x.name != text_col])
    return docs.mapInArrow(run, schema)
