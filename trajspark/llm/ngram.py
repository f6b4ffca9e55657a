"""Language model by deleted interpolation: n-gram maximum likelihood mixed by buckets of the context's frequency.

Tokens of a text are its words and one end, which is also what comes before a text's first word. The model is
P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), with weights for each bucket of c(h) (powers of two),
learned by expectation-maximisation on held-out texts whose own counts have been deleted.

Counts travel as blobs. A unit is a run of texts of one task; it sends its distinct keys, with how often they occur in
training and in held-out texts, to partitions of keys, and gets the sums back in its own order. Nothing of a size that
grows with the corpus is broadcast or collected, and a frequent key has one entry for each unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import kept, slices
from trajspark.llm.words import SPACE, U, mix, words_of

END = U(0x3C6EF372FE94F82B)
#: Tokens of a unit; characters of text for one partition of keys. No result depends on them.
UNIT, PART_CHARS = 1_200_000, 8 << 20
TEST, TRAIN, TUNE = 0, 1, 2  # roles of texts: not learned from; learned from; also held out for the weights
STEP = 4  # bins of a power of two
BUCKETS = 64


@dataclass
class Unit:
    number: int
    ids: pa.Array
    role: np.ndarray    # of each text
    first: np.ndarray   # first token of each text, and the end
    one: list           # distinct words: (keys, counts in training texts, counts in held-out ones, part bounds)
    two: list           # distinct pairs
    word: np.ndarray    # of each token its word and its pair
    pair: np.ndarray


def distinct(keys: np.ndarray, role: np.ndarray, parts: int):
    """Distinct keys ordered by part, counts by role, part bounds; and of each token its place among them."""
    found, which = np.unique(keys, return_inverse=True)
    part = ((found >> U(48)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token = place[which]
    learned = np.bincount(token[role >= TRAIN], minlength=len(found))
    tuned = np.bincount(token[role == TUNE], minlength=len(found))
    return [found[order], learned, tuned, np.searchsorted(part[order], np.arange(parts + 1))], token


def units(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[Unit]:
    """Units of a task, from columns id, text, role. The same rows give the same units again."""
    ids, roles, tokens, sizes, many, made = [], [], [], [], 0, 0
    task = TaskContext.get().partitionId()

    def unit():
        flat, size = np.concatenate(tokens), np.concatenate(sizes)
        first = np.concatenate([[0], np.cumsum(size)])
        role = np.concatenate(roles)
        before = np.empty(len(flat), np.uint64)
        before[1:] = flat[:-1]
        before[first[:-1]] = END
        each = np.repeat(role, size)
        one, word = distinct(flat, each, parts)
        two, pair = distinct(mix(before * U(0x9E3779B97F4A7C15) + flat), each, parts)
        return Unit(task << 32 | made, pa.concat_arrays(ids), role, first, one, two, word, pair)

    for batch in slices(batches, "text"):
        w = words_of(batch.column(1), SPACE)
        first = w.first()
        ids.append(batch.column(0))
        roles.append(batch.column(2).to_numpy())
        tokens.append(np.insert(w.hash, first[1:], END))
        sizes.append(np.diff(first) + 1)
        many += len(tokens[-1])
        if many >= UNIT:
            yield unit()
            ids, roles, tokens, sizes, many, made = [], [], [], [], 0, made + 1
    if many:
        yield unit()


def narrow(n: np.ndarray) -> bytes:
    """Counts in one byte each, those of 255 and more apart."""
    big = np.flatnonzero(n >= 255)
    head = np.array([len(big)], "<u4").tobytes() + big.astype("<u4").tobytes() + n[big].astype("<u8").tobytes()
    return head + np.minimum(n, 255).astype(np.uint8).tobytes()


def wide(b: bytes) -> np.ndarray:
    k = int(np.frombuffer(b, "<u4", 1)[0])
    n = np.frombuffer(b, np.uint8, offset=4 + 12 * k).astype(np.int64)
    n[np.frombuffer(b, "<u4", k, 4)] = np.frombuffer(b, "<u8", k, 4 + 4 * k)
    return n


def low(x: np.ndarray, size: int) -> bytes:
    """The lowest bytes of numbers, plane by plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def high(b: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def keys_of(docs: DataFrame, parts: int) -> DataFrame:
    """Of each unit and part the keys and their counts; pairs (order 2) and words (order 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in units(batches, parts):
            rows = []
            for order, (keys, learned, tuned, cuts) in ((1, u.one), (2, u.two)):
                for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    if b > a:
                        rows.append((order, p, u.number, low(keys[a:b], 6 if order == 2 else 8), narrow(learned[a:b]),
                                     narrow(tuned[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    names, types = ["ord", "part", "unit", "keys", "learned", "tuned"], [pa.int32(), pa.int32(), pa.int64(),
                                                                        pa.binary(), pa.binary(), pa.binary()]
    return docs.mapInArrow(run, "ord int, part int, unit bigint, keys binary, learned binary, tuned binary")


def summed(keys: DataFrame) -> DataFrame:
    """The sums of each part, to each unit in its own order; and rows without a unit: (distinct, total) of words."""
    def run(key, t):
        order, part = (x.as_py() for x in key)
        size = 6 if order == 2 else 8
        blobs = [high(b, size) for b in t["keys"].to_pylist()]
        cuts = np.cumsum([0, *map(len, blobs)])
        found, which = np.unique(np.concatenate(blobs), return_inverse=True)
        out, sums = [], []
        for name in ("learned", "tuned"):
            n = np.bincount(which, np.concatenate([wide(b) for b in t[name].to_pylist()]), len(found)).astype(np.int64)
            sums.append(n)
            out.append([narrow(n[which[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])] + [None])
        stats = [[None] * len(blobs) + [int(x)] for n in sums for x in ((n > 0).sum(), n.sum())]
        stats[2][-1] = int((sums[0] > sums[1]).sum())  # distinct once the held-out counts are deleted
        m = len(blobs) + 1
        return pa.table([pa.array([order] * m, pa.int32()), pa.array([part] * m, pa.int32()),
                         pa.array([*t["unit"].to_pylist(), None], pa.int64()), *(pa.array(x, pa.binary()) for x in out),
                         *(pa.array(x, pa.int64()) for x in stats)],
                        names=["ord", "part", "unit", "learned", "tuned", "types", "total", "rest_types", "held"])

    return keys.groupBy("ord", "part").applyInArrow(
        run, "ord int, part int, unit bigint, learned binary, tuned binary, types bigint, total bigint, "
             "rest_types bigint, held bigint")


def encoded(docs: DataFrame, parts: int, tune: bool) -> DataFrame:
    """Units as rows: the texts' ids and roles, and their tokens as places; tune: of held-out texts only."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in units(batches, parts):
            take = np.flatnonzero(u.role == TUNE) if tune else np.arange(len(u.role))
            if not len(take):
                continue
            size = np.diff(u.first)
            token = np.repeat(u.role == TUNE, size) if tune else slice(None)
            rows = [[u.number], [u.ids.take(pa.array(take)).to_pylist()], [u.role[take].tolist()],
                    [size[take].tolist()], [low(u.word[token], 3)], [low(u.pair[token], 3)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, fields(batch_kind))],
                                             schema=pa.schema(fields(batch_kind)))

    def fields(t):
        return [pa.field("unit", pa.int64()), pa.field("ids", pa.list_(t)), pa.field("roles", pa.list_(pa.int32())),
                pa.field("sizes", pa.list_(pa.int64())), pa.field("word", pa.binary()), pa.field("pair", pa.binary())]

    from pyspark.sql.pandas.types import to_arrow_type
    batch_kind = to_arrow_type(docs.schema["id"].dataType)
    return docs.mapInArrow(run, f"unit bigint, ids array<{kind}>, roles array<int>, sizes array<bigint>, "
                                "word binary, pair binary")


def merged(unit: DataFrame, counts: DataFrame) -> DataFrame:
    """Units and their counts as rows of one table, to be grouped by unit."""
    return unit.unionByName(counts.where("unit IS NOT NULL").select("unit", "ord", "part", "learned", "tuned"),
                            allowMissingColumns=True)


def unpacked(t: pa.Table):
    """Of a unit: its row, its counts of words and of pairs, and of each token its word, the one before and its pair."""
    rows = t.to_pylist()
    own = [r for r in rows if r["ord"] is None]
    if not own:
        return None
    own, counts = own[0], []
    for order in (1, 2):
        part = sorted((r for r in rows if r["ord"] == order), key=lambda r: r["part"])
        counts.append(tuple(np.concatenate([wide(r[c]) for r in part]) for c in ("learned", "tuned")))
    word, pair = high(own["word"], 3), high(own["pair"], 3)
    if max(word.max() + 1 - len(counts[0][0]), pair.max() + 1 - len(counts[1][0])) > 0:
        raise RuntimeError("a second reading of the texts gave other units; write them to a table first")
    size = np.array(own["sizes"])
    first = np.cumsum(size) - size
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[first] = word[first + size - 1]  # the end
    return own, counts, word, before, pair, first


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the power of two."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(np.float64))[1], 0)


def held_out(table: DataFrame, types: int, total: int) -> DataFrame:
    """How many held-out tokens have these odds: by bucket, log2 of word and of pair odds against the uniform share."""
    def run(key, t):
        out = unpacked(t)
        if out is None:
            return pa.table({c: pa.array([], pa.int64()) for c in ("b", "x", "y", "n")})
        own, counts, word, before, pair, _ = out
        one, two = (a - b for a, b in counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.log2(one[word] / max(total, 1) * (types + 1))
            y = np.log2(two[pair] / one[before] * (types + 1))
        cell = [np.where(np.isfinite(v), np.rint(v * STEP), -(1 << 20)).astype(np.int64) for v in (x, y)]
        rows, n = np.unique(np.stack([bucket(one[before]), *cell]), axis=1, return_counts=True)
        return pa.table([*(pa.array(r.astype(np.int64)) for r in rows), pa.array(n)], names=["b", "x", "y", "n"])

    return (table.groupBy("unit").applyInArrow(run, "b bigint, x bigint, y bigint, n bigint")
            .groupBy("b", "x", "y").agg(F.sum("n").alias("n")))


def learn(cells: list, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket by expectation-maximisation; buckets without tokens get those of all."""
    if not cells:
        return np.full((BUCKETS, 3), 1 / 3)
    b, x, y, n = np.array(cells, np.float64).T
    odds = np.stack([np.where(v < -(1 << 19), 0, 2.0 ** (v / STEP)) for v in (y, x)] + [np.ones(len(n))], 1)

    def fit(odds, n):
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = odds * w
            share = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            done, w = np.abs(share - w).max() < 1e-9, share
            if done:
                break
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    out = np.tile(fit(odds, n), (BUCKETS, 1))
    for k in np.unique(b).astype(int):
        out[k] = fit(odds[b == k], n[b == k])
    return out


def score_texts(docs: DataFrame, learned: Column, tuned: Column, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, n_known, train_tokens, base_score and score (log10).

    `learned`: which rows the counts come from; `tuned`: which of these are held out for the weights (their counts are
    deleted then, and count for the scores). Null texts are empty: one token, the end. Null ids, repeated rows and ties
    are scored like others; an empty table gives an empty one. `docs` is read three times and must give its rows in the
    same order in the same partitions: a table does.
    """
    role = F.when(F.coalesce(learned, F.lit(False)), F.when(F.coalesce(tuned, F.lit(False)), TUNE).otherwise(TRAIN)
                  ).otherwise(TEST)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), role.cast("int").alias("role"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    counts = kept(summed(keys_of(docs, parts)), "counts")
    types, total, rest_types, held = (int(x or 0) for x in counts.where("unit IS NULL AND ord = 1").agg(
        *(F.sum(c) for c in ("types", "total", "rest_types", "held"))).first())
    cells = held_out(merged(encoded(docs, parts, True), counts), rest_types, total - held).collect()  # bins: bounded
    weights = learn([tuple(r) for r in cells])

    def run(key, t):
        out = unpacked(t)
        if out is None:
            return schema.empty_table()
        own, counts, word, before, pair, first = out
        (one, _), (two, _) = counts
        c, h = one[word], one[before]
        w = weights[bucket(h)]
        p = w[:, 0] * two[pair] / np.maximum(h, 1) + w[:, 1] * c / max(total, 1) + w[:, 2] / (types + 1)
        base = np.log10((c + 1) / (total + types + 1))
        return pa.table([pa.array(own["ids"], schema.field(0).type), pa.array(np.array(own["sizes"], np.int64)),
                         pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                         pa.array(np.full(len(first), total, np.int64)), pa.array(np.add.reduceat(base, first)),
                         pa.array(np.add.reduceat(np.log10(p), first))], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    scored = merged(encoded(docs, parts, False), counts).groupBy("unit").applyInArrow(
        run, f"id {kind.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
             "score double")
    return scored.withColumnRenamed("id", id_col)
