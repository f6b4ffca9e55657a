"""Repeated passages by suffix arrays: bytes that a string of SPAN bytes covers which also starts in an earlier document.

Every window of SPAN bytes belongs to its smallest hash of GRAM bytes, so equal windows meet under one key wherever they
stand. Keys that one document alone has can't repeat; a bitmap of bounded size sorts most of them out (it may let others
pass). The runs of windows that remain travel as strings, each distinct one once per unit of texts, and the suffix array
of a part's strings puts equal windows next to each other. Keys of very many different strings are dealt out window by
window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import kept, offsets_of, slices
from trajspark.llm.lyndon import suffix_array
from trajspark.llm.words import U, mix, powers

SPAN, GRAM = 50, 24
#: Different strings from which on a key is dealt out window by window; texts of a unit and of a part, in bytes.
MANY, UNIT_BYTES, PART_BYTES = 2048, 8 << 20, 4 << 20
#: Bytes of strings in one suffix array, but for strings of one key.
SORTED_BYTES = 1 << 20
#: Bits of a bitmap at most: 16 MB.
BITS = 1 << 27
LAST = np.iinfo(np.int64).max


def runs_of(column: pa.Array):
    """Runs of windows with one key: (key, row, first byte in the text, bytes), the texts' offsets, bytes, prefix sums."""
    at, data = offsets_of(column)
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[:n], out=total[1:])
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return np.zeros(0, np.uint64), none, none, none, at, data, total
    low = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    width, have = SPAN - GRAM + 1, 1
    while have < width:  # minimum of ever more neighbours
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    valid = np.zeros(len(low) + 1, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SPAN:
            valid[a:b - SPAN + 1] = True
    new = np.empty(len(low), bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (valid[1:-1] != valid[:-2])
    edge = at[(at > 0) & (at < len(low))]
    new[edge] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(low)))
    keep = valid[first]
    first, size = first[keep], size[keep]
    row = np.searchsorted(at, first, "right") - 1
    return low[first], row, first - at[row], size + SPAN - 1, at, data, total


def hash_of(total: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of strings of bytes, from the prefix sums."""
    return mix((total[begin + size] - total[begin]) * powers(len(total))[1][begin] + size.astype(np.uint64))


def places(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of a key, from its lowest 40 bits."""
    low = key & U((1 << 40) - 1)
    return [(mix(low + U(k << 41)) % U(bits)).astype(np.int64) for k in (0, 1)]


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U(40)) % U(parts)).astype(np.int64)


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(part[rows[0]]), rows


def keys_of(docs: DataFrame, parts: int) -> DataFrame:
    """Of each unit and part the lowest 40 bits of distinct keys, whether two documents have one (2, else 1), and how many
    different strings it has (255 at most; counts of units add up)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def unit():
            key, doc, text = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((text, key))
            key, doc, text = key[order], doc[order], text[order]
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            strings = np.add.reduceat((new | np.append(True, text[1:] != text[:-1])).astype(np.int64), first)
            found = key[first]
            rows = [(p, found[r].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                     np.stack([several[r] + 1, np.minimum(strings[r], 255)], 1).astype(np.uint8).tobytes())
                    for p, r in by_part(part_of(found, parts))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in slices(batches, "text"):
            key, row, pos, length, at, data, total = runs_of(batch.column(0))
            if len(key):
                held.append((key, row + texts, hash_of(total, at[row] + pos, length)))
            texts += batch.num_rows
            size += int(at[-1])
            if size >= UNIT_BYTES and held:
                yield unit()
                held, size = [], 0
        if held:
            yield unit()

    names, types = ["part", "keys", "n"], [pa.int32(), pa.binary(), pa.binary()]
    return docs.select("text").mapInArrow(run, "part int, keys binary, n binary")


def shared(keys: DataFrame, bits: int) -> DataFrame:
    """The bits (from 1) of keys that two documents have or more, and whether they have MANY strings."""
    def run(key, t):
        flat = [np.frombuffer(b, np.uint8).reshape(-1, 5) for b in t["keys"].to_pylist()]
        wide = np.zeros((sum(map(len, flat)), 8), np.uint8)
        wide[:, :5] = np.concatenate(flat)
        docs, strings = np.frombuffer(b"".join(t["n"].to_pylist()), np.uint8).reshape(-1, 2).T
        found, which = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        hit = np.bincount(which, docs) >= 2
        many = np.bincount(which, strings)[hit] >= MANY
        return pa.table([pa.array(np.concatenate(places(found[hit], bits)) + 1), pa.array(np.tile(many, 2))],
                        names=["bit", "many"])

    return keys.groupBy("part").applyInArrow(run, "bit bigint, many boolean")


def bitmap(bits: DataFrame, size: int) -> bytes:
    """One bit for each row's `bit`, in at most BITS / 8 bytes."""
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b")).collect()
    out = bytearray(max(size, 32768) // 8)
    for r in rows:
        out[(r["k"] - 1) * 4096:r["k"] * 4096] = bytes(r["b"])
    return bytes(out)


def test(flags: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Whether all bits of a key are set."""
    return np.logical_and(*((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0 for at in bits))


def packed(x) -> bytes:
    """Bytes or an array, compressed: shuffles of text are most of the work's disk."""
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, kind=None):
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return raw if kind is None else np.frombuffer(raw, kind)


def strings_of(docs: DataFrame, parts: int, bits: int, two, many) -> DataFrame:
    """Of each unit and part the distinct strings, and where each occurs (id, hash of the text, first byte)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, hot = (np.frombuffer(b.value, np.uint8) for b in (two, many))
        for batch in slices(batches, "text"):
            key, row, pos, size, at, data, total = runs_of(batch.column(1))
            hit = test(flags, places(key, bits))
            key, row, pos, size = (x[hit] for x in (key, row, pos, size))
            if not len(key):
                continue
            apart = test(hot, places(key, bits))
            count = np.where(apart, size - SPAN + 1, 1)
            which = np.repeat(np.arange(len(key)), count)
            pos = pos[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            size = np.where(apart[which], SPAN, size[which])
            row, key = row[which], key[which]
            begin = at[row] + pos
            text = hash_of(total, begin, size)
            key = np.where(apart[which], text, key)
            found, one, string = np.unique(mix(text + key * U(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
            raw, ids = data.tobytes(), batch.column(0).cast(pa.int64()).fill_null(LAST).to_numpy()
            hashes, out = batch.column(2).to_numpy(), []
            part = part_of(key[one], parts)
            place_in = np.empty(len(one), np.int64)
            where = {p: rows for p, rows in by_part(part)}
            for rows in where.values():
                place_in[rows] = np.arange(len(rows))
            for p, occ in by_part(part[string]):
                rows = one[where[p]]
                a = begin[rows]
                docs_, doc = np.unique(row[occ], return_inverse=True)
                out.append((p, key[rows].tobytes(), packed(size[rows].astype(np.int32)),
                            packed(b"".join([raw[x:y] for x, y in zip(a.tolist(), (a + size[rows]).tolist())])),
                            packed(place_in[string[occ]].astype(np.int32)), packed(doc.astype(np.int32)),
                            packed(pos[occ].astype(np.int32)), ids[docs_].astype(np.int64).tobytes(),
                            hashes[docs_].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    names = ["part", "keys", "sizes", "strings", "string", "doc", "pos", "id", "hash"]
    types = [pa.int32()] + [pa.binary()] * 8
    return docs.select("id", "text", "hash").mapInArrow(run, ", ".join(["part int", *(f"{c} binary" for c in names[1:])]))


def earliest(strings: list[bytes], owner: np.ndarray, limit: int = 1 << 20) -> list[np.ndarray]:
    """For each window of each string the smallest owner of an equal window; by the strings' suffix array."""
    out = [np.full(len(s) - SPAN + 1, o) for s, o in zip(strings, owner.tolist())]
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    size = np.array([len(s) + 1 for s in strings])
    begin = np.cumsum(size) - size
    order = np.array(suffix_array(text.tolist()), np.int64)
    string = np.searchsorted(begin, order, "right") - 1
    whole = order - begin[string] + SPAN < size[string]
    order, string = order[whole], string[whole]
    same = np.zeros(len(order), bool)
    for lo in range(1, len(order), limit // SPAN):
        hi = min(len(order), lo + limit // SPAN)
        rows = text[order[lo - 1:hi, None] + np.arange(SPAN)]
        same[lo:hi] = (rows[1:] == rows[:-1]).all(1)
    group = np.flatnonzero(~same)
    low = np.repeat(np.minimum.reduceat(owner[string], group), np.diff(np.append(group, len(order))))
    flat = np.concatenate(out)
    base = np.cumsum([len(x) for x in out]) - [len(x) for x in out]
    flat[base[string] + order - begin[string]] = low
    return np.split(flat, base[1:])


def smallest(strings: list[bytes], owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For all windows of all strings, in order, the smallest owner of an equal window under the same key.

    Windows whose hash is the only one of its kind under the key have no equal. What is left of the strings goes to
    suffix arrays, key by key, but where it is one string.
    """
    size = np.array(list(map(len, strings)))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(strings), np.uint8)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data) + 1)[0][:-1], out=total[1:])
    windows = size - SPAN + 1
    string = np.repeat(np.arange(len(strings)), windows)
    at = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashed = mix(hash_of(total, begin[string] + at, np.int64(SPAN)) + key[string].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    _, which, count = np.unique(hashed, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    low = owner[string]
    edge = np.append(True, string[1:] != string[:-1])
    first = np.flatnonzero(shared & (edge | ~np.append(False, shared[:-1])))
    last = np.flatnonzero(shared & (np.append(edge[1:], True) | ~np.append(shared[1:], False)))
    table: dict[tuple[int, bytes], int] = {}
    parts, owners, of_key = [], [], {}
    part = np.zeros(len(first), np.int64)
    for n, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        i = int(string[a])
        name = (int(key[i]), strings[i][at[a]:at[b] + SPAN])
        j = table.get(name)
        if j is None:
            j = table[name] = len(parts)
            parts.append(name[1])
            owners.append(owner[i])
            of_key.setdefault(name[0], []).append(j)
        owners[j] = min(owners[j], owner[i])
        part[n] = j
    owners = np.array(owners, np.int64)
    best = {}
    batch, held, sort = [], 0, [same for same in of_key.values() if len(same) > 1]
    for n, same in enumerate(sort):
        batch += same
        held += sum(len(parts[i]) for i in same)
        if held >= SORTED_BYTES or n == len(sort) - 1:
            best.update(zip(batch, earliest([parts[i] for i in batch], owners[batch])))
            batch, held = [], 0
    for a, b, j in zip(first.tolist(), last.tolist(), part.tolist()):
        low[a:b + 1] = best[j] if j in best else owners[j]
    return low


def marks(strings: DataFrame) -> DataFrame:
    """(id, hash, first, last): bytes to remove, once for each occurrence whose windows an earlier document has."""
    def run(key, t):
        texts, owner, table, occurrences = [], [], {}, []
        keys_of_text: dict[int, list[int]] = {}
        for r in t.to_pylist():
            ends = np.cumsum(unpacked(r["sizes"], np.int32), dtype=np.int64).tolist()
            names, strings_ = [], unpacked(r["strings"])
            for k, a, b in zip(np.frombuffer(r["keys"], np.uint64).tolist(), [0, *ends[:-1]], ends):
                s = (k, strings_[a:b])
                i = table.get(s)
                if i is None:
                    i = table[s] = len(texts)
                    texts.append(s[1])
                    keys_of_text.setdefault(k, []).append(i)
                names.append(i)
            doc = unpacked(r["doc"], np.int32)
            occurrences.append((np.array(names)[unpacked(r["string"], np.int32)],
                                *(np.frombuffer(r[c], np.int64)[doc] for c in ("id", "hash")),
                                unpacked(r["pos"], np.int32).astype(np.int64)))
        string, id_, hash_, pos = (np.concatenate(x) for x in zip(*occurrences))
        owner = np.full(len(texts), LAST)
        np.minimum.at(owner, string, id_)
        # A key with a single string has nothing to sort: equal windows are those of the string's own occurrences.
        many = [same for same in keys_of_text.values() if len(same) > 1]
        order = [i for same in many for i in same]
        start, low = np.full(len(texts), -1), np.zeros(0, np.int64)
        if order:
            low = smallest([texts[i] for i in order], owner[order], np.repeat(np.arange(len(many)), list(map(len, many))))
            start[order] = np.cumsum([0, *(len(texts[i]) - SPAN + 1 for i in order[:-1])])
        length = np.array(list(map(len, texts)))
        plain = (start[string] < 0) & (owner[string] < id_)
        out = [(id_[plain], hash_[plain], pos[plain], pos[plain] + length[string[plain]])]
        some = np.flatnonzero(start[string] >= 0)
        windows = length[string[some]] - SPAN + 1
        which = np.repeat(some, windows)
        at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = low[start[string[which]] + at] < id_[which]
        which, at = which[hit], at[hit]
        if len(which):
            apart = (which[1:] != which[:-1]) | (np.diff(at) > SPAN)
            a, b = np.append(True, apart), np.append(apart, True)
            out.append((id_[which[a]], hash_[which[a]], pos[which[a]] + at[a], pos[which[b]] + at[b] + SPAN))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["id", "hash", "first", "last"])

    return strings.groupBy("part").applyInArrow(run, "id bigint, hash bigint, first bigint, last bigint")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans and `kept`, the bytes that remain.

    Ids are integers. Null texts are empty; texts under SPAN bytes lose nothing. A null id counts as the largest, and
    rows with the same id take nothing from each other. Repeated rows lose the same bytes. An empty table gives an empty
    one. Only id and text are read. What remains may cut a character, so it is binary.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BITS, 1 << max(15, int(size // 8).bit_length()))
    parts = max(1, -(-size // PART_BYTES))
    both = kept(shared(keys_of(docs, parts), bits), "bits")
    two, many = (spark.sparkContext.broadcast(bitmap(x.select("bit"), bits)) for x in (both, both.where("many")))
    found = marks(strings_of(docs, parts, bits, two, many))
    spans = found.groupBy("id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    key = F.coalesce(F.col("id").cast("bigint"), F.lit(LAST))
    rows = docs.withColumn("key", key).join(
        spans.select(F.col("id").alias("key"), "hash", "spans"), ["key", "hash"], "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, data = offsets_of(batch.column(1))
            raw, out = data.tobytes(), []
            for a, b, spans in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(2).to_pylist()):
                if not spans:
                    out.append((b - a, 0, 0, raw[a:b]))
                    continue
                joined: list[list[int]] = []
                for x, y in sorted((s["first"], s["last"]) for s in spans):
                    if joined and x <= joined[-1][1]:
                        joined[-1][1] = max(y, joined[-1][1])
                    else:
                        joined.append([x, y])
                stays = zip([0, *(y for _, y in joined)], [*(x for x, _ in joined), b - a])
                out.append((b - a, sum(y - x for x, y in joined), len(joined),
                            b"".join(raw[a + x:a + y] for x, y in stays)))
            n, gone, many_, left = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, many_)),
                                              pa.array(left, pa.binary())], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    return rows.mapInArrow(cut, f"id {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
                           ).withColumnRenamed("id", id_col)
