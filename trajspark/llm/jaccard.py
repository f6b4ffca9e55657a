"""Exact Jaccard join of word shingles in a metric space: pivots, Voronoi cells, triangle-inequality windows.

Documents of different content are all at distance 1 from each other, where no pivot tells them apart. So shared pairs of
rare shingles first join documents to regions outside of which nothing can link (see `candidates`). Within a region distances tell: pivots are compared with every document of it; the
rest that isn't settled goes to the cell of its nearest pivot, along with the documents whose distances allow a link
over the border, and each cell is joined in the same way until all its open documents have been pivots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import WORDS_BYTES, kept, slices
from trajspark.llm.components import components
from trajspark.llm.repeats import by_part, part_of
from trajspark.llm.words import SPACE, U, mix, words_of

SIZE, NUM, DEN = 5, 4, 5  # shingles of five words; linked from 4/5 on
#: A region of up to LEAF open documents is compared at once, one of more by PIVOTS of them; blocks hold up to BLOCK open
#: documents, and so many nodes of a region are compared by one task. A cell of more than SHRINK times its region's open
#: documents isn't divided again. All of them are matters of speed.
LEAF, PIVOTS, BLOCK, GROUP, SHRINK = 64, 8, 512, 1024, 0.8
#: Bytes of text for one partition of keys; no result depends on it.
PART_BYTES = 16 << 20
#: Shingles whose counts order the prefixes; any order gives the same links, this one fewer candidates.
FREQUENT, OFTEN, FLUSH = 200_000, 4, 3_000_000
THIRDS = np.array([0, 1, 2], np.uint64) * U((1 << 64) // 3)
ODDS = mix(np.arange(11, 14, dtype=np.uint64)) | U(1)


def shingles(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted hashes; a text with fewer words has one, one without words none."""
    w = words_of(column, SPACE)
    first = w.first()
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | U(1)
    n = max(0, len(w.hash) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += w.hash[k:k + n] * odd[k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a:b - size + 1])
        elif b > a:
            yield mix((w.hash[a:b] * odd[:b - a]).sum(keepdims=True, dtype=np.uint64) + U(b - a))
        else:
            yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def family(s: np.ndarray) -> int:
    """48 bits of the first shingles from three places of the hash range on: the same for most near copies of a text."""
    first = s[np.searchsorted(s, THIRDS) % len(s)]
    return int(mix((first * ODDS).sum(keepdims=True, dtype=np.uint64))[0]) >> 16


def describe(docs: DataFrame, size: int) -> DataFrame:
    """Per row: id, n, digest and family of its set; and rows (hash, count) of shingles that are frequent within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def frequent():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n >= OFTEN], n[n >= OFTEN]
            none = pa.nulls(len(h))
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(h), kind), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()),
                 pa.array(h.view(np.int64)), pa.array(n)], names)

        for batch in slices(batches, "text", WORDS_BYTES):
            kind, sets = batch.schema.field(0).type, list(shingles(batch.column(1), size))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array([family(s) if len(s) else None for s in sets], pa.int64()), none, none], names)
            held += sets
            many += sum(map(len, sets))
            if many > FLUSH:
                yield frequent()
                held, many = [], 0
        if many:
            yield frequent()

    names = ["id", "n", "digest", "family", "hash", "count"]
    spark_kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {spark_kind}, n bigint, digest binary, family bigint, hash bigint, "
                           "count bigint")


def candidates(docs: DataFrame, size: int, frequent, parts: int) -> DataFrame:
    """Links (a, b) between families of sets that share a key, as a star for each key.

    Sets of one family meet anyway, so a large group of near copies sends few links, however many keys it shares.

    Keys are three neighbours among the first 0.6 n + 3 shingles of a set, the rare ones first. Two linked sets have at
    most a quarter as many shingles of their own (d together) as in common. The first 2 d + 3 in common stand within
    these bounds on both sides, in at most d + 1 runs that no other shingle parts, so one run has three. Sets of up to
    five shingles, where there may not be as many in common, also have pairs as keys. Each unit of texts sends a key
    once, and links of its own at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value
        seen, keys, owners, many = set(), [], [], 0

        def flush():
            key, g = np.concatenate(keys), np.concatenate(owners)
            new, links = chained(key, g)
            key, g = key[new], g[new]
            out = []
            for p, rows in by_part(part_of(key, parts)):
                out.append((p, key[rows].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                            g[rows].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                            b"" if out else links.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

        for batch in slices(batches, "text", WORDS_BYTES):
            for s in shingles(batch.column(0), size):
                d = digest(s)
                if len(s) < 4 or d in seen:  # smaller sets link with equal ones only
                    continue
                seen.add(d)
                owner = family(s)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rare = np.where(often[at] == s, rank[at], 0)
                    s = s[np.argsort(rare, kind="stable")]
                s = s[:3 * len(s) // 5 + 3]
                two = mix(s[:-1] * U(0x9E3779B97F4A7C15) + s[1:])
                three = mix(two[:-1] * U(0x9E3779B97F4A7C15) + s[2:])
                keys.append(np.concatenate([two, three]) if len(s) <= 5 else three)
                owners.append(np.full(len(keys[-1]), owner))
                many += len(s)
            if many > FLUSH // 2:
                yield flush()
                keys, owners, many = [], [], 0
        if many:
            yield flush()

    def meet(_, t):
        def wide(column, size):
            flat = np.frombuffer(b"".join(t[column].to_pylist()), np.uint8).reshape(-1, size)
            out = np.zeros((len(flat), 8), np.uint8)
            out[:, :size] = flat
            return out.view(np.int64).ravel()
        _, links = chained(wide("keys", 5), wide("g", 6))
        links = np.concatenate([links, np.frombuffer(b"".join(t["links"].to_pylist()), np.int64).reshape(-1, 2)])
        return pa.table([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    names, types = ["part", "keys", "g", "links"], [pa.int32()] + [pa.binary()] * 3
    return docs.select("text").mapInArrow(run, "part int, keys binary, g binary, links binary").groupBy(
        "part").applyInArrow(meet, "a bigint, b bigint")


def chained(key: np.ndarray, g: np.ndarray):
    """The rows that are the first of each key, and the distinct links of the others with the first of their key."""
    order = np.lexsort((g, key))
    k, o = key[order], g[order]
    new = np.append(True, k[1:] != k[:-1])
    pairs = np.stack([o, o[np.flatnonzero(new)][np.cumsum(new) - 1]], 1)[~new].astype(np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return order[new], np.unique(pairs, axis=0) if len(pairs) else pairs


def bitmap(ids: DataFrame, bits: int) -> dict[int, bytes]:
    """Which of `bits` places the hashes of the ids take: at most bits / 8 bytes."""
    place = ids.select((F.pmod(F.xxhash64("id"), F.lit(bits)) + 1).alias("p"))
    rows = place.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    return {r["k"]: bytes(r["b"]) for r in rows.collect()}


def node_of(digest: str) -> Column:
    """A set of one row: its digest, and a hash of the row's id."""
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.xxhash64("id")), 16, "0")))


def sets_of(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(node, words) of the chosen documents (id, digest), and of some others whose nodes are no chosen ones: a bitmap of
    fixed size leaves most of them out, and joining regions, by node, the rest. So words move once, not twice."""
    bits = 1 << min(27, max(15, 4 + int(chosen.count()).bit_length()))  # 16 MB at most
    held = docs.sparkSession.sparkContext.broadcast(bitmap(chosen, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for k, b in held.value.items():
            flags[(k - 1) * 32768:k * 32768] = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[:bits]
        for batch in slices(batches, "text", WORDS_BYTES):
            batch = batch.filter(pa.array(flags[batch.column(2).to_numpy()]))
            sets = list(shingles(batch.column(1), size))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["id", "node", "words"])

    kind = docs.schema["id"].dataType.simpleString()
    found = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p")).mapInArrow(
        run, f"id {kind}, node binary, words array<bigint>")
    return found.select(node_of("node").alias("node"), "words")


def compare(rows: DataFrame) -> DataFrame:
    """Pivots against all rows of their region and salt: spanning links (node, root) and, with `far`, the distances of
    each node to the pivots. role: 0 for a pivot, 1 for a node, 2 for both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None

        def work():
            pivots = [(n, w) for role, n, w, _ in group if role != 1]
            nodes = [(n, w, far) for role, n, w, far in group if role]
            if not nodes:
                return None
            size = np.array([len(w) for _, w in pivots])
            flat = np.concatenate([w for _, w in pivots])
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(pivots)), size)[order]
            all_, start = np.unique(flat[order], return_index=True)
            many = np.diff(np.append(start, len(flat)))
            names = [n for n, _ in pivots]
            root = list(range(len(pivots)))

            def find(i):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            out = []
            for n, w, far in nodes:
                at = np.minimum(np.searchsorted(all_, w), len(all_) - 1)
                at = at[all_[at] == w]
                # The pivots that have each word, one after the other.
                n_at, ends = many[at], np.cumsum(many[at])
                place = np.arange(ends[-1] if len(at) else 0) + np.repeat(start[at] - ends + n_at, n_at)
                both = np.bincount(owner[place], minlength=len(pivots))
                either = size + len(w) - both
                linked = np.flatnonzero(both * DEN >= either * NUM).tolist()
                for i in linked[1:]:
                    root[find(i)] = find(linked[0])
                out.append((n, linked[0] if linked else -1, (1 - both / either) if far else None))
            tops = [names[find(i)] for i in range(len(names))]
            return [(key[0], n, tops[i] if i >= 0 else n, d) for n, i, d in out] + [
                (key[0], n, tops[i], None) for i, n in enumerate(names) if tops[i] != n]

        for batch in batches:
            region, salt, role, node, words, far = (batch.column(i) for i in range(6))
            at, flat, out = words.offsets.to_numpy(), words.values.to_numpy(), []
            for i, row in enumerate(zip(region.to_pylist(), salt.to_pylist(), role.to_pylist(), node.to_pylist(),
                                        far.to_pylist())):
                if row[:2] != key:
                    out += (group and work()) or []
                    group, key = [], row[:2]
                group.append((row[2], row[3], flat[at[i]:at[i + 1]].copy(), row[4]))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
        out = (group and work()) or []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    names = ["region", "node", "root", "d"]
    schema = pa.schema([("region", pa.string()), ("node", pa.binary()), ("root", pa.binary()),
                        ("d", pa.list_(pa.float64()))])
    return rows.mapInArrow(run, "region string, node binary, root binary, d array<double>")


def join_regions(sets: DataFrame, regions: DataFrame) -> DataFrame | None:
    """Links (a, b) that join just those documents that links within the regions (region, node) join.

    `open`: a document still to be compared with all of its region. While a region has more than LEAF of them, about
    PIVOTS of them are compared, else all. In the first round, documents of a region's commonest component need no
    links among each other, so only the others stay open. Cells are divided again as long as distances divide them; the
    rest is joined in blocks of open documents (`last`): exact, and split over tasks. Tables with a few rows for each
    region are written first, so that the planner knows their size and needn't gather a large region to join them.
    """
    links, level = None, 0
    regions = regions.select("region", "node", F.lit(True).alias("open"), F.lit(False).alias("last"))
    by = F.xxhash64("node", F.lit(7))
    while True:
        sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("open").cast("int")).alias("o"),
                                              F.min(F.when(F.col("open"), by)).alias("low"))
        sizes = kept(sizes.where("o > 0 AND m > 1"), "sizes")
        far = (F.col("o") > LEAF) & ~F.col("last")
        rows = kept(regions.join(sizes, "region").select(
            "region", "node", far.alias("far"), F.ceil(F.col("m") / GROUP).cast("int").alias("salts"),
            (F.col("open") & (~far | (F.pmod(by, F.col("o")) < PIVOTS) | (by == F.col("low")))).alias("pivot"), "open", "o"), "rows")
        if rows.isEmpty():
            break
        own = F.pmod(F.xxhash64("node"), "salts").cast("int")
        copy = lambda salt, role: F.struct(salt.alias("salt"), F.lit(role).alias("role"))
        copies = F.when(F.col("pivot") & (F.col("salts") == 1), F.array(copy(own, 2))).when(F.col("pivot"), F.concat(
            F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: copy(s, 0)), F.array(copy(own, 1))
        )).otherwise(F.array(copy(own, 1)))
        put = rows.join(sets, "node").select("region", F.explode(copies).alias("c"), "node", "words", "far").select(
            "region", "c.salt", "c.role", "node", "words", "far")
        put = put.repartition("region", "salt").sortWithinPartitions("region", "salt", "role", "node")
        found = kept(compare(put), "found")
        new = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = new if links is None else links.unionAll(new)
        if rows.where("far").isEmpty():
            break
        left = rows.where("far").join(found.where("d IS NOT NULL").select("region", "node", "d"), ["region", "node"])
        if level == 0:
            parts = components(links).withColumnRenamed("id", "node")
            left = kept(left.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "left")
            top = (left.groupBy("region", "component").count().groupBy("region")
                   .agg(F.max_by("component", F.struct("count", "component")).alias("top")))
            left = left.join(kept(top, "top"), "region").withColumn("open", F.col("component") != F.col("top"))
            wide = kept(left.groupBy("region").agg(F.sum(F.col("open").cast("int")).alias("o")), "wide")
            left = left.drop("o").join(wide, "region")
        level += 1
        regions = kept(blocks(kept(cells(kept(left, "left")), "cells")), "regions")
    return links


def cells(left: DataFrame) -> DataFrame:
    """Open documents to the cell of their nearest pivot, with all that may link with one of them over its border."""
    r = 1 - NUM / DEN + 1e-9
    home = F.array_position("d", F.array_min("d")).cast("int") - 1
    stays = F.col("open") & ~F.col("pivot")
    cell = left.where(stays).select("region", home.alias("cell"), F.element_at("d", home + 1).alias("to")).groupBy(
        "region", "cell").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    near = left.join(kept(cell, "cell"), "region").withColumn("to", F.element_at("d", F.col("cell") + 1))
    near = near.where((F.col("to") - F.array_min("d") <= 2 * r) & F.col("to").between(F.col("low") - r, F.col("high") + r))
    return near.select(F.concat_ws("/", "region", "cell").alias("region"), "node",
                       (stays & (home == F.col("cell"))).alias("open"), F.col("o").alias("before"))


def blocks(regions: DataFrame) -> DataFrame:
    """Cells with few open documents, or which distances hardly made smaller, as blocks of up to BLOCK open ones with
    everything of the cell; the others as they are."""
    sizes = regions.groupBy("region").agg(F.sum(F.col("open").cast("int")).alias("o"))
    last = (F.col("o") <= BLOCK) | (F.col("o") > SHRINK * F.col("before"))
    cut = regions.join(kept(sizes.where("o > 0"), "sizes"), "region").withColumn(
        "many", F.when(last, F.ceil(F.col("o") / BLOCK)).otherwise(1).cast("int"))
    cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    own = F.pmod(F.xxhash64("node", F.lit(9)), "many") == F.col("block")
    return cut.select(F.concat_ws("#", "region", "block").alias("region"), "node", (F.col("open") & own).alias("open"),
                      last.alias("last"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id that links reach).

    Words are lower-cased (A-Z) and split at ASCII white space. Null and empty texts and those of white space only have
    no shingles and link with nothing. Rows of equal sets are one while joining, repeated rows too. A null id counts as
    largest: it names a component only if no other id is in it. Empty tables give empty ones. Only id and text are read.
    Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = kept(describe(docs, size), "sets")
    rows = both.where("hash IS NULL").select("id", "n", "digest", "family")
    often = (both.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("count").alias("n"))
             .orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow())  # a fixed number of rows
    hashes, counts = often["hash"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], counts[order]))
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    regions = components(candidates(docs, size, frequent, parts))
    # Sets of less than four shingles link with equal ones only.
    reps = rows.where("n >= 4").groupBy("digest").agg(F.min("id").alias("id"), F.min("family").alias("family"))
    same = reps.groupBy("family").count().where("count > 1").select("family", F.col("family").alias("component"))
    regions = regions.select(F.col("id").alias("family"), "component").unionAll(same).groupBy("family").agg(
        F.min("component").alias("component"))
    chosen = kept(reps.join(kept(regions, "regions"), "family").select(
        "id", "digest", F.col("component").cast("string").alias("region")), "chosen")
    links = join_regions(kept(sets_of(docs, chosen, size), "words"), chosen.select("region", node_of("digest").alias("node")))
    named = rows.withColumn("class", F.when(F.col("n") > 0, F.col("digest")))
    if links is not None:
        links = links.select(*(F.substring(c, 1, 16).alias(c) for c in ("a", "b")))
        parts = components(links).select(F.col("id").alias("class"), "component")
        named = named.join(parts, "class", "left").withColumn("class", F.coalesce("component", "class"))
    low = named.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("low"))
    return named.join(low, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))
