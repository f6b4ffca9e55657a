"""Phrases whose words keep together: exact counts of all frequent n-grams, found by mergeable Misra-Gries summaries.

Words become numbers once: a unit is a run of texts of one language and one task, with its distinct words and its words in
order as their places, 0 where a piece ends. It is written to a table, so that later passes read numbers.

A round finds frequent n-grams of some orders. Each unit sends its distinct n-grams as hashes with their counts, dealt to
partitions by ranges of the hash. A partition merges these summaries one by one. It may hold one counter more than its
mass divided by the threshold; when a merge makes more, the largest count that has no room is taken from all, and those
that reach zero go. What has been taken in sum stays below the threshold, so every n-gram that reaches it is still there.
The unit gets back one bit for each of its n-grams, and counts the words of those that stay: the second pass, exact. A
task works on one unit and one order at a time, and sends hashes in small batches.

The first round takes words and pairs. Its units drop all words that are in no pair that stays, so the second round, for
longer phrases, sees only stretches in which each pair may be frequent: no other phrase can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import WORDS_BYTES, kept, slices
from trajspark.llm.ngram import high, low, narrow, wide
from trajspark.llm.periods import Numbers
from trajspark.llm.words import U, mix, words_of

#: Places (words, ends of pieces) of a unit and of all open units of a task; bytes of text for one partition of n-grams.
#: No result depends on them.
UNIT, OPEN, PART_BYTES = 1_250_000, 2_500_000, 8 << 20
#: Counters that a summary takes in before it is trimmed.
SLACK = 1 << 18
#: Places of a unit that are worked on at once, and hashes that are sent at once. Only memory depends on them.
BLOCK, SEND = 1 << 16, 1 << 17
END = b"\xff"  # of a piece; no byte of UTF-8
# Where pieces end.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytearray(range(256))
TABLE[65:91] = range(97, 123)
TABLE[9] = 32
for _b in ENDS:
    TABLE[_b] = END[0]
TABLE = bytes(TABLE)
BLANK = np.arange(256) == 32
UNITS = "unit bigint, lang string, words binary, tokens binary, n bigint"


class Open:
    """A unit that still grows."""

    def __init__(self):
        self.places, self.parts, self.n = Numbers({END: 0}), [], 0

    def add(self, texts: list[bytes]) -> None:
        words = (END.join(texts) + END).translate(TABLE).replace(END, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.n += len(words)


def units(docs: DataFrame) -> DataFrame:
    """Units of all texts, from columns text and lang; n: how many words each holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, opened = TaskContext.get().partitionId(), 0, {}

        def row(lang):
            u = opened.pop(lang)
            tokens = np.concatenate(u.parts)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                (task << 32 | made, lang, b" ".join(list(u.places)[1:]), low(tokens, 4), int((tokens > 0).sum())),
                (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()))],
                ["unit", "lang", "words", "tokens", "n"])

        for batch in slices(batches, "text", WORDS_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text or b"")
            for lang, texts in by_lang.items():
                opened.setdefault(lang, Open()).add(texts)
                if opened[lang].n >= UNIT:
                    yield row(lang)
                    made += 1
            while sum(u.n for u in opened.values()) > OPEN:
                yield row(max(opened, key=lambda x: opened[x].n))
                made += 1
        for lang in list(opened):
            yield row(lang)
            made += 1

    return docs.mapInArrow(run, UNITS)


def parts_of(words: bytes) -> Iterator[bytes]:
    """The same words in order, cut at blanks into pieces of few bytes each, or one word."""
    lo = 0
    while lo < len(words):
        hi = words.find(b" ", lo + WORDS_BYTES)
        hi = len(words) if hi < 0 else hi
        yield words[lo:hi]
        lo = hi + 1


class Grams:
    """The n-grams of a unit, one order after the other: hashed and valid are of the current one, by place."""

    def __init__(self, lang: str, words: bytes, tokens: bytes):
        self.tokens = np.ascontiguousarray(np.frombuffer(tokens, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        salt = words_of(pa.array([lang + " "]), BLANK & False, False).hash[0]
        self.each = np.concatenate([np.zeros(1, np.uint64), *(
            mix(words_of(pa.array([x], pa.binary()).cast(pa.large_string()), BLANK, False).hash ^ salt)
            for x in parts_of(words))])

    def orders(self, orders: list[int]) -> Iterator[int]:
        """Each of the ordered orders, once the hashes are worked out."""
        self.hashed, self.valid = self.each[self.tokens], self.tokens > 0
        for k in range(1, max(orders) + 1):
            if k > 1:
                m = max(0, len(self.hashed) - 1)
                self.hashed, self.valid = self.hashed[:m], self.valid[:m]
                for lo in range(0, m, BLOCK):
                    here = slice(lo, min(lo + BLOCK, m))
                    last = self.tokens[k - 1:k - 1 + m][here]
                    self.hashed[here] = mix(self.hashed[here] * U(0x9E3779B97F4A7C15) + self.each[last])
                    self.valid[here] &= last > 0
            if k in orders:
                yield k

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, ordered, and how often each occurs."""
        every = self.hashed[self.valid]
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[:len(every)])
        return every[first], np.diff(first, append=len(every))

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether at each place one of the hashes `keys`, ordered, occurs; and for each of them one of its places."""
        there, at = np.zeros(len(self.hashed), bool), np.zeros(len(keys), np.int64)
        for lo in range(0, len(self.hashed) if len(keys) else 0, BLOCK):
            hashed = self.hashed[lo:lo + BLOCK]
            which = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            here = self.valid[lo:lo + BLOCK] & (keys[which] == hashed)
            there[lo:lo + BLOCK] = here
            at[which[here]] = lo + np.flatnonzero(here)
        return there, at


def bounds(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """The partitions that ordered hashes fall into, which are ranges of their upper halves: each with its first hash and
    the one after its last."""
    least = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)
    cuts = [*np.searchsorted(keys, least).tolist(), len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def summaries(table: DataFrame, orders: list[int], parts: int) -> DataFrame:
    """Of each unit, order and partition the hashes and their counts."""
    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(r["lang"], r["words"], r["tokens"])
                for k in grams.orders(orders):
                    keys, n = grams.distinct()
                    rows, many = [], 0
                    for p, a, b in bounds(keys, parts):
                        rows.append((k, p, r["unit"], low(keys[a:b], 8), narrow(n[a:b])))
                        many += b - a
                        if many >= SEND:
                            yield sent(rows)
                            rows, many = [], 0
                    if rows:
                        yield sent(rows)

    names = ["ord", "part", "unit", "keys", "counts"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return (table.select("unit", "lang", "words", "tokens")
            .mapInArrow(run, "ord int, part int, unit bigint, keys binary, counts binary"))


class Summary:
    """A Misra-Gries summary with `room` counters. lost: what has been taken from each counter at most."""

    def __init__(self, room: int):
        self.room, self.lost = room, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > self.room + SLACK:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        self.waiting, self.held = [], 0
        self.keys, which = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(which, counts, len(self.keys)).astype(np.int64)
        if len(self.keys) > self.room:
            cut = int(np.partition(self.counts, len(self.counts) - self.room - 1)[len(self.counts) - self.room - 1])
            self.lost += cut
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut

    def reach(self, least: int) -> np.ndarray:
        """The keys that may occur `least` times, ordered; every one that does is among them."""
        self.merge()
        return self.keys[self.counts + self.lost >= least]


def frequent(sent: DataFrame, least: int) -> DataFrame:
    """For each unit, order and partition, which of its hashes may be frequent: bits in their order."""
    def run(key, t):
        def blobs():
            return (high(b.as_buffer(), 8).view(np.uint64) for b in t["keys"])

        def counts():
            return (wide(b.as_buffer()) for b in t["counts"])

        summary = Summary(sum(int(n.sum()) for n in counts()) // least + 1)
        for keys, n in zip(blobs(), counts()):
            summary.add(keys, n)
        found = np.append(summary.reach(least), U(0xFFFFFFFFFFFFFFFF))
        bits = [(np.packbits(found[np.searchsorted(found[:-1], k)] == k).tobytes(), len(k)) for k in blobs()]
        return pa.table([t["unit"], t["ord"], t["part"], *(pa.array(x, kind) for x, kind in zip(
            zip(*bits), (pa.binary(), pa.int64())))], ["unit", "ord", "part", "bits", "size"])

    return sent.groupBy("ord", "part").applyInArrow(run, "unit bigint, ord int, part int, bits binary, size bigint")


def shortened(tokens: np.ndarray, split: list[bytes], joined: np.ndarray) -> tuple[bytes, bytes, int]:
    """Only stretches whose neighbours are joined; joined: for each place whether it is so with the next."""
    after = np.append(joined, False)
    stay = after.copy()
    stay[1:] |= joined
    at = np.flatnonzero(stay)
    out = np.zeros(2 * len(at), np.uint32)
    out[::2] = tokens[at]
    use = np.ones(len(out), bool)
    use[1::2] = ~after[at]
    places = np.zeros(len(split) + 1, np.uint32)
    places[tokens[at]] = 1
    used = np.flatnonzero(places)
    places[used] = np.arange(1, len(used) + 1)
    return b" ".join([split[i - 1] for i in used.tolist()]), low(places[out[use]], 4), len(at)


def counted(table: DataFrame, bits: DataFrame, orders: list[int], parts: int, shorten: bool) -> DataFrame:
    """Each unit's n-grams that may be frequent and their counts, by partition and size (in `words` and `tokens`), and
    with `shorten` the unit's shortened form, which has no partition."""
    def run(t):
        here = pc.is_valid(t["lang"])
        if not pc.any(here).as_py():
            return schema.empty_table()
        own = t.select(["unit", "lang", "words", "tokens"]).filter(here).to_pylist()[0]
        answers = t.select(["ord", "part", "bits", "size"]).filter(pc.invert(here)).sort_by("part")
        grams, split, out = Grams(own["lang"], own["words"], own["tokens"]), own["words"].split(b" "), []
        for k in grams.orders(orders):
            keys, n = grams.distinct()
            mine = answers.filter(pc.equal(answers["ord"], k))
            stay = np.concatenate([np.zeros(0, np.uint8), *(
                np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=size.as_py())
                for b, size in zip(mine["bits"], mine["size"]))]).astype(bool)
            if len(stay) != len(keys):
                raise RuntimeError("the answers don't fit the unit")
            keys, n = keys[stay], n[stay]
            there, at = grams.found(keys)
            for p, a, b in bounds(keys, parts):
                places = grams.tokens[at[a:b, None] + np.arange(k)]
                phrases = [b" ".join([split[i - 1] for i in row]) for row in places.tolist()]
                out.append((None, own["lang"], b"\n".join(phrases), narrow(n[a:b]), b - a, k, p))
            if k == 2 and shorten:
                words, tokens, many = shortened(grams.tokens, split, there)
                if many:
                    out.append((own["unit"], own["lang"], words, tokens, many, None, None))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    schema = pa.schema([("unit", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("tokens", pa.binary()),
                        ("n", pa.int64()), ("size", pa.int32()), ("part", pa.int32())])
    both = table.select("unit", "lang", "words", "tokens").unionByName(bits, allowMissingColumns=True)
    return both.groupBy("unit").applyInArrow(run, f"{UNITS}, size int, part int")


def reaching(found: DataFrame, least: int) -> DataFrame:
    """The phrases that occur `least` times: lang, phrase, size and n, the exact sums of all units."""
    def run(key, t):
        rows = []
        for r in t.to_pylist():
            phrases = pa.array(r["words"].split(b"\n"), pa.binary())
            rows.append(pa.table([pa.array([r["lang"]] * len(phrases), pa.string()), phrases, pa.array(wide(r["tokens"]))],
                                 ["lang", "phrase", "n"]))
        n = pa.concat_tables(rows).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        n = n.filter(pc.greater_equal(n["n_sum"], least))
        return pa.table([n["lang"], n["phrase"].cast(pa.string()), pa.array([key[0].as_py()] * len(n), pa.int32()),
                         n["n_sum"]], ["lang", "phrase", "size", "n"])

    return found.where("part IS NOT NULL").select("size", "part", "lang", "words", "tokens").groupBy("size", "part") \
        .applyInArrow(run, "lang string, phrase string, size int, n bigint")


def frequent_phrases(docs: DataFrame, most: int = 5, least: int = 100, text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Tables of all phrases of up to `most` words that occur `least` times (lang, phrase, size, n), and of each
    language's words (lang, total)."""
    docs = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    table, counts = kept(units(docs), "units"), []
    totals = table.groupBy("lang").agg(F.sum("n").alias("total")).where("total > 0")
    rounds = [[1, 2][:most]] + ([list(range(3, most + 1))] if most > 2 else [])
    for orders in rounds:
        bits = frequent(summaries(table, orders, parts), least)
        found = kept(counted(table, bits, orders, parts, orders is not rounds[-1]), "counts")
        counts.append(reaching(found, least))
        table = found.where("part IS NULL")
    return reduce(DataFrame.unionByName, counts), totals


def collocations(docs: DataFrame, most: int = 5, least: int = 100, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A text is lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, pieces at blanks and tabs into words. a is
    how often a phrase of 2 to `most` words occurs within pieces, `least` or more; n counts all words of the language. A
    cut after its first words gives l and r, how often these and the rest occur, and the score floor(1000 a n / (l r));
    the least counts, of equal ones that after fewest words. A phrase goes if a longer one that holds it occurs as often.
    (Then one that is longer by a single word does, so only these are looked at.) Rank: score, a, then the phrase's bytes.

    Null and empty texts have no words, a null language is `und`, repeated rows count each time, an empty table gives an
    empty one. Ids aren't read, and other columns may have any name. A word that starts a third of all phrases makes a
    skewed join, which adaptive execution splits; the report's rows are limited in buckets before a language's meet.
    """
    counts, totals = frequent_phrases(docs, most, least, text_col, lang_col)
    counts = kept(counts, "phrases")
    some = counts.where("size >= 2").withColumnRenamed("n", "a")
    cuts = (some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("tail", F.expr("substring_index(phrase, ' ', k - size)")))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    exact = "CAST(1000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(20, 0)) * CAST(total AS DECIMAL(20, 0))" \
            " div (CAST(l AS DECIMAL(20, 0)) * CAST(r AS DECIMAL(18, 0)))"
    scored = (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
              .withColumn("score", F.expr(exact))
              .groupBy("lang", "phrase", "a", F.col("total").alias("n"))
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inner = (counts.where("size >= 3")
             .select("lang", F.col("n").alias("outer"), F.explode(F.array(
                 F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
             ).alias("phrase")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer")))
    left = scored.join(inner, ["lang", "phrase"], "left").where("outer IS NULL OR outer < a").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = Window.partitionBy("lang", "bucket").orderBy(*order)
    best = (left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
            .withColumn("rank", F.row_number().over(bucket)).where(F.col("rank") <= top))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
