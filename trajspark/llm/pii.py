"""Personal data by bootstrapping: seeds found by their form induce lexical patterns, which find what has other forms.

A pattern is the word, or the two words, before an identifier. Patterns and instances form a graph: a pattern is as
reliable as the instances it introduces, an instance as the best pattern that introduces it. Spark scores the graph
round by round; patterns with enough support and confidence then mark identifiers that no form has caught.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import kept, slices

KINDS = ["email", "ip", "card", "phone"]
#: Rounds of scoring; least distinct seeds of a pattern; least confidence of patterns that mark.
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.9

# The forms of the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
SIGN = re.compile(r"[0-9@]+")
#: Digits that belong together without a space between; what may stand between such groups.
PART = re.compile(r"\(?[0-9](?:[0-9().-]*[0-9])?\)?")
GAP = re.compile(r" {1,2}(?:[.-] {1,2})?")
SPACES = " \t\n\r\v\f"
EDGE = ".,;:!?\"'()[]{}<>|*#&%"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), ordered, of what has one of the forms: leftmost matches that don't overlap, per kind."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            floor = m.end()
            out.append((0, start, floor))
        at = text.find("@", m.end() if m else at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def free(a: int, b: int, taken: list[tuple[int, int, int]]) -> bool:
    return not any(x < b and a < y for _, x, y in taken)


def grouped(text: str, start: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds) of what neighbouring groups of digits from `start` on form together: for cards and phones the
    most groups that fit, the longer first; none if that is never more than one group."""
    a = start - (text[start - 1:start] == "(")
    ends, at, digits = [], a, 0
    while digits <= 19 and (m := PART.match(text, at)) and free(a, m.end(), taken):
        after = text[m.end():m.end() + 1]
        if after and after not in SPACES and after not in EDGE:
            break
        digits += sum(map(str.isdigit, m.group()))
        ends.append(m.end())
        gap = GAP.match(text, m.end())
        if not gap:
            break
        at = gap.end()
    longest: dict[int, list[int]] = {}
    for k in (2, 3):
        fit = [b for b in ends if fits(KINDS[k], text[a:b])]
        if fit:
            longest.setdefault(fit[-1], []).append(k)
    if not longest or max(longest) == ends[0]:
        return []
    return [(a, b, longest[b]) for b in sorted(longest, reverse=True)]


def other_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int], bool]]:
    """(start, end, kinds, whether the first at its place) of words with digits or an at sign, of a length that an
    identifier has at least, and of digits written in groups, outside of the spans taken."""
    out, last = [], -1
    for m in SIGN.finditer(text):
        if m.start() < last:
            continue
        a, b = m.span()
        while a and text[a - 1] not in SPACES:
            a -= 1
        n = len(text)
        while b < n and text[b] not in SPACES:
            b += 1
        last = b
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        if groups := grouped(text, a, taken):
            out.extend((*g, g is groups[0]) for g in groups)
            last = groups[-1][1]
        elif 6 <= b - a and free(a, b, taken):
            out.append((a, b, [k for k, name in enumerate(KINDS) if fits(name, text[a:b])], True))
    return out


def key_of(word: str) -> str:
    """What stands for an identifier in the graph: itself in small letters, or if it is long, its digest."""
    return word.lower() if len(word) <= 64 else sha256(word.lower().encode("utf-8", "surrogatepass")).hexdigest()


def fits(kind: str, word: str) -> bool:
    """Whether a word can be of a kind at all."""
    digits = sum(c in "0123456789" for c in word)
    return {"email": "@" in word, "ip": digits >= 4 and word.count(".") + word.count(":") >= 3,
            "card": 12 <= digits <= 19, "phone": 7 <= digits <= 15 and digits * 2 > len(word)}[kind]


def before(text: str, start: int) -> list[str]:
    """The patterns of a place: the word before it, and the two words."""
    words = [w for w in (x.strip(EDGE).lower() for x in text[max(0, start - 80):start].split()[-2:]) if w]
    return [" ".join(words[-k:]) for k in range(1, len(words) + 1)]


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                   support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of `docs`: the id and `spans` (kind, start, end in code points, base), by kind, then start.

    Null and empty texts have no spans. Null ids, repeated rows and ties are kept apart; an empty table gives an empty
    one. Only id and text are read, and each text is read once, whole. Patterns are counted before they are shuffled,
    instances are not gathered by pattern, and marked spans come back by a join; none is broadcast.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                                ("word", pa.string()), ("patterns", pa.list_(pa.string())),
                                ("may", pa.list_(pa.int32())), ("first", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                row = [{"kind": k, "start": a, "end": b, "word": key_of(text[a:b]), "patterns": before(text, a),
                        "may": [k], "first": True} for k, a, b in base]
                row += [{"kind": None, "start": a, "end": b, "word": key_of(text[a:b]), "patterns": before(text, a),
                         "may": may, "first": first} for a, b, may, first in other_spans(text, base)]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found)], ["id", "found"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"id {kind}, found array<struct<kind:int,start:bigint,end:bigint,word:string,patterns:array<string>,"
              "may:array<int>,first:boolean>>")
    texts = kept(texts.withColumn("uid", F.monotonically_increasing_id()), "places")
    places = texts.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    # Each place counts once, however many ends it may have.
    edges = places.where("first").select("word", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "word").agg(
        F.count(F.lit(1)).alias("n"), F.max("kind").alias("seed"))
    edges = kept(edges, "graph")
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    # Instances begin with their seeds: (word, kind, belief).
    belief = edges.where("seed IS NOT NULL").select("word", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
    belief = belief.distinct()
    for _ in range(rounds):
        patterns = (edges.join(belief, "word").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("belief")).alias("mass"), F.sum("belief").alias("support"))
            .where(F.col("support") >= support).join(total, "pattern")
            .select("pattern", "kind", (F.col("mass") / F.col("total")).alias("trust")))
        patterns = kept(patterns, "patterns")
        best = edges.join(patterns, "pattern").groupBy("word", "kind").agg(F.max("trust").alias("belief"))
        seeds = edges.where("seed IS NOT NULL").select("word", F.col("seed").alias("kind"), F.lit(1.0).alias("belief"))
        belief = seeds.unionByName(best).groupBy("word", "kind").agg(F.max("belief").alias("belief"))
    sure = patterns.where(F.col("trust") >= confidence) if rounds else None
    marked = places.where("kind IS NULL").select("uid", "start", "end", "may", F.explode("patterns").alias("pattern"))
    if sure is not None:
        marked = marked.join(sure, "pattern").where(F.array_contains("may", F.col("kind")))
        marked = marked.groupBy("uid", "start").agg(F.max_by(F.struct("kind", "end"), F.struct(
            "trust", -F.col("kind"), "end")).alias("best")).select("uid", "start", "best.*")
        marked = marked.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base")))
                                           .alias("more"))  # of one text
        texts = texts.join(marked, "uid", "left")
    else:
        texts = texts.withColumn("more", F.lit(None).cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>"))
    base = F.transform(F.filter("found", lambda f: f["kind"].isNotNull()), lambda f: F.struct(
        f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), F.lit(True).alias("base")))
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast(
        "array<struct<kind:int,start:bigint,end:bigint,base:boolean>>"))))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(every, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"),
                                                  s["end"].alias("end"), s["base"].alias("base")))
    return texts.select(F.col("id").alias(id_col), spans.alias("spans"))
