import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from brute import UPPER
from trajspark.llm import phrases, queries


def brute(rows, most=5, least=100, top=2000):
    """The report of texts by language, computed phrase by phrase."""
    words, count = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, most + 1):
                count.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    many = {p: n for p, n in count.items() if n >= least}
    for p, a in many.items():
        lang, w = p[0], p[1:]
        if len(w) < 2:
            continue
        if any(q[0] == lang and len(q) > len(p) and n >= a and any(q[i:i + len(w)] == w for i in range(1, len(q)))
               for q, n in many.items()):
            continue
        cuts = [(1000 * a * words[lang] // (count[lang, *w[:k]] * count[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, count[lang, *w[:k]], count[lang, *w[k:]], words[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= top:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return ranked


def some_rows(seed, n=60):
    r = random.Random(seed)
    marks = ["", "", "", "", ",", ".", " ?", "\n", "\x0b", "\t", " :"]
    fixed = ["New York", "at the end of the day", "ÉTÉ été", "a a a a"]

    def text():
        return " ".join((r.choice(fixed) if r.random() < .2 else f"w{min(r.randrange(40), r.randrange(40))}")
                        + r.choice(marks) for _ in range(r.randrange(1, 60)))
    return [(text(), r.choice(["en", "en", "de", None, ""])) for _ in range(n)] + [(None, "en"), ("", None), (" . ", "fr")]


def report(df):
    return sorted(tuple(r) for r in df.collect())


def test_summaries_keep_what_is_frequent():
    """However counts are dealt to summaries, no key of the threshold is lost, and there's no room for more."""
    r = np.random.default_rng(2)
    for _ in range(40):
        least = int(r.integers(2, 30))
        keys = (r.zipf(1.3, 3000) % 1500).astype(np.uint64)
        want = {int(k) for k, n in zip(*np.unique(keys, return_counts=True)) if n >= least}
        s = phrases.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 25):
            s.add(*np.unique(part, return_counts=True))
            s.merge()
            assert len(s.keys) <= s.room and s.lost < least
        assert want <= set(s.reach(least).tolist())


@pytest.mark.parametrize("most, least, top", [(5, 4, 2000), (5, 4, 7), (3, 2, 2000), (2, 30, 2000), (5, 10 ** 6, 5)])
def test_collocations_equal_brute_force(spark, most, least, top):
    rows = some_rows(least)
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "text string, lang string, phrase string, n string")
    got = phrases.collocations(df.repartition(3), most, least, top)
    want = brute(rows, most, least, top)
    assert report(got) == sorted(want)
    assert bool(want) == (least < 100)


def test_small_units_and_summaries_give_the_same(spark, monkeypatch):
    """Many units, partitions and trimmed summaries."""
    rows = some_rows(1, 200)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    want = sorted(brute(rows, 5, 12))
    for name, x in (("PART_BYTES", 2000), ("SLACK", 1)):
        monkeypatch.setattr(phrases, name, x)
    assert report(phrases.collocations(df, 5, 12)) == want


def test_open_units_are_closed(monkeypatch):
    """Units end at their size, and the largest when many languages are open."""
    unit = phrases.Open()
    unit.add([b"A b.c", b"", b"b \xc3\x89;"])
    assert list(unit.places) == [phrases.END, b"a", b"b", b"c", b"\xc3\x89"]
    assert unit.parts[0].tolist() == [1, 2, 0, 3, 0, 0, 2, 4, 0, 0]


def test_scores_past_64_bits(spark, monkeypatch):
    """Products of counts are exact beyond 64 bits."""
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10 ** 9), ("en", "b", 1, 3 * 10 ** 9 + 1), ("en", "a b", 2, 10 ** 9 + 7)],
                                   "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 10 ** 13 + 9)], "lang string, total long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (counts, totals))
    got = phrases.collocations(None).first()
    assert got["score"] == 1000 * (10 ** 9 + 7) * (10 ** 13 + 9) // (3 * 10 ** 9 * (3 * 10 ** 9 + 1)) > 0


def test_odd_tables(spark, docs, odd, empty, rows):
    assert report(phrases.collocations(docs, 5, 3)) == sorted(
        brute([(t, "en" if i % 3 else None) for i, t in rows.items()], 5, 3))
    assert phrases.collocations(odd, 2, 2).count() > 0
    none = phrases.collocations(empty)
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_sql_equals_brute_force(spark, tmp_path):
    rows = some_rows(4, 400)
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = report(queries.QUERIES["op11_phrases"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(queries.SQL["op11_phrases"]).fetchall()) == got == sorted(brute(rows)) and got
