import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from trajspark.llm import periods, queries


def brute(words, least=24, times=3):
    """All runs by every lag."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        a = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and a is None:
                a = i
            elif not same and a is not None:
                if i - a + q >= max(least, times * q):
                    found.setdefault((a, i + q), q)
                a = None
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(r):
    """Words of few kinds, with stretches that repeat at short and long periods, one inside another too."""
    out = [f"w{r.randrange(r.choice([2, 5, 400]))}" for _ in range(r.randrange(60))]
    for _ in range(r.randrange(4)):
        q = r.choice([1, 2, 3, 7, 16, 17, 18, 20, 21, 25, 26, 31, 32, 40, 63, 90])
        unit = [f"w{r.randrange(r.choice([1, 2, 3, 9, 400]))}" for _ in range(q)]
        if r.random() < .3:
            unit = unit[:max(1, q // 5)] * 5
        n = r.randrange(2 * q, 5 * q + 9)
        out += [unit[i % len(unit)] for i in range(n)] + [f"z{r.randrange(9)}" for _ in range(r.randrange(3))]
    return out


def test_runs_equal_brute_force():
    r = random.Random(3)
    texts = [some_words(r) for _ in range(400)]
    for some in (texts[:150], texts[150:380], [texts[380]], texts[381:]):
        got = periods.run_table([" ".join(w).encode() for w in some])
        for words, (rows, text) in zip(some, got):
            assert rows == brute(words), words
            assert text.decode() == collapsed(words, rows)
    assert sum(q > periods.LAGS for w in texts for _, _, q in brute(w)) > 100


def test_runs_that_touch_and_other_limits():
    """Runs of other bounds, runs of words of Fibonacci and of a text that is one run."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 700:
        a, b = b, b + a
    for words in (b, ["x"] * 500, (["x"] * 40 + ["y"]) * 20, ["x", "y", "z"] * 8, ["x", "y", "z"] * 7 + ["x", "y"]):
        for least, times in ((24, 3), (6, 3), (1, 4), (90, 5)):
            got = periods.run_table([" ".join(words).encode()], least, times)[0][0]
            assert got == brute(words, least, times)
    with pytest.raises(ValueError):
        periods.periodic_runs(None, times=2)


def test_minimizers_at_every_scale():
    """A run of three periods is found whatever its period is."""
    r = np.random.default_rng(1)
    texts = []
    for q in range(17, 400):
        unit = r.integers(0, 10 ** 6, q)
        texts.append([f"w{x}" for x in np.tile(unit, 4)[:3 * q]])
    got = periods.run_table([" ".join(w).encode() for w in texts])
    assert [rows for rows, _ in got] == [[(0, 3 * q, q)] for q in range(17, 400)]
    low = [s for s in periods.scales(10 ** 6)]
    assert all(y[0] == x[1] + 1 and x[2] > 0 for x, y in zip(low, low[1:]))


def test_periodic_runs(spark, docs, odd, empty, rows):
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(docs).collect()}
    for i, t in rows.items():
        words = [w.decode() for w in (t or "").encode().split()]
        if len(words) < 2000:
            assert got[i] == (brute(words), collapsed(words, brute(words)))
    assert len(got) == len(rows) and got[0] == ([], "")
    assert periods.periodic_runs(odd).count() == odd.count()
    assert periods.periodic_runs(empty).count() == 0 and periods.periodic_runs(empty).columns == ["doc_id", "runs", "collapsed"]


def contract(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rows = brute(w)
    top = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(rows), *(top[:3] if top else [None] * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in rows).encode()).hexdigest(),
            hashlib.sha256(collapsed(w, rows).encode()).hexdigest())


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    r = random.Random(9)
    texts = {i: " ".join(some_words(r)) for i in range(120)} | {120: None, 121: "", 122: " \n", 123: "é\tb\x0bc " * 40}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op13_periods"](spark, str(tmp_path))
    got = {x["doc_id"]: tuple(x) for x in df.collect()}
    assert got == {i: contract(i, t) for i, t in texts.items()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in texts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.SQL["op13_periods"])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    assert {x[names.index("doc_id")]: tuple(x[names.index(c)] for c in df.columns) for x in sql.fetchall()} == got
