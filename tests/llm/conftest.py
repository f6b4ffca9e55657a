import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, hash string, n string, "
          "digest string, score_ string, key string, unit string, part string, label string, words string")


def prose(seed, n=120, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def edited(text, seed, share=0.02):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"e{r.randrange(10 ** 6)}" for w in text.split())


def texts():
    base = [prose(i) for i in range(12)]
    out = [None, "", " \t\n", "one", "ONE", "a b c d", "A b\tc  d", "a b c d e"]
    out += base + base[:3] + [edited(base[k], 100 + j, 0.01 * j) for k in range(3) for j in range(12)]
    out += [base[5][:300] + prose(50, 30), prose(51, 30) + base[5][100:400] + prose(52, 30), "é" * 300, "ab" * 200,
            "ab" * 150 + "é" * 100, prose(60, 30000)]
    return out


@pytest.fixture(scope="session")
def rows():
    """Texts of all sorts, most ids unique."""
    return dict(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The same as a table with columns whose names operators use inside."""
    data = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 3}", len(t or ""), *["x"] * 10)
            for i, t in rows.items()]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(data, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and the same id over different texts; not from files."""
    a, b = prose(1), prose(2)
    data = [(None, a), (None, a), (None, None), (5, a), (5, a), (5, b), (7, b.rsplit(" ", 1)[0] + " other"), (8, "")]
    return spark.createDataFrame([(i, t, None, None, 0, *["x"] * 10) for i, t in data], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
