import random

from brute import repeats as brute_repeats
from trajspark.llm import repeats
from trajspark.llm.lyndon import suffix_array


def test_suffix_array():
    r = random.Random(3)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 26])) for _ in range(r.randrange(40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def check(docs, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in repeats.remove_repeats(docs).collect()}
    assert got == brute_repeats(rows)


def test_repeats(docs, rows):
    check(docs, rows)


def test_keys_of_many_documents(docs, rows, monkeypatch):
    """Every shared key dealt out window by window, in small units and many parts."""
    for name, value in (("MANY", 2), ("UNIT_BYTES", 2000), ("PART_BYTES", 2000), ("SORTED_BYTES", 3000)):
        monkeypatch.setattr(repeats, name, value)
    check(docs, rows)


def test_odd_rows(odd, empty):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(odd).collect())
    whole = {n for i, n, gone in got if i == "5"}
    assert all(gone == 0 for i, _, gone in got if i == "5") and len(whole) == 2
    assert [gone for i, n, gone in got if i == "None"].count(0) == 1  # the empty text; the others are in document 5
    assert repeats.remove_repeats(empty).count() == 0
