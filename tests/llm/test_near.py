import math
import random

import numpy as np

from brute import jaccard as brute_jaccard
from brute import least
from trajspark.llm import jaccard, neardup
from trajspark.llm.components import components


def vectors():
    r = random.Random(4)
    out = []
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    for i in range(300):
        c = centres[r.randrange(20)]
        out.append((i, [float(np.float32(x + r.gauss(0, 0.2))) for x in c], r.randrange(2)))
    one = out[0][1]
    return out + [(400, one, out[0][2]), (401, [2 * x for x in one], out[0][2]), (402, one, None), (403, None, 0), (404, [], 0),
                  (405, [0.0] * 16, 0), (406, [math.nan] + one[1:], 0), (407, [None] + one[1:], 0),
                  (408, [math.inf] + one[1:], 0), (409, one[:8], 0)]


def test_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "label")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows
            if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}

    def linked(a, b):
        return (a in unit and b in unit and label[a] == label[b] and len(unit[a]) == len(unit[b])
                and unit[a] @ unit[b] >= neardup.COSINE)
    names = least([i for i, _, _ in rows], linked)
    for tile in (512, 8):
        old, neardup.TILE = neardup.TILE, tile
        got = {r["vec_id"]: r for r in neardup.near_vectors(df.unionAll(df.limit(3))).collect()}
        neardup.TILE = old
        assert len(got) == len(rows)
        for i, _, _ in rows:
            n = sum(linked(i, j) for j in label if j != i)
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, names[i], names[i] == i), i
    assert neardup.near_vectors(df.limit(0)).count() == 0


def test_plan_finds_nearly_all():
    for n in (2, 1000, 10 ** 6):
        bits, tables = neardup.plan(n)
        same = (1 - math.acos(neardup.COSINE) / math.pi) ** bits
        assert (1 - same) ** tables <= neardup.MISS * 1.0001


def test_jaccard(docs, rows):
    sizes, names = brute_jaccard(rows)
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(docs).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == names


def test_jaccard_recursion(docs, rows, monkeypatch):
    """Small leaves and groups: several rounds of pivots, cells and windows."""
    for name, value in (("LEAF", 2), ("PIVOTS", 1), ("BLOCK", 3), ("GROUP", 5)):
        monkeypatch.setattr(jaccard, name, value)
    _, names = brute_jaccard(rows)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs).collect()} == names


def test_cells_find_links_over_borders(spark, monkeypatch):
    """A region of documents of which many don't link: every link is found, whatever the cells."""
    r = random.Random(8)
    base = [r.getrandbits(62) for _ in range(60)]
    sets = {}
    for i in range(90):
        drop = r.choice([4, 8, 12, 20])
        sets[bytes([i])] = sorted(set(r.sample(base, 60 - drop) + [r.getrandbits(62) for _ in range(drop // 2)]))
    words = spark.createDataFrame(list(sets.items()), "node binary, words array<long>")
    regions = spark.createDataFrame([("r", k) for k in sets], "region string, node binary")

    def linked(a, b):
        both = len(set(sets[a]) & set(sets[b]))
        return 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)
    want = least(list(sets), linked)
    for leaf, block in ((64, 512), (8, 512), (4, 8)):
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        links = jaccard.join_regions(words, regions)
        got = {bytes(x["id"]): bytes(x["component"]) for x in components(links).collect()}
        assert {k: got.get(k, k) for k in sets} == want and len(set(want.values())) > 5


def test_jaccard_large_group(spark):
    """Many near copies of one text, texts that share a passage, and clean ones."""
    r = random.Random(12)
    text = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    base, passage, rows = text(120), text(30), {}
    for i in range(260):
        if i % 2:
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        else:
            w = text(60) + passage + text(20) if i % 4 else text(80)
        rows[1000 - i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    sizes, names = brute_jaccard(rows)
    got = {x["doc_id"]: x for x in jaccard.jaccard_classes(df).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == names
    assert {i: x["n_shingles"] for i, x in got.items()} == sizes


def test_jaccard_odd_rows(odd, empty):
    got = sorted(map(tuple, jaccard.jaccard_classes(odd).collect()), key=str)
    assert len(got) == 8 and {g for g in got if g[0] == 5} == {(5, 116, 5)}
    assert (7, 116, 5) in [(a, b, c) for a, b, c in got] and (8, 0, 8) in got and (None, 0, None) in got
    assert jaccard.jaccard_classes(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90 + k) for k in range(5)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(90, 95)], 90)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
