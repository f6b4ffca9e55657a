import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import words
from trajspark.llm import mixing, ngram, packing, pii, secrets, toxicity
from trajspark.llm.automaton import Automaton
from trajspark.llm.common import kept

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_automaton_finds_what_regexes_find():
    auto, r = Automaton(secrets.RULES), random.Random(1)
    forms = [(rule, re.compile(rule.pattern.encode())) for rule in secrets.RULES]
    parts = ["token", "=", "'", '"', " ", ":", "api_key", "apiKEY", "AKIA", "ABCDEFGHIJKLMNOPQ0123", "a0f", "secret", "pass",
             "0123456789abcdef0123", "word", "wd", "é", "\n", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "abcdefghijklmnop",
             "ghp_", "sk_live_", "xoxb-", "AIza", "tok"]
    for _ in range(4000):
        d = "".join(r.choice(parts) for _ in range(r.randrange(14))).encode()
        want = sorted(((i, *m.span()) for i, (rule, p) in enumerate(forms) for m in p.finditer(d)
                       if len(m.group(rule.group)) >= rule.least), key=lambda x: (x[1], x[0], x[2]))
        assert auto.spans(d) == want


def test_secret_spans(spark, docs, odd, empty):
    text = "é token = 'abc123' " + "0" * 24
    df = spark.createDataFrame([(1, text), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.secret_spans(df).collect()}
    assert got == {1: [("assign", 2, 17, True), ("hex", 19, 43, True)], None: []}
    assert secrets.secret_spans(docs).count() == docs.count() and secrets.secret_spans(odd).count() == 8
    assert secrets.secret_spans(empty).count() == 0


def test_personal_forms():
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    r = random.Random(2)
    parts = ["a", "b.", "@", "@x.com", "x-y", "1", "23", "255", "256", ".", "..", "+1", " ", "-", "(0", "4111111111111111",
             "é", "%", "\n", "5500 0000 0000 0004", "00255"]

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return [True, kind != 1 or all(int(x) <= 255 for x in m.split(".")),
                16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15][kind]
    for _ in range(8000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        want = [(k, *m.span()) for k, f in enumerate(forms) for m in re.finditer(f, t) if good(k, m.group())]
        assert pii.base_spans(t) == want
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_patterns_find_identifiers_in_groups(spark):
    seeds = [f"tel +49 30 12345{i:03d} and call +1 555 98765{i:02d} or card 4111 1111 1111 1111" for i in range(10, 20)]
    host = "x" * 70
    seeds += [f"mail me{i}@{host}.org now" for i in range(10)]
    forms = {"Tel: 030 1234567": "030 1234567", "please call (555) 123-4567, or": "(555) 123-4567",
             "tel 030 . 123.4567.": "030 . 123.4567", "tel 12345678 23456789 34567890": "12345678",
             "tel 0301234567 0309876543": "0301234567", "call 1-800-555 1234 today": "1-800-555 1234",
             "tel 555 1234abc": None, "tel 12 34 apples": None, "see 030 1234567": None}
    texts = seeds + list(forms)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"] if not s["base"]]
           for r in pii.personal_spans(df).collect()}
    for i, text in enumerate(forms, len(seeds)):
        assert got[i] == ([("phone", forms[text])] if forms[text] else []), text
    long = f"mail {host}@{host} now"
    assert (5, 5 + 141, [0], True) in pii.other_spans(long, pii.base_spans(long))
    card = "card 4111 1111 1111 1112 now"
    assert (5, 24, [2], True) in pii.other_spans(card, pii.base_spans(card))


def test_patterns_find_unseen_forms(spark, docs, odd, empty):
    """Mail addresses follow 'reach me'; so does one whose form isn't known. Other words with digits stay."""
    rows = [(i, f"w{i} please reach me user{i}@mail.example.com now") for i in range(12)]
    rows += [(100, "é kindly reach me someone@localhost now"), (101, "there are 123456 things"), (102, None)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_spans(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("email", 18, 35, False)] and got[101] == got[102] == []
    assert all(len(got[i]) == 1 and got[i][0][3] for i in range(12))
    assert pii.personal_spans(docs).count() == docs.count() and pii.personal_spans(odd).count() == 8
    assert pii.personal_spans(empty).count() == 0


def test_encoder():
    r, encoder, whole = random.Random(5), packing.Encoder(PATH), Tokenizer.from_file(PATH)
    chars = [*"abzAZ09.,'!-_@|<>\"", "é", "É", "×", "÷", "ß", "«", "…", "é", "́", " ", " ", "日", "Σ", " ", "\n",
             "\x1c", "'s", "'ll", "½", "İ", "K", "👍"]
    for special in ([], ["<|endoftext|>", "<|ENDOFTEXT|>"]):
        for _ in range(60):
            texts = ["".join(r.choice(chars + special) for _ in range(r.randrange(30))) for _ in range(30)] + [None, ""]
            ids, at = encoder.encode(pa.array(texts))
            for i, t in enumerate(texts):
                assert ids[at[i]:at[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, rows, odd, empty):
    whole = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, with_ids=True).toPandas()
    for i, t in rows.items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == i].sort_values("piece")
        assert np.concatenate(mine.ids.to_list()).tolist() == ids
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in mine.ids]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.append(0, np.cumsum(s.length)[:-1]).tolist() and s.length.sum() <= 2048
    assert packing.pack(odd, PATH).count() == 8 and packing.pack(empty, PATH).count() == 0


def test_combinations():
    r = random.Random(7)
    for _ in range(60):
        counts = {r.randint(1, 64): r.randint(1, 30) for _ in range(r.randint(0, 40))}
        plan = packing.combinations(counts, 64)
        used = Counter()
        for lengths, k in plan:
            assert sum(lengths) <= 64 and k > 0
            for x in lengths:
                used[x] += k
        assert used == Counter(counts)
        assert sum(k for _, k in plan) <= 1.3 * sum(x * n for x, n in counts.items()) / 64 + sum(
            n for x, n in counts.items() if x > 32) + 2
    exact = packing.combinations({60: 1, 4: 1, 30: 2, 33: 1, 31: 1, 20: 2, 13: 1, 11: 1}, 64)
    assert sum(sum(x) == 64 for x, _ in exact) >= 2


def test_schedule_stays_within_a_block():
    r = random.Random(9)
    for _ in range(40):
        weights = {f"s{i}": r.random() + 0.01 for i in range(r.randint(1, 12))}
        share = mixing.shares(weights, 200)
        assert sum(share.values()) == 200
        order = mixing.pfair(share)
        seen = Counter()
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[k] - a * t / 200) < 1 for k, a in share.items())


def test_shares_of_skewed_sources_end():
    """The sources lifted to one slot have none to give back."""
    tiny = {f"t{i}": 0.0001 for i in range(10)}
    for weights in ({"big": 5e6 ** 0.5, "a": 1, "b": 1, "c": 1}, {"big": 0.999, **tiny}):
        share = mixing.shares(weights)
        assert share == {s: 1 if s != "big" else 1001 - len(weights) for s in weights}
    many = {f"m{i}": 1 + i for i in range(1500)}
    assert set(mixing.shares(many).values()) == {1}


def test_schedule_stays_within_a_block_of_the_weights():
    """Of the weights as given, not of rounded ones, over far more slots than a period has."""
    r = random.Random(10)
    cases = [({"a": 0.6004999, "b": 0.3995001}, {"a": 40000, "b": 40000}),
             ({"big": 0.9991, "t": 0.0004, "u": 0.0005}, {"big": 50000, "t": 500, "u": 500}),
             ({f"m{i}": 0.01 + r.random() for i in range(1200)}, {f"m{i}": 40 for i in range(1200)}),
             ({"big": 5e6 ** 0.5, "x": 1.0, "y": 1.0, "z": 1.0}, {"big": 312500, "x": 1, "y": 1, "z": 1})]
    for weights, blocks in cases:
        plan, total = mixing.phases(blocks, weights), sum(weights.values())
        every = np.concatenate([at + (np.arange(blocks[s] - first) if p is None else p) for s, first, at, p in plan])
        assert np.array_equal(np.sort(every), np.arange(sum(blocks.values())))
        ends = min(at for *_, at, _ in plan if at) if any(at for *_, at, _ in plan) else len(every)
        for s, _, at, p in plan:
            if at == 0:
                k = np.arange(len(p))  # before and after each block of the first phase
                assert (np.abs(k - p * (weights[s] / total)) < 1 + 1e-9).all()
                assert (np.abs(k + 1 - (p + 1) * (weights[s] / total)) < 1 + 1e-9).all()
        for s in weights:
            n = sum(len(p) for x, _, at, p in plan if x == s and at == 0)
            assert abs(n - ends * weights[s] / total) < 1 + 1e-9


def test_mixing(docs, odd, empty):
    got = mixing.schedule(docs, {"s0": 3, "s1": 1, "gone": 1}, block=2).toPandas().sort_values("position")
    assert len(got) == docs.count() and got.position.is_unique
    slots = got.drop_duplicates("slot")
    assert slots.slot.tolist() == list(range(len(slots)))
    first = slots.source.tolist()[:8]
    assert all(abs(first[:t].count("s0") - 0.75 * t) < 1 for t in range(1, 9))
    late = slots[~slots.source.isin(["s0", "s1"])]
    assert late.slot.min() > slots[slots.source.isin(["s0", "s1"])].slot.max()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(r[0] for r in out.collect()) == list(range(docs.count()))
    assert mixing.schedule(odd).count() == 8 and mixing.mixed(odd).count() == 8
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_toxicity(spark, docs, odd, empty):
    """Telling words, an inflected one too, are learned; held-out texts are told apart; long ones and nulls get scores."""
    r = random.Random(6)
    data = []
    for i in range(900):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randint(3, 80))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["dreadful", "AWFUL!", f"grossest{r.randrange(50)}"])
        data.append((i, " ".join(w), ["en", "fr", None][i % 3], int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    labels = df.where("doc_id < 700").select("doc_id", "toxic").unionAll(
        spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.train(df.drop("toxic"), labels)
    got = toxicity.score(df, model).where("doc_id >= 700").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.95 and (got.rejected == (got.toxic == 1)).mean() > 0.95
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score(odd, model, keep_text=False).count() == 8 and toxicity.score(empty, model).count() == 0
    assert toxicity.train(df, labels.where("toxic = 0")) is None
    assert toxicity.score(odd, None).where("score = 0 AND NOT rejected").count() == 8


def labelled(spark, many, early):
    """Short documents, every other one toxic by a word; the toxic ones behind the first `early` by hash have one of
    their own. Ids from `many` on come without label."""
    r = random.Random(8)
    data = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(4, 9))), ["en", "fr", None][i % 3], i % 2)
            for i in range(many + 200)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    known = df.where(F.col("doc_id") < many)
    by = Window.orderBy(F.xxhash64("doc_id"))
    late = known.where("toxic = 1").withColumn("n", F.row_number().over(by)).where(F.col("n") > early).select("doc_id")
    late = F.broadcast(late.union(df.where(F.col("doc_id") >= many).select("doc_id")).withColumn("late", F.lit(1)))
    text = F.when(F.col("toxic") == 1, F.concat("text", F.when(F.col("late") == 1, " vile").otherwise(" awful")))
    docs = df.join(late, "doc_id", "left").select("doc_id", F.coalesce(text, "text").alias("text"), "lang", "toxic")
    return docs.select("doc_id", "text", "lang"), known.select("doc_id", "toxic")


def test_toxicity_learns_from_all_labels(spark):
    docs, labels = labelled(spark, 2600, 1000)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("doc_id >= 2600").toPandas()
    assert ((scored.score >= 0.5) == (scored.doc_id % 2 == 1)).mean() > 0.95
    assert (scored.rejected == (scored.doc_id % 2 == 1)).mean() > 0.95


def test_toxicity_learns_by_shards(spark, monkeypatch):
    """Shards and windows, with ids that come again and empty texts; wherever rows are, the model is the same."""
    monkeypatch.setattr(toxicity, "ROWS", 150)
    monkeypatch.setattr(toxicity, "SHARDS", 4)
    monkeypatch.setattr(toxicity, "WINDOW", 90)
    docs, labels = labelled(spark, 900, 300)
    docs = kept(docs.union(docs.where("doc_id % 50 = 7")).union(
        spark.createDataFrame([(1, None, "en"), (2, "", None)], docs.schema)), "docs")
    one, two = (toxicity.train(docs.repartition(n, F.xxhash64(F.lit(n), "doc_id", "text")), labels) for n in (2, 5))
    for a, b in ((one.embedding, two.embedding), (one.filters, two.filters), (one.weight, two.weight)):
        assert (a == b).all()
    assert one.thresholds == two.thresholds and set(one.thresholds) == {"en", "fr", None}
    scored = toxicity.score(docs, one).where("doc_id >= 900").toPandas()
    assert (scored.rejected == (scored.doc_id % 2 == 1)).mean() > 0.95


def test_thresholds(spark):
    r = random.Random(9)
    data = [(["en", None, "fr", "de"][i % 4], round(r.random(), 1), int(r.random() < 0.5)) for i in range(200)]
    data = [(lang, s, 0 if lang == "de" else y) for lang, s, y in data] + [("it", 0.25, 1), ("it", 0.75, 0)]
    got = toxicity.thresholds(spark.createDataFrame(data, "lang string, score double, label int"))
    want = {}
    for lang in ("en", "fr", "it", None):
        own = [(s, y) for x, s, y in data if x == lang]
        known = sorted({s for s, _ in own})
        edges = [0.0, *((a + b) / 2 for a, b in zip(known, known[1:])), 1.0]
        if known[-1] == 1:
            edges[-1] = 1.0000001
        wrong = {e: sum((s >= e) != y for s, y in own) for e in edges}
        want[lang] = min(1.0, min(edges, key=lambda e: (wrong[e], abs(min(e, 1.0) - 0.5), e)))
    assert got == want


def test_language_model(spark, docs, rows, odd, empty, monkeypatch):
    monkeypatch.setattr(ngram, "UNIT", 500)
    monkeypatch.setattr(ngram, "PART_CHARS", 20000)
    tokens = {i: [*words(t), "\0"] for i, t in rows.items()}
    learned = [i for i in rows if i % 4]
    one = Counter(w for i in learned for w in tokens[i])
    two = Counter(p for i in learned for p in zip(["\0", *tokens[i]], tokens[i]))
    n, v = sum(one.values()), len(one)
    by = docs.doc_id % 4
    got = {r["doc_id"]: r for r in ngram.score_texts(docs, by != 0, by == 1).collect()}
    assert len(got) == len(rows)
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and -math.inf < r["score"] <= 0
        most = sum(math.log10(max(two[p] / max(one[p[0]], 1), one[p[1]] / n, 1 / (v + 1)))
                   for p in zip(["\0", *w], w))
        assert r["score"] <= most + 1e-9
    assert ngram.score_texts(odd, odd.doc_id.isNotNull(), odd.doc_id == 7).count() == 8
    assert ngram.score_texts(empty, empty.doc_id > 0, empty.doc_id > 1).count() == 0


def test_weights_from_held_out_counts():
    cells = [(3, 4 * 6, 4 * 9, 900), (3, 4 * 6, -(1 << 20), 100), (0, -(1 << 20), -(1 << 20), 50)]
    w = ngram.learn(cells)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.8 and w[0, 2] > 0.99 and np.allclose(ngram.learn([]), 1 / 3)
