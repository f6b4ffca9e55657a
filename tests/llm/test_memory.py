"""What a Python worker holds while it works on a slice of text, and from one task to the next."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from trajspark.llm import packing, phrases, toxicity


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(n)]


def test_scoring_holds_no_windows_of_a_whole_slice(monkeypatch):
    w = words(120_000, 1)
    texts = [" ".join(w[:70_000]), "", None, *(" ".join(w[i:i + 50]) for i in range(70_000, len(w), 50)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    ids, first = toxicity.buckets(batch.column(1))
    model = toxicity.Model.new()
    model.scores(ids[:, :9], np.array([0, 4, 9]))
    tracemalloc.start()
    got = model.scores(ids, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 * len(w), peak / len(w)
    top = np.maximum(model.pooled(ids, first)[0] + model.bias, 0)
    whole = 1 / (1 + np.exp(-(top @ model.weight + model.intercept).astype(np.float64)))
    np.testing.assert_allclose(got, whole, rtol=0, atol=1e-6)
    monkeypatch.setattr(toxicity, "PLACES", 1)  # windows that begin between texts, in each place and at both ends
    few = ids[:, first[3]:first[6]], first[3:7] - first[3]
    np.testing.assert_allclose(model.scores(*few)[:2], whole[3:5], rtol=0, atol=1e-6)
    monkeypatch.setattr(toxicity, "WORDS_BYTES", 1000)
    parts, begin = toxicity.buckets_of(batch, "text")
    assert (parts == ids).all() and (begin == first).all()


def test_encoder_remembers_words_in_few_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 70_000)
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    column = pa.array([" ".join(words(500, i)) for i in range(130)])
    encoder.encode(column[:1])
    tracemalloc.start()
    for i in range(0, len(column), 10):
        encoder.encode(column[i:i + 10])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 70 * len(encoder.known), held / len(encoder.known)


def test_encoder_forgets_and_learns_again(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    column = pa.array([" ".join(words(300, i % 7)) for i in range(20)] + ["", None, "a a b"])
    whole, at = packing.Encoder(path).encode(column)
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    encoder = packing.Encoder(path)
    for i in range(len(column)):
        ids, ends = encoder.encode(column[i:i + 1])
        assert ids.tolist() == whole[at[i]:at[i + 1]].tolist() and ends.tolist() == [0, at[i + 1] - at[i]]
        assert len(encoder.known) == len(encoder.place) <= 500


class Caught:
    """Stands for a table and keeps the function that would run on it."""

    def __getattr__(self, name):
        def call(*args, **_):
            if name in ("mapInArrow", "applyInArrow"):
                self.run = args[0]
            return self
        return call


def test_units_of_phrases_hold_one_order_at_a_time():
    r = np.random.default_rng(3)
    w = sorted(set(words(20_000, 5)))
    tokens = r.integers(0, len(w) + 1, 600_000)  # 0 ends a piece
    tokens[300_000:] = tokens[:300_000]
    names, types = ["unit", "lang", "words", "tokens"], [pa.int64(), pa.string(), pa.binary(), pa.binary()]
    unit = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
        (7, "en", " ".join(w).encode(), phrases.low(tokens, 4)), types)], names)
    sender, counter = Caught(), Caught()
    phrases.summaries(sender, [3, 4, 5], 40)
    phrases.counted(counter, Caught(), [3, 4, 5], 40, False)
    next(sender.run(iter([unit])))
    tracemalloc.start()
    large = max(sum(len(k.as_py()) for k in sent["keys"]) for sent in sender.run(iter([unit])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(tokens), peak / len(tokens)
    assert large <= 2 << 20  # bytes of hashes in one batch
    sent = [x for batch in sender.run(iter([unit])) for x in batch.to_pylist()]
    inside = [sum((np.lib.stride_tricks.sliding_window_view(tokens, k) > 0).all(1)) for k in (3, 4, 5)]
    assert [sum(int(phrases.wide(x["counts"]).sum()) for x in sent if x["ord"] == k) for k in (3, 4, 5)] == inside
    bits = [(7, x["ord"], x["part"], np.packbits(phrases.wide(x["counts"]) > 2).tobytes(), len(x["keys"]) // 8)
            for x in sent]
    group = pa.concat_tables([pa.Table.from_batches([unit]), pa.table(
        [pa.array(x, t) for x, t in zip(zip(*bits), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))],
        ["unit", "ord", "part", "bits", "size"])], promote_options="default")
    del sent, bits
    tracemalloc.start()
    counter.run(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * len(tokens), peak / len(tokens)


def test_units_of_phrases_send_the_same_in_small_steps(monkeypatch):
    r = np.random.default_rng(4)
    w = [f"é{i}" for i in range(900)]
    tokens = r.zipf(1.2, 5000) % (len(w) + 1)
    unit = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["fr"]), pa.array([" ".join(w).encode()]),
                                       pa.array([phrases.low(tokens, 4)])], ["unit", "lang", "words", "tokens"])
    sender, counter = Caught(), Caught()
    phrases.summaries(sender, [1, 2, 3], 9)
    phrases.counted(counter, Caught(), [1, 2, 3], 9, True)

    def results():
        sent = [x for batch in sender.run(iter([unit, unit])) for x in batch.to_pylist()]
        bits = [(1, x["ord"], x["part"], np.packbits(phrases.wide(x["counts"]) > 2).tobytes(), len(x["keys"]) // 8)
                for x in sent[:len(sent) // 2]]
        group = pa.concat_tables([pa.Table.from_batches([unit]), pa.table(
            [pa.array(x, t) for x, t in zip(zip(*bits), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))],
            ["unit", "ord", "part", "bits", "size"])], promote_options="default")
        return sent, counter.run(group).to_pylist()

    want = results()
    for name, x in (("BLOCK", 7), ("SEND", 10), ("WORDS_BYTES", 20)):
        monkeypatch.setattr(phrases, name, x)
    assert results() == want
    found = {(k["size"], p): n for k in want[1] if k["part"] is not None
             for p, n in zip(k["words"].split(b"\n"), phrases.wide(k["tokens"]).tolist())}
    count = {}
    for k in (1, 2, 3):
        for i in range(len(tokens) - k + 1):
            if all(tokens[i:i + k]):
                p = k, " ".join(w[j - 1] for j in tokens[i:i + k]).encode()
                count[p] = count.get(p, 0) + 1
    assert found == {p: n for p, n in count.items() if n > 2} and len({p[0] for p in found}) == 3
    short = next(k for k in want[1] if k["part"] is None)
    assert short["n"] < sum(tokens > 0) and set(short["words"].split(b" ")) <= {x.encode() for x in w}
