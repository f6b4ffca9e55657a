import random

import public_tokenizers
import pytest
import sentencepiece

from trajspark.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_parts_count_like_the_whole(model):
    count, r = tokens.Counter(PATH), random.Random(1)
    assert count.plain
    some = ["a", "the ", " ", "  ", "\n", "\t", "é", "漢", "字", "1", "23", "▁", "<s>", "</s>", "<unk>", "\x00", ".", ", ",
            "😀", "é", "ation", " q", "\r\n", "//", "=="]
    for _ in range(1500):
        text = "".join(r.choice(some) for _ in range(r.randrange(40)))
        for size in (1, 3, 7):
            parts = list(count.parts(text, size))
            assert sum(len(model.encode(p)) - over for p, over in parts) == len(model.encode(text)), (text, parts)


def test_long_texts_are_split(model, monkeypatch):
    count = tokens.Counter(PATH)
    text = "some words, é and 12345 more\n" * 4000
    assert len(list(count.parts(text))) > 5
    endless = "a" * 50_000
    assert len(list(count.parts(endless))) == 1
    want = [len(model.encode(t)) for t in (text, endless, "", " ")]
    assert count.lengths([text, endless, "", " "]) == want
    monkeypatch.setattr(tokens, "BATCH_BYTES", 1)
    assert count.lengths([text, endless, "", " "]) == want


def test_token_counts(spark, docs, odd, empty, rows, model):
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.token_counts(docs, PATH, limit=100).collect()}
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows.items()}
    assert got == {i: (b, n, n > 100) for i, (b, n) in want.items()}
    assert any(x[2] for x in got.values()) and not got[0][2]
    ids = [r["doc_id"] for r in tokens.token_counts(odd, PATH).collect()]
    assert sorted(ids, key=str) == sorted([r["doc_id"] for r in odd.collect()], key=str)
    assert tokens.token_counts(empty, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert tokens.token_counts(empty, PATH).count() == 0
