"""Token counts against the library's own encoding of whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece

from artifactgate.llm import tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def small(monkeypatch):
    """Windows so short that every text has many; tasks get the sizes with the functions that use them."""
    monkeypatch.setattr(tokens, "CHUNK", 60)
    monkeypatch.setattr(tokens, "OVERLAP", 16)


def counted(texts):
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [(i, len((t or "").encode()), n := len(encoder.encode(t or "")), n > 4096) for i, t in enumerate(texts)]


def texts():
    rng = random.Random(5)
    alphabets = ["abcdefghij etaoin ", "aaaa a", "  \t\n x", "漢字かな \U0001d11e", "▁ ▁a<s></s><0x0A>", "=-_#", "инфо "]
    out = [None, "", " ", "<s> hello </s> <unk>", "word " * 30_000, "=" * 70_000, " " * 40_000, "a" * 33_000 + " b " + "the cat " * 9_000]
    return out + ["".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 59, 60, 61, 119, 121, 500, 3_000]))) for _ in range(120)]


def test_windows_of_every_kind_align_or_widen(small):
    """The windows of a text, spliced by hand, and widened where they don't align."""
    model = tokens.load(open(MODEL, "rb").read())
    whole = 0
    for text in (t for t in texts() if t and len(t) < 5_000):
        cut = [text[lo : lo + tokens.CHUNK + tokens.OVERLAP] for lo in range(0, len(text), tokens.CHUNK)]
        cores = [min(tokens.CHUNK, len(text) - k * tokens.CHUNK) for k in range(len(cut))]
        spans = [tokens.encoded_window(model, t, core, k == 0, k == len(cut) - 1) for k, (t, core) in enumerate(zip(cut, cores))]
        joints = [(a.right - core, b.left) for a, core, b in zip(spans, cores, spans[1:])]
        assert all(right == left or right + core < 0 for (right, left), core in zip(joints, cores))
        if all(s.tokens >= 0 for s in spans):
            whole += len(spans) > 1
            assert sum(s.tokens for s in spans) == len(model.encoder.encode(text))
    assert whole > 30


def test_operator(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(rows)], "doc_id int, text string, window string, row int").repartition(3)
    got = tokens.token_counts(docs, MODEL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == counted(rows)


def test_repeated_and_missing_ids(spark):
    long = "some words of text, " * 5_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (1, "b")], "doc_id bigint, text string")
    n = len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(long))
    assert sorted(tokens.token_counts(docs, MODEL).collect(), key=str) == sorted([(1, len(long), n, True)] * 2 + [(None, len(long), n, True), (1, 1, 1, False)], key=str)
    assert tokens.token_counts(docs.limit(0), MODEL).collect() == []


def test_stable_positions_split_any_text():
    model = tokens.load(open(MODEL, "rb").read())
    for text in (t for t in texts() if t and len(t) < 4_000):
        starts = {x[0] for x in model.encoder.encode(text, return_type="offset_mapping")["offsets"]}
        assert set(tokens.stable(text, model.pairs).tolist()) <= starts
