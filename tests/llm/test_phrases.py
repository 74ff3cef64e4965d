"""Collocations against a plain count of all phrases, with budgets that split every prefix, and the SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from artifactgate.llm import phrases, queries
from oracle import same


def brute(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in found.items():
            if any(len(q) > len(p) and found[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in found):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1)]
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamé", "of", "the", "x\x00y", "Ж", "q r", "end"]
    rows = []
    for k in range(300):
        text = "".join(rng.choices(words, [3, 3, 2, 9, 9, 1, 1, 1, 2])[0] + rng.choices([" ", "\t ", ". ", "\n", ",", "\x0b"], [20, 2, 2, 1, 1, 1])[0] for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, ""]), text))
    return rows + [("en", "the very same line of text again and again ") for _ in range(200)] + [("en", None), (None, "")] + [("en", "the the the the the the")] * 30


@pytest.mark.parametrize("budget,most_words", [(phrases.BUDGET, phrases.MOST_WORDS), (150, phrases.MOST_WORDS), (150, 0), (1_000_000, 0)])
def test_against_all_phrases(spark, budget, most_words):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id int, lang string, text string, key int").repartition(5)
    got = phrases.collocations(docs, least=12, top=40, budget=budget, most_words=most_words)
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 40)


def test_heavy_prefixes_are_dealt_on(spark):
    """A prefix beyond the budget gets several groups, down to the last word but one."""
    docs = spark.createDataFrame([("en", "a b c d e a b c d f a b c g")] * 100, "lang string, text string")
    words, _ = phrases.frequencies(docs, 10, 50)
    counts = np.array([r.f for r in words.orderBy("key").collect()])
    stretches = spark.createDataFrame([(__import__("zstandard").compress(np.tile(np.array([0, 1, 2, 3, 4], dtype=np.uint32), 100).tobytes()),)], "stretch binary")
    p = phrases.partitioned(stretches, words, np.full(len(counts), 100), np.uint32, 50)
    assert len(p.heavy) == phrases.DEPTH - 1 and p.split_to(int(p.heavy[2][1][0])) == 3 and p.split_to(0) == 0


def test_long_stretches_lose_no_suffix():
    numbers = np.random.default_rng(1).integers(0, 4, 1000).astype(np.uint32)
    whole = sorted(zip(*(w.tolist() for w in phrases.suffix_words(numbers))))
    import pyarrow as pa
    import zstandard

    batch = pa.RecordBatch.from_arrays([pa.array([zstandard.compress(numbers.tobytes())])], ["stretch"])
    before, phrases.COMBINED = phrases.COMBINED, 64
    try:
        parts = sorted(x for part in phrases._buffered(iter([batch]), np.uint32) for x in zip(*(w.tolist() for w in part)))
    finally:
        phrases.COMBINED = before
    assert parts == whole


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id int, lang string, text string")).collect() == []


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert same(queries.op11_phrases(spark, sf), queries.ORACLES["op11_phrases"], sf) > 0
