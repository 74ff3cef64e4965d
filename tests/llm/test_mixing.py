import json
import random

import numpy as np

from artifactgate.llm import mixing

WORDS = {"en": "the and of to in hat thing that with not".split(), "de": "der die und für über ich schön groß nicht".split(), "fr": "le été çà où très déjà être pas aux".split()}


def corpus(spark, n=400):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        lang = rng.choice(["en"] * 6 + ["de"] * 2 + ["fr"])
        rows.append((k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 60))), lang, 1))
    rows += [(n, None, "en", 1), (n + 1, "", None, 1), (None, "the thing", "en", 1), (3, rows[3][1], rows[3][2], 1)]
    labels = [(k, 1 if k % 3 else 0) for k in range(0, n, 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, rate int"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_totals_reach_the_targets_and_match_numpy(spark):
    docs, labels = corpus(spark)
    out = mixing.report(docs, labels).collect()
    assert len(out) == 404
    domains = ["de", "en", "fr"]
    p = np.array([[json.loads(r.posterior)[d] for d in domains] for r in out])
    t = np.array([r.tokens for r in out], dtype=float)
    assert np.allclose(p.sum(axis=1), 1)
    own = p.T @ t
    want = own.sum() * np.sqrt(own) / np.sqrt(own).sum()
    r = np.array([x.rate for x in out])
    assert (r >= 0).all() and np.allclose(p.T @ (r * t), want, rtol=2e-4)
    # The same descent in numpy.
    use = t > 0
    m = (p[use] * t[use, None]).T @ p[use]
    scale = np.diag(m)
    size = 1 / np.linalg.eigvalsh(m / np.sqrt(np.outer(scale, scale)))[-1]
    x = np.ones(len(t))
    for _ in range(mixing.MAX_STEPS):
        e = p[use].T @ (x[use] * t[use]) - want
        if (np.abs(e) <= mixing.TOLERANCE * want).all():
            break
        x = np.maximum(0, x - p @ (size * e / scale))
    assert np.allclose(x, r, rtol=1e-6, atol=1e-9)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in out)


def test_no_labels_and_empty_tables(spark):
    docs, labels = corpus(spark, 20)
    assert {(r.rate, r.copies, r.posterior) for r in mixing.report(docs, labels.limit(0)).collect()} == {(1.0, 1, None)}
    assert mixing.report(docs.limit(0), labels).count() == 0
    assert mixing.mixed(docs, labels).columns == [*docs.columns, "_posterior", "_rate", "_copies"]


def test_capitals_and_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    capitals = docs.where("doc_id < 400").selectExpr("doc_id + 1000 AS doc_id", "upper(replace(text, 'ß', 's')) AS text", "lang", "rate")
    lower = docs.where("doc_id < 400").selectExpr("doc_id + 2000 AS doc_id", "replace(text, 'ß', 's') AS text", "lang", "rate")
    out = {r.doc_id: r for r in mixing.report(docs.union(capitals).union(lower), labels).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    for k in range(400):
        assert out[1000 + k].posterior == out[2000 + k].posterior
    guess = lambda k: max((p := json.loads(out[k].posterior)), key=p.get)
    held_out = [k for k in range(1, 400, 2)]
    assert sum(guess(k) == lang[k] for k in held_out) >= 0.99 * len(held_out)
