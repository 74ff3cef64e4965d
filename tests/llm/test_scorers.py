import random

import numpy as np
from pyspark.sql import functions as F

from artifactgate.llm import quality, toxicity


def corpus(spark, n=600):
    rng = random.Random(11)
    words = "river stone market garden window letter summer winter music paper you your they light".split()
    rows, labels = [], []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["grobianlich", "grobianisch", "idiot", "moron"]))
        rows.append((k, " ".join(own), 0.5))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, int(toxic)))
    rows += [(n, None, 0.1), (n + 1, "", 0.1), (None, "idiot moron", 0.1), (4, rows[4][1], 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, features double"), spark.createDataFrame(labels + [(n + 9, None), (None, 1), (0, 1)], "doc_id bigint, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    out = toxicity.report(docs, labels).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id").isin(600, 601)).count() == 2


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(12)
    words = "river stone market garden window letter summer winter music paper light morning evening story people".split()
    rows = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(5)), "x") for k in range(300)]
    rows += [(1000 + k, " | ".join(rng.choice(["###", "%%%", "$$$", "a", "@@"]) for _ in range(60)), "x") for k in range(60)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "   ", "x")]
    out = {r.doc_id: r for r in quality.report(spark.createDataFrame(rows, "doc_id bigint, text string, votes string")).collect()}
    assert len(out) == len(rows)
    assert all(out[k].keep for k in range(300)) and not any(out[1000 + k].keep for k in range(60)) and not any(out[k].keep for k in (2000, 2001, 2002))
    assert quality.report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_quality_votes_and_features_match_plain_python():
    import pyarrow as pa

    from artifactgate.llm import textops

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ha", "Ha", "of", "stone", "##", "a1"]) for _ in range(rng.randrange(0, 90))) for _ in range(50)]
    ((_, _, data, at),) = textops.slices(pa.array(texts))
    words = textops.split_words(data, at, textops.SPACED)
    again = quality.repeated(words)
    weights = np.random.default_rng(1).standard_normal(quality.WIDTH + 1)
    logits, n = quality.scores(data, at, weights)
    dense = np.concatenate(list(quality.vectors(data, at)))
    assert dense.shape == (50, quality.WIDTH) and np.allclose(dense @ weights[:-1] + weights[-1], logits)
    for k, text in enumerate(texts):
        own = text.lower().split()
        want = [0.0] * (quality.SHARES + 1)
        for w in own:
            want[min(int(np.floor(np.log2(len(own) / own.count(w)))), quality.SHARES - 1)] += 1 / len(own)
        want[-1] = sum(a == b for a, b in zip(own, own[1:])) / max(1, len(own))
        assert n[k] == len(own) and np.allclose(again[k], want)
        v = quality.votes(text)
        assert len(v) == len(quality.LABELLERS)
        if len(own) >= 5:
            same = sum(a == b for a, b in zip(own, own[1:])) / (len(own) - 1)
            assert v[-1] == (-1 if same > 0.25 else 1 if same <= 0.1 else 0)


def test_expectation_maximisation_recovers_accuracies():
    from collections import Counter

    from artifactgate.llm.weak import posteriors

    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < 0.4, 0, np.where(rng.random(20_000) < right, 2 * truth - 1, 1 - 2 * truth)) for right in (0.95, 0.85, 0.8, 0.9)], axis=1)
    counts = sorted(Counter(map(tuple, votes.tolist())).items())
    known = dict(zip([p for p, _ in counts], posteriors([(list(p), c) for p, c in counts], silent=False)))
    spoken = (votes != 0).any(axis=1)
    guess = np.array([known[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (guess == truth)[spoken].mean() > 0.9


def test_quality_of_one_repeated_text_and_clashing_names(spark):
    rows = [(k, "the same words on every page of it", 1) for k in range(200)] + [(None, None, 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _quality int")
    out = quality.scored(frame)
    assert out.columns == ["doc_id", "text", "_votes", "_posterior", "_quality"]
    assert {r._quality for r in out.where("text IS NULL").collect()} == {0.0} and out.select("_quality").where("text IS NOT NULL").distinct().count() == 1


def test_toxicity_features_match_plain_python():
    text = "You IDIOT!! i-d-i-o-t you moron, sooo bad"
    f = toxicity.features(text, {"bad": 1.5})
    words = text.lower().replace("!", " ").replace(",", " ").split()
    assert len(f) == 14 and f[3] == 1.5 and f[6] == 2.0 and f[10] > 0 and f[8] == sum(c.isupper() for c in text) / len(text)
    assert f[0] > 0 and toxicity.features("", {}) == [0.0] * 14 and len(words) == 7
