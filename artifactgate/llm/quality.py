"""Quality: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller looks at one property of the whole text and votes good (1), bad
(-1) or abstains (0). The votes of all documents are counted by pattern (at most
3**9 rows); expectation-maximisation over the counts estimates how accurate each
labeller is where it votes and gives each pattern a posterior. The posteriors of
at most ``SAMPLE`` documents train a logistic scorer over hashed words, hashed
byte pairs and how often words are repeated, which scores every whole text in
one narrow pass. The sample holds the rows of the smallest hashes of id and text;
rows equal in both enter once, so that no repeated row fills it.

Defined results: a null text counts as empty; a text without words is bad, score
0; where all posteriors of the sample stand at one end, every text with words has
their mean as its score; a score of exactly 0.5 is kept. Columns named _votes,
_posterior and _quality are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artifactgate.llm import textops
from artifactgate.llm.common import stored
from artifactgate.llm.weak import posteriors

SAMPLE = 8_000
#: Times that a bad vote counts at the start: most documents are good, and most labellers see only one kind of bad one.
AGAINST = 4.0
#: Hashed features of words, and as many of byte pairs; classes of a word's share of its text; rows made dense at a time.
BUCKETS, SHARES, DENSE_ROWS = 1024, 8, 256
WIDTH = 2 * BUCKETS + SHARES + 1
LABELLERS = ("length", "variety", "symbols", "letters", "capitals", "top_word", "lines", "word_length", "runs")

_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_SYMBOL = np.ones(256, dtype=bool)
_SYMBOL[[ord(c) for c in " \t\r\n\f\v.,;:'\"?-()0123456789"]] = False
_SYMBOL &= ~_PLAIN
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True


def _vote(x: float, bad_under: float, good_from: float) -> int:
    return -1 if x < bad_under else 1 if x >= good_from else 0


def votes(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    words = text.lower().split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [-1] * len(LABELLERS)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = float(_PLAIN[raw].mean()) if len(raw) else 0.0
    capitals = float(_CAPITAL[raw].sum()) / max(1.0, float(_PLAIN[raw].sum()))
    again = sum(x == y for x, y in zip(words, words[1:])) / max(1, n - 1)
    return [
        _vote(n, 5, 40),
        _vote(len(counts) / n**0.8, 0.25, 0.6),
        _vote(-float(_SYMBOL[raw].sum()) / size, -0.02, -0.004),
        _vote(letters, 0.6, 0.75),
        _vote(-capitals, -0.3, -0.1),
        _vote(-counts.most_common(1)[0][1] / n, -0.25, -0.12) if n >= 20 else 0,
        _vote(len(set(lines)) / len(lines), 0.6, 0.95) if len(lines) >= 4 else 0,
        _vote(-abs(len(text) / n - 6.0), -4.0, -2.5),
        _vote(-again, -0.25, -0.1) if n >= 5 else 0,
    ]


def hashed(data: np.ndarray, at: np.ndarray) -> tuple[textops.Words, np.ndarray, np.ndarray]:
    """The words, the feature of each word, and the feature of each byte and its successor (-1 at a text's end)."""
    words = textops.split_words(data, at, textops.SPACED)
    pairs = np.full(len(data), -1, dtype=np.int64)
    if len(data) > 1:
        pairs[:-1] = ((data[:-1].astype(np.int64) * 2654435761 + data[1:].astype(np.int64) * 40503) >> 7) % BUCKETS
    ends = at[1:] - 1
    pairs[ends[ends >= 0]] = -1
    return words, (words.hash % np.uint64(BUCKETS)).astype(np.int64), pairs


def repeated(words: textops.Words) -> np.ndarray:
    """(texts, SHARES + 1): the share of words by the share that the word itself has of the text, in halves, and of words that follow themselves."""
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.hash, text))
    t, h = text[order], words.hash[order]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))) if len(t) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(new, len(t)))
    of = t[new] if len(t) else t
    kind = np.minimum(np.floor(np.log2(n[of] / count)).astype(np.int64), SHARES - 1)
    out = np.bincount(of * (SHARES + 1) + kind, weights=count, minlength=len(n) * (SHARES + 1)).reshape(len(n), SHARES + 1)
    same = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    out[:, SHARES] = np.bincount(text[1:][same], minlength=len(n))
    return out / np.maximum(1, n)[:, None]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scorer's logit, and the number of words, of each text."""
    words, of_word, of_pair = hashed(data, at)
    n = np.diff(words.first)
    by_word = _sums(weights[of_word], words.first) / np.maximum(1, n)
    by_pair = _sums(np.where(of_pair >= 0, weights[BUCKETS + of_pair], 0.0), at) / np.maximum(1, np.diff(at))
    return by_word + by_pair + repeated(words) @ weights[2 * BUCKETS : WIDTH] + weights[-1], n


def vectors(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The dense features of each text, DENSE_ROWS texts at a time: shares of its words, of its byte pairs, and ``repeated``."""
    words, of_word, of_pair = hashed(data, at)
    again = repeated(words)
    for lo in range(0, len(at) - 1, DENSE_ROWS):
        out = np.zeros((min(DENSE_ROWS, len(at) - 1 - lo), WIDTH))
        for k in range(len(out)):
            own = of_word[words.first[lo + k] : words.first[lo + k + 1]]
            out[k, :BUCKETS] = np.bincount(own, minlength=BUCKETS) / max(1, len(own))
            pairs = of_pair[at[lo + k] : at[lo + k + 1]]
            out[k, BUCKETS : 2 * BUCKETS] = np.bincount(pairs[pairs >= 0], minlength=BUCKETS) / max(1, len(pairs))
        out[:, 2 * BUCKETS :] = again[lo : lo + len(out)]
        yield out


def fitted(sample: DataFrame) -> np.ndarray:
    """Weights for (text, posterior) rows, the intercept last."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in textops.slices(batch.column(0)):
                for x in vectors(data, at):
                    # Scaled so that one regularisation fits rare and common features.
                    x *= np.sqrt(BUCKETS)
                    own = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([own, batch.column(1).slice(lo, len(x))], ["f", "p"])
                    lo += len(x)

    ends = sample.agg(F.max("posterior"), F.min("posterior"), F.avg("posterior")).first()
    if ends[0] < 1e-4 or ends[1] > 1 - 1e-4:
        return np.append(np.zeros(WIDTH), np.log(max(ends[2], 1e-9) / max(1 - ends[2], 1e-9)))
    rows = stored(sample.select("text", "posterior").mapInArrow(features, "f array<double>, p double"), "features").select(array_to_vector("f").alias("features"), "p")
    both = rows.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x")).select("features", "x.*").where("weight > 1e-4")
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-6, standardization=False, maxIter=200).fit(both)
    return np.append(model.coefficients.toArray() * np.sqrt(BUCKETS), model.intercept)


def label_model(rows: DataFrame) -> tuple[dict[tuple[int, ...], float], DataFrame]:
    """The posterior of each vote pattern of (id, text), and the sample's (text, posterior)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t or "") for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["votes", "h"])

    place = F.xxhash64("id", "text")
    voted = stored(rows.select("text", place.alias("h")).mapInArrow(vote, "votes array<int>, h bigint"), "votes")
    patterns = sorted((list(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect())
    known = {tuple(p): float(q) for (p, _), q in zip(patterns, posteriors(patterns, against=AGAINST, silent=False))} if patterns else {}
    # Numbers alone are sorted; the texts of those that are chosen are read by their hash.
    chosen = voted.groupBy("h").agg(F.max("votes").alias("votes")).orderBy("h").limit(SAMPLE)
    table = rows.sparkSession.createDataFrame([(list(p), q) for p, q in known.items()], "votes array<int>, posterior double")
    # Both are bounded: at most SAMPLE hashes, and 3**9 patterns.
    chosen = stored(chosen.join(F.broadcast(table), "votes").select("h", "posterior"), "chosen")
    sample = rows.select(F.coalesce("text", F.lit("")).alias("text"), place.alias("h")).join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    return known, stored(sample.select("text", "posterior"), "sample")


def scored(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_votes``, ``_posterior`` and ``_quality``, the score from 0 to 1."""
    docs = docs.drop("_votes", "_posterior", "_quality")
    place = docs.columns.index(text_col)
    known, sample = label_model(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")))
    weights = fitted(sample) if known else np.zeros(WIDTH + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            own = [votes(t or "") for t in texts.to_pylist()]
            out = []
            for _, _, data, at in textops.slices(texts):
                logit, n = scores(data, at, weights)
                out += np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int32())), pa.array([known[tuple(v)] for v in own], pa.float64()), pa.array(out, pa.float64())], [*batch.schema.names, "_votes", "_posterior", "_quality"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("_votes array<int>, _posterior double, _quality double").fields]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score and keep (score of 0.5 or more), a row per document."""
    out = scored(docs.select("doc_id", "text"))
    return out.select("doc_id", F.array_join(F.col("_votes").cast("array<string>"), ",").alias("votes"), F.col("_posterior").alias("posterior"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.5).alias("keep"))
