"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed and of a learned lexicon, lexicon
words near second-person words, capitals, punctuation, and obfuscated spellings.
The learned lexicon holds words and word beginnings of four to seven letters that occur far
more often in toxic training texts (log-likelihood ratio). Training uses at most
``SAMPLE`` labelled rows, taken by the hash of doc_id, whose crc32 remainder is
not 0; of them those with remainder 4 fit the isotonic curve and the rest the
lexicon and the trees. Scoring is one narrow pass over all texts.

Defined results: a null text counts as empty, and empty texts are scored as any
other; a null doc_id is never learned from and counts as held out; of repeated
labels of a document the largest counts; without labels of both kinds every
score is the share of toxic labels (0 without labels). Columns of any other
name stay out of the scores; one named _toxicity is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactgate.llm.common import stored

#: Labelled rows that training takes at most.
SAMPLE = 20_000
LEXICON_SIZE = 400
#: Least log-likelihood ratio of a learned entry.
MIN_RATIO = 15.0
#: Least times as frequent in toxic texts as in others.
MIN_LIFT = 10.0
#: Lengths of the word beginnings that are entries of their own.
PREFIXES = 4, 5, 6, 7
TREES, DEPTH = 20, 3

#: Common insults of English, and second-person words of four languages.
INSULTS = frozenset("idiot idiots stupid moron morons scum trash loser losers pathetic worthless disgusting clown dumb fool filthy garbage vermin jerk creep coward liar freak retard imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
LEET = str.maketrans("01345789@$!", "oieastbgasi")

_WORD = re.compile(r"[^\W_]+")
#: A word with a digit or sign among its letters.
_OBFUSCATED = re.compile(r"\b[^\W\d_]+[0-9@$*!]+[^\W_]+\b")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_PUNCTUATION = re.compile(r"[^\w\s]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")



def entries(word: str) -> tuple[str, ...]:
    """A word's lexicon entries: itself and, of longer words, its beginnings."""
    return (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k))


def features(text: str, learned: dict[str, float]) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    weight = {w: max(learned.get(e, 0.0) for e in entries(w)) for w in distinct}
    weight = {w: v for w, v in weight.items() if v}
    odd = _OBFUSCATED.findall(low)
    disguised = [w for w in odd if (p := w.replace("*", "").translate(LEET)) in INSULTS or any(e in learned for e in entries(p))]
    hits = [k for k, w in enumerate(words) if w in weight or w in INSULTS] if weight or distinct & INSULTS else []
    near = sum(1 for k in hits if not SECOND_PERSON.isdisjoint(words[max(0, k - 3) : k + 4])) if hits and distinct & SECOND_PERSON else 0
    return [
        sum(weight.get(words[k], 0.0) for k in hits) / n,
        sum(weight.values()),
        float(len(weight)),
        max(weight.values(), default=0.0),
        float(len(hits)),
        len(hits) / n,
        float(len(distinct & INSULTS)),
        near / n,
        len(_CAPITAL.findall(text)) / chars,
        len(_SHOUTED.findall(text)) / n,
        text.count("!") / n,
        len(_PUNCTUATION.findall(text)) / chars,
        (len(odd) + len(_REPEATED.findall(low))) / n,
        float(len(disguised)),
    ]


def _remainder(id_col):
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(rest, toxic, text) of the bounded sample."""
    labels = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("of IS NOT NULL AND toxic IS NOT NULL")
    chosen = labels.groupBy("of").agg(F.max("toxic").alias("toxic")).where(_remainder(F.col("of")) != 0).orderBy(F.xxhash64("of"), "of").limit(SAMPLE)
    # Bounded by SAMPLE rows of a number and a flag.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    return rows.select(_remainder(F.col("doc_id")).alias("rest"), "toxic", F.coalesce("text", F.lit("")).alias("text"))


def learn_lexicon(training: DataFrame) -> dict[str, float]:
    """Entry -> weight: the log of how much more often it occurs in toxic texts; LEXICON_SIZE entries at most."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                counts = Counter(), Counter()
                for toxic, text in zip(batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512).to_pylist()):
                    counts[toxic].update({e for w in set(_WORD.findall(text.lower())) for e in entries(w)})
                own = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array([counts[toxic][e] for e in own], pa.int64()) for toxic in (1, 0))], ["entry", "a", "b"])

    n = training.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    p, q = F.lit(n[0] + 1.0), F.lit(n[1] + 1.0)
    counts = training.select("toxic", "text").dropDuplicates(["toxic", "text"]).mapInArrow(emit, "entry string, a bigint, b bigint").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    expected = (F.col("a") + F.col("b")) / (p + q)
    log = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (log(F.col("a"), expected * p) + log(F.col("b"), expected * q))
    lift = F.log((F.col("a") + 0.25) / p) - F.log((F.col("b") + 0.25) / q)
    best = counts.select("entry", ratio.alias("ratio"), lift.alias("lift")).where((F.col("lift") > math.log(MIN_LIFT)) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("ratio"), "entry").limit(LEXICON_SIZE)
    return {r["entry"]: r["lift"] for r in best.collect()}


def _with_features(rows: DataFrame, text_col: str, learned: dict[str, float], name: str) -> DataFrame:
    place = rows.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([features(t or "", learned) for t in batch.column(place).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], batch.schema.names)

    out = rows.withColumn(name, F.lit(None).cast("array<double>"))
    return out.mapInArrow(add, out.schema)


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``_toxicity`` from 0 to 1."""
    docs = docs.drop("_toxicity", "_toxic_features", "_toxic_vector", "_toxic_class", "_toxic_raw", "_toxic_probability", "_toxic_x")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    training = stored(_training(rows, labels), "training")
    fit, curve = training.where("rest <> 4"), training.where("rest = 4")
    kinds = training.groupBy(F.col("rest") == 4, F.col("toxic") > 0).count().collect()
    of = {(r[0], r[1]): r[2] for r in kinds}
    if not of.get((False, True)) or not of.get((False, False)):
        total = sum(of.values())
        return docs.withColumn("_toxicity", F.lit(sum(n for (_, toxic), n in of.items() if toxic) / total if total else 0.0))
    learned = learn_lexicon(fit.withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    table = stored(_with_features(training.select("rest", (F.col("toxic") > 0).cast("double").alias("label"), "text"), "text", learned, "f").drop("text"), "features").withColumn("features", array_to_vector("f")).coalesce(2).cache()
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=2, seed=6).fit(table.where("rest <> 4"))
    trees.setFeaturesCol("_toxic_vector").setPredictionCol("_toxic_class").setRawPredictionCol("_toxic_raw").setProbabilityCol("_toxic_probability")
    curve_of = None
    if of.get((True, True), 0) >= 5 and of.get((True, False), 0) >= 5:
        seen = trees.transform(table.where("rest = 4").withColumnRenamed("features", "_toxic_vector")).select("label", vector_to_array("_toxic_probability")[1].alias("x"))
        curve_of = IsotonicRegression(featuresCol="x", labelCol="label", predictionCol="_toxicity").fit(seen)
        curve_of.setFeaturesCol("_toxic_x")
    table.unpersist()
    out = _with_features(docs, text_col, learned, "_toxic_features").withColumn("_toxic_vector", array_to_vector("_toxic_features"))
    out = trees.transform(out).withColumn("_toxic_x", vector_to_array("_toxic_probability")[1])
    out = curve_of.transform(out) if curve_of else out.withColumn("_toxicity", F.col("_toxic_x"))
    return out.select(*(f"`{c}`" for c in docs.columns), F.least(F.greatest("_toxicity", F.lit(0.0)), F.lit(1.0)).alias("_toxicity"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, a row per document."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (_remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` whose score is under 0.5, same columns."""
    return scored(docs, labels).where("_toxicity < 0.5").drop("_toxicity")
