"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A labelled table says which domain a document belongs to. From it a naive Bayes
model of letter counts is fitted, which gives every document a posterior over
the domains; a document counts as at most ``EVIDENCE`` independent letters, so
posteriors stay soft. Every document then gets a rate of 0 or more, the expected
number of times it is drawn, such that the expected tokens of each domain,
sum(rate * tokens * posterior), come as near as possible to its target in
relative least squares. The rates are found by projected gradient descent from
the rate 1. A step moves a rate by the dot product of its posterior with the
domains' relative errors, so a pass over the documents only has to bring back
one sum per domain, and a rate is a fold over the error vectors since it was last
stored. The descent ends when every domain is within ``TOLERANCE`` of its target,
when the totals no longer move, or after ``MAX_STEPS``; ``Solution.residual`` is
the largest relative distance that is left, and a warning names it where it is
above the tolerance.

Defined results: a null or empty text has no tokens, the labelled table's shares
as its posterior, and takes part without effect on the totals; a null domain is
never learned from; without labelled rows every posterior is null and every rate
1; a domain of the targets that the labelled table lacks is an error. The draws
depend on the doc_id alone, so repeated rows are drawn alike. Other columns are
kept as they are; those named _posterior, _rate and _copies are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactgate.llm.common import stored

#: Letters whose counts the classifier sees, capitals included.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçáíóúñ"
EVIDENCE = 64
#: Domains that a mix may have; error vectors of this length come to the driver.
MAX_DOMAINS = 500
MAX_STEPS = 200
TOLERANCE = 1e-4
#: Steps after which the rates so far are stored, so that a pass folds over no more than these.
STORE_EVERY = 16


class Model(NamedTuple):
    domains: list[str]
    prior: list[float]
    letters: list[list[float]]


class Solution(NamedTuple):
    steps: list[list[float]]
    residual: float


def _vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def token_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("double")


def letter_counts(text: Column) -> Column:
    """How often each letter occurs in either case, from the bytes that go when it is taken out."""
    text = F.lower(text)
    return F.array(*(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / F.lit(len(c.encode()))).cast("double") for c in LETTERS))


def fit(labelled: DataFrame) -> Model | None:
    """The model of (domain, letters); None without rows."""
    labelled = labelled.where("domain IS NOT NULL")
    sums = labelled.groupBy("domain").agg(F.count("*").alias("n"), *(F.sum(F.col("letters")[k]).alias(f"c{k}") for k in range(len(LETTERS)))).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(sums) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not sums:
        return None
    counts = np.array([r[2:] for r in sums], dtype=float) + 0.5
    n = np.array([r["n"] for r in sums], dtype=float)
    return Model([r["domain"] for r in sums], np.log(n / n.sum()).tolist(), np.log(counts / counts.sum(axis=1, keepdims=True)).tolist())


def posterior(letters: Column, model: Model) -> Column:
    """array<double>: the posterior of each domain, in the model's order."""
    total = F.aggregate(letters, F.lit(0.0), lambda s, v: s + v)
    weight = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(total, F.lit(1.0)))
    rows = F.array(*(F.struct(F.lit(p).alias("prior"), _vector(row).alias("row")) for p, row in zip(model.prior, model.letters)))
    scores = F.transform(rows, lambda d: d["prior"] + weight * _dot(d["row"], letters))
    shifted = F.transform(F.array(scores), lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))[0]
    return F.transform(F.array(shifted), lambda s: F.transform(s, lambda v: v / F.aggregate(s, F.lit(0.0), lambda x, y: x + y)))[0]


def rate(posteriors: Column, steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate after the given steps: each goes against its error vector and stays at 0 or more."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    return F.aggregate(F.array(*(_vector(s) for s in steps)), start, lambda r, e: F.greatest(F.lit(0.0), r - _dot(posteriors, e)))


def solve(memberships: DataFrame, targets: list[float] | None, n: int) -> Solution:
    """The steps that bring the totals of (tokens, posterior) to the targets.

    targets: tokens of each domain; None for shares proportional to the square root of the domains' own.
    """
    flat = memberships.select("tokens", "posterior").where("tokens > 0")
    # Second moments: with them the step size is known beforehand.
    moments = flat.select("tokens", "posterior", F.posexplode("posterior").alias("i", "p")).select("i", F.col("tokens") * F.col("p"), F.posexplode("posterior").alias("j", "q")).toDF("i", "w", "j", "q").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("q")).alias("m"))
    m = np.zeros((n, n))
    for i, j, v in moments.collect():
        m[i, j] = v
    own = m.sum(axis=1)
    if not own.sum():
        return Solution([], 0.0)
    if targets is None:
        share = np.sqrt(own)
        targets = own.sum() * share / share.sum()
    want = np.asarray(targets, dtype=float)
    scale = np.maximum(np.diag(m), 1e-9 * own.sum())
    size = 1.0 / np.linalg.eigvalsh(m / np.sqrt(np.outer(scale, scale)))[-1]
    steps: list[list[float]] = []
    flat, folded = flat.withColumn("rate", F.lit(1.0)), 0
    now = own
    least = np.maximum(want, 1e-9 * own.sum())
    while True:
        error = now - want
        residual = float(np.max(np.abs(error) / least))
        if residual <= TOLERANCE or len(steps) == MAX_STEPS:
            break
        steps.append((size * error / scale).tolist())
        current = rate(F.col("posterior"), steps[folded:], F.col("rate"))
        if len(steps) - folded == STORE_EVERY:
            flat, folded = stored(flat.select("tokens", "posterior", current.alias("rate")), "rates"), len(steps)
            current = F.col("rate")
        sums = flat.select((current * F.col("tokens")).alias("w"), F.posexplode("posterior").alias("i", "p")).groupBy("i").agg(F.sum(F.col("w") * F.col("p")).alias("s")).collect()
        last, now = now, np.zeros(n)
        for i, v in sums:
            now[i] = v
        if np.all(np.abs(now - last) <= 1e-9 * own.sum()):
            residual = float(np.max(np.abs(now - want) / least))
            break
    if residual > TOLERANCE:
        warnings.warn(f"the mix ends {residual:.2%} off its targets after {len(steps)} steps", stacklevel=2)
    return Solution(steps, residual)


def draws(rate: Column, doc_id: Column) -> Column:
    """A whole number of copies whose expectation is the rate: by the hash of the doc_id."""
    part = F.pmod(F.xxhash64(doc_id, F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("bigint")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def counted(docs: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, domain, tokens, letters), stored: all that the fit and the rates need to know of a document; with ``whole``, its row as well."""
    text = _text(text_col)
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    return stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{domain_col}`").cast("string").alias("domain"), token_count(text).alias("tokens"), letter_counts(text).alias("letters"), *row), "letters")


def solved(narrow: DataFrame, labelled_ids: DataFrame, targets: Mapping[str, float] | None = None) -> tuple[Model | None, Solution]:
    """The classifier and the steps that lead to the rates.

    labelled_ids: (doc_id) of the rows of ``narrow`` whose domain is a label.
    targets: weight of each domain; their sum is that of the documents' tokens.
    """
    chosen = labelled_ids.select(F.col("doc_id").alias("of")).where("of IS NOT NULL").distinct()
    narrow = narrow.select("doc_id", "domain", "tokens", "letters")
    model = fit(narrow.join(chosen, F.col("doc_id") == F.col("of"), "left_semi"))
    if model is None:
        return None, Solution([], 0.0)
    if targets is not None and set(targets) - set(model.domains):
        raise ValueError(f"no labelled rows of {sorted(set(targets) - set(model.domains))}")
    memberships = stored(narrow.select("tokens", posterior(F.col("letters"), model).alias("posterior")), "posteriors")
    want = None
    if targets is not None:
        total = memberships.agg(F.sum("tokens")).first()[0] or 0.0
        want = [total * targets.get(d, 0.0) / sum(targets.values()) for d in model.domains]
    return model, solve(memberships, want, len(model.domains))


def with_rates(counts: DataFrame, model: Model | None, steps: list[list[float]]) -> DataFrame:
    """``counts``, of ``counted``, with ``posterior``, ``rate`` and ``copies`` added."""
    if model is None:
        return counts.withColumns({"posterior": F.lit(None).cast("array<double>"), "rate": F.lit(1.0), "copies": F.lit(1).cast("bigint")})
    # As an array's element a posterior is a value: as an expression it would be worked out anew in every step of the fold.
    both = F.transform(F.array(posterior(F.col("letters"), model)), lambda p: F.struct(p.alias("posterior"), rate(p, steps).alias("rate")))[0]
    out = counts.withColumn("_both", both)
    out = out.select(*counts.columns, F.col("_both.posterior").alias("posterior"), F.col("_both.rate").alias("rate"))
    return out.withColumn("copies", draws(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labelled_ids: DataFrame, domain_col: str = "lang", targets: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_posterior``, ``_rate`` and ``_copies`` added.

    Rows are written once with their letter counts and read again: texts are neither shuffled nor counted twice.
    """
    docs = docs.drop("_posterior", "_rate", "_copies")
    counts = counted(docs, domain_col, id_col, text_col, whole=True)
    model, solution = solved(counts, labelled_ids, targets)
    out = with_rates(counts, model, solution.steps)
    return out.select("row.*", F.col("posterior").alias("_posterior"), F.col("rate").alias("_rate"), F.col("copies").alias("_copies"))


def good_ids(labels: DataFrame) -> DataFrame:
    """The documents whose label says that they are good ones of their domain."""
    return labels.where("quality = 1").select("doc_id")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, posterior (domain -> probability), rate and copies, a row per document."""
    narrow = counted(docs, "lang")
    model, solution = solved(narrow, good_ids(labels))
    out = with_rates(narrow, model, solution.steps)
    named = F.map_from_arrays(F.array(*map(F.lit, model.domains)), "posterior") if model else F.lit(None).cast("map<string,double>")
    return out.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), F.to_json(named).alias("posterior"), "rate", "copies")
