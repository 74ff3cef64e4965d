"""MinHash near-dedup with sequential Bayesian verification.

A text's set is that of its distinct five-word shingles. Texts of equal sets
form a class; classes are compared, rows only carry their class. A class has a
MinHash signature of 128 values; 32 bands of four values name its buckets
(a pair of similarity 0.75 shares none with probability 5e-6). Candidates from
the buckets are compared signature batch by signature batch: after n values of
which m agree, the similarity has the posterior Beta(m + 1, n - m + 1), and the
pair goes once the posterior chance of 0.75 or more falls under ``MISS``.
Survivors are verified on the full shingle sets, and near copies are joined to
groups as ``groups`` describes, without all pairs of a bucket.

Sets hold 64-bit hashes of shingles, and a class is known by 64 bits of its
set's hash; two of n different sets fall together with a chance of about
n * n / 2**65.

Defined results: a null, empty or blank text has no set and is linked with
nothing. Rows of one doc_id are rows of their own; a null doc_id is never a
component's id unless no member has another. Extra columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artifactgate.llm import textops
from artifactgate.llm.common import discard, stored
from artifactgate.llm.groups import Block, join_groups, linked_groups, shared_buckets

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
#: Numerator and denominator of the similarity from which two texts are linked.
SIMILARITY = 75, 100
#: Chance at which the sequential test may drop a pair that is a link.
MISS = 1e-6
BATCH = 16

_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _class_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), PERMUTATIONS) uint32; the sets hold something."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((PERMUTATIONS, len(sets)), dtype=np.uint32)
    for k in range(PERMUTATIONS):
        out[k] = np.minimum.reduceat(((every * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return np.ascontiguousarray(out.T)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n_shingles, signature) of every row of (doc_id, text); cls and signature are null for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in textops.slices(batch.column(1)):
                sets = list(textops.shingle_sets(textops.split_words(data, at, textops.SPACED), SHINGLE))
                full = [k for k, s in enumerate(sets) if len(s)]
                cls, signature = [None] * len(sets), [None] * len(sets)
                if full:
                    for k, row in zip(full, _signatures([sets[k] for k in full])):
                        cls[k], signature[k] = _class_id(sets[k]), row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cls, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signature, pa.binary())], ["doc_id", "cls", "n_shingles", "signature"])

    return docs.mapInArrow(sketch, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("cls bigint, n_shingles bigint, signature binary").fields]))


def _tail(matches: int, of: int, similarity: float) -> float:
    """P(S >= similarity) for S ~ Beta(matches + 1, of - matches + 1)."""
    return sum(math.comb(of + 1, k) * similarity**k * (1 - similarity) ** (of + 1 - k) for k in range(matches + 1))


def least_matches(similarity: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, least m): a pair with fewer than m of its first n values in common is dropped."""
    return [(n, next(m for m in range(n + 1) if _tail(m, n, similarity) >= miss)) for n in range(BATCH, PERMUTATIONS + 1, BATCH)]


def _plausible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The (a, b) pairs that the sequential test does not drop."""
    share = SIMILARITY[0] / SIMILARITY[1]
    steps = least_matches(share)
    # Sizes alone bound the similarity from above.
    near = (F.least("n_a", "n_b") * SIMILARITY[1] >= F.greatest("n_a", "n_b") * SIMILARITY[0])
    side = lambda x: signatures.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(-1, PERMUTATIONS) for k in (2, 3))
            live, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for n, least in steps:
                matches = matches + (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(axis=1)
                live, matches = live[matches >= least], matches[matches >= least]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(live)) for k in (0, 1)], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(test, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lambda column: [s for _, _, data, at in textops.slices(column) for s in textops.shingle_sets(textops.split_words(data, at, textops.SPACED), SHINGLE)]
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                keep = []
                for x, y in zip(sets(part.column(2)), sets(part.column(3))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(_enough(both, len(x), len(y)))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("cls").alias(x), F.col("text").alias(f"t_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(verify, "a bigint, b bigint")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text), one row for each class of (doc_id, cls); rows that share a doc_id but not the class are left out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(s) > 0 and _class_id(s) == cls for (lo, hi, data, at) in textops.slices(batch.column(1)) for s, cls in zip(textops.shingle_sets(textops.split_words(data, at, textops.SPACED), SHINGLE), batch.column(0).slice(lo, hi - lo).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    wanted = wanted.select(F.col("doc_id").alias("of"), "cls")
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["of"])).select("cls", "text").mapInArrow(check, "cls bigint, text string")
    return found.dropDuplicates(["cls"])


def _enough(both, one, other) -> bool:
    """100 * both >= 75 * (one + other - both), for sizes of an intersection and of two sets."""
    return (SIMILARITY[0] + SIMILARITY[1]) * both >= SIMILARITY[0] * (one + other)


def _narrowed(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The members that share enough shingles with any others to be linked to a member of their bucket.

    A node's shingles that no other open node has can't be in an intersection.
    The count is exact: one row per shingle, those of one owner counted by node.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in textops.slices(batch.column(1)):
                sets = list(textops.shingle_sets(textops.split_words(data, at, textops.SPACED), SHINGLE))
                nodes = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    nodes = members.select("node").distinct()
    open_texts = texts.join(nodes.withColumnRenamed("node", "cls"), "cls", "left_semi").select("cls", "text")
    owners = open_texts.mapInArrow(shingles, "node bigint, shingle bigint").groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    alone = owners.groupBy("node").agg(F.count("*").alias("own"))
    sizes = classes.select(F.col("cls").alias("node"), F.col("n_shingles").alias("size")).join(nodes, "node", "left_semi")
    known = stored(sizes.join(alone, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own")), "shared")
    members = stored(members.join(known, "node"), "sized")
    least = stored(members.groupBy("key").agg(F.min("size").alias("least")), "least")
    return members.join(least, "key").where(_enough(F.col("size") - F.col("own"), F.col("size"), F.col("least"))).select("key", "part", "node", "component", (F.col("own") / F.col("size")).alias("alone"))


def _bodies(nodes: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, body): the signature and the shingle set, one behind the other."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in textops.slices(batch.column(1)):
                sets = textops.shingle_sets(textops.split_words(data, at, textops.SPACED), SHINGLE)
                own = [x + s.tobytes() for x, s in zip(batch.column(2).slice(lo, hi - lo).to_pylist(), sets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], ["node", "body"])

    rows = texts.join(signatures.select("cls", "signature"), "cls").join(nodes.withColumnRenamed("node", "cls"), "cls", "left_semi")
    return rows.select("cls", "text", "signature").mapInArrow(body, "node bigint, body binary")


def compare(a: Block, b: Block, band: int, same: bool) -> list[tuple[int, int]]:
    """Links that join groups: signature batches first, then the sets, most alike first.

    A pair is decided in the first band that it shares.
    """
    width = 4 * PERMUTATIONS
    left, right = (np.frombuffer(b"".join(x[:width] for x in side.body), dtype=np.uint32).reshape(-1, PERMUTATIONS) for side in (a, b))
    apart = a.component[:, None] != b.component[None, :]
    i, j = np.nonzero(np.triu(apart, 1) if same else apart)
    matches = np.zeros(len(i), dtype=np.int64)
    for n, least in least_matches(SIMILARITY[0] / SIMILARITY[1]):
        matches += (left[i, n - BATCH : n] == right[j, n - BATCH : n]).sum(axis=1)
        live = matches >= least
        i, j, matches = i[live], j[live], matches[live]
    rows = PERMUTATIONS // BANDS
    first = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 4096):
        equal = (left[i[lo : lo + 4096]] == right[j[lo : lo + 4096]]).reshape(-1, BANDS, rows).all(axis=2)
        first[lo : lo + 4096] = equal.argmax(axis=1) == band
    order = np.flatnonzero(first)
    order = order[np.argsort(-matches[order], kind="stable")]
    sets_a, sets_b = ([np.frombuffer(x, dtype=np.uint64, offset=width) for x in side.body] for side in (a, b))
    linked = lambda x, y: _enough(len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)), len(sets_a[x]), len(sets_b[y]))
    return join_groups(a, b, zip(i[order].tolist(), j[order].tolist()), linked)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row per row of ``docs``."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(sketches(docs), "sketches")
    width = 4 * PERMUTATIONS // BANDS
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    keys = F.posexplode(F.array(*(F.xxhash64(F.lit(k), F.substring("signature", 1 + k * width, width)) for k in range(BANDS))))
    members = stored(shared_buckets(classes.select(F.col("cls").alias("node"), keys.alias("part", "key"))), "buckets")
    nodes = members.select(F.col("node").alias("cls")).distinct()
    own = stored(classes.join(nodes, "cls", "left_semi"), "signatures")
    texts = stored(_texts_of(docs, own), "texts")
    groups = linked_groups(
        members,
        verify=lambda pairs: _verified(stored(_plausible(pairs, own), "plausible"), texts),
        bodies=lambda nodes: _bodies(nodes, own, texts),
        compare=compare,
        narrow=lambda x: _narrowed(x, own, texts),
    )
    # The component's id is the least doc_id of its classes.
    joined = classes.select("cls", F.col("doc_id").alias("least"))
    if groups is not None:
        joined = joined.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("component"))
    else:
        joined = joined.withColumn("component", F.col("cls"))
    joined = stored(joined, "components")
    named = stored(joined.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    of_class = stored(joined.join(named, "component").select("cls", "component_id"), "classes")
    discard(members, own, texts, joined, named)
    full = rows.where("cls IS NOT NULL").select("doc_id", "n_shingles", "cls").join(of_class, "cls").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that with the smallest doc_id."""
    # Stored: rows that go may share one id, and their join is then split.
    gone = stored(near_duplicates(docs, id_col, text_col).where("NOT kept").select("doc_id").distinct(), "gone").withColumnRenamed("doc_id", "_gone")
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["_gone"]), "left_anti")


#: DuckDB SQL for near_duplicates() over the table documents: every pair that shares a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS (
  SELECT x.rid AS a, y.rid AS b
  FROM (SELECT p.rid AS x, q.rid AS y, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.rid <> q.rid GROUP BY 1, 2) z
  JOIN n x ON x.rid = z.x JOIN n y ON y.rid = z.y
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT rid AS a, rid AS b FROM d
  UNION
  SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
comp AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN comp USING (rid) LEFT JOIN n USING (rid)
"""
