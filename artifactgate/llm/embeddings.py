"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik 2011) learns, on at most ``SAMPLE``
vectors taken by hash, rotations of the leading principal axes whose signs are
balanced binary codes; vectors of a length that the sample hardly holds get
random rotations. A code is cut into chunks, and each chunk is the key of one
Hamming table. A vector stands in a table under its own chunk and looks up,
besides that, the keys that differ in one of its least certain bits. Keys widen
with the logarithm of the number of vectors, so that a bucket holds as many
unlike vectors in a large table as in a small one, and the number of tables
grows by the power that keeps the recall.

Retrieval moves codes only: vectors that meet in a table and whose whole codes
are near each other become candidates, named by the one table and key in which
their pair is decided. Vectors are joined for candidates alone, and the pairs
are reranked by cosine in double precision, in blocks of bounded size. Out come
counts by vector and enough links to join each group, not pairs.

Equal vectors are one class: only its representative is indexed, and copies are
counted, not compared. Groups of links are connected components.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
parts links with nothing; vectors of different lengths don't link. Repeated rows
of a vec_id are rows of their own; labels and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artifactgate.llm.common import discard, stored
from artifactgate.llm.groups import BLOCK_NODES, batches_of, connected_components

COSINE = 0.9
#: Vectors, and values, that the rotations are learned from at most.
SAMPLE, SAMPLE_VALUES = 10_000, 2_000_000
ROUNDS = 30
#: Bits of a rotation's code at most, bits of a key that a look-up turns, and vectors for each bit from which a rotation is learned.
BITS, PROBES, LEARN_FROM = 64, 4, 4
#: Bits of a key beyond the logarithm of the number of vectors, and its limits; tables at keys of 16 bits, doubled by every ``DOUBLE`` bits more.
SPARE, LEAST_BITS, MOST_BITS = 2, 12, 31
TABLES, DOUBLE = 12, -np.log(2) / np.log(1 - np.arccos(COSINE) / np.pi)
#: Standard deviations above the expected number of differing bits, at COSINE, up to which codes count as near.
NEAR = 6


class Index(NamedTuple):
    """Bits of a key, number of tables, and the learned rotations by the vectors' length."""

    chunk: int
    tables: int
    learned: dict[int, list[tuple[np.ndarray, np.ndarray]]]

    def rotations(self, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if length not in self.learned:
            self.learned[length] = [random_rotation(length, seed) for seed in range(self.needed(length))]
        return self.learned[length]

    def width(self, length: int) -> int:
        return min(self.chunk, BITS, length)

    def needed(self, length: int) -> int:
        """Rotations that give the number of tables."""
        return -(-self.tables // (min(BITS, length) // self.width(length)))

    def near(self, length: int) -> int:
        """Differing bits up to which codes count as near."""
        n = self.tables * self.width(length)
        p = np.arccos(COSINE) / np.pi
        return int(np.ceil(n * p + NEAR * np.sqrt(n * p * (1 - p))))


def sized(vectors: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors."""
    chunk = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(2, vectors)))) + SPARE))
    return chunk, int(np.ceil(TABLES * 2 ** (max(0, chunk - 16) / DOUBLE)))


def random_rotation(length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(np.random.default_rng(1_000 + seed).standard_normal((length, min(BITS, length))))
    return np.zeros(length), q


def learn_rotation(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of (x - mean) @ projection are the codes."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    bits = axes.shape[1]
    v = centred @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, unit vectors) of the usable rows."""
    found: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for k, v in enumerate(column.to_pylist()):
        if not v or any(y is None for y in v):
            continue
        x = np.asarray(v, dtype=np.float64)
        top = np.abs(x).max()
        if np.isfinite(x).all() and top > 0:
            x = x / top  # neither overflow nor underflow in the norm
            rows, units = found.setdefault(len(x), ([], []))
            rows.append(k)
            units.append(x / np.sqrt(x @ x))
    return {n: (np.array(rows), np.array(units)) for n, (rows, units) in found.items()}


class Codes(NamedTuple):
    """Of each vector and table: its key, and the bits of it that look-ups turn."""

    own: np.ndarray
    unsure: np.ndarray


def codes(units: np.ndarray, index: Index) -> Codes:
    own, unsure = [], []
    width = index.width(units.shape[1])
    for mean, projection in index.rotations(units.shape[1]):
        y = (units - mean) @ projection
        for lo in range(0, y.shape[1] - width + 1, width):
            part = y[:, lo : lo + width]
            bit = np.int64(1) << np.arange(width)
            own.append(((part > 0) * bit).sum(axis=1))
            least = np.argsort(np.abs(part), axis=1, kind="stable")[:, :PROBES]
            unsure.append(bit[least].sum(axis=1))
    return Codes(np.array(own[: index.tables], dtype=np.uint32).T.copy(), np.array(unsure[: index.tables], dtype=np.uint32).T.copy())


def _side(rows: pa.StructArray, tables: int):
    both = np.frombuffer(b"".join(rows.field("code").to_pylist()), dtype=np.uint32).reshape(-1, 2, tables)
    return rows.field("cls").to_numpy(zero_copy_only=False), rows.field("owner").to_numpy(zero_copy_only=False), both


def candidates(codes_of: DataFrame, index: Index) -> DataFrame:
    """(key, length, cls, role) of the members of (cls, length, code) with a near code in the bucket in which their pair is decided."""
    tables = index.tables

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                both = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint32).reshape(-1, 2, tables)
                for t in range(tables):
                    own, unsure = both[:, 0, t].astype(np.int64), both[:, 1, t].astype(np.int64)
                    for bit in (0, *(1 << k for k in range(index.chunk))):
                        rows = np.flatnonzero(unsure & bit) if bit else np.arange(len(own))
                        if len(rows):
                            take = pa.array(rows)
                            yield pa.RecordBatch.from_arrays([pa.array((own[rows] ^ bit) + (t << 32)), *(c.take(take) for c in part.columns[:2]), pa.array(np.full(len(rows), not bit))], ["key", "cls", "length", "owner"])

    # Memberships go without codes; only those of keys that have a pair to look at are joined with them.
    members = codes_of.select("cls", "length", "code").mapInArrow(probe, "key bigint, cls bigint, length int, owner boolean")
    sizes = stored(members.groupBy("key", "length").agg(F.count("*").alias("n"), F.max("owner").alias("owned")).where("n > 1 AND owned").select("key", "length", F.ceil(F.col("n") / BLOCK_NODES).alias("blocks")), "sizes")
    live = members.join(sizes, ["key", "length"]).join(codes_of.select("cls", "code"), "cls")
    packed = live.groupBy("key", "length", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("cls", "owner", "code")).alias("rows"))
    packed = stored(packed, "tables")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths, cls, owner = [], [], [], []
            for k, (key, length, same) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                a = _side(batch.column(3)[k].values, tables)
                b = a if same else _side(batch.column(4)[k].values, tables)
                i, j = decided(a, b, key >> 32, same, index.near(length))
                for x, rows in ((a, np.unique(i)), (b, np.unique(j))):
                    keys += [key] * len(rows)
                    lengths += [length] * len(rows)
                    cls += x[0][rows].tolist()
                    owner += x[1][rows].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lengths, pa.int32()), pa.array(cls, pa.int64()), pa.array(owner, pa.bool_())], ["key", "length", "cls", "owner"])

    with batches_of(codes_of.sparkSession, 64):
        out = stored(_block_pairs(packed).mapInArrow(meet, "key bigint, length int, cls bigint, owner boolean").distinct(), "candidates")
    discard(packed, sizes)
    return out


def _block_pairs(packed: DataFrame) -> DataFrame:
    """Every pair of the blocks of a bucket, each block with itself included, dealt over all tasks."""
    one = packed.select("key", "length", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "rows")
    other = packed.select("key", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("others"))
    return one.join(other, ["key", "length", "i", "j"]).select("key", "length", (F.col("i") == F.col("j")).alias("same"), "rows", "others")


def decided(a, b, table: int, same: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near codes that are decided in this bucket: in the first table in which they meet, and there
    under the key of both, or else that of the smaller class, or else that of the larger."""
    width = a[2].shape[2]
    differ = np.zeros((len(a[0]), len(b[0])), dtype=np.int16)
    for t in range(width):
        differ += np.bitwise_count(a[2][:, 0, t][:, None] ^ b[2][:, 0, t][None, :])
    near = (differ <= most) & (a[1][:, None] | b[1][None, :])
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    keep = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 8192):
        x, y = i[lo : lo + 8192], j[lo : lo + 8192]
        bits = a[2][x, 0] ^ b[2][y, 0]
        one = (bits & (bits - np.uint32(1))) == 0
        by_a, by_b = one & ((bits & b[2][y, 1]) != 0), one & ((bits & a[2][x, 1]) != 0)
        first = ((bits == 0) | by_a | by_b).argmax(axis=1) == table
        own_a, own_b = a[1][x], b[1][y]
        small_a = a[0][x] < b[0][y]
        # Under a's key a is the owner; the pair is left to b's key if b is the smaller class and can be its owner.
        under_a = own_a & ~own_b & (small_a | ~by_b[:, table])
        under_b = own_b & ~own_a & (~small_a | ~by_a[:, table])
        keep[lo : lo + 8192] = first & ((own_a & own_b) | under_a | under_b) & (a[0][x] != b[0][y])
    return i[keep], j[keep]


def reranked(found: DataFrame, vectors: DataFrame, index: Index) -> DataFrame:
    """(a, b, n) over candidates: for each class a its number of links n from a block, and links (a, b) that join groups with n = 0."""
    rows = found.join(vectors, "cls")
    sizes = stored(found.groupBy("key", "length").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks")), "sizes")
    packed = rows.join(sizes, ["key", "length"]).groupBy("key", "length", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"))
    packed = stored(packed.agg(F.collect_list(F.struct("cls", "owner", "code", "copies", "v")).alias("rows")), "rerank")

    def side(r: pa.StructArray, length: int):
        return *_side(r, index.tables), r.field("copies").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(r.field("v").to_pylist()), dtype=np.float64).reshape(-1, length)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for k, (key, length, same) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                a = side(batch.column(3)[k].values, length)
                b = a if same else side(batch.column(4)[k].values, length)
                i, j = decided(a[:3], b[:3], key >> 32, same, index.near(length))
                cosine = np.concatenate([np.einsum("ij,ij->i", a[4][i[lo : lo + 4096]], b[4][j[lo : lo + 4096]]) for lo in range(0, len(i), 4096)]) if len(i) else np.zeros(0)
                i, j = i[cosine >= COSINE], j[cosine >= COSINE]
                for x, y, m, n in ((a, b, i, j), (b, a, j, i)):
                    totals = np.bincount(m, weights=y[3][n], minlength=len(x[0]))
                    out += [(int(x[0][r]), int(x[0][r]), int(totals[r])) for r in np.flatnonzero(totals)]
                seen: dict[int, int] = {}
                for x, y in zip(a[0][i].tolist(), b[0][j].tolist()):
                    while x in seen:
                        x = seen[x]
                    while y in seen:
                        y = seen[y]
                    if x != y:
                        seen[max(x, y)] = min(x, y)
                        out.append((x, y, 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["a", "b", "n"])

    with batches_of(found.sparkSession, 16):
        out = stored(_block_pairs(packed).mapInArrow(rerank, "a bigint, b bigint, n bigint"), "reranked")
    discard(packed, sizes)
    return out


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, a row per row of ``embeddings``."""
    rows = embeddings.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    alone = lambda x: x.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n, values = rows.where(F.size("embedding") > 0).agg(F.count("*"), F.avg(F.size("embedding"))).first()
    if not n:
        return alone(rows)
    chunk, tables = sized(n)
    sample = rows.where(F.size("embedding") > 0).orderBy(F.xxhash64("vec_id", "embedding")).limit(max(2, min(SAMPLE, int(SAMPLE_VALUES / values))))
    index = Index(chunk, tables, {})
    for length, (_, units) in _units(pa.array([r[0] for r in sample.select("embedding").collect()], pa.list_(pa.float64()))).items():
        if len(units) >= LEARN_FROM * min(BITS, length):
            index.learned[length] = [learn_rotation(units, seed) for seed in range(index.needed(length))]

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, size, v, code = ([None] * len(batch) for _ in range(4))
            for length, (own, x) in _units(batch.column(1)).items():
                c = codes(x, index)
                for k, vector, key, unsure in zip(own.tolist(), x, c.own, c.unsure):
                    v[k], size[k] = vector.tobytes(), length
                    cls[k] = xxhash.xxh3_64_intdigest(v[k]) - (1 << 63)
                    code[k] = key.tobytes() + unsure.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), pa.array(v, pa.binary()), pa.array(code, pa.binary())], ["vec_id", "cls", "length", "v", "code"])

    with batches_of(embeddings.sparkSession, 4096):
        every = stored(rows.mapInArrow(classed, T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("cls bigint, length int, v binary, code binary").fields])), "vectors")
    classes = stored(every.where("cls IS NOT NULL").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("length").alias("length"), F.first("v").alias("v"), F.first("code").alias("code")), "classes")
    found = candidates(classes, index)
    out = reranked(found, classes.select("cls", "code", "copies", "v"), index)
    counts = out.where("n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    known = classes.select("cls", "least", "copies").join(counts, "cls", "left")
    groups = stored(connected_components(out.where("n = 0").select("a", "b")), "groups").withColumnRenamed("node", "cls")
    known = stored(known.join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "known")
    named = stored(known.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    known = stored(known.join(named, "component").select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "known")
    linked = every.where("cls IS NOT NULL").select("vec_id", "cls").join(known, "cls")
    linked = linked.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone(every.where("cls IS NULL")))


#: DuckDB SQL for near_duplicates() over the table embeddings: every pair.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER () AS rid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT rid, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
      WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT x.rid AS a, y.rid AS b FROM u x JOIN u y ON x.rid <> y.rid AND len(x.v) = len(y.v)
      WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.9),
reach AS (SELECT rid AS a, rid AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
comp AS (SELECT r.a AS rid, min(e.vec_id) AS component_id FROM reach r JOIN e ON e.rid = r.b GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN comp USING (rid) LEFT JOIN n USING (rid)
"""
