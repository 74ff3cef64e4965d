"""Collocations by vertically partitioned suffix trees.

After ERA (Mansour et al. 2011): the suffixes of all texts, cut to ``DEPTH``
words, are partitioned by their first words so that each part fits a task's
memory; every part becomes a subtree of its own, whose leaves are the distinct
cut suffixes, and a phrase's frequency is the sum of the leaves below its node.

1. Words are counted by language. Only those that reach the least frequency can
   stand in a candidate; the sorted array of their 64-bit hashes, in which the
   language is mixed, is broadcast, and a word's place in it is its number. Should
   there be more than ``MOST_WORDS`` of them, nothing is broadcast and the hashes
   themselves are the numbers.
2. Texts are stored as stretches of numbers, broken at the ends of pieces and at
   rarer words.
3. First words are packed into groups of at most ``BUDGET`` suffixes by their
   frequencies. A prefix with more than that gets several groups, over which its
   children are dealt; children that are too heavy themselves are counted and
   dealt further, word by word.
4. Each task sends its suffixes to their groups as packed blocks of distinct ones
   with counts, so that a phrase that fills a third of the corpus is a row a task.
5. A group sorts what has come, and emits the nodes of sufficient total.

Counts are exact, hash collisions of 64 bits aside. Scores are decimals. Ranks
come from ranges of the sorted phrases, not from one task for each language.

Defined results: null texts are empty, a null language is ``und``; rows that
repeat a doc_id all count; other columns play no part; a language without
candidates, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artifactgate.llm.common import discard, stored
from artifactgate.llm.groups import batches_of
from artifactgate.llm.textops import _alphabet, mix, slices, split_words

LEAST, DEPTH, TOP = 100, 5, 2_000
#: Suffixes of a group, words of the broadcast, heavy prefixes of the broadcast, suffixes that a task combines at once, and bytes of text split at once.
BUDGET, MOST_WORDS, MOST_HEAVY, COMBINED, SLICE = 2_000_000, (1 << 21) - 2, 1 << 20, 1 << 18, 2 << 20
U = np.uint64

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORDS = _alphabet(np.array([0x20, 0x09, *np.flatnonzero(BREAKS)]))
WORDS[0] = 0xFF  # NUL is a word byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Split(NamedTuple):
    """Of the words of consecutive texts: text number, key, whether a piece starts there, and bytes."""

    text: np.ndarray
    key: np.ndarray
    begins: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def split_batch(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Split]]:
    """(languages, words) of the slices of a batch of (lang, text)."""
    for lo, hi, data, at in slices(batch.column(1), SLICE):
        langs = batch.column(0).slice(lo, hi - lo).to_pylist()
        words = split_words(data, at, WORDS)
        text = np.repeat(np.arange(hi - lo), np.diff(words.first))
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], dtype=U)
        key = mix(words.hash + seeds[text]) if len(text) else words.hash
        key = np.where(key == 0, U(1), key)  # 0 stands for no word
        breaks = np.concatenate([[0], np.cumsum(BREAKS[data])])
        begins = np.ones(len(key), dtype=bool)
        begins[1:] = (text[1:] != text[:-1]) | (breaks[words.start[1:]] > breaks[words.end[:-1]])
        yield langs, Split(text, key, begins, words.start, words.end, data)


def _strings(words: Split, which: np.ndarray) -> pa.Array:
    """The lower-cased words at these places."""
    size = (words.end - words.start)[which]
    at = np.concatenate([[0], np.cumsum(size)])
    body = LOWER[words.data[np.repeat(words.start[which] - at[:-1], size) + np.arange(at[-1])]]
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body.tobytes())]).cast(pa.string())


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, key, f) of every word; a null word stands for all of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, words in split_batch(batch):
                if not len(words.key):
                    continue
                key, first, n = np.unique(words.key, return_index=True, return_counts=True)
                names = pa.array(langs, pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(words.text[first])), _strings(words, first), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "key", "f"])
                total: dict[str, int] = {}
                for x, c in zip(langs, np.bincount(words.text, minlength=len(langs)).tolist()):
                    total[x] = total.get(x, 0) + c
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "key", "f"])

    found = docs.mapInArrow(count, "lang string, word string, key bigint, f bigint")
    return found.groupBy("lang", "word", "key").agg(F.sum("f").alias("f"))


class Packing(NamedTuple):
    """How numbers of words are laid into 64-bit columns."""

    bits: int
    per: int

    @property
    def columns(self) -> int:
        return -(-DEPTH // self.per)

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for lo in range(0, DEPTH, self.per):
            column = np.zeros(len(words[0]), dtype=U)
            for k in range(self.per):
                column = column << U(self.bits % 64) if self.per > 1 else column
                if lo + k < DEPTH:
                    column = column | words[lo + k].astype(U)
            out.append(column)
        return out

    def word(self, columns: list[np.ndarray], k: int) -> np.ndarray:
        column = columns[k // self.per]
        return column if self.per == 1 else (column >> U(self.bits * (self.per - 1 - k % self.per))) & U((1 << self.bits) - 1)


NUMBERED, HASHED = Packing(21, 3), Packing(64, 1)


def prefix_hash(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(words[0]), dtype=U)
    for w in words:
        out = mix(out * U(0x9E3779B97F4A7C15) + w.astype(U))
    return out


class Partition(NamedTuple):
    """Which group takes a suffix.

    first: group of each word by its number; None where words are hashes, which ``light`` groups share
    light: groups of first words that are not heavy
    heavy: for each number of words, (hashes of heavy prefixes, sorted; first group of each; number of its groups)
    """

    first: np.ndarray | None
    light: int
    heavy: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def groups(self, words: list[np.ndarray]) -> np.ndarray:
        own = self.first[words[0].astype(np.int64)].astype(np.int64) if self.first is not None else (mix(words[0]) % U(self.light)).astype(np.int64)
        for depth, (prefixes, base, n) in enumerate(self.heavy, 1):
            if not len(prefixes):
                break
            h = prefix_hash(words[:depth])
            at = np.minimum(np.searchsorted(prefixes, h), len(prefixes) - 1)
            hit = prefixes[at] == h
            child = prefix_hash(words[: depth + 1])
            own[hit] = base[at[hit]] + (child[hit] % n[at[hit]].astype(U)).astype(np.int64)
        return own

    def split_to(self, group: int) -> int:
        """Words of the prefix whose children the group shares with other groups; 0 for groups of whole first words."""
        out = 0
        for depth, (_, base, n) in enumerate(self.heavy, 1):
            if ((base <= group) & (group < base + n)).any():
                out = depth
        return out


def pack_first(counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """(group of each word number, number of groups): next fit in the order of numbers; index 0 is no word."""
    sums = np.cumsum(np.minimum(counts, budget))
    group = (np.maximum(sums - 1, 0) // budget).astype(np.int32)
    return np.concatenate([[0], group]), int(group.max(initial=0)) + 1


def suffix_words(numbers: np.ndarray) -> list[np.ndarray]:
    """The words of every suffix of two words or more, as DEPTH arrays; 0: the stretch has ended."""
    padded = np.concatenate([numbers, np.zeros(DEPTH, dtype=numbers.dtype)])
    at = np.flatnonzero((numbers > 0) & (padded[1 : len(numbers) + 1] > 0))
    out = [numbers[at]]
    for k in range(1, DEPTH):
        out.append(np.where(out[-1] > 0, padded[at + k], 0))
    return out


def _combined(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, sorted, and how often each stands there."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts
    return [c[at] for c in columns], n.astype(np.int64)


def _block(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted rows with counts, packed: the first column as differences."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.diff(columns[0], prepend=U(0)).tobytes(), *(c.tobytes() for c in columns[1:]), counts.astype(np.int64).tobytes()]))


def _unblock(block: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=U).reshape(columns + 1, -1)
    return [np.cumsum(data[0], dtype=U), *data[1:-1]], data[-1].astype(np.int64)


def _buffered(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[list[np.ndarray]]:
    """Suffix words of the stretches, COMBINED or somewhat more at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        for data in batch.column(0).to_pylist():
            numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)
            for lo in range(0, len(numbers), COMBINED):
                # The words beyond the part belong to its last suffixes; suffixes that start there come with the next part.
                part = numbers[lo : lo + COMBINED + DEPTH - 1]
                own = min(COMBINED, len(numbers) - lo)
                words = suffix_words(part)
                starts = np.flatnonzero((part > 0) & (np.append(part[1:], 0) > 0))
                held.append([w[starts < own] for w in words])
                if sum(len(h[0]) for h in held) >= COMBINED:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def frequencies(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, word, key, f, n) and (words array<bigint>, f), of at least ``least`` occurrences. docs: (lang, text)."""
    spark = docs.sparkSession
    counted = stored(count_words(docs).where((F.col("f") >= least) | F.col("word").isNull()), "words")
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = stored(counted.where("word IS NOT NULL AND key IS NOT NULL").join(totals, "lang").select("lang", "word", "key", "f", "n"), "words")
    known = words.count()
    if known <= min(most_words, MOST_WORDS):
        table = words.select("key", "f").toArrow()
        keys, counts = table.column(0).to_numpy().view(U), table.column(1).to_numpy()
        order = np.argsort(keys)
        keys, counts, packing, kind = keys[order], counts[order], NUMBERED, np.uint32
    else:
        keys, counts, packing, kind = None, None, HASHED, np.uint64
    shared = spark.sparkContext.broadcast(keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            for _, words in split_batch(batch):
                numbers = words.key
                if keys is not None:
                    at = np.minimum(np.searchsorted(keys, words.key), max(0, len(keys) - 1))
                    numbers = np.where(keys[at] == words.key, at + 1, 0) if len(keys) else np.zeros(len(words.key))
                ends = np.flatnonzero(words.begins)
                stretch = np.insert(numbers.astype(kind), ends, 0)
                twice = np.zeros(len(stretch), dtype=bool)
                twice[1:] = (stretch[1:] == 0) & (stretch[:-1] == 0)
                yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(stretch[~twice].tobytes())], pa.binary())], ["stretch"])

    with batches_of(spark, 2_000):
        encoded = stored(docs.mapInArrow(encode, "stretch binary"), "stretches")
    partition = spark.sparkContext.broadcast(partitioned(encoded, words, counts, kind, budget))
    columns = packing.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for suffixes in _buffered(batches, kind):
            rows, n = _combined(packing.pack(suffixes), None)
            group = partition.value.groups([packing.word(rows, k) for k in range(DEPTH)])
            order = np.argsort(group, kind="stable")
            rows, n, group = [c[order] for c in rows], n[order], group[order]
            at = np.flatnonzero(np.diff(group, prepend=-1))
            blocks = [_block([c[lo:hi] for c in rows], n[lo:hi]) for lo, hi in zip(at, np.append(at[1:], len(group)))]
            yield pa.RecordBatch.from_arrays([pa.array(group[at]), pa.array(blocks, pa.binary())], ["group", "block"])

    def subtree(table: pa.Table) -> pa.Table:
        """The nodes of a group's tree with their totals."""
        parts = [_unblock(b, columns) for b in table.column("block").to_pylist()]
        leaves, n = _combined([np.concatenate([p[0][c] for p in parts]) for c in range(columns)], np.concatenate([p[1] for p in parts]))
        partial = partition.value.split_to(table.column("group")[0].as_py())
        word = [packing.word(leaves, k) for k in range(DEPTH)]
        new = np.ones(len(n), dtype=bool)
        new[1:] = word[0][1:] != word[0][:-1]
        phrases, totals = [], []
        for depth in range(2, DEPTH + 1):
            w = word[depth - 1]
            new[1:] |= w[1:] != w[:-1]
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at)
            # Nodes on the way to a prefix that other groups share have only a part of their total here.
            keep = (w[at] > 0) & ((total >= least) | (depth <= partial))
            path = np.stack([word[k][at[keep]] for k in range(depth)], axis=1)
            path = shared.value[path.astype(np.int64) - 1] if shared.value is not None else path
            phrases.append(pa.ListArray.from_arrays(np.arange(0, path.size + 1, depth, dtype=np.int32), pa.array(path.ravel().view(np.int64))))
            totals.append(total[keep])
        return pa.table({"words": pa.concat_arrays(phrases), "f": np.concatenate(totals)})

    with batches_of(spark, 16):
        dealt = encoded.mapInArrow(deal, "group bigint, block binary")
        nodes = stored(dealt.groupBy("group").applyInArrow(subtree, "words array<bigint>, f bigint"), "nodes")
    phrases = stored(nodes.groupBy("words").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    discard(nodes, encoded, counted)
    return words, phrases


def partitioned(encoded: DataFrame, words: DataFrame, counts: np.ndarray | None, kind: type, budget: int) -> Partition:
    """Groups of at most about ``budget`` suffixes each, by first words, and by longer prefixes where one word has more."""
    spark = encoded.sparkSession
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, total // MOST_HEAVY)  # bounds the prefixes that are sent to all tasks
    if counts is not None:
        first, light = pack_first(counts, budget)
        number = np.flatnonzero(counts > budget).astype(kind) + 1
        n = counts[counts > budget]
    else:
        first, light = None, int(-(-2 * total // budget)) or 1
        table = words.where(F.col("f") > budget).select("key", "f").toArrow()
        number, n = table.column(0).to_numpy().view(U), table.column(1).to_numpy()
    heavy: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    hashes, used = prefix_hash([number]), light
    while len(hashes) and len(heavy) < DEPTH - 1:
        order = np.argsort(hashes)
        many = -(-2 * n[order] // budget)
        base = used + np.concatenate([[0], np.cumsum(many)[:-1]])
        used += int(many.sum())
        heavy.append((hashes[order], base.astype(np.int64), many.astype(np.int64)))
        depth, prefixes = len(heavy), spark.sparkContext.broadcast(heavy[-1][0])
        if depth == DEPTH - 1:
            break

        def children(batches: Iterator[pa.RecordBatch], depth=depth, prefixes=prefixes) -> Iterator[pa.RecordBatch]:
            for suffixes in _buffered(batches, kind):
                inside = np.isin(prefix_hash(suffixes[:depth]), prefixes.value) & (suffixes[depth] > 0)
                child, n = np.unique(prefix_hash([w[inside] for w in suffixes[: depth + 1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(n.astype(np.int64))], ["child", "n"])

        with batches_of(spark, 16):
            found = encoded.mapInArrow(children, "child bigint, n bigint").groupBy("child").agg(F.sum("n").alias("n")).where(F.col("n") > budget).toArrow()
        hashes, n = found.column(0).to_numpy().view(U), found.column(1).to_numpy()
    return Partition(first, light, heavy)


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, lang, a, l, r, n, score) of the phrases that no longer one of the same frequency holds."""
    parts = phrases.select(F.col("words").alias("part"), F.col("f").alias("of")).unionByName(words.select(F.array("key").alias("part"), F.col("f").alias("of")))
    size = F.size("words")
    # If a longer candidate holds a phrase and is as frequent, so is one of one word more.
    longer = phrases.where(size > 2).select(F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), "f")
    longer = longer.groupBy("words").agg(F.max("f").alias("covered"))
    kept = phrases.join(longer, "words", "left").where("covered IS NULL OR covered < f").select("words", F.col("f").alias("a"))
    kept = stored(kept.withColumn("key", F.element_at("words", 1)).join(words.select("key", "lang", "n"), "key").drop("key"), "kept")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("of").alias("l")), "left").drop("left")
    cuts = cuts.join(parts.select(F.col("part").alias("right"), F.col("of").alias("r")), "right").drop("right")
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("below", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("words", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("words", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def named(found: DataFrame, words: DataFrame) -> DataFrame:
    """With ``phrase``, the words joined by spaces."""
    each = found.select("words", F.posexplode("words").alias("at", "key")).join(words.select("key", "word"), "key")
    texts = each.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return found.join(texts, "words").drop("words")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """With ``rank``, for the first ``top`` of each language. Ranges of the sorted rows are counted, and ranked from what stands before each."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = stored(found.repartitionByRange("lang", *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = spread.groupBy("lang", "part").agg(F.count("*").alias("size"))
    before = before.withColumn("before", F.sum("size").over(Window.partitionBy("lang").orderBy("part")) - F.col("size")).where(F.col("before") < top)
    near = spread.join(before.select("lang", "part", "before"), ["lang", "part"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    return near.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, budget: int = BUDGET, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to DEPTH words of each language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with batches_of(docs.sparkSession, 2_000):
        words, phrases = frequencies(rows, least, budget, most_words)
    found = ranked(named(scored(words, phrases), words), top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for collocations() over the table documents.
ORACLE_SQL = r"""
WITH w AS (
    SELECT lang, list_filter(regexp_split_to_array(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t]+'), lambda x: x <> '') AS ws
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce(text, ''), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents)),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
    SELECT lang, m, list_slice(ws, i, i + m - 1) AS phrase
    FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
longer AS (
    SELECT lang, part, max(f) AS f FROM (SELECT lang, unnest([phrase[1:m - 1], phrase[2:m]]) AS part, f FROM f WHERE m > 2) GROUP BY ALL),
kept AS (
    SELECT f.lang, f.m, f.phrase, f.f AS a FROM f LEFT JOIN longer ON f.lang = longer.lang AND f.phrase = longer.part
    WHERE f.m > 1 AND (longer.f IS NULL OR longer.f < f.f)),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c JOIN totals USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:c.k] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1:c.m]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM best)
WHERE rank <= 2000
"""
