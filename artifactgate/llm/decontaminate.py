"""Benchmark decontamination.

Every benchmark item becomes a set of word windows (13 consecutive words; an
item with fewer words is one window). The windows' hashes are broadcast, in
parts of at most ``MAX_WINDOWS`` each, one at a time, so what a task and the driver
hold is bounded however large the benchmark grows. Each document's windows are hashed with numpy, looked
up in the sorted hashes, and every hit is verified on the words themselves.
Texts are never shuffled: with one part (the usual case) the scan is one narrow
stage; with more parts each part adds one more scan, whose result is stored with
its hits merged into each row, still without a shuffle.

Defined results: a null or empty text has no words and is never hit; an item
without words hits nothing; a null item_id takes part in hits but is not named
in ``items``; repeated document rows get one result each; repeated item rows
count as one item. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactgate.llm import textops
from artifactgate.llm.common import discard, stored

WINDOW = 13
#: Windows of one broadcast part: about 300 bytes each with their words, so 60 MB at most.
MAX_WINDOWS = 200_000

_HITS = "n_words bigint, hits array<struct<lo:int,hi:int>>, items array<string>"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item string, width int, words string): the distinct windows of every item, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, widths, grams = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text or "")
                width = min(window, len(words))
                for k in range(len(words) - width + 1 if width else 0):
                    items.append(item)
                    widths.append(width)
                    grams.append(" ".join(words[k : k + width]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(widths, pa.int32()), pa.array(grams, pa.string())], ["item", "width", "words"])

    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, width int, words string").distinct()


_TABLE = bytes(int(b) or 0x20 for b in textops.ALNUM)


def _words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(_TABLE).split(b" ") if w]


class _Lookup:
    """The windows of one part, by hash."""

    def __init__(self, rows: list[tuple[str | None, int, str]]):
        self.by_width: dict[int, tuple[np.ndarray, dict[int, list[tuple[str | None, bytes]]]]] = {}
        #: By width, which low bits of a hash occur: a small table that turns most windows away.
        self.low: dict[int, np.ndarray] = {}
        for width in sorted({r[1] for r in rows}):
            entries: dict[int, list[tuple[str | None, bytes]]] = {}
            own = [(item, gram.encode()) for item, w, gram in rows if w == width]
            data = np.frombuffer(b"".join(g for _, g in own), dtype=np.uint8)
            at = np.cumsum([0, *(len(g) for _, g in own)])
            words = textops.split_words(data, at, textops.ALNUM)
            for (item, gram), lo in zip(own, words.first[:-1]):
                entries.setdefault(int(textops.windows(words.hash[lo : lo + width], width)[0]), []).append((item, gram))
            keys = np.array(sorted(entries), dtype=np.uint64)
            self.by_width[width] = keys, entries
            self.low[width] = np.zeros(1 << 20, dtype=bool)
            self.low[width][(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True


def _find(lookup: _Lookup, words: textops.Words) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text: its words, the verified hits as merged word ranges, and the items hit."""
    low = textops.ALNUM[words.data]
    low[low == 0] = 0x20
    found: list[tuple[int, int, int]] = []
    for width, (keys, _) in lookup.by_width.items():
        every = textops.windows(words.hash, width)
        if not len(every):
            continue
        at = np.flatnonzero(lookup.low[width][(every & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, every[at]), len(keys) - 1)
        at = at[keys[place] == every[at]]
        found += [(int(p), width, int(every[p])) for p in at]
    found.sort()
    k = 0
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        while k < len(found) and found[k][0] < hi:
            p, width, h = found[k]
            k += 1
            if p + width > hi:
                continue
            gram = b" ".join(low[words.start[i] : words.end[i]].tobytes() for i in range(p, p + width))
            same = [item for item, g in lookup.by_width[width][1][h] if g == gram]
            if same:
                items.update(x for x in same if x is not None)
                if ranges and p - lo <= ranges[-1][1]:
                    ranges[-1] = ranges[-1][0], max(ranges[-1][1], p - lo + width)
                else:
                    ranges.append((p - lo, p - lo + width))
        yield hi - lo, ranges, sorted(items)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _without(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the words of the ranges and what stands between them."""
    raw = text.encode("utf-8")
    words = textops.split_words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), textops.ALNUM)
    parts, last = [], 0
    for lo, hi in ranges:
        parts.append(raw[last : words.start[lo]])
        last = int(words.end[hi - 1])
    return b"".join([*parts, raw[last:]]).decode("utf-8", "replace")


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, hits (merged word ranges, end exclusive) and items (sorted ids of the items hit) added.

    The columns are named ``_n_words``, ``_hits`` and ``_items``; columns of the table that have these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_n_words", "_hits", "_items")
    grams = stored(benchmark_windows(benchmark, window=window), "windows")
    parts = max(1, -(-grams.count() // max_windows))
    out = docs.withColumns({"_n_words": F.lit(None).cast("bigint"), "_hits": F.array().cast("array<struct<lo:int,hi:int>>"), "_items": F.array().cast("array<string>")})
    place = out.columns.index(text_col)
    for part in range(parts):
        # At most max_windows rows (a little more by chance): hashes split the windows evenly.
        rows = grams if parts == 1 else grams.where(F.pmod(F.xxhash64("width", "words"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lookup = _Lookup(held.value)
            for batch in batches:
                names = batch.schema.names
                n_words, hits, items = [], [], []
                for _, _, data, at in textops.slices(batch.column(place)):
                    for n, ranges, own in _find(lookup, textops.split_words(data, at, textops.ALNUM)):
                        n_words.append(n)
                        hits.append(ranges)
                        items.append(own)
                if part:
                    hits = [_merged([*a, *((x["lo"], x["hi"]) for x in b)]) for a, b in zip(hits, batch.column(len(names) - 2).to_pylist())]
                    items = [sorted({*a, *b}) for a, b in zip(items, batch.column(len(names) - 1).to_pylist())]
                kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
                new = [pa.array(n_words, pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in x] for x in hits], kind), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names)

        last, out = out, out.mapInArrow(scan, out.schema)
        if parts > 1:
            out = stored(out, "hits")
            held.destroy()
            if part:
                discard(last)
    return out


def contaminated(n_words, n_hit):
    """The contract's rule: any hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def _n_hit():
    return F.aggregate("_hits", F.lit(0).cast("bigint"), lambda n, x: n + (x["hi"] - x["lo"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` after decontamination, same columns.

    mode "documents": contaminated documents go. mode "spans": every hit span is cut out of its text.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    hit = find_hits(docs, benchmark, text_col, window)
    if mode == "documents":
        return hit.where(~contaminated(F.col("_n_words"), _n_hit())).select(*(f"`{c}`" for c in docs.columns))
    place, names = docs.columns.index(text_col), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not h else _without(t, [(x["lo"], x["hi"]) for x in h]) for t, h in zip(batch.column(place).to_pylist(), batch.column(len(names) + 1).to_pylist())]
            columns = [*batch.columns[: len(names)]]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return hit.mapInArrow(cut, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit word ranges as a string, a row per document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hit = find_hits(rows, benchmark).withColumn("n_hit", _n_hit())
    return hit.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        "n_hit",
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("_n_words"), F.col("n_hit")).alias("contaminated"),
    )


#: DuckDB SQL for report() over the tables documents and benchmark.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.gram = bw.gram),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
