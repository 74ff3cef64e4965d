"""Token counts of texts of any length: overlapping windows, encoded apart and spliced.

Texts of at most ``CHUNK`` characters are encoded as they are. A longer one is
cut into windows of ``CHUNK`` characters, each followed by ``OVERLAP`` characters
of the next, which are dealt over all tasks and encoded with their offsets. Two
neighbours are spliced at the first boundary of the overlap that both encodings
have and that is proven stable; each window then counts the tokens between its
two splices.

A boundary between two characters is stable if no piece of the vocabulary holds
them side by side. Encoding joins symbols only to pieces of the vocabulary, so
that nothing on one side of such a boundary can have an effect on the other: a
text is then encoded as its two sides are, whatever stands further off.

Where neighbours don't align, as in an endless run of one character, the overlap
is widened: the windows between the nearest joints that do align are put together
and encoded as one. The second pass always ends, since all its ends are splices.

Defined results: a null text is an empty one, with no bytes and no tokens; rows
that repeat an id, or have none, are counted one by one; no other column plays a
part, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from artifactgate.llm.common import stored
from artifactgate.llm.groups import batches_of

#: Characters of a window and of its overlap with the next.
CHUNK, OVERLAP = 32_768, 512
LIMIT = 4_096
#: Bytes of texts that are encoded in one call at most, but for a single text.
CALL_BYTES = 1 << 20


class Model(NamedTuple):
    encoder: sentencepiece.SentencePieceProcessor
    pairs: np.ndarray  # characters that stand side by side in a piece, as first << 32 | second, sorted


@lru_cache(maxsize=2)
def load(proto: bytes) -> Model:
    spec = model_pb2.ModelProto()
    spec.ParseFromString(proto)
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("texts are cut by characters: a model that normalises them can't be spliced")
    kinds = model_pb2.ModelProto.SentencePiece
    pieces = [p.piece for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
    pairs = {ord(a) << 32 | ord(b) for p in pieces for a, b in zip(p, p[1:])}
    return Model(sentencepiece.SentencePieceProcessor(model_proto=proto), np.array(sorted(pairs), dtype=np.uint64))


#: What the encoder writes for a space.
SPACE, MARK = 0x20, 0x2581


def stable(text: str, pairs: np.ndarray) -> np.ndarray:
    """The positions in ``text``, but its ends, that no piece can span."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    c[c == SPACE] = MARK
    return 1 + np.flatnonzero(~np.isin((c[:-1] << np.uint64(32)) | c[1:], pairs))


class Span(NamedTuple):
    """Splices at either end of a window, as positions in it (-1: none), and tokens between them (-1: not known)."""

    left: int
    right: int
    tokens: int


def encoded_window(model: Model, text: str, core: int, first: bool, last: bool) -> Span:
    """``core``: the characters of the window without its overlap."""
    starts = np.array([x[0] for x in model.encoder.encode(text, return_type="offset_mapping")["offsets"]], dtype=np.int64)

    def splice(lo: int) -> int:
        at = lo + stable(text[lo : lo + OVERLAP], model.pairs)
        at = at[np.isin(at, starts)]
        return int(at[0]) if len(at) else -1

    left, right = 0 if first else splice(0), len(text) if last else splice(core)
    return Span(left, right, int(((starts >= left) & (starts < right)).sum()) if min(left, right) >= 0 else -1)


def _lengths(model: Model, texts: list[str]) -> Iterator[int]:
    """Tokens of each text."""
    lo, size = 0, 0
    for hi, text in enumerate(texts):
        if hi > lo and size + len(text) > CALL_BYTES:
            yield from map(len, model.encoder.encode(texts[lo:hi], num_threads=1, return_type="numpy"))
            lo, size = hi, 0
        size += len(text)
    if texts[lo:]:
        yield from map(len, model.encoder.encode(texts[lo:], num_threads=1, return_type="numpy"))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``model_path``: a sentencepiece model that the driver can read."""
    spark = docs.sparkSession
    proto = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    whole = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("row bigint, n_bytes bigint, n_tokens bigint, k int, core int, last boolean, window string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto.value)
        for batch in batches:
            size, chars = pc.binary_length(batch.column(2)).cast(pa.int64()), pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)
            short = pa.array(np.flatnonzero(chars <= CHUNK))
            tokens = pa.array(list(_lengths(model, batch.column(2).take(short).to_pylist())), pa.int64())
            empty = [pa.nulls(len(short), kind) for kind in (pa.int32(), pa.int32(), pa.bool_(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(short), batch.column(1).take(short), size.take(short), tokens, *empty], whole.names)
            for i in np.flatnonzero(chars > CHUNK).tolist():
                text = batch.column(2)[i].as_py()
                for k, lo in enumerate(range(0, len(text), CHUNK)):
                    core = min(CHUNK, len(text) - lo)
                    one = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), size.slice(i, 1), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([core], pa.int32()), pa.array([lo + core == len(text)])]
                    yield pa.RecordBatch.from_arrays([*one, pa.array([text[lo : lo + core + OVERLAP]], pa.string())], whole.names)

    with batches_of(spark, 256):
        every = stored(rows.mapInArrow(cut, whole), "windows")
    short, windows = every.where("window IS NULL"), every.where("window IS NOT NULL")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(proto.value)
        for batch in batches:
            spans = [encoded_window(model, text, core, k == 0, last) for k, core, last, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in zip(*spans))], ["row", "k", "left", "right", "tokens"])

    with batches_of(spark, 16):
        spans = stored(windows.select("row", "k", "core", "last", "window").repartition("row", "k").mapInArrow(encode, "row bigint, k int, left bigint, right bigint, tokens bigint"), "spans")
    tokens = spliced(spans, windows, proto)
    head = windows.where("k = 0").select("row", "doc_id", "n_bytes")
    long = head.join(tokens, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.select("doc_id", "n_bytes", "n_tokens").unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def spliced(spans: DataFrame, windows: DataFrame, proto) -> DataFrame:
    """(row, n_tokens): the sums of the windows' tokens, where neighbours that don't align are encoded as one."""
    order = Window.partitionBy("row").orderBy("k")
    # A window's right splice counts from its own start, the next one's left splice from the end of its core.
    joints = spans.join(windows.select("row", "k", "core"), ["row", "k"])
    apart = (F.col("left") < 0) | (F.lag("right").over(order) < 0) | (F.lag(F.col("right") - F.col("core")).over(order) != F.col("left"))
    joints = joints.withColumn("aligned", (F.col("k") == 0) | ~apart)
    joints = joints.withColumn("run", F.sum(F.col("aligned").cast("int")).over(order)).withColumn("many", F.count("*").over(Window.partitionBy("row", "run")) > 1)
    joints = stored(joints, "joints")

    def widened(table: pa.Table) -> pa.Table:
        model, table = load(proto.value), table.sort_by("k")
        core, text = table.column("core").to_pylist(), table.column("window").to_pylist()
        whole = "".join(t[:n] for t, n in zip(text, core)) + text[-1][core[-1] :]
        span = encoded_window(model, whole, sum(core), table.column("k")[0].as_py() == 0, table.column("last")[-1].as_py())
        return pa.table({"row": table.column("row").slice(0, 1), "tokens": pa.array([span.tokens], pa.int64())})

    single = joints.where("NOT many").select("row", "tokens")
    again = joints.where("many").select("row", "k", "run").join(windows.select("row", "k", "core", "last", "window"), ["row", "k"])
    wide = again.groupBy("row", "run").applyInArrow(widened, "row bigint, tokens bigint")
    return single.unionByName(wide).groupBy("row").agg(F.sum("tokens").alias("n_tokens"))
