"""Archives in archives, packed from each document's own text, and what their members hold."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate.helpers import archives, scan
from artifactgate.operators import facts, formats, indicators
from artifactgate.plans import helpers  # noqa: F401  the fixture of pickles
from artifactgate.plans.findings import FINDINGS_SQL
from artifactgate.plans.fixtures import FIXTURES, frame
from artifactgate.plans.registry import query, quoted

_PACKERS = [lambda b: gzip.compress(b, 1), lambda b: bz2.compress(b, 1), lambda b: lzma.compress(b, preset=0), lambda b: b]


def _tar(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def packed(rows: DataFrame, name: str) -> DataFrame:
    """(target_id, path, content) of (target_id, path, content): each file as ``name`` in a compressed tar in a ZIP file in a tar; the compression by the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                body = batch.column(2)[k].as_py() or b""
                middle = io.BytesIO()
                with zipfile.ZipFile(middle, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    z.writestr("in.tar", _PACKERS[len(body) % 4](_tar({name: body})))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([_tar({"in.zip": middle.getvalue()})], pa.binary())], ["target_id", "path", "content"])

    return rows.select("target_id", "path", "content").mapInArrow(run, "target_id string, path string, content binary")


@query(f"{FINDINGS_SQL} SELECT target_id, path || '!in.zip!in.tar!body.bin' AS path, 3 AS depth, rule_id, key, CAST(severity AS INT) AS severity, match, CAST(rank AS INT) AS rank FROM content")
def archived_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators of every text, found in a compressed tar in a ZIP file in a tar, are those of the plain file."""
    plain = frame(spark, sf_dir, "text_artifacts").select("target_id", "path", F.encode("text", "UTF-8").alias("content"))
    windows = archives.member_windows(packed(plain, "body.bin"), window=16_384).where("error IS NULL").drop("error")
    found = indicators.first_findings(scan.matches(windows), also=("depth",))
    return found.where("depth = 3").select("target_id", "path", "depth", "rule_id", "key", "severity", "match", "rank")


@query("""SELECT path || '!in.zip!in.tar!m.pkl' AS file, unnest(CASE doc_id % 5 WHEN 0 THEN ['os.system'] WHEN 2 THEN ['builtins.eval', 'os.popen'] ELSE [] END) AS import, 4 AS severity, CASE doc_id % 5 WHEN 0 THEN true WHEN 2 THEN true END AS invoked FROM pickles WHERE doc_id % 5 IN (0, 2)""")
def archived_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pickles in archives in archives import, each around a document's text."""
    found = archives.member_imports(packed(frame(spark, sf_dir, "pickles"), "m.pkl")).where("error IS NULL").withColumnRenamed("path", "file")
    return facts.import_findings(found).select("file", F.concat_ws(".", "module", "name").alias("import"), "severity", "invoked")


#: Schemas of skops archives around each document's words: dangerous, unknown and fallback types, a broken one, and one under another name.
_SCHEMAS = [
    '{"note":"OWN","__module__":"os","__class__":"system","content":[{"__module__":"sklearn.svm","__class__":"SVC"},{"__module__":"os","__class__":"system"}]}',
    '{"a":{"b":[{"__module__":"lib_SRC.x","__class__":"Y","__loader__":"ReduceNode"}]},"note":"OWN"}',
    '{"__class__":"OWN","__loader__":"MethodPickleNode","__module__":"sklearn.x"}',
    '{"note":"OWN',
    '{"note":"OWN"}',
]
FIXTURES["schemas"] = lambda d: f"""
        SELECT source AS target_id, concat('s/', CAST(doc_id AS STRING), '.skops') AS path, doc_id, source,
               replace(replace(CASE doc_id % 5 {" ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(_SCHEMAS))} END, 'SRC', source), 'OWN', lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}))) AS body
        FROM {d.table("documents")}"""


def zipped(rows: DataFrame) -> DataFrame:
    """(target_id, path, content) of (target_id, path, name, content): a ZIP file of the one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, body in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = io.BytesIO()
                with zipfile.ZipFile(own, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    z.writestr(name, body)
                out.append(own.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["target_id", "path", "content"])

    return rows.select("target_id", "path", "name", "content").mapInArrow(run, "target_id string, path string, content binary")


@query("""SELECT target_id, path, CASE doc_id % 5 WHEN 0 THEN 'SKOPS_DANGEROUS_TYPE' WHEN 1 THEN 'SKOPS_UNKNOWN_TYPE' WHEN 2 THEN 'SKOPS_PICKLE_FALLBACK' ELSE 'SKOPS_MALFORMED' END AS rule_id,
  CASE doc_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS severity, CASE doc_id % 5 WHEN 0 THEN 'os.system' WHEN 1 THEN 'lib_' || source || '.x.Y' WHEN 2 THEN 'MethodPickleNode' END AS name FROM schemas""")
def skops_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and loaders in the schemas of archives, from the bytes of the archives."""
    rows = frame(spark, sf_dir, "schemas").select("target_id", "path", F.when(F.col("doc_id") % 5 == 4, "other.json").otherwise("schema.json").alias("name"), F.encode("body", "UTF-8").alias("content"))
    return formats.skops_findings(zipped(rows))
