"""Queries whose facts come from the byte helpers, over bytes that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate.helpers import bytes as raw
from artifactgate.helpers import scan
from artifactgate.operators import facts, indicators
from artifactgate.plans.findings import FINDINGS_SQL
from artifactgate.plans.fixtures import FIXTURES, frame
from artifactgate.plans.registry import query, quoted
from artifactgate.sources.shared import written

#: Pickles that hold each document's text as a string, before, between or behind what they import; TEXT stands for it.
_PICKLES = ["cos\nsystem\n(VTEXT\ntR.", "ccollections\nOrderedDict\n(VTEXT\ntR.", "VTEXT\n0cbuiltins\neval\n(VTEXT\ntR.cos\npopen\n.", "not a pickle TEXT", "(VTEXT\nctorch._utils\n_rebuild_tensor_v2\nt."]
_LINE = "translate(coalesce(text, ''), chr(10) || chr(13) || chr(92), '   ')"

FIXTURES["pickles"] = lambda d: f"SELECT source AS target_id, concat(CAST(doc_id AS STRING), '.pkl') AS path, {d.bytes('replace(CASE doc_id % 5 ' + ' '.join('WHEN %d THEN %s' % (k, repr_sql(p)) for k, p in enumerate(_PICKLES)) + f' END, {quoted("TEXT")}, {_LINE})')} AS content, doc_id FROM {d.table('documents')}"


def repr_sql(text: str) -> str:
    """A literal with line feeds by chr(10); doubled quotes stand for one."""
    return "concat(" + ", chr(10), ".join("'" + p + "'" for p in text.replace("''", chr(39) * 2).split("\n")) + ")"


@query("""SELECT target_id, path, module, name, error FROM (SELECT target_id, path, unnest(CASE doc_id % 5 WHEN 0 THEN [{'module': 'os', 'name': 'system', 'error': NULL}] WHEN 1 THEN [{'module': 'collections', 'name': 'OrderedDict', 'error': NULL}]
  WHEN 2 THEN [{'module': 'builtins', 'name': 'eval', 'error': NULL}, {'module': 'os', 'name': 'popen', 'error': NULL}] WHEN 3 THEN [{'module': NULL, 'name': NULL, 'error': 'ValueError'}] ELSE [{'module': 'torch._utils', 'name': '_rebuild_tensor_v2', 'error': NULL}] END, recursive := true) FROM pickles)""")
def pickle_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.pickle_facts(frame(spark, sf_dir, "pickles")).select("target_id", "path", "module", "name", "error")


@query("""SELECT path AS file, module, name, 4 AS severity, category, invoked FROM (SELECT path, unnest(CASE doc_id % 5 WHEN 0 THEN [{'module': 'os', 'name': 'system', 'category': 'os-command', 'invoked': true}]
  WHEN 2 THEN [{'module': 'builtins', 'name': 'eval', 'category': 'code-execution', 'invoked': true}, {'module': 'os', 'name': 'popen', 'category': 'os-command', 'invoked': true}] ELSE [] END, recursive := true) FROM pickles)""")
def pickle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raw.pickle_facts(frame(spark, sf_dir, "pickles")).where("error IS NULL")
    return facts.import_findings(found.withColumnRenamed("path", "file"))


#: Sources around each document's words: calls under their names and behind assignments, a decoded value that is run, reads of the environment, and one that does not parse.
_SOURCES = [
    'import os\nnote = "OWN"\nx = input()\ny = x\ndef f(a):\n    z = y\n    os.system(z)\neval(y)\n',
    'import base64, os\nnote = "OWN"\nblob = base64.b64decode(note)\ncode = blob\nexec(code)\nkey = os.environ\n',
    'def (\n# OWN\n',
    '"""OWN"""\nimport requests\ndef send(u):\n    return requests.get(u)\nprint("OWN")\n',
]
FIXTURES["sources"] = lambda d: f"""
        SELECT source AS target_id, concat(CAST(doc_id AS STRING), '.py') AS path, doc_id, {d.bytes("replace(CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {repr_sql(x)}" for k, x in enumerate(_SOURCES)) + f" END, 'OWN', regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}))")} AS content FROM {d.table("documents")}"""


@query("""SELECT target_id, path, c.fact, c.name, CAST(c.line AS INT) AS line, c.top AS on_import, c.arg FROM sources JOIN (VALUES
  (0, 'call', 'input', 3, true, NULL), (0, 'call', 'os.system', 7, false, 'z'), (0, 'call', 'eval', 8, true, 'y'), (1, 'call', 'base64.b64decode', 3, true, 'note'), (1, 'call', 'exec', 5, true, 'code'),
  (2, 'error', 'SyntaxError', 0, false, NULL), (3, 'call', 'requests.get', 4, false, 'u'), (3, 'call', 'print', 5, true, NULL)) AS c(kind, fact, name, line, top, arg) ON c.kind = doc_id % 4""")
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.source_facts(frame(spark, sf_dir, "sources")).where("fact IN ('call', 'error')").select("target_id", "path", "fact", "name", "line", "on_import", "arg")


#: Payloads that are hidden under one key: each document's text in front of one of these, or alone.
_HIDDEN = ["import os; os.system(1)", "see https://evil.example.net/a", "post https://hooks.slack.com/services/T0AB12CD/B0EF34GH now", "docs at https://huggingface.co/model", "-----BEGIN RSA PRIVATE KEY-----"]
_XOR_SQL = " ".join(f"WHEN {k} THEN {quoted(h)}" for k, h in enumerate(_HIDDEN))
FIXTURES["hidden"] = lambda d: f"SELECT source AS target_id, CAST(doc_id AS STRING) AS path, doc_id % 200 + 1 AS xor_key, left(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}), 300) AS own, CASE doc_id % 6 {_XOR_SQL} ELSE '' END AS payload FROM {d.table('documents')}"


@query("""SELECT target_id, path, 'EXFIL_XOR_PAYLOAD' AS rule_id, CAST(xor_key AS INT) AS xor_key, own || ' ' || payload || ' ' AS plain,
  CASE WHEN contains(payload, 'hooks.slack') THEN 4 WHEN contains(payload, 'os.system') THEN 3 WHEN contains(payload, 'PRIVATE KEY') THEN 4 ELSE 3 END AS severity,
  CASE WHEN contains(payload, 'hooks.slack') THEN 'Slack webhook endpoint' WHEN contains(payload, 'os.system') THEN 'shell command' WHEN contains(payload, 'PRIVATE KEY') THEN 'private key material' ELSE 'non-allowlisted URL' END AS reason
FROM hidden WHERE payload <> '' AND NOT contains(payload, 'huggingface')""")
def xor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads hidden under a key of each document's own, behind its text, between bytes that are not printable under it."""
    rows = frame(spark, sf_dir, "hidden")
    plain = F.concat(F.encode(F.concat(F.col("own"), F.lit(" "), F.col("payload"), F.lit(" ")), "UTF-8"))
    found = scan.xor_findings(raw.xored(rows.select("target_id", "path", "xor_key", plain.alias("content"))))
    return found.select("target_id", "path", "rule_id", "xor_key", "plain", "severity", "reason").distinct()


FIXTURES["low_texts"] = lambda d: f"SELECT target_id, path, concat('https://evil.example.net/x ', regexp_replace(text, '[^ -~]', ''{d.everywhere})) AS text FROM text_artifacts"


@query(f"{FINDINGS_SQL.replace('FROM text_artifacts', 'FROM low_texts')} SELECT target_id, path, rule_id, key, CAST(severity AS INT) AS severity FROM content")
def low_plane_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators in the lowest bytes of 4-byte elements: each text's characters spread over one plane."""
    spread = F.encode(F.regexp_replace("text", "(.)", "$1\x00\x00\x00"), "ISO-8859-1")
    tensors = frame(spark, sf_dir, "low_texts").select("target_id", "path", spread.alias("content"))
    return indicators.indicator_findings(raw.low_planes(tensors, most=None)).select("target_id", "path", "rule_id", "key", "severity")


@query("""SELECT path AS file, c.rule_id, c.name, c.severity, c.category, c.line, c.top AS on_import FROM sources JOIN (VALUES
  (0, 'PY_DANGEROUS_CALL', 'os.system', 4, 'os-command', 7, false), (0, 'PY_DANGEROUS_CALL', 'eval', 4, 'code-execution', 8, true), (1, 'PY_DANGEROUS_CALL', 'exec', 4, 'code-execution', 5, true), (1, 'PY_DANGEROUS_CALL', 'base64.b64decode', 3, 'obfuscation', 3, true),
  (1, 'PY_TAINTED_FLOW', 'exec', 4, 'code-execution', 5, true), (1, 'PY_ENV_HARVEST', 'os.environ', 2, 'secret', 6, NULL), (3, 'PY_DANGEROUS_CALL', 'requests.get', 3, 'network', 4, false)) AS c(kind, rule_id, name, severity, category, line, top) ON c.kind = doc_id % 4""")
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangerous calls, environment reads and flows of decoded data in Python sources."""
    # Many steps read the facts, of which the closures read them in every round: sources are parsed once.
    found = written(raw.source_facts(frame(spark, sf_dir, "sources")).withColumnRenamed("path", "file"), "facts")
    calls = facts.call_findings(found.where("fact = 'call'").withColumnRenamed("name", "call"))
    out = calls.select("file", F.lit("PY_DANGEROUS_CALL").alias("rule_id"), F.col("call").alias("name"), "severity", "category", "line", "on_import")
    env = facts.environment_findings(found).select("file", "rule_id", F.lit("os.environ").alias("name"), "severity", F.lit("secret").alias("category"), "line", F.lit(None).cast("boolean").alias("on_import"))
    return out.unionByName(env).unionByName(facts.flow_findings(found))


FIXTURES["json_bodies"] = lambda d: f"""
        SELECT source AS target_id, CAST(doc_id AS STRING) AS path, own, {d.bytes("concat('{{\"a\":[{{\"auto_map\":{{\"', source, '\":\"x.Y\"}}}}, true],\"note\":\"', own, '\"}}')".replace("{{", "{").replace("}}", "}"))} AS content
        FROM (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}) AS own FROM {d.table("documents")}) x"""


@query("""SELECT target_id, path, k.at_path AS at, coalesce(k.key, target_id) AS key, CASE k.kind WHEN 'string' THEN coalesce(k.value, own) ELSE k.value END AS value, k.kind
FROM json_bodies, (VALUES ('$', 'a', NULL, 'array'), ('$.a', '0', NULL, 'object'), ('$.a', '1', 'True', 'boolean'), ('$.a.0', 'auto_map', NULL, 'object'), ('$.a.0.auto_map', NULL, 'x.Y', 'string'), ('$', 'note', NULL, 'string')) AS k(at_path, key, value, kind)""")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.json_facts(frame(spark, sf_dir, "json_bodies")).select("target_id", "path", "at", "key", "value", "kind")
