"""Imports, calls, taint, vulnerabilities and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.operators import facts, intel, trust
from artifactgate.plans.fixtures import FIXTURES, frame
from artifactgate.plans.registry import query, quoted

_DANGER = "danger(prefix, severity, category) AS (VALUES " + ", ".join(f"({quoted(p)}, {s}, {quoted(c)})" for p, s, c in rules.DANGEROUS_IMPORTS) + ")"
_SAFE = " OR ".join(f"starts_with(full_name, {quoted(p)}) OR starts_with(module, {quoted(p)})" for p in rules.SAFE_IMPORT_PREFIXES)
_KINDS = f"""{_DANGER},
n AS (SELECT DISTINCT module, name, module || '.' || name AS full_name FROM imports),
t AS (SELECT *, full_name AS prefix, 0 AS o FROM n UNION ALL SELECT n.*, array_to_string(string_split(module, '.')[1:len(string_split(module, '.')) - k], '.'), k + 1 FROM n, range(0, 6) r(k) WHERE k < len(string_split(module, '.'))),
h AS (SELECT module, name, severity, category, row_number() OVER (PARTITION BY module, name ORDER BY o) AS r FROM t JOIN danger USING (prefix)),
kinds AS (SELECT n.module, n.name, coalesce(h.severity, CASE WHEN regexp_matches(lower(full_name), '{rules.HINTS}') THEN 2 ELSE 1 END) AS severity, coalesce(h.category, 'unknown-import') AS category
          FROM n LEFT JOIN h ON h.module = n.module AND h.name = n.name AND r = 1 WHERE h.module IS NOT NULL OR NOT ({_SAFE.replace("module,", "n.module,")}))"""


@query(f"WITH {_KINDS} SELECT module, name, CAST(severity AS INT) AS severity, category FROM kinds")
def import_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.classified_imports(frame(spark, sf_dir, "imports"))


@query(f"WITH {_KINDS} SELECT DISTINCT i.file, i.module, i.name, CAST(severity AS INT) AS severity, category, (SELECT sum(calls) FROM imports x WHERE x.file = i.file) > 0 AS invoked FROM imports i JOIN kinds k ON k.module = i.module AND k.name = i.name")
def import_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.import_findings(frame(spark, sf_dir, "imports"))


@query(f"""WITH g AS (SELECT file, bool_or(module || '.' || name IN ({", ".join(map(quoted, rules.PIVOTS))})) AS pivots, sum(gadget_calls) AS calls, count(DISTINCT module || ' ' || name) AS imports, max(length(module || '.' || name) - length(replace(module || '.' || name, '.', ''))) AS dots FROM imports GROUP BY file)
SELECT file, 'DEEP_GADGET_PIVOT' AS rule_id, 3 AS severity FROM g WHERE pivots AND calls > 0 UNION ALL SELECT file, 'DEEP_GADGET_CHAIN', 2 FROM g WHERE imports >= 8 AND calls >= 8 UNION ALL SELECT file, 'DEEP_GADGET_DEEP_IMPORT', 1 FROM g WHERE dots >= 4""")
def gadget_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.gadget_findings(frame(spark, sf_dir, "imports"))


def _kind(call: str, column: int) -> str:
    """SQL for the severity (1) or category (2) of a call."""
    value = lambda row: str(row[1]) if column == 1 else quoted(row[2])
    whole = " ".join(f"WHEN {call} = {quoted(r[0])} THEN {value(r)}" for r in rules.PYTHON_CALLS)
    begins = " ".join(f"WHEN starts_with({call}, {quoted(r[0])}) THEN {value(r)}" for r in rules.PYTHON_CALL_PREFIXES)
    decodes = f"WHEN {call} IN ({', '.join(map(quoted, rules.DECODERS))}) THEN {1 if column == 1 else quoted('obfuscation')}"
    return f"CASE {whole} {begins} {decodes} END"


_SINK = f"{_kind('call', 2)} IN ({', '.join(map(quoted, rules.SINKS))})"


@query(f"""WITH k AS (SELECT *, {_kind("call", 1)} AS sev, {_kind("call", 2)} AS category FROM calls)
SELECT file, call, line, CAST(CASE WHEN category = 'obfuscation' THEN 3 ELSE sev END AS INT) AS severity, category, bool_or(on_import) AS on_import
FROM k WHERE category IS NOT NULL AND (category <> 'obfuscation' OR file IN (SELECT file FROM calls WHERE call IN ('eval', 'exec'))) GROUP BY file, call, line, sev, category""")
def call_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.call_findings(frame(spark, sf_dir, "calls"))


_TAINT = """WITH tainted AS (SELECT DISTINCT file, scope, dst AS name FROM assigns WHERE is_source UNION SELECT a.file, a.scope, a.dst FROM tainted t JOIN assigns a ON a.file = t.file AND a.scope = t.scope AND a.src = t.name)"""


@query(f"{_TAINT} SELECT file, scope, name FROM tainted", recursive=True)
def taint_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.tainted(frame(spark, sf_dir, "assigns"))


@query(f"{_TAINT} SELECT DISTINCT c.file, c.scope, call, line, arg FROM calls c JOIN tainted t ON t.file = c.file AND t.scope = c.scope AND t.name = c.arg WHERE {_SINK}", recursive=True)
def tainted_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.tainted_flows(frame(spark, sf_dir, "assigns"), frame(spark, sf_dir, "calls"))


# --- vulnerabilities ------------------------------------------------------------

_V = r"CAST(string_split(regexp_extract({x}, '(\d+(?:\.\d+)+)', 1), '.') AS BIGINT[])"
_AFFECTED = f"""v AS (SELECT DISTINCT channel, version, CASE WHEN regexp_matches(version, '\\d+\\.\\d+') THEN {_V.format(x="version")} END AS have FROM declared),
p AS (SELECT c.*, j, trim(string_split(affected, ',')[j]) AS part FROM (SELECT *, unnest(range(1, len(string_split(affected, ',')) + 1)) AS j FROM cves) c),
q AS (SELECT *, regexp_extract(part, '^(>=|<=|==|<|>)\\s*([\\d.]+)', 1) AS op, regexp_extract(part, '^(>=|<=|==|<|>)\\s*([\\d.]+)', 2) AS raw FROM p),
z AS (SELECT *, list_resize(CASE WHEN regexp_matches(raw, '\\d+\\.\\d+') THEN {_V.format(x="raw")} ELSE CAST([] AS BIGINT[]) END, 6, 0) AS bound FROM q),
h AS (SELECT v.channel, v.version, cve, framework, summary, affected, bool_and(coalesce(CASE op WHEN '<' THEN list_resize(have, 6, 0) < bound WHEN '<=' THEN list_resize(have, 6, 0) <= bound WHEN '>' THEN list_resize(have, 6, 0) > bound WHEN '>=' THEN list_resize(have, 6, 0) >= bound WHEN '==' THEN list_resize(have, 6, 0) = bound ELSE false END, false)) AS hit
      FROM v JOIN z ON z.channel = v.channel GROUP BY ALL)"""


@query(f"""WITH {_AFFECTED},
one AS (SELECT channel, version, framework, cve, min(summary) AS summary FROM h WHERE hit GROUP BY ALL),
b AS (SELECT h.channel, h.version, h.framework, z.raw, z.bound FROM h JOIN z ON z.cve = h.cve AND z.affected = h.affected AND z.channel = h.channel WHERE hit AND op = '<'),
m AS (SELECT channel, version, framework, arg_max(raw, (bound, raw)) AS clear_at FROM b GROUP BY ALL),
g AS (SELECT channel, version, framework, count(*) AS n, list(summary ORDER BY cve) AS l FROM one GROUP BY ALL)
SELECT file, g.framework, n, array_to_string(l[1:3], '; ') || CASE WHEN n > 3 THEN '; +' || CAST(n - 3 AS VARCHAR) || ' more' ELSE '' END AS summaries, clear_at
FROM declared d JOIN g ON g.channel = d.channel AND g.version = d.version LEFT JOIN m ON m.channel = g.channel AND m.version = g.version AND m.framework = g.framework""")
def loader_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.loader_findings(frame(spark, sf_dir, "declared"), frame(spark, sf_dir, "cves"))


@query("SELECT id, cve, is_ghsa, pos, framework FROM (SELECT *, row_number() OVER (PARTITION BY cve ORDER BY is_ghsa DESC, pos) AS k FROM records) WHERE k = 1")
def one_record_per_cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.one_per_cve(frame(spark, sf_dir, "records"))


@query("SELECT cve, framework FROM curated UNION ALL SELECT cve, framework FROM (SELECT cve, framework, row_number() OVER (PARTITION BY cve ORDER BY is_ghsa DESC, pos) AS k FROM records) WHERE k = 1 AND cve NOT IN (SELECT cve FROM curated)")
def merged_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.merged(frame(spark, sf_dir, "curated"), intel.one_per_cve(frame(spark, sf_dir, "records")))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 4 WHEN 0 THEN '<1.' || CAST(p_partkey % 9 AS VARCHAR) WHEN 1 THEN '>=1.0,<2.' || CAST(p_partkey % 9 AS VARCHAR) || '|>=3.0' WHEN 2 THEN '>=0' ELSE '' END AS specs FROM part")
def range_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    event = lambda i, f: F.struct(F.lit(i).cast("string").alias("introduced"), (f if f is not None else F.lit(None)).cast("string").alias("fixed"))
    minor = (F.col("p_partkey") % 9).cast("string")
    events = F.when(F.col("p_partkey") % 4 == 0, F.array(event("0", None), event(None, F.concat(F.lit("1."), minor)))).when(F.col("p_partkey") % 4 == 1, F.array(event("1.0", None), event(None, F.concat(F.lit("2."), minor)), event("3.0", None))).when(F.col("p_partkey") % 4 == 2, F.array(event("0", None)))
    none = F.array().cast("array<struct<introduced:string,fixed:string>>")
    return rows.select(F.col("p_partkey").cast("bigint").alias("id"), F.array_join(intel.specs_of(F.coalesce(events, none)), "|").alias("specs"))


@query("SELECT cve, framework, affected FROM (SELECT CASE WHEN pos % 50 = 0 THEN ' ' ELSE cve END AS cve, CASE WHEN pos % 70 = 0 THEN NULL ELSE framework END AS framework, '<1.0' AS affected FROM records) WHERE cve = ' ' OR framework IS NULL")
def invalid_intel_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "records").selectExpr("CASE WHEN pos % 50 = 0 THEN ' ' ELSE cve END AS cve", "CASE WHEN pos % 70 = 0 THEN NULL ELSE framework END AS framework", "'<1.0' AS affected")
    return intel.invalid_entries(rows)


# --- signatures -----------------------------------------------------------------

_DIFF = "diff AS (SELECT coalesce(f.target_id, s.target_id) AS target_id, coalesce(f.path, s.path) AS path, CASE WHEN s.sha256 IS NULL THEN 'added' WHEN f.sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change FROM files f FULL OUTER JOIN signed_manifest s ON f.target_id = s.target_id AND f.path = s.path WHERE f.sha256 IS DISTINCT FROM s.sha256)"
_STATUS = f"""{_DIFF}, st AS (SELECT t.target_id, CASE WHEN g.key_id IS NULL THEN 'unsigned' WHEN algorithm <> 'ed25519' THEN 'invalid' WHEN k.publisher IS NULL THEN 'untrusted' WHEN revoked THEN 'revoked'
  WHEN coalesce(created, TIMESTAMP '2024-01-10 00:00:00') < not_before OR coalesce(created, TIMESTAMP '2024-01-10 00:00:00') > not_after THEN 'expired' WHEN t.target_id IN (SELECT target_id FROM diff) THEN 'invalid' WHEN NOT sig_valid THEN 'invalid' ELSE 'verified' END AS status
  FROM targets t LEFT JOIN signatures g ON g.target_id = t.target_id LEFT JOIN trust_store k ON k.key_id = g.key_id)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.manifest_diff(frame(spark, sf_dir, "files"), frame(spark, sf_dir, "signed_manifest"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = frame(spark, sf_dir, "signatures").withColumn("created", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return trust.signature_status(frame(spark, sf_dir, "targets"), signed, frame(spark, sf_dir, "trust_store"), _diff(spark, sf_dir), "2024-01-10 00:00:00")


@query(f"WITH {_DIFF} SELECT target_id, path, change FROM diff")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"WITH {_STATUS} SELECT target_id, status FROM st")
def signature_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f"WITH {_STATUS} SELECT target_id, 'SIGNATURE_' || upper(status) AS rule_id, CASE WHEN status IN ('invalid', 'revoked') THEN 3 ELSE 2 END AS severity FROM st WHERE status IN ('invalid', 'revoked', 'untrusted', 'expired')")
def signature_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.status_findings(_status(spark, sf_dir))


FIXTURES["bundles"] = lambda d: f"""
        SELECT source AS target_id, min(doc_id) % 5 <> 1 AS available, min(doc_id) % 3 <> 0 AS verified, CASE WHEN min(doc_id) % 2 = 0 THEN concat('ci@', source) END AS identity FROM {d.table("documents")} WHERE source <> 'src2' GROUP BY source"""


@query("""WITH s AS (SELECT t.target_id, CASE WHEN b.target_id IS NULL THEN 'unsigned' WHEN NOT available THEN 'unavailable' WHEN NOT verified THEN 'invalid' WHEN b.identity IS NULL THEN 'untrusted' ELSE 'verified' END AS status FROM targets t LEFT JOIN bundles b USING (target_id))
SELECT target_id, 'SIGSTORE_' || upper(status) AS rule_id, CASE status WHEN 'invalid' THEN 3 WHEN 'unavailable' THEN 1 ELSE 2 END AS severity FROM s WHERE status NOT IN ('verified', 'unsigned')""")
def identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.status_findings(trust.identity_status(frame(spark, sf_dir, "targets"), frame(spark, sf_dir, "bundles")), "SIGSTORE")
