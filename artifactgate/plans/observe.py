"""Counters, reports, detection quality, licences and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.operators import intel, observe
from artifactgate.plans.fixtures import FIXTURES, _cases, frame
from artifactgate.plans.registry import query, quoted

_LABELS = ["verdict", "category", "format", "status", "origin"]


@query("SELECT target_id, count(*) FILTER (severity = 0) AS info, count(*) FILTER (severity = 1) AS low, count(*) FILTER (severity = 2) AS medium, count(*) FILTER (severity = 3) AS high, count(*) FILTER (severity = 4) AS critical, max(severity) AS max_severity FROM findings GROUP BY target_id")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.severity_counts(frame(spark, sf_dir, "findings"))


_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS value, count(*) AS n FROM scans GROUP BY {c}" for c in _LABELS)


@query(_COUNTS)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.label_counts(frame(spark, sf_dir, "scans"), _LABELS)


@query(_COUNTS)
def grouping_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.grouping_set_counts(frame(spark, sf_dir, "scans"), _LABELS)


FIXTURES["scanned_files"] = lambda d: "SELECT format, CASE doc_id % 17 WHEN 3 THEN -size ELSE size END AS size, CASE WHEN doc_id % 13 = 4 THEN 'unreadable' END AS error FROM files"
FIXTURES["all_findings"] = lambda d: f"SELECT severity, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE category END AS category, CASE WHEN doc_id % 19 < 4 THEN {_cases('doc_id', 4, rules.ERROR_RULES)} ELSE rule_id END AS rule_id FROM findings"
FIXTURES["blocking"] = lambda d: f"SELECT {_cases('doc_id', 9, [*rules.BLOCK_REASON], quoted('POLICY_FILE_TOO_LARGE'))} AS rule_id FROM {d.table('documents')}"
_REASONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.BLOCK_REASON.items())


@query(f"""SELECT 'verdict' AS family, verdict AS label, count(*) AS n FROM scans GROUP BY verdict UNION ALL SELECT 'status', status, count(*) FROM scans GROUP BY status
UNION ALL SELECT 'origin', upper(CASE WHEN coalesce(origin, '') = '' THEN 'unknown' ELSE origin END) AS o, count(*) FROM scans GROUP BY o UNION ALL SELECT 'format', format, count(*) FROM scanned_files GROUP BY format
UNION ALL SELECT 'bytes', 'all', CAST(sum(greatest(size, 0)) AS BIGINT) FROM scanned_files UNION ALL SELECT 'errors', 'all', (SELECT count(*) FROM scanned_files WHERE error IS NOT NULL) + (SELECT count(*) FROM all_findings WHERE rule_id IN {tuple(rules.ERROR_RULES)})
UNION ALL SELECT 'severity', ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][severity + 1], count(*) FROM all_findings GROUP BY severity UNION ALL SELECT 'category', coalesce(category, 'other') AS c, count(*) FROM all_findings GROUP BY c
UNION ALL SELECT 'block_reason', CASE rule_id {_REASONS} END AS r, count(*) FROM blocking WHERE r IS NOT NULL GROUP BY r""")
def counter_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.counter_families(*(frame(spark, sf_dir, t) for t in ("scans", "scanned_files", "all_findings", "blocking")))


FIXTURES["datasets"] = lambda d: f"""
        SELECT concat('data-', CAST(o_orderkey AS STRING)) AS name, o_orderkey, CAST(o_orderdate AS DATE) AS made,
               concat('# ', coalesce(o_orderpriority, ''), chr(10), '# Last refreshed: ', CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '1998-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END) AS text FROM {d.table("orders")}"""


@query("""SELECT name, CASE WHEN o_orderkey % 5 > 1 THEN made END AS refreshed, CASE WHEN o_orderkey % 5 > 1 THEN CAST(DATE '1998-06-01' - made AS INT) END AS age, o_orderkey % 5 > 1 AND DATE '1998-06-01' - made > 90 AS stale FROM datasets""")
def dataset_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.dataset_ages(frame(spark, sf_dir, "datasets"), "1998-06-01")


@query("SELECT v AS value, (SELECT count(*) FROM scans WHERE verdict = v) AS n FROM (SELECT unnest(['PASS', 'WARN', 'FAIL', 'BLOCKED', 'ERROR']) AS v)")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.zero_filled(observe.label_counts(frame(spark, sf_dir, "scans"), ["verdict"]), "verdict", rules.VERDICTS)


_HIST = "h AS (SELECT replica, le, count(*) FILTER (duration <= le) AS n, count(*) AS total, sum(duration) AS sum FROM scans, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, CAST('inf' AS DOUBLE)]::DOUBLE[]) AS le) GROUP BY replica, le)"


@query(f"WITH {_HIST} SELECT replica, le, n, total, round(sum, 4) AS sum FROM h")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.latency_histogram(frame(spark, sf_dir, "scans"), ["replica"]).withColumn("sum", F.round("sum", 4))


@query(f"""WITH {_HIST}, s AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, coalesce(lag(le) OVER w, 0) AS le0 FROM h WINDOW w AS (PARTITION BY replica ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY le) AS k FROM s WHERE n >= 0.95 * total)
SELECT replica, round(CASE WHEN isinf(le) THEN le0 ELSE le0 + (le - le0) * (0.95 * total - n0) / greatest(n - n0, 1) END, 6) AS value FROM f WHERE k = 1""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = observe.latency_histogram(frame(spark, sf_dir, "scans"), ["replica"])
    return observe.histogram_quantile(h, 0.95, ["replica"]).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT replica, date_trunc('second', ts) AS moment, 1 AS d FROM scans UNION ALL SELECT replica, date_trunc('second', ts + to_seconds(CAST(ceil(duration) AS BIGINT))), -1 FROM scans)
SELECT replica, moment, CAST(sum(d) OVER (PARTITION BY replica ORDER BY moment) AS BIGINT) AS running FROM (SELECT replica, moment, sum(d) AS d FROM e GROUP BY ALL)""")
def scans_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.in_flight(frame(spark, sf_dir, "scans"))


@query("SELECT category AS value, count(*) AS n FROM scans GROUP BY category ORDER BY n DESC, value LIMIT 10")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.top_values(frame(spark, sf_dir, "scans"), "category")


@query("SELECT target_id, path, rule_id, severity FROM findings ORDER BY severity DESC, target_id, path, rule_id")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "findings").select("target_id", "path", "rule_id", "severity").orderBy(F.desc("severity"), "target_id", "path", "rule_id")


@query("SELECT target_id, rule_id, CASE WHEN severity >= 3 THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'note' END AS level, path AS uri, title AS message FROM findings")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.sarif_results(frame(spark, sf_dir, "findings"))


@query("SELECT target_id, rule_id, left(arg_min(title, doc_id), 120) AS name FROM findings GROUP BY ALL")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.sarif_rules(frame(spark, sf_dir, "findings"))


def _parts(table: str, by: str) -> str:
    return f"(SELECT r.*, CAST('0x' || substr(sha256({by}), 1, 8) AS BIGINT) % c.parts AS part FROM {table} r JOIN (SELECT target_id, CAST(ceil(count(*) / 200) AS BIGINT) AS parts FROM {table} GROUP BY target_id) c ON c.target_id = r.target_id)"


@query(f"""WITH res AS (SELECT target_id, rule_id, CASE WHEN severity <= 1 THEN 'note' WHEN severity = 2 THEN 'warning' ELSE 'error' END AS level, coalesce(path, target_id) AS uri, title AS message FROM findings),
p AS {_parts("res", "uri")}, n AS (SELECT target_id, rule_id, left(arg_min(title, doc_id), 120) AS name FROM findings GROUP BY ALL),
d AS (SELECT target_id, part, list_sort(list({{'rule_id': rule_id, 'level': level, 'uri': uri, 'message': message}})) AS results FROM p GROUP BY ALL),
u AS (SELECT p.target_id, part, list_sort(list(DISTINCT {{'rule_id': p.rule_id, 'name': name}})) AS rules FROM p JOIN n ON n.target_id = p.target_id AND n.rule_id = p.rule_id GROUP BY ALL)
SELECT d.target_id, d.part, CAST(to_json({{'version': '2.1.0', 'runs': [{{'rules': rules, 'results': results}}]}}) AS VARCHAR) AS body FROM d JOIN u ON u.target_id = d.target_id AND u.part = d.part""")
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.sarif_documents(frame(spark, sf_dir, "findings"), most=200)


@query("SELECT t.target_id, max(severity) AS max_severity, count(rule_id) AS n_findings, array_to_string(list_sort(list_distinct(list(rule_id)))[1:20], ',') AS rule_ids FROM targets t LEFT JOIN findings f ON f.target_id = t.target_id GROUP BY t.target_id")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.audit_records(frame(spark, sf_dir, "targets"), frame(spark, sf_dir, "findings")).drop("body")


@query(f"""WITH g AS (SELECT target_id, path, list_sort(list({{'rule_id': rule_id, 'severity': severity}})) AS fs FROM findings GROUP BY ALL), p AS {_parts("files", "path")}
SELECT target_id, part, CAST(to_json({{'target_id': target_id, 'part': part, 'files': files}}) AS VARCHAR) AS body
FROM (SELECT p.target_id, part, list_sort(list({{'path': p.path, 'format': format, 'size': size, 'sha256': sha256, 'findings': coalesce(fs, [])}})) AS files FROM p LEFT JOIN g ON g.target_id = p.target_id AND g.path = p.path GROUP BY p.target_id, part)""")
def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = frame(spark, sf_dir, "findings").withColumn("path", F.concat("path", F.lit("")))
    return observe.nested_reports(frame(spark, sf_dir, "files").drop("doc_id"), findings, most=200)


_PREFIXES = ", ".join(f"({quoted(p)}, {quoted(t)})" for p, t in rules.TECHNIQUES)


@query(f"""WITH p(prefix, technique) AS (VALUES {_PREFIXES}), r AS (SELECT DISTINCT rule_id FROM findings UNION SELECT 'DEEP_STEGO_X' UNION SELECT 'UNKNOWN_RULE' UNION SELECT 'SIGNATURE_INVALID'),
b AS (SELECT rule_id, arg_max(technique, length(prefix)) AS technique FROM r JOIN p ON starts_with(rule_id, prefix) GROUP BY rule_id)
SELECT rule_id, CASE WHEN technique = 'AML.T0010.003' THEN technique ELSE technique || ',AML.T0010.003' END AS tags FROM b""")
def rule_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frame(spark, sf_dir, "findings").select("rule_id").unionByName(spark.createDataFrame([("DEEP_STEGO_X",), ("UNKNOWN_RULE",), ("SIGNATURE_INVALID",)], "rule_id string"))
    return observe.techniques(own, spark.createDataFrame(rules.TECHNIQUES, "prefix string, technique string")).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT round(avg(CASE WHEN label = 'malicious' THEN (max_severity >= 2)::INT END), 9) AS tpr, round(avg(CASE WHEN label = 'benign' THEN (verdict IN ('FAIL', 'BLOCKED'))::INT END), 9) AS fpr, count(*) FILTER (label = 'benign' AND verdict = 'WARN') AS benign_warned,
  count(*) FILTER (label = 'malicious' AND max_severity < 2) AS missed, count(*) FILTER (label = 'benign' AND verdict IN ('FAIL', 'BLOCKED')) AS false_positives,
  round(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(seconds AS DOUBLE), 0.95), 6) AS p95 FROM tool_results""")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.detection_metrics(frame(spark, sf_dir, "tool_results").withColumn("seconds", F.col("seconds").cast("double")))


@query("SELECT id, CASE label WHEN 'malicious' THEN 'missed' ELSE 'false_positive' END AS error FROM tool_results WHERE (label = 'malicious' AND max_severity < 2) OR (label = 'benign' AND verdict IN ('FAIL', 'BLOCKED'))")
def detection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.detection_errors(frame(spark, sf_dir, "tool_results"))


@query("SELECT attack_class, count(*) AS n, count(*) FILTER (max_severity >= 2) AS detected, array_to_string(list_sort(list_distinct(list(rule_id)))[1:3], ',') AS rules FROM tool_results WHERE label = 'malicious' GROUP BY attack_class")
def detection_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.by_attack_class(frame(spark, sf_dir, "tool_results"))


@query("""WITH s AS (SELECT tool, count(*) FILTER (label = 'malicious' AND verdict <> 'SKIPPED' AND max_severity >= 2) AS detected, count(*) FILTER (label = 'malicious' AND verdict <> 'SKIPPED' AND max_severity < 2) AS missed, count(*) FILTER (label = 'malicious' AND verdict = 'SKIPPED') AS not_attempted,
  count(*) FILTER (label = 'benign' AND verdict IN ('FAIL', 'BLOCKED')) AS false_positives FROM tool_results GROUP BY tool) SELECT *, round(detected / nullif(detected + missed, 0), 9) AS recall FROM s""")
def scanner_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.scanner_comparison(frame(spark, sf_dir, "tool_results"))


@query("SELECT count(*) FILTER (NOT known_open) AS n, count(*) FILTER (NOT known_open AND resisted) AS resisted, count(*) FILTER (known_open AND NOT resisted) AS open, round(avg(CASE WHEN NOT known_open THEN resisted::INT END), 9) AS recall FROM tool_results WHERE label = 'malicious'")
def evasion_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.evasion_recall(frame(spark, sf_dir, "tool_results"))


@query("""WITH n AS (SELECT name, version, min(CASE lower(trim(licence)) WHEN 'mit license' THEN 'MIT' WHEN 'mit' THEN 'MIT' WHEN 'apache software license' THEN 'Apache-2.0' WHEN 'bsd license' THEN 'BSD-3-Clause' WHEN 'isc license (iscl)' THEN 'ISC' WHEN 'mozilla public license 2.0 (mpl 2.0)' THEN 'MPL-2.0' ELSE trim(licence) END) AS licence FROM licences GROUP BY ALL)
SELECT licence, count(*) AS n FROM n GROUP BY licence""")
def licence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.licence_summary(frame(spark, sf_dir, "licences"))


@query(r"""WITH o AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-Za-z0-9_.-]+==') THEN line_no END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_line FROM lock_lines)
SELECT file, at_line AS at, regexp_extract(arg_min(line, line_no), '^([A-Za-z0-9_.-]+)==', 1) AS name, regexp_extract(arg_min(line, line_no), '==([^\s;]+)', 1) AS version,
  coalesce(string_agg(DISTINCT nullif(regexp_extract(line, '--hash=sha256:([0-9a-f]{64})', 1), ''), ',' ORDER BY nullif(regexp_extract(line, '--hash=sha256:([0-9a-f]{64})', 1), '')), '') AS hashes
FROM o WHERE at_line IS NOT NULL GROUP BY file, at_line""")
def lock_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.lock_packages(frame(spark, sf_dir, "lock_lines"))
