"""From artifacts to indicators, policy findings and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.functions import text as fn
from artifactgate.operators import indicators, policy
from artifactgate.plans.fixtures import FIXTURES, frame
from artifactgate.plans.registry import query, quoted

_RUNS = r"""runs AS (
  SELECT target_id, path, CAST(i - 1 AS INT) AS run_no, r[i] AS run FROM (SELECT target_id, path, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT target_id, path, regexp_extract_all(text, '[\x20-\x7e]{8,}') AS r FROM text_artifacts)))"""

_HOST = r"lower(regexp_extract(m, '(?i)^[a-z]+://([^/:]+)', 1))"
_BENIGN = "(" + " OR ".join(f"{_HOST} = {quoted(h)} OR ends_with({_HOST}, {quoted('.' + h)})" for h in rules.BENIGN_HOSTS) + ")"


def _all_matches() -> str:
    """SQL: every match of every rule, by its number in the scan."""
    parts, n = [], 0

    def part(rule, label, pattern, severity, chars, test="true", gate="true", labelled=False):
        nonlocal n
        key = f"left(m, {chars})"
        key = f"{quoted(label + ':')} || {key}" if labelled else key
        inner = f"SELECT target_id, path, run_no, unnest(range(1, len(l) + 1)) AS j, l FROM (SELECT target_id, path, run_no, regexp_extract_all(run, {quoted(pattern)}) AS l FROM gated WHERE {gate})"
        if test != "true":
            inner = f"SELECT target_id, path, run_no, unnest(range(1, len(l) + 1)) AS j, l FROM (SELECT target_id, path, run_no, list_filter(regexp_extract_all(run, {quoted(pattern)}), lambda m: {test}) AS l FROM gated WHERE {gate})"
        parts.append(f"SELECT target_id, path, run_no, {n} AS rule_no, j AS match_no, {quoted(rule)} AS rule_id, {severity} AS severity, {key} AS key, left(m, 200) AS match FROM (SELECT *, l[j] AS m FROM ({inner}))")
        n += 1

    for label, p, _ in rules.WEBHOOKS:
        part("EXFIL_WEBHOOK", label, p, rules.CRITICAL, 120)
    part("EXFIL_URL", "url", rules.URL, rules.MEDIUM, 120, f"NOT {_BENIGN}")
    part("EXFIL_IP_ENDPOINT", "ip", rules.IP_PORT, rules.HIGH, 60, "CAST(string_split(m, ':')[2] AS INT) > 10")
    for label, p, severity, _ in rules.SECRETS:
        part("EXFIL_SECRET", label, p, severity, 64, gate="length(run) >= 14 AND NOT weighty")
    for label, p, severity, _ in rules.CODE:
        part("EXFIL_CODE_INDICATOR", label, p, severity, 60, labelled=True)
    return " UNION ALL ".join(parts)


FINDINGS_SQL = (
    f"WITH {_RUNS}, "
    "gated AS (SELECT *, length(run) >= 64 AND NOT contains(run, ' ') AND list_sum(list_transform(list_distinct(string_split(run, '')), lambda c: -(len(list_filter(string_split(run, ''), lambda x: x = c)) / length(run)) * log2(len(list_filter(string_split(run, ''), lambda x: x = c)) / length(run)))) > 4.5 AS weighty FROM runs), "
    f"matches AS ({_all_matches()}), "
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, path, rule_id, key ORDER BY run_no, rule_no, match_no) AS k FROM matches) WHERE k = 1), "
    "content AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, path ORDER BY run_no, rule_no, match_no) AS rank FROM firsts) WHERE rank <= 500)"
)


@query(f"WITH {_RUNS} SELECT target_id, path, run_no, run FROM runs")
def printable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.runs_of(frame(spark, sf_dir, "text_artifacts"))


@query(f"{FINDINGS_SQL} SELECT target_id, path, rule_id, key, CAST(severity AS INT) AS severity, match, CAST(rank AS INT) AS rank FROM content")
def indicator_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.indicator_findings(frame(spark, sf_dir, "text_artifacts"))


@query(f"{FINDINGS_SQL} SELECT target_id, path, rule_id, key, CAST(max(severity) AS INT) AS severity, count(*) AS n FROM matches GROUP BY ALL")
def windowed_indicator_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches from windows of a file as from the whole, each counted once."""
    return indicators.windowed_findings(frame(spark, sf_dir, "text_artifacts"), window=16_384, overlap=4096)


@query(f"{FINDINGS_SQL} SELECT target_id, path, rule_id, key, CAST(severity AS INT) AS severity, match, CAST(rank AS INT) AS rank FROM content")
def wide_indicator_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in UTF-16 of either byte order give the findings of the plain ones."""
    text = F.col("text")
    wide = F.when(F.length(text) % 2 == 0, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-16BE"))
    return indicators.indicator_findings(frame(spark, sf_dir, "text_artifacts").select("target_id", "path", wide.alias("content")))


@query()
def encoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.encoded_findings(frame(spark, sf_dir, "text_artifacts"))


@query("""WITH h AS (SELECT unnest(regexp_extract_all(text, '\\b(?:[0-9a-fA-F]{2}){32,}\\b')) AS blob, target_id, path FROM text_artifacts)
SELECT DISTINCT target_id, path, blob, decode(unhex(blob)) AS plain FROM h WHERE regexp_matches(decode(unhex(blob)), '^[\\x09\\x0a\\x0d\\x20-\\x7e]+$') AND regexp_matches(decode(unhex(blob)), 'os\\.environ|import |#!/|os\\.system')""")
def hex_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex runs that decode, by built-in functions alone, to script-like text."""
    runs = frame(spark, sf_dir, "text_artifacts").select("target_id", "path", F.explode(F.regexp_extract_all("text", F.lit(rules.HEX), F.lit(0))).alias("blob")).distinct()
    plain = runs.withColumn("plain", F.decode(F.unhex("blob"), "ISO-8859-1"))
    return plain.where(F.col("plain").rlike(r"^[\x09\x0a\x0d\x20-\x7e]+$") & F.col("plain").rlike(r"os\.environ|import |#!/|os\.system"))


@query("SELECT target_id, path, 'SCAN_TRUNCATED' AS rule_id, 2 AS severity, CAST(size AS BIGINT) AS file_bytes, CAST(8388608 AS BIGINT) AS scanned_bytes FROM files WHERE size > 8388608")
def truncated_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.truncated(frame(spark, sf_dir, "files"), 8 << 20)


@query(f"""SELECT url, lower(regexp_extract(url, '(?i)^[a-z]+://([^/:]+)', 1)) AS host, {_BENIGN.replace("(m,", "(url,")} AS benign FROM (SELECT DISTINCT url FROM pages)""")
def benign_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").distinct()
    return urls.select("url", fn.host_of(F.col("url")).alias("host"), fn.is_benign_url(F.col("url")).alias("benign"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS id, path, regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*://') OR starts_with(replace(path, chr(92), '/'), '/') OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') AS escapes
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '../x/' WHEN 1 THEN 'C:' WHEN 2 THEN 'http://h/' WHEN 3 THEN '/abs/' WHEN 4 THEN 'a/..b/' ELSE 'sub/' END || c_name AS path FROM customer)""")
def path_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS BIGINT) AS id", "concat(CASE c_custkey % 7 WHEN 0 THEN '../x/' WHEN 1 THEN 'C:' WHEN 2 THEN 'http://h/' WHEN 3 THEN '/abs/' WHEN 4 THEN 'a/..b/' ELSE 'sub/' END, c_name) AS path")
    return rows.select("id", "path", fn.path_escapes(F.col("path")).alias("escapes"))


@query("SELECT path, sha256 FROM files")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "files").select("path", "doc_id")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return docs.join(texts, "doc_id").select("path", "sha256")


# --- policies -------------------------------------------------------------------


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "policies")
    lists = ["formats", "countries", "publishers_blocked", "publishers_allowed", "issuers", "identities", "models", "deny_publishers", "deny_models"]
    return policy.with_globs(rows.withColumns({c: F.filter(F.split(c, ","), lambda v: v != "") for c in lists}))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = policy.known_origins(frame(spark, sf_dir, "bundled_origins"), frame(spark, sf_dir, "user_origins"))
    return policy.provenance(frame(spark, sf_dir, "targets"), F.broadcast(origins))


_ORIGINS = "origins AS (SELECT coalesce(u.publisher, b.publisher) AS publisher, coalesce(u.country, b.country) AS country FROM bundled_origins b FULL OUTER JOIN user_origins u ON b.publisher = u.publisher)"
_PROVENANCE = f"""{_ORIGINS}, named AS (
  SELECT *, lower(CASE WHEN signature_status = 'verified' THEN signed_publisher WHEN claimed_origin IS NOT NULL THEN string_split(repo_id, '/')[1] ELSE coalesce(sidecar_publisher, string_split(repo_id, '/')[1]) END) AS publisher FROM targets),
known AS (
  SELECT n.*, CASE WHEN signature_status = 'verified' THEN upper(signed_origin) WHEN claimed_origin IS NOT NULL THEN claimed_origin WHEN sidecar_origin IS NOT NULL THEN sidecar_origin ELSE country END AS origin,
         CASE WHEN signature_status = 'verified' THEN 'signed' WHEN claimed_origin IS NOT NULL THEN 'explicit' WHEN sidecar_origin IS NOT NULL THEN 'sidecar' WHEN country IS NOT NULL THEN 'database' ELSE 'unknown' END AS origin_source,
         signature_status = 'verified' AS verified
  FROM named n LEFT JOIN origins o ON n.publisher = o.publisher)"""


@query(f"WITH {_ORIGINS} SELECT publisher, country FROM origins")
def origin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.known_origins(frame(spark, sf_dir, "bundled_origins"), frame(spark, sf_dir, "user_origins"))


@query(f"WITH {_PROVENANCE} SELECT target_id, publisher, origin, origin_source, verified FROM known")
def target_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(spark, sf_dir).select("target_id", "publisher", "origin", "origin_source", "verified")


_POLICY = f"""{_PROVENANCE},
pol AS (SELECT *, {", ".join(f"list_filter(string_split({c}, ','), lambda v: v <> '') AS l_{c}" for c in ("formats", "countries", "publishers_blocked", "publishers_allowed", "issuers", "identities", "models", "deny_publishers", "deny_models"))} FROM policies),
bt AS (SELECT p.*, k.target_id, k.publisher, k.origin, k.verified, k.identity, k.identity_issuer,
              list_distinct([lower(repo_id), lower(string_split(repo_id, '/')[2]), lower(replace(target, 'hf://', '')), lower(string_split(target, '/')[4])]) AS names FROM pol p, known k),
said AS (
  SELECT name AS policy, target_id, NULL AS path, 'POLICY_SIGNATURE_REQUIRED' AS rule_id, 4 AS severity, true AS blocks FROM bt WHERE require_signed AND NOT verified
  UNION ALL SELECT name, target_id, NULL, 'POLICY_IDENTITY_BLOCKED', 3, true FROM bt WHERE identity_mode <> 'off' AND identity IS NOT NULL AND NOT CASE WHEN identity_mode = 'allowlist'
    THEN (len(l_issuers) = 0 OR len(list_filter(l_issuers, lambda g: identity_issuer GLOB g)) > 0) AND (len(l_identities) = 0 OR len(list_filter(l_identities, lambda g: identity GLOB g)) > 0)
    ELSE len(list_filter(l_issuers, lambda g: identity_issuer GLOB g)) = 0 AND len(list_filter(l_identities, lambda g: identity GLOB g)) = 0 END
  UNION ALL SELECT name, target_id, NULL, 'POLICY_ORIGIN_UNKNOWN', CASE unknown_origin WHEN 'deny' THEN 3 ELSE 2 END, unknown_origin = 'deny' FROM bt WHERE origin_mode <> 'off' AND origin IS NULL AND unknown_origin IN ('deny', 'warn')
  UNION ALL SELECT name, target_id, NULL, 'POLICY_ORIGIN_BLOCKED', 4, true FROM bt WHERE origin IS NOT NULL AND ((origin_mode = 'blocklist' AND list_contains(l_countries, origin)) OR (origin_mode = 'allowlist' AND NOT list_contains(l_countries, origin)))
  UNION ALL SELECT name, target_id, NULL, 'POLICY_PUBLISHER_BLOCKED', 4, true FROM bt WHERE list_contains(l_publishers_blocked, publisher)
  UNION ALL SELECT name, target_id, NULL, 'POLICY_PUBLISHER_NOT_ALLOWED', 4, true FROM bt WHERE NOT list_contains(l_publishers_blocked, publisher) AND len(l_publishers_allowed) > 0 AND NOT list_contains(l_publishers_allowed, publisher)
  UNION ALL SELECT name, target_id, NULL, CASE models_mode WHEN 'blocklist' THEN 'POLICY_MODEL_BLOCKED' ELSE 'POLICY_MODEL_NOT_ALLOWED' END, 4, true FROM bt WHERE models_mode <> 'off' AND (len(list_filter(l_models, lambda g: len(list_filter(names, lambda n: n GLOB g)) > 0)) > 0) = (models_mode = 'blocklist')
  UNION ALL SELECT name, target_id, NULL, 'POLICY_DENYLIST_PUBLISHER', 4, true FROM bt WHERE len(list_filter(l_deny_publishers, lambda g: publisher GLOB g)) > 0
  UNION ALL SELECT name, target_id, NULL, 'POLICY_DENYLIST_MODEL', 4, true FROM bt WHERE len(list_filter(l_deny_models, lambda g: len(list_filter(names, lambda n: n GLOB g)) > 0)) > 0
  UNION ALL SELECT name, target_id, path, 'POLICY_DENYLIST_HASH', 4, true FROM pol, files WHERE sha256 IN (SELECT sha256 FROM deny_hashes)
  UNION ALL SELECT name, target_id, path, 'POLICY_FORMAT_BLOCKED', 4, true FROM pol, files WHERE format NOT IN ('unknown', 'archive', 'python_source', 'hf_config') AND ((formats_mode = 'blocklist' AND list_contains(l_formats, format)) OR (formats_mode = 'allowlist' AND NOT list_contains(l_formats, format)))
  UNION ALL SELECT name, target_id, path, 'POLICY_FILE_TOO_LARGE', 2, false FROM pol, files WHERE max_file_size_mb > 0 AND size > max_file_size_mb * 1048576)"""


def said_by_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_findings(provenance(spark, sf_dir), frame(spark, sf_dir, "files"), policies(spark, sf_dir), frame(spark, sf_dir, "deny_hashes"))


@query(f"WITH {_POLICY} SELECT policy, target_id, CAST(path AS VARCHAR) AS path, rule_id, CAST(severity AS INT) AS severity, blocks FROM said")
def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said_by_policies(spark, sf_dir)


@query("SELECT f.target_id, f.path, f.sha256 FROM files f WHERE sha256 IN (SELECT sha256 FROM deny_hashes)")
def hash_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "files").join(frame(spark, sf_dir, "deny_hashes"), "sha256", "left_semi").select("target_id", "path", "sha256")


_OVERRIDDEN = """counted AS (SELECT target_id, rule_id, severity, count(*) AS n FROM {source} GROUP BY ALL),
eff AS (SELECT p.name AS policy, c.target_id, c.rule_id, CASE WHEN action = 'warn' AND severity >= fail_on THEN 1 ELSE severity END AS severity, n, coalesce(action = 'deny', false) AS blocks, coalesce(action = 'warn' AND severity >= fail_on, false) AS downgraded
        FROM counted c CROSS JOIN policies p LEFT JOIN overrides o ON o.name = p.name AND o.rule_id = c.rule_id WHERE action IS NULL OR action <> 'ignore')"""


@query(f"WITH {_OVERRIDDEN.format(source='findings')} SELECT policy, target_id, rule_id, CAST(severity AS INT) AS severity, n, blocks, downgraded FROM eff")
def rule_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.overridden(frame(spark, sf_dir, "findings"), frame(spark, sf_dir, "policies"), frame(spark, sf_dir, "overrides"))


@query(
    f"""{FINDINGS_SQL}, {_POLICY}, {_OVERRIDDEN.format(source="content")},
v AS (SELECT p.name AS policy, t.target_id, fail_on, (SELECT bool_or(blocks) FROM said s WHERE s.policy = p.name AND s.target_id = t.target_id) AS b1, (SELECT bool_or(blocks) FROM eff e WHERE e.policy = p.name AND e.target_id = t.target_id) AS b2,
             (SELECT sum(n) FROM eff e WHERE e.policy = p.name AND e.target_id = t.target_id) AS nf, (SELECT count(*) FROM said s WHERE s.policy = p.name AND s.target_id = t.target_id) AS np, (SELECT max(severity) FROM eff e WHERE e.policy = p.name AND e.target_id = t.target_id) AS ms
      FROM policies p CROSS JOIN targets t)
SELECT policy, target_id, CASE WHEN coalesce(b1, false) OR coalesce(b2, false) THEN 'BLOCKED' WHEN ms >= fail_on THEN 'FAIL' WHEN coalesce(nf, 0) + np > 0 THEN 'WARN' ELSE 'PASS' END AS verdict, CAST(coalesce(nf, 0) AS BIGINT) AS n_findings, np AS n_policy_findings, CAST(ms AS INT) AS max_severity FROM v"""
)
def fleet_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts to indicators, provenance, policies, overrides and one verdict per target and policy."""
    rules_of = frame(spark, sf_dir, "policies")
    effective = policy.overridden(indicators.indicator_findings(frame(spark, sf_dir, "text_artifacts")), rules_of, frame(spark, sf_dir, "overrides"))
    return policy.verdicts(frame(spark, sf_dir, "targets"), rules_of, said_by_policies(spark, sf_dir), effective)


FIXTURES["asked"] = lambda d: f"SELECT source AS target_id FROM {d.table('documents')} GROUP BY source UNION ALL SELECT concat('missing/', n_name) AS target_id FROM {d.table('nation')}"


@query(
    f"""WITH {_POLICY}, {_OVERRIDDEN.format(source="findings")},
b AS (SELECT policy, target_id, bool_or(blocks) AS blocks, count(*) AS n FROM said GROUP BY ALL), e AS (SELECT policy, target_id, bool_or(blocks) AS blocks, sum(n) AS n, max(severity) AS ms FROM eff GROUP BY ALL)
SELECT p.name AS policy, t.target_id, CASE WHEN t.target_id NOT IN (SELECT target_id FROM files) THEN 'ERROR' WHEN coalesce(b.blocks, false) OR coalesce(e.blocks, false) THEN 'BLOCKED' WHEN ms >= fail_on THEN 'FAIL' WHEN coalesce(b.n, 0) + coalesce(e.n, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM policies p CROSS JOIN asked t LEFT JOIN b ON b.policy = p.name AND b.target_id = t.target_id LEFT JOIN e ON e.policy = p.name AND e.target_id = t.target_id"""
)
def asked_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of targets that somebody asks for, some of which are not there."""
    rules_of = frame(spark, sf_dir, "policies")
    effective = policy.overridden(frame(spark, sf_dir, "findings"), rules_of, frame(spark, sf_dir, "overrides"))
    out = policy.verdicts(frame(spark, sf_dir, "asked"), rules_of, said_by_policies(spark, sf_dir), effective, frame(spark, sf_dir, "files"))
    return out.select("policy", "target_id", "verdict")
