"""Approvals, admission, signals, and windowed rates as batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate.operators import approve, signals
from artifactgate.plans.fixtures import FIXTURES, frame
from artifactgate.plans.registry import query, quoted
from artifactgate.streaming import buckets, rates

_ACT = "act AS (SELECT digest, ts, scan_id, verdict = 'PASS' AS approved FROM scans WHERE errors = 0 AND verdict IN ('PASS', 'FAIL', 'BLOCKED'))"
_LAST = f"{_ACT}, l AS (SELECT digest, arg_max(approved, (ts, scan_id)) AS approved, max(ts) AS since FROM act GROUP BY digest)"
_SPANS = f"""{_ACT}, one AS (SELECT digest, ts, arg_max(approved, scan_id) AS approved, max(scan_id) AS scan_id FROM act GROUP BY digest, ts),
c AS (SELECT * FROM (SELECT *, lag(approved) OVER (PARTITION BY digest ORDER BY ts, scan_id) AS b FROM one) WHERE b IS NULL OR b <> approved),
spans AS (SELECT digest, approved, ts AS from_ts, lead(ts) OVER (PARTITION BY digest ORDER BY ts, scan_id) AS to_ts FROM c)"""


@query(f"WITH {_LAST} SELECT digest, since FROM l WHERE approved")
def current_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approve.current_approvals(frame(spark, sf_dir, "scans"))


@query(f"WITH {_SPANS} SELECT digest, approved, from_ts, to_ts FROM spans")
def approval_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approve.approval_intervals(frame(spark, sf_dir, "scans"))


_ASOF = f"WITH {_ACT} SELECT r.uid, r.digest_a AS digest, coalesce(a.approved, false) AS approved FROM (SELECT * FROM requests WHERE digest_a IS NOT NULL) r ASOF LEFT JOIN (SELECT digest, ts, arg_max(approved, scan_id) AS approved FROM act GROUP BY digest, ts) a ON a.digest = r.digest_a AND r.ts >= a.ts"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "requests").where("digest_a IS NOT NULL").select("uid", "ts", F.col("digest_a").alias("digest"))


@query(_ASOF)
def approval_as_of_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approve.state_at(_asked(spark, sf_dir), approve.approval_intervals(frame(spark, sf_dir, "scans"))).select("uid", "digest", "approved")


@query(_ASOF)
def approval_by_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approve.last_state_at(_asked(spark, sf_dir), frame(spark, sf_dir, "scans")).select("uid", "digest", "approved")


@query(f"""WITH {_SPANS}, asked AS (SELECT uid, ts, lower(digest_a) AS digest FROM requests WHERE digest_a IS NOT NULL UNION SELECT uid, ts, lower(digest_b) FROM requests WHERE digest_b IS NOT NULL),
miss AS (SELECT uid, array_to_string(list_sort(list_distinct(list(left(digest, 12)))), ',') AS missing FROM asked a WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.digest = a.digest AND s.approved AND a.ts >= s.from_ts AND (s.to_ts IS NULL OR a.ts < s.to_ts)) GROUP BY uid),
known AS (SELECT min(from_ts) AS since FROM spans WHERE approved),
said AS (SELECT r.uid, CASE WHEN opted_in THEN array_to_string(list_filter([CASE WHEN NOT contains(image, '@sha256:') THEN 'an image is not pinned by digest' END, CASE WHEN upper(verdict) IN ('FAIL', 'BLOCKED') THEN 'the scan verdict is ' || upper(verdict) END,
           CASE WHEN NOT listed AND r.uid IN (SELECT uid FROM asked) THEN 'models are declared but no approved digests are known' END, CASE WHEN listed AND missing IS NOT NULL THEN 'not approved: ' || missing END], lambda x: x IS NOT NULL), '; ') ELSE '' END AS reasons,
           CASE WHEN opted_in AND image IS NULL AND r.uid NOT IN (SELECT uid FROM asked) THEN 'no containers found' ELSE '' END AS warnings
         FROM (SELECT q.*, coalesce(q.ts >= k.since, false) AS listed FROM requests q CROSS JOIN known k) r LEFT JOIN miss m ON m.uid = r.uid)
SELECT uid, reasons = '' AS allowed, reasons, warnings FROM said""")
def admission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods, and controllers with a template of one, with digests in either case."""
    rows = frame(spark, sf_dir, "requests")
    metadata = F.struct(F.create_map(F.lit("gate"), F.when(F.col("opted_in"), "True").otherwise("off")).alias("labels"), F.create_map(F.lit("verdict"), F.col("verdict"), F.lit("models"), F.concat_ws(" , ", F.concat(F.lit("sha256:"), "digest_a"), "digest_b")).alias("annotations"))
    spec = F.struct(F.array(F.struct("image")).alias("containers"))
    body = F.when(F.col("pod"), F.to_json(F.struct(F.lit("Pod").alias("kind"), metadata.alias("metadata"), spec.alias("spec")))).otherwise(
        F.to_json(F.struct(F.lit("Deployment").alias("kind"), F.struct(F.struct(metadata.alias("metadata"), spec.alias("spec")).alias("template")).alias("spec")))
    )
    return approve.decided(approve.parsed(rows.select("uid", "ts", body.alias("object"))), approve.approval_intervals(frame(spark, sf_dir, "scans")))


@query("SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'k:' || left(sha256(CAST(user_id AS VARCHAR)), 16) ELSE 'ip:10.0.0.' || CAST(user_id % 9 AS VARCHAR) END AS client FROM events")
def client_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from artifactgate.functions.text import client_id

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("id"), client_id(F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")), F.concat(F.lit("10.0.0."), (F.col("user_id") % 9).cast("string"))).alias("client"))


@query("SELECT uid, repo FROM (SELECT uid, concat('org', CAST(event_id % 13 AS VARCHAR), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/model' ELSE '-other/model' END) AS repo FROM requests) WHERE repo IN ('org1', 'org7/model') OR starts_with(repo, 'org1/') OR starts_with(repo, 'org7/model/')")
def allowed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame([("org1",), ("org7/model",)], "prefix string")
    rows = frame(spark, sf_dir, "requests").selectExpr("uid", "concat('org', CAST(event_id % 13 AS STRING), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/model' ELSE '-other/model' END) AS repo")
    return approve.allowed_repos(rows, prefixes)


@query("SELECT DISTINCT sha256 AS digest FROM files WHERE doc_id % 4 <> 3")
def digest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("sha256:"), F.upper("sha256"), F.lit("  # note"))).when(F.col("doc_id") % 4 == 3, F.concat(F.lit("# "), "sha256")).otherwise(F.concat(F.lit("  "), "sha256"))
    return approve.parse_digests(frame(spark, sf_dir, "files").select(line.alias("value")))


@query("SELECT 'sha256:' || sha256 || '  # ' || left(regexp_replace('note é ' || sha256 || sha256, '[^\\x20-\\x7e]', '', 'g'), 120) AS value FROM deny_hashes")
def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "deny_hashes").select(F.col("sha256").alias("digest"))
    return approve.rendered(rows, F.concat(F.lit("note é "), "digest", "digest"))


# --- signals --------------------------------------------------------------------


_REPO = "concat(source, '/', CAST(doc_id - doc_id % 300 AS STRING))"


@query(f"""WITH i AS (SELECT {_REPO} AS repo_id, doc_id, row_number() OVER (PARTITION BY {_REPO} ORDER BY doc_id) AS k, [' Malicious', 'suspicious', 'unsafe', 'DANGEROUS', 'error', 'blocked', NULL][1 + doc_id % 7] AS level FROM documents),
l AS (SELECT *, coalesce(lower(trim(level)), '') IN ('unsafe', 'malicious', 'dangerous', 'blocked') AS bad FROM i)
SELECT repo_id, CASE WHEN bad THEN 'HF_UPSTREAM_UNSAFE' ELSE 'HF_UPSTREAM_SUSPICIOUS' END AS rule_id, CASE WHEN bad THEN 3 ELSE 2 END AS severity, 'f' || CAST(doc_id AS VARCHAR) AS path FROM l WHERE k <= 10
UNION ALL SELECT repo_id, 'HF_UPSTREAM_UNSAFE', 3, '+' || CAST(count(*) - 10 AS VARCHAR) FROM i GROUP BY repo_id HAVING count(*) > 10
UNION ALL SELECT repo_id, 'SIGNAL_UNAVAILABLE', 1, NULL FROM i GROUP BY repo_id HAVING min(doc_id) % 3 = 1""")
def upstream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict bodies of repositories of at most 300 files each, over all documents."""
    level = F.element_at(F.array(*map(F.lit, [" Malicious", "suspicious", "unsafe", "DANGEROUS", "error", "blocked", None])), (F.col("doc_id") % 7 + 1).cast("int"))
    issue = F.struct("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), level.alias("level"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bodies = docs.groupBy(F.expr(_REPO).alias("repo_id")).agg(F.array_sort(F.collect_list(issue)).alias("filesWithIssues"), F.min("doc_id").alias("least"))
    # scansDone is absent, false or true; only false is a gap.
    done = F.when(F.col("least") % 3 == 1, False).when(F.col("least") % 3 == 2, True)
    return signals.upstream_findings(bodies.select("repo_id", F.to_json(F.struct(done.alias("scansDone"), "filesWithIssues")).alias("body")), cap=10)


@query("SELECT source AS repo_id, 'f' || CAST(doc_id % 50 AS VARCHAR) AS path, array_to_string(list_sort(list_distinct(list('scanner-' || CAST(doc_id % 3 AS VARCHAR)))), ',') AS scanners FROM documents WHERE doc_id % 4 IN (1, 3) GROUP BY ALL")
def flagging_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("source AS repo_id", "concat('f', CAST(doc_id % 50 AS STRING)) AS path", "concat('scanner-', CAST(doc_id % 3 AS STRING)) AS scanner", "element_at(array('safe', 'unsafe', 'queued', 'Suspicious'), CAST(doc_id % 4 + 1 AS INT)) AS status")
    return signals.flagged_by(rows)


#: Status blobs of four shapes, with OWN for a document's words and STATUS for its status.
_BLOBS = [
    '{"avScan":{"status":"STATUS","message":"OWN"},"status":"unsafe"}',
    '{"protectAi":[{"report":{"fileStatus":"STATUS"}},{"status":"Safe ","note":"OWN"}],"n":{"status":5}}',
    '{"x":{"y":{"virusStatus":"STATUS","detail":{"status":{"deep_status":"bad"}}}},"OWN":{"state":"bad"}}',
    '[{"scan":{"STATUS_OF":{"Status":["STATUS",{"status":"STATUS"}]}}},"OWN"]',
]
FIXTURES["blobs"] = lambda d: f"""
        SELECT source AS repo_id, concat('f', CAST(doc_id AS STRING)) AS path, doc_id, doc_id % 3 AS good,
               replace(replace(CASE doc_id % 4 {" ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(_BLOBS))} END, '"STATUS"', CASE doc_id % 3 WHEN 0 THEN '"innocuous"' WHEN 1 THEN '" Queued"' ELSE '"Suspicious"' END),
                       'OWN', lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', ' '{d.everywhere}))) AS body
        FROM {d.table("documents")}"""


@query("""WITH s AS (SELECT repo_id, path, good, unnest(CASE doc_id % 4 WHEN 0 THEN ['avScan'] WHEN 1 THEN ['protectAi[0]', 'protectAi[1]'] WHEN 2 THEN ['x', 'x!'] ELSE ['[0]'] END) AS scanner FROM blobs)
SELECT repo_id, path, rtrim(scanner, '!') AS scanner, CASE WHEN scanner = 'protectAi[1]' THEN 'safe' WHEN scanner = 'x!' THEN 'bad' ELSE CASE good WHEN 0 THEN 'innocuous' WHEN 1 THEN 'queued' ELSE 'suspicious' END END AS status FROM s""")
def upstream_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of upstream scanners in blobs whose shape nobody promises."""
    return signals.upstream_statuses(frame(spark, sf_dir, "blobs"))


@query("""SELECT repo_id, path, CASE doc_id % 4 WHEN 0 THEN 'avScan' WHEN 1 THEN 'protectAi[0]' WHEN 2 THEN 'x' ELSE '[0]' END AS scanners FROM blobs WHERE good = 2 OR doc_id % 4 = 2""")
def upstream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanners that flag a file, from its blob."""
    return signals.flagged_by(signals.upstream_statuses(frame(spark, sf_dir, "blobs")))


@query("SELECT repo_id, CASE WHEN n % 3 = 0 THEN 'CARD_MISSING' ELSE 'CARD_NO_EVALUATION' END AS rule_id FROM (SELECT 'm' || CAST(p_partkey AS VARCHAR) AS repo_id, p_partkey AS n FROM part) WHERE n % 3 <> 1")
def card_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('m', CAST(p_partkey AS STRING)) AS repo_id", "p_partkey AS n")
    cards = part.where("n % 3 <> 0").selectExpr("repo_id", """CASE WHEN n % 3 = 1 THEN '{"model-index":[{"results":[{"metric":"a"}]}]}' ELSE '{"model-index":[{"results":[]}]}' END AS body""")
    return signals.missing_cards(part.select("repo_id"), cards)


@query("SELECT target_id, rule_id, severity, source FROM (SELECT target_id, 'SIGNAL_UNAVAILABLE' AS rule_id, 1 AS severity, 'broken' AS source FROM targets UNION ALL SELECT target_id, 'SIGNATURE_NOTE', 0, 'notes' FROM targets WHERE signature_status = 'unsigned')")
def collected_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def broken(targets: DataFrame) -> DataFrame:
        raise RuntimeError("not reachable")

    notes = lambda t: t.where("signature_status = 'unsigned'").select("target_id", F.lit("SIGNATURE_NOTE").alias("rule_id"), F.lit(0).alias("severity"))
    return signals.collected(frame(spark, sf_dir, "targets"), {"broken": broken, "notes": notes, "off": notes}, {"broken", "notes"})


@query("""SELECT 'ID-' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'CVE-' || CAST(p_partkey AS VARCHAR) ELSE 'ID-' || CAST(p_partkey AS VARCHAR) END AS cve, CASE WHEN p_partkey % 3 = 0 THEN 'cwe CWE-502' ELSE 'word deserialization,pickle' END AS reason FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 2""")
def relevant_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "concat('ID-', CAST(p_partkey AS STRING)) AS id", "CASE WHEN p_partkey % 2 = 0 THEN array('GHSA-x', concat('CVE-', CAST(p_partkey AS STRING))) ELSE array('GHSA-x') END AS aliases",
        "CASE WHEN p_partkey % 3 = 1 THEN 'Pickle issue' ELSE 'other' END AS summary", "concat(CASE WHEN p_partkey % 3 = 1 THEN 'unsafe Deserialization' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ' denial of service' ELSE '' END) AS details", "CASE WHEN p_partkey % 3 = 0 THEN array('CWE-502', 'CWE-1') ELSE array('CWE-2') END AS cwe_ids",
    )
    return signals.relevant(rows, ["pickle", "deserialization"], ["denial of service"], ["CWE-502", "CWE-94"])


# --- batch twins of the streams -------------------------------------------------


@query("SELECT date_trunc('minute', ts) AS minute, verdict AS value, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(errors) AS BIGINT) AS errors FROM scans GROUP BY ALL")
def verdicts_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.per_minute(frame(spark, sf_dir, "scans"))


_RATIO = """SELECT m - to_minutes(CAST(k AS BIGINT)) AS from_ts, CAST(sum(n) AS BIGINT) AS total, round(sum(b) / sum(n), 9) AS ratio FROM (SELECT date_trunc('minute', ts) AS m, count(*) AS n, count(*) FILTER (verdict IN ('FAIL', 'BLOCKED')) AS b FROM scans GROUP BY m), range(0, 15) r(k) GROUP BY from_ts"""


@query(_RATIO)
def block_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.block_ratio_from_minutes(frame(spark, sf_dir, "scans"))


@query(_RATIO)
def sliding_block_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.block_ratio(frame(spark, sf_dir, "scans"))


FIXTURES["outcomes"] = lambda d: """SELECT ts, errors, CASE WHEN scan_id % 6 = 5 THEN 'REJECTED' ELSE verdict END AS verdict, CASE WHEN scan_id % 6 <> 5 THEN status WHEN scan_id % 4 = 1 THEN 'capacity' WHEN scan_id % 8 = 3 THEN 'rate' ELSE 'auth' END AS status FROM scans"""


@query("""WITH s AS (SELECT ts, 'errors' AS alert, 5 AS m, 0 AS over FROM outcomes WHERE errors > 0 UNION ALL SELECT ts, 'blocks', 15, 3 FROM outcomes WHERE verdict = 'BLOCKED'
  UNION ALL SELECT ts, 'capacity_rejects', 10, 0 FROM outcomes WHERE verdict = 'REJECTED' AND status IN ('capacity', 'rate') UNION ALL SELECT ts, 'auth_rejects', 5, 10 FROM outcomes WHERE verdict = 'REJECTED' AND status = 'auth')
SELECT alert, time_bucket(to_minutes(CAST(m AS BIGINT)), ts) AS from_ts, count(*) AS n FROM s GROUP BY alert, m, over, from_ts HAVING count(*) > over""")
def scan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.alerts(frame(spark, sf_dir, "outcomes"))


@query("WITH h AS (SELECT DISTINCT time_bucket(INTERVAL 10 MINUTES, ts) AS w FROM scans) SELECT unnest(generate_series((SELECT min(w) FROM h), (SELECT max(w) FROM h), INTERVAL 10 MINUTES)) AS from_ts EXCEPT SELECT w FROM h")
def silent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.silent_windows(frame(spark, sf_dir, "scans"))


@query("SELECT DISTINCT scan_id, ts, verdict FROM scans")
def deliveries_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = frame(spark, sf_dir, "scans")
    return rates.once(scans.unionByName(scans.where("scan_id % 3 = 0"))).select("scan_id", "ts", "verdict")


@query(f"WITH {_LAST} SELECT uid, coalesce((SELECT approved FROM l WHERE l.digest = r.digest_a), false) AS admitted FROM requests r")
def admitted_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = frame(spark, sf_dir, "requests").select("uid", F.col("digest_a").alias("digest"))
    return rates.admitted(asked, approve.current_approvals(frame(spark, sf_dir, "scans")))


FIXTURES["calls_of_clients"] = lambda d: f"SELECT CAST(user_id AS STRING) AS client, ts, event_id FROM {d.table('events')}"


@query("""WITH o AS (SELECT client, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS n FROM calls_of_clients),
r AS (SELECT client, ts, n, t, 1.0::DOUBLE AS left_over, true AS ok FROM o WHERE n = 1
  UNION ALL SELECT o.client, o.ts, o.n, o.t, least(2.0, r.left_over + (o.t - r.t) / 30) - CASE WHEN least(2.0, r.left_over + (o.t - r.t) / 30) >= 1 THEN 1 ELSE 0 END, least(2.0, r.left_over + (o.t - r.t) / 30) >= 1 FROM r JOIN o ON o.client = r.client AND o.n = r.n + 1)
SELECT client, ts, ok AS allowed, CASE WHEN ok THEN 0.0 ELSE round((1 - left_over) * 30, 3) END AS retry_after FROM r""", recursive=True)
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.limited(frame(spark, sf_dir, "calls_of_clients"), per_minute=2).withColumn("retry_after", F.round("retry_after", 3))


FIXTURES["approved_list"] = lambda d: f"SELECT DISTINCT upper({d.sha('CAST(user_id AS STRING)')}) AS digest FROM {d.table('events')} WHERE event_type = 'purchase'"
FIXTURES["revoked_list"] = lambda d: f"SELECT {d.sha('CAST(user_id AS STRING)')} AS digest FROM {d.table('events')} WHERE event_type = 'error'"


@query(f"WITH {_LAST} SELECT digest FROM (SELECT digest FROM l WHERE approved UNION SELECT lower(digest) FROM approved_list) WHERE digest NOT IN (SELECT digest FROM revoked_list)")
def changed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is approved after a list of approvals and one of revocations."""
    return approve.changed_digests(approve.current_approvals(frame(spark, sf_dir, "scans")), frame(spark, sf_dir, "approved_list"), frame(spark, sf_dir, "revoked_list"))
