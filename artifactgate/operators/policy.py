"""Provenance, policies and verdicts, for many policies at once.

Policies and their lists are small tables of the user's own; targets and
findings are large. Findings are counted by target, rule and severity before
they meet the policies, so the work grows with distinct rules, not findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.functions import text as fn


def known_origins(bundled: DataFrame, user: DataFrame) -> DataFrame:
    """(publisher, country): the user's rows over the bundled ones."""
    own = lambda df, c: df.select(F.lower("publisher").alias("publisher"), F.upper("country").alias(c))
    return own(bundled, "old").join(own(user, "new"), "publisher", "full_outer").select("publisher", F.coalesce("new", "old").alias("country"))


def provenance(targets: DataFrame, origins: DataFrame) -> DataFrame:
    """Adds publisher, origin, source and verified.

    A verified signature is authoritative: publisher and origin are those of the
    trust store's key (signed_publisher, signed_origin), known or not, whatever
    the target says of itself. Otherwise a claim counts, then a sidecar, then the database.
    """
    signed = F.col("signature_status") == "verified"
    owner = F.substring_index("repo_id", "/", 1)
    publisher = F.when(signed, F.col("signed_publisher")).when(F.col("claimed_origin").isNotNull(), owner).otherwise(F.coalesce(F.col("sidecar_publisher"), owner))
    found = targets.withColumn("publisher", F.lower(publisher)).join(origins.withColumnRenamed("country", "db_origin"), "publisher", "left")
    steps = [(signed, F.upper("signed_origin"), "signed"), (F.col("claimed_origin").isNotNull(), F.upper("claimed_origin"), "explicit"), (F.col("sidecar_origin").isNotNull(), F.upper("sidecar_origin"), "sidecar"), (F.col("db_origin").isNotNull(), F.col("db_origin"), "database")]
    origin, source = F.lit(None).cast("string"), F.lit("unknown")
    for test, value, label in reversed(steps):
        origin, source = F.when(test, value).otherwise(origin), F.when(test, F.lit(label)).otherwise(source)
    return found.withColumn("origin", origin).withColumn("origin_source", source).withColumn("verified", signed).drop("db_origin")


def with_globs(policies: DataFrame) -> DataFrame:
    """Policies whose glob lists are also there as Java patterns, in arrays of (glob, pattern)."""
    spark = policies.sparkSession
    lists = ["issuers", "identities", "models", "deny_publishers", "deny_models"]
    # The user's patterns: as many rows as policies.
    rows = [(r["name"], *([(g, fn.glob_regex(g)) for g in r[c]] for c in lists)) for r in policies.select("name", *lists).collect()]
    kind = "array<struct<glob:string,pattern:string>>"
    return policies.drop(*lists).join(F.broadcast(spark.createDataFrame(rows, "name string, " + ", ".join(f"{c} {kind}" for c in lists))), "name")


def matched_globs(values: Column, globs: Column) -> Column:
    """The sorted globs that any of ``values`` matches."""
    return F.array_sort(F.transform(F.filter(globs, lambda g: F.exists(values, lambda v: fn.glob_match(v, g["pattern"]))), lambda g: g["glob"]))


def policy_findings(targets: DataFrame, files: DataFrame, policies: DataFrame, deny_hashes: DataFrame) -> DataFrame:
    """(policy, target_id, path, rule_id, severity, blocks): what the policies say about targets and files.

    policies: as ``with_globs`` returns them.
    """
    both = targets.crossJoin(F.broadcast(policies.withColumnRenamed("name", "policy"))).withColumn("names", fn.model_names(F.col("repo_id"), F.col("target")))
    c = F.col
    known, publisher = c("origin").isNotNull(), F.lower("publisher")
    listed = lambda x, y: F.array_contains(y, x)
    any_of = lambda x, globs: F.coalesce(F.size(matched_globs(F.array(x), globs)) > 0, F.lit(False)) & x.isNotNull()
    allowed = F.when(c("identity_mode") == "allowlist", ((F.size("issuers") == 0) | any_of(c("identity_issuer"), c("issuers"))) & ((F.size("identities") == 0) | any_of(c("identity"), c("identities")))).otherwise(
        ~(any_of(c("identity_issuer"), c("issuers")) | any_of(c("identity"), c("identities")))
    )
    model = F.size(matched_globs(c("names"), c("models"))) > 0
    has_publisher = publisher.isNotNull() & (publisher != "")
    blocked_publisher = has_publisher & listed(publisher, c("publishers_blocked"))
    checks = [
        (c("require_signed") & ~c("verified"), "POLICY_SIGNATURE_REQUIRED", rules.CRITICAL, True),
        ((c("identity_mode") != "off") & (c("identity").isNotNull() | c("identity_issuer").isNotNull()) & ~allowed, "POLICY_IDENTITY_BLOCKED", rules.HIGH, True),
        ((c("origin_mode") != "off") & ~known & (c("unknown_origin") == "deny"), "POLICY_ORIGIN_UNKNOWN", rules.HIGH, True),
        ((c("origin_mode") != "off") & ~known & (c("unknown_origin") == "warn"), "POLICY_ORIGIN_UNKNOWN", rules.MEDIUM, False),
        (known & (((c("origin_mode") == "blocklist") & listed(c("origin"), c("countries"))) | ((c("origin_mode") == "allowlist") & ~listed(c("origin"), c("countries")))), "POLICY_ORIGIN_BLOCKED", rules.CRITICAL, True),
        (blocked_publisher, "POLICY_PUBLISHER_BLOCKED", rules.CRITICAL, True),
        (has_publisher & ~blocked_publisher & (F.size("publishers_allowed") > 0) & ~listed(publisher, c("publishers_allowed")), "POLICY_PUBLISHER_NOT_ALLOWED", rules.CRITICAL, True),
        ((c("models_mode") == "blocklist") & model, "POLICY_MODEL_BLOCKED", rules.CRITICAL, True),
        ((c("models_mode") == "allowlist") & ~model, "POLICY_MODEL_NOT_ALLOWED", rules.CRITICAL, True),
        (has_publisher & any_of(publisher, c("deny_publishers")), "POLICY_DENYLIST_PUBLISHER", rules.CRITICAL, True),
        (F.size(matched_globs(c("names"), c("deny_models"))) > 0, "POLICY_DENYLIST_MODEL", rules.CRITICAL, True),
    ]
    kind = "array<struct<rule_id:string,severity:int,blocks:boolean>>"
    said = lambda checks: F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(b).alias("blocks"))) for t, r, s, b in checks))).cast(kind)).alias("f")
    of_targets = both.select("policy", "target_id", F.lit(None).cast("string").alias("path"), said(checks)).select("policy", "target_id", "path", "f.*")
    # A file meets policies only where a check could fire: known-bad content for all, format and size by policy.
    bad = files.join(deny_hashes.select(F.lower("sha256").alias("sha256")).distinct(), "sha256", "left_semi").select("target_id", "path")
    of_bad = bad.crossJoin(F.broadcast(policies.select(F.col("name").alias("policy")))).select("policy", "target_id", "path", F.lit("POLICY_DENYLIST_HASH").alias("rule_id"), F.lit(rules.CRITICAL).alias("severity"), F.lit(True).alias("blocks"))
    limits = policies.where("formats_mode <> 'off' OR max_file_size_mb > 0").select(F.col("name").alias("policy"), "formats_mode", "formats", "max_file_size_mb")
    fmt = F.lower("format")
    file_checks = [
        (~fmt.isin(rules.FORMAT_EXEMPT) & (((c("formats_mode") == "blocklist") & listed(fmt, c("formats"))) | ((c("formats_mode") == "allowlist") & ~listed(fmt, c("formats")))), "POLICY_FORMAT_BLOCKED", rules.CRITICAL, True),
        ((c("max_file_size_mb") > 0) & (c("size") > c("max_file_size_mb").cast("bigint") * (1 << 20)), "POLICY_FILE_TOO_LARGE", rules.MEDIUM, False),
    ]
    of_files = files.crossJoin(F.broadcast(limits)).select("policy", "target_id", "path", said(file_checks)).select("policy", "target_id", "path", "f.*")
    return of_targets.unionByName(of_bad).unionByName(of_files)


def overridden(findings: DataFrame, policies: DataFrame, overrides: DataFrame) -> DataFrame:
    """(policy, target_id, rule_id, severity, n, blocks, downgraded): content findings, counted, after each policy's rule overrides."""
    counted = findings.groupBy("target_id", F.upper("rule_id").alias("rule_id"), "severity").agg(F.count("*").alias("n"))
    each = counted.crossJoin(F.broadcast(policies.select(F.col("name").alias("policy"), "fail_on")))
    last = overrides.select(F.col("name").alias("policy"), F.upper("rule_id").alias("rule_id"), "action")
    found = each.join(F.broadcast(last), ["policy", "rule_id"], "left").where("action IS NULL OR action <> 'ignore'")
    down = F.coalesce((F.col("action") == "warn") & (F.col("severity") >= F.col("fail_on")), F.lit(False))
    return found.select("policy", "target_id", "rule_id", F.when(down, rules.LOW).otherwise(F.col("severity")).alias("severity"), "n", F.coalesce(F.col("action") == "deny", F.lit(False)).alias("blocks"), down.alias("downgraded"))


def verdicts(targets: DataFrame, policies: DataFrame, of_policy: DataFrame, effective: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(policy, target_id, verdict, n_findings, n_policy_findings, max_severity): policy findings block or warn, but never fail.

    existing: (target_id) of the targets that are there; any other is an ERROR, whatever policies say of it.
    """
    a = of_policy.groupBy("policy", "target_id").agg(F.bool_or("blocks").alias("blocked"), F.count("*").alias("n_policy_findings"))
    b = effective.groupBy("policy", "target_id").agg(F.bool_or("blocks").alias("denied"), F.sum("n").alias("n_findings"), F.max("severity").alias("max_severity"))
    each = targets.select("target_id").crossJoin(F.broadcast(policies.select(F.col("name").alias("policy"), "fail_on")))
    all_ = each.join(a, ["policy", "target_id"], "left").join(b, ["policy", "target_id"], "left")
    there = F.lit(True)
    if existing is not None:
        all_ = all_.join(existing.select("target_id").distinct().withColumn("exists", F.lit(True)), "target_id", "left")
        there = F.coalesce("exists", F.lit(False))
    verdict = (
        F.when(~there, "ERROR")
        .when(F.coalesce("blocked", F.lit(False)) | F.coalesce("denied", F.lit(False)), "BLOCKED")
        .when(F.col("max_severity") >= F.col("fail_on"), "FAIL")
        .when((F.coalesce("n_findings", F.lit(0)) + F.coalesce("n_policy_findings", F.lit(0))) > 0, "WARN")
        .otherwise("PASS")
    )
    return all_.select("policy", "target_id", verdict.alias("verdict"), F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"), F.coalesce("n_policy_findings", F.lit(0)).cast("bigint").alias("n_policy_findings"), "max_severity")
