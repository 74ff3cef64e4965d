"""Signatures: manifests against files, keys against time, and one status a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.functions.dates import iso_time


def manifest_diff(actual: DataFrame, signed: DataFrame) -> DataFrame:
    """(target_id, path, change): what was changed, added or removed since signing."""
    a, s = actual.select("target_id", "path", F.col("sha256").alias("now")), signed.select("target_id", "path", F.col("sha256").alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return a.join(s, ["target_id", "path"], "full_outer").select("target_id", "path", change.alias("change")).where("change IS NOT NULL")


def signature_status(targets: DataFrame, signatures: DataFrame, store: DataFrame, diff: DataFrame, as_of: str) -> DataFrame:
    """(target_id, status), tests in fixed order. Where a column ``available`` says that a signature could not be checked, it is unavailable. A time may be given as ISO text; a signature without one that can be read counts as made at ``as_of``."""
    if signatures.schema["created"].dataType.typeName() == "string":
        signatures = signatures.withColumn("created", iso_time(F.col("created")))
    if "available" not in signatures.columns:
        signatures = signatures.withColumn("available", F.lit(True))
    broken = diff.groupBy("target_id").agg(F.count("*").alias("changes"))
    known = targets.select("target_id").join(signatures, "target_id", "left").join(store, "key_id", "left").join(broken, "target_id", "left")
    at = F.coalesce("created", F.lit(as_of).cast("timestamp"))
    status = (
        F.when(F.col("key_id").isNull(), "unsigned")
        .when(~F.col("available"), "unavailable")
        .when(F.col("algorithm") != "ed25519", "invalid")
        .when(F.col("publisher").isNull(), "untrusted")
        .when(F.col("revoked"), "revoked")
        .when((at < F.col("not_before")) | (at > F.col("not_after")), "expired")
        .when(F.col("changes") > 0, "invalid")
        .when(~F.col("sig_valid"), "invalid")
        .otherwise("verified")
    )
    return known.select("target_id", status.alias("status"))


def identity_status(targets: DataFrame, bundles: DataFrame) -> DataFrame:
    """(target_id, status) of (target_id, available, identity, verified) bundles that bind a signer's identity: a target without one is unsigned."""
    known = targets.select("target_id").join(bundles.withColumn("bundled", F.lit(True)), "target_id", "left")
    status = F.when(F.col("bundled").isNull(), "unsigned").when(~F.col("available"), "unavailable").when(~F.col("verified"), "invalid").when(F.col("identity").isNull(), "untrusted").otherwise("verified")
    return known.select("target_id", status.alias("status"))


def status_findings(status: DataFrame, prefix: str = "SIGNATURE") -> DataFrame:
    """(target_id, rule_id, severity) of statuses of keys (prefix SIGNATURE) or identities (prefix SIGSTORE): none for verified and unsigned."""
    severity = F.when(F.col("status").isin("invalid", "revoked"), rules.HIGH).when(F.col("status") == "unavailable", rules.LOW).when(~F.col("status").isin("verified", "unsigned"), rules.MEDIUM)
    return status.select("target_id", F.concat(F.lit(f"{prefix}_"), F.upper("status")).alias("rule_id"), severity.alias("severity")).where("severity IS NOT NULL")
