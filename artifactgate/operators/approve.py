"""Approvals from scans, and admission of deploy requests against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def acting(scans: DataFrame, approving: tuple[str, ...] = ("PASS",)) -> DataFrame:
    """(digest, ts, scan_id, approved): scans that change a digest's state; others leave it as it is."""
    acts = F.when(F.col("verdict").isin(*approving), True).when(F.col("verdict").isin("FAIL", "BLOCKED"), False)
    return scans.where("errors = 0").select("digest", "ts", "scan_id", acts.alias("approved")).where("approved IS NOT NULL")


def current_approvals(scans: DataFrame, approving: tuple[str, ...] = ("PASS",)) -> DataFrame:
    """(digest, since) of the digests whose last acting scan approved them; a max per digest, combined before the shuffle."""
    last = acting(scans, approving).groupBy("digest").agg(F.max(F.struct("ts", "scan_id", "approved")).alias("l"))
    return last.where("l.approved").select("digest", F.col("l.ts").alias("since"))


def upserted(current: DataFrame, batch: DataFrame) -> DataFrame:
    """(digest, ts, scan_id, approved): the last state of each digest of both."""
    return current.unionByName(batch).groupBy("digest").agg(F.max(F.struct("ts", "scan_id", "approved")).alias("l")).select("digest", "l.*")


def approval_intervals(scans: DataFrame, approving: tuple[str, ...] = ("PASS",)) -> DataFrame:
    """(digest, approved, from_ts, to_ts): history with repeats of a state left out; to_ts is null for the last."""
    w = Window.partitionBy("digest").orderBy("ts", "scan_id")
    one = acting(scans, approving).groupBy("digest", "ts").agg(F.max(F.struct("scan_id", "approved")).alias("l")).select("digest", "ts", "l.*")
    changes = one.withColumn("before", F.lag("approved").over(w)).where("before IS NULL OR before <> approved")
    return changes.select("digest", "approved", F.col("ts").alias("from_ts"), F.lead("ts").over(w).alias("to_ts"))


def state_at(requests: DataFrame, intervals: DataFrame, buckets: int = 16) -> DataFrame:
    """``requests`` (uid, ts, digest) with ``approved`` as of their time; null where nothing was known.

    Intervals are few after compaction; requests for popular digests are dealt over ``buckets`` with copies of the intervals.
    """
    salt = F.pmod(F.xxhash64("uid"), F.lit(buckets))
    left = requests.withColumn("salt", salt)
    right = intervals.where("approved").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint")))).withColumnRenamed("digest", "d").withColumnRenamed("salt", "s")
    inside = (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("ts") >= F.col("from_ts")) & (F.col("to_ts").isNull() | (F.col("ts") < F.col("to_ts")))
    return left.join(right, inside, "left").select(*requests.columns, F.coalesce("approved", F.lit(False)).alias("approved"))


def last_state_at(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """The same by one sorted pass over both: the last acting scan at or before each request."""
    both = acting(scans).select("digest", "ts", F.lit(0).alias("kind"), "scan_id", "approved", F.lit(None).cast("string").alias("uid")).unionByName(requests.select("digest", "ts", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("scan_id"), F.lit(None).cast("boolean").alias("approved"), "uid"))
    w = Window.partitionBy("digest").orderBy("ts", "kind", "scan_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("state", F.last("approved", ignorenulls=True).over(w)).where("kind = 1").select("uid", "digest", "ts", F.coalesce("state", F.lit(False)).alias("approved"))


_KINDS = ("initContainers", "containers", "ephemeralContainers")
_CONTAINERS = "array<struct<image:string>>"
_POD = f"metadata:struct<labels:map<string,string>,annotations:map<string,string>>,spec:struct<initContainers:{_CONTAINERS},containers:{_CONTAINERS},ephemeralContainers:{_CONTAINERS}"
#: A pod, or what holds the template of one.
REQUEST = f"struct<kind:string,{_POD},template:struct<{_POD}>>>>"


def parsed(requests: DataFrame, label: str = "gate", verdict: str = "verdict", models: str = "models") -> DataFrame:
    """(uid, ts, opted_in, images, verdict, digests) of (uid, ts, object), the object a workload's JSON.

    Labels, annotations and containers are those of the pod, or of the template in
    a controller's spec. A workload opts in by the label's value true. Digests are
    read in either case, one of each word of the annotation, and compared in lower case.
    """
    # Exploded, so that a body is parsed once and not again in every branch that reads it.
    once = lambda df, value: df.select("uid", "ts", F.explode(F.array(value)).alias("o"))
    o = F.col("o")
    pod = o["kind"] == "Pod"
    part = lambda name: F.when(pod, o[name]).otherwise(o["spec"]["template"][name])
    containers = F.when(pod, F.struct(*(o["spec"][k] for k in _KINDS))).otherwise(F.struct(*(o["spec"]["template"]["spec"][k] for k in _KINDS)))
    own = once(requests, F.from_json("object", REQUEST)).select("uid", "ts", F.explode(F.array(F.struct(part("metadata").alias("metadata"), containers.alias("spec")))).alias("o"))
    images = F.filter(F.flatten(F.array_compact(F.array(*(F.transform(o["spec"][k], lambda c: c["image"]) for k in _KINDS)))), lambda i: F.coalesce(i, F.lit("")) != "")
    said = lambda name: F.coalesce(F.try_element_at(o["metadata"]["annotations"], F.lit(name)), F.lit(""))
    digests = F.transform(F.split(said(models), r"[,\s]+"), lambda w: F.lower(F.regexp_extract(w, "(?:sha256:)?([a-fA-F0-9]{64})", 1)))
    return own.select(
        "uid", "ts", F.coalesce(F.lower(F.try_element_at(o["metadata"]["labels"], F.lit(label))) == "true", F.lit(False)).alias("opted_in"), F.coalesce(images, F.array().cast("array<string>")).alias("images"),
        F.upper(said(verdict)).alias("verdict"), F.array_distinct(F.filter(digests, lambda d: d != "")).alias("digests"),
    )


def decided(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """(uid, allowed, reasons, warnings) of parsed requests, as of their times: workloads that did not opt in are let through without a word."""
    asked = requests.select("uid", "ts", F.explode("digests").alias("digest")).distinct()
    missing = state_at(asked, intervals).where("NOT approved").groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set(F.substring("digest", 1, 12))), ",").alias("missing"))
    # One value: since when any digest has been approved at all.
    since = intervals.where("approved").agg(F.min("from_ts")).first()[0]
    each = requests.join(missing, "uid", "left")
    listed = F.col("ts") >= F.lit(since) if since else F.lit(False)
    loose = F.exists("images", lambda i: ~F.contains(i, F.lit("@sha256:")))
    declares = F.size("digests") > 0
    reasons = F.array_compact(F.array(
        F.when(loose, F.lit("an image is not pinned by digest")),
        F.when(F.col("verdict").isin("FAIL", "BLOCKED"), F.concat(F.lit("the scan verdict is "), F.col("verdict"))),
        F.when(declares & ~listed, F.lit("models are declared but no approved digests are known")),
        F.when(listed & F.col("missing").isNotNull(), F.concat(F.lit("not approved: "), F.col("missing"))),
    ))
    said = F.when(F.col("opted_in"), F.array_join(reasons, "; ")).otherwise("")
    warned = F.when(F.col("opted_in") & ~declares & (F.size("images") == 0), F.lit("no containers found")).otherwise("")
    return each.select("uid", (said == "").alias("allowed"), said.alias("reasons"), warned.alias("warnings"))


def allowed_repos(requests: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Requests (…, repo) for a listed repo or one under it."""
    return requests.join(F.broadcast(prefixes), (F.col("repo") == F.col("prefix")) | F.startswith("repo", F.concat("prefix", F.lit("/"))), "left_semi")


# --- digest lists ---------------------------------------------------------------


def parse_digests(lines: DataFrame) -> DataFrame:
    """(digest): distinct lower-case digests of text lines (value); blank lines and comments are passed over."""
    kept = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return kept.select(F.lower(F.regexp_extract("value", "(?:sha256:)?([a-fA-F0-9]{64})", 1)).alias("digest")).where("digest <> ''").distinct()


def changed_digests(known: DataFrame, approved: DataFrame, revoked: DataFrame) -> DataFrame:
    """(digest): the known digests and those approved, without those revoked; each once, in either case of letters."""
    low = lambda df: df.select(F.lower("digest").alias("digest"))
    return low(known).unionByName(low(approved)).distinct().join(low(revoked).distinct(), "digest", "left_anti")


def read_digests(spark, paths: list[str]) -> DataFrame:
    """Digest feeds, read anew at every call; files that have gone are passed over."""
    return parse_digests(spark.read.option("ignoreMissingFiles", True).text(paths))


def rendered(digests: DataFrame, note: Column) -> DataFrame:
    """(value): sorted lines ``sha256:<digest>  # note``, the note plain and 120 characters at most."""
    plain = F.substring(F.regexp_replace(note, r"[^\x20-\x7e]", ""), 1, 120)
    return digests.select("digest", F.concat(F.lit("sha256:"), "digest", F.lit("  # "), plain).alias("value")).orderBy("digest").select("value")
