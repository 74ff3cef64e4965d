"""Counters, histograms, rankings, reports and detection quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactgate import rules


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row a target: a zero-filled count for each severity, and the largest severity."""
    counts = [F.count_if(F.col("severity") == k).alias(s.lower()) for k, s in enumerate(rules.SEVERITIES)]
    return findings.groupBy("target_id").agg(*counts, F.max("severity").alias("max_severity"))


def label_counts(scans: DataFrame, labels: list[str]) -> DataFrame:
    """(label, value, n) for every label column in one pass: grouping sets over one partial aggregation."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c).cast("string"), F.lit("other")).alias("value")) for c in labels))).alias("x")
    return scans.select(each).groupBy("x.label", "x.value").agg(F.count("*").alias("n"))


def counter_families(scans: DataFrame, files: DataFrame, findings: DataFrame, policy: DataFrame) -> DataFrame:
    """(family, label, n): scans by verdict, provenance status and origin, files by format, their bytes, findings by severity and category, blocks by reason, and errors.

    scans: (verdict, status, origin). files: (format, size, error). findings, those of policies included: (severity, category, rule_id). policy: (rule_id).
    Each table is read once; every row gives its few labels, which are summed before the shuffle.
    """

    def labelled(df: DataFrame, *of: tuple[str, Column, Column | int]) -> DataFrame:
        one = [F.struct(F.lit(family).alias("family"), label.cast("string").alias("label"), (n if isinstance(n, Column) else F.lit(n)).cast("bigint").alias("n")) for family, label, n in of]
        return df.select(F.explode(F.array(*one)).alias("x")).select("x.*").where("label IS NOT NULL")

    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    levels = F.element_at(F.array(*map(F.lit, rules.SEVERITIES)), F.col("severity") + 1)
    reasons = F.create_map(*(F.lit(x) for kv in rules.BLOCK_REASON.items() for x in kv))
    error = lambda test: F.when(test, F.lit("all"))
    rows = labelled(scans, ("verdict", F.col("verdict"), 1), ("status", known("status"), 1), ("origin", F.upper(known("origin")), 1))
    rows = rows.unionByName(labelled(files, ("format", F.col("format"), 1), ("bytes", F.lit("all"), F.greatest(F.col("size"), F.lit(0))), ("errors", error(F.col("error").isNotNull()), 1)))
    rows = rows.unionByName(labelled(findings, ("severity", levels, 1), ("category", F.coalesce("category", F.lit("other")), 1), ("errors", error(F.col("rule_id").isin(rules.ERROR_RULES)), 1)))
    rows = rows.unionByName(labelled(policy, ("block_reason", F.try_element_at(reasons, F.col("rule_id")), 1)))
    return rows.groupBy("family", "label").agg(F.sum("n").alias("n"))


def grouping_set_counts(scans: DataFrame, labels: list[str]) -> DataFrame:
    """The same counts by GROUPING SETS."""
    sets = ", ".join(f"({c})" for c in labels)
    name = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in labels) + " END"
    value = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN {c}" for c in labels) + " END"
    return scans.sparkSession.sql(f"SELECT {name} AS label, {value} AS value, count(*) AS n FROM {{scans}} GROUP BY GROUPING SETS ({sets})", scans=scans)


def zero_filled(counts: DataFrame, label: str, values: list[str]) -> DataFrame:
    """(value, n) with a row for each of the values."""
    all_ = counts.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return F.broadcast(all_).join(counts.where(F.col("label") == label).select("value", "n"), "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def latency_histogram(scans: DataFrame, by: list[str] | None = None, buckets: list[float] | None = None) -> DataFrame:
    """(by..., le, n, total, sum): cumulative counts, the last bucket being infinity."""
    buckets = rules.LATENCY_BUCKETS if buckets is None else buckets
    sums = [F.count_if(F.col("duration") <= b).alias(f"b{k}") for k, b in enumerate(buckets)]
    one = scans.groupBy(*(by or [])).agg(*sums, F.count("*").alias("total"), F.sum("duration").alias("sum"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(buckets)), F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return one.select(*(by or []), F.explode(rows).alias("r"), "total", "sum").select(*(by or []), "r.le", "r.n", "total", "sum")


def histogram_quantile(histogram: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by..., value): linear within the first bucket that reaches the rank; the last finite bound beyond it."""
    w = Window.partitionBy(*by).orderBy("le")
    steps = histogram.withColumn("n0", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("le0", F.coalesce(F.lag("le").over(w), F.lit(0.0))).where(F.col("n") >= q * F.col("total"))
    first = steps.groupBy(*by).agg(F.min(F.struct("le", "le0", "n", "n0", "total")).alias("f")).select(*by, "f.*")
    inside = F.col("le0") + (F.col("le") - F.col("le0")) * (q * F.col("total") - F.col("n0")) / F.greatest(F.col("n") - F.col("n0"), F.lit(1))
    return first.select(*by, F.when(F.col("le") == float("inf"), F.col("le0")).otherwise(inside).alias("value"))


def in_flight(scans: DataFrame) -> DataFrame:
    """(replica, moment, running): scans running after each second with a start or an end; ends come first."""
    start = scans.select("replica", F.date_trunc("second", "ts").alias("moment"), F.lit(1).alias("d"))
    end = scans.select("replica", F.date_trunc("second", F.timestamp_add("SECOND", F.ceil("duration").cast("int"), F.col("ts"))).alias("moment"), F.lit(-1).alias("d"))
    steps = start.unionByName(end).groupBy("replica", "moment").agg(F.sum("d").alias("d"))
    return steps.select("replica", "moment", F.sum("d").over(Window.partitionBy("replica").orderBy("moment")).alias("running"))


def top_values(scans: DataFrame, label: str, k: int = 10) -> DataFrame:
    return scans.groupBy(F.coalesce(F.col(label), F.lit("other")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


# --- reports --------------------------------------------------------------------


def techniques(rule_ids: DataFrame, prefixes: DataFrame, umbrella: str = rules.UMBRELLA) -> DataFrame:
    """(rule_id, tags): the technique of the longest prefix, and the umbrella; none for a rule without one."""
    hits = rule_ids.select("rule_id").distinct().join(F.broadcast(prefixes), F.startswith("rule_id", "prefix"))
    best = hits.groupBy("rule_id").agg(F.max(F.struct(F.length("prefix").alias("n"), "technique")).alias("b"))
    return best.select("rule_id", F.array_distinct(F.array("b.technique", F.lit(umbrella))).alias("tags"))


def tagged(findings: DataFrame, tags: DataFrame) -> DataFrame:
    """Findings whose own tags come first and technique tags are appended once."""
    return findings.join(F.broadcast(tags.withColumnRenamed("tags", "more")), "rule_id", "left").withColumn("tags", F.array_union("tags", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(target_id, rule_id, level, uri, message)."""
    levels = F.create_map(*(F.lit(x) for kv in rules.SARIF_LEVEL.items() for x in kv))
    return findings.select("target_id", "rule_id", F.element_at(levels, F.col("severity").cast("int")).alias("level"), F.coalesce("path", "target_id").alias("uri"), F.col("title").alias("message"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(target_id, rule_id, name): the first title of each rule, 120 characters at most."""
    return findings.groupBy("target_id", "rule_id").agg(F.substring(F.min_by("title", "doc_id"), 1, 120).alias("name"))


def in_parts(rows: DataFrame, by: str, most: int) -> DataFrame:
    """``rows`` with ``part``: each target's rows dealt by the hash of a column over as many parts as hold about ``most`` rows."""
    sizes = rows.groupBy("target_id").agg(F.ceil(F.count("*") / most).cast("bigint").alias("parts"))
    place = F.conv(F.substring(F.sha2(by, 256), 1, 8), 16, 10).cast("bigint")
    return rows.join(sizes, "target_id").withColumn("part", F.pmod(place, F.col("parts"))).drop("parts")


def sarif_documents(findings: DataFrame, most: int = 1000) -> DataFrame:
    """(target_id, part, body): SARIF documents of about ``most`` results, as many as a target needs; a document names the rules of its own results."""
    rows = in_parts(sarif_results(findings), "uri", most)
    results = rows.groupBy("target_id", "part").agg(F.array_sort(F.collect_list(F.struct("rule_id", "level", "uri", "message"))).alias("results"))
    named = rows.select("target_id", "part", "rule_id").distinct().join(sarif_rules(findings), ["target_id", "rule_id"])
    named = named.groupBy("target_id", "part").agg(F.array_sort(F.collect_list(F.struct("rule_id", "name"))).alias("rules"))
    body = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct("rules", "results")).alias("runs")))
    return results.join(named, ["target_id", "part"]).select("target_id", "part", body.alias("body"))


def audit_records(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """(target_id, max_severity, n_findings, rule_ids, body): at most 20 sorted distinct rule ids."""
    sums = findings.groupBy("target_id").agg(F.max("severity").alias("max_severity"), F.count("*").alias("n_findings"), F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, 20), ",").alias("rule_ids"))
    each = targets.select("target_id").join(sums, "target_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    return each.withColumn("body", F.to_json(F.struct("target_id", "max_severity", "n_findings", "rule_ids")))


def nested_reports(files: DataFrame, findings: DataFrame, most: int = 1000) -> DataFrame:
    """(target_id, part, body): a target's files, each with its findings, as JSON documents of about ``most`` files."""
    own = findings.groupBy("target_id", "path").agg(F.array_sort(F.collect_list(F.struct("rule_id", "severity"))).alias("findings"))
    each = in_parts(files, "path", most).join(own, ["target_id", "path"], "left")
    file = F.struct("path", "format", "size", "sha256", F.coalesce("findings", F.array().cast("array<struct<rule_id:string,severity:int>>")).alias("findings"))
    return each.groupBy("target_id", "part").agg(F.array_sort(F.collect_list(file)).alias("files")).select("target_id", "part", F.to_json(F.struct("target_id", "part", "files")).alias("body"))


# --- detection quality ----------------------------------------------------------


def detected(verdict: Column, severity: Column) -> Column:
    return severity >= rules.MEDIUM


def detection_metrics(results: DataFrame) -> DataFrame:
    """One row: rates, counts of warned benign, missed and wrongly flagged ones, and percentiles of the time."""
    bad, good = F.col("label") == "malicious", F.col("label") == "benign"
    hit, flagged = detected(F.col("verdict"), F.col("max_severity")), F.col("verdict").isin("FAIL", "BLOCKED")
    p = F.percentile("seconds", F.array(F.lit(0.5), F.lit(0.95)))
    return results.agg(
        F.round(F.avg(F.when(bad, hit.cast("double"))), 9).alias("tpr"), F.round(F.avg(F.when(good, flagged.cast("double"))), 9).alias("fpr"), F.count_if(good & (F.col("verdict") == "WARN")).alias("benign_warned"),
        F.count_if(bad & ~hit).alias("missed"), F.count_if(good & flagged).alias("false_positives"), F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"),
    )


def detection_errors(results: DataFrame) -> DataFrame:
    """(id, error): what was missed and what was wrongly flagged, a row each."""
    hit, flagged = detected(F.col("verdict"), F.col("max_severity")), F.col("verdict").isin("FAIL", "BLOCKED")
    error = F.when((F.col("label") == "malicious") & ~hit, "missed").when((F.col("label") == "benign") & flagged, "false_positive")
    return results.select("id", error.alias("error")).where("error IS NOT NULL")


def by_attack_class(results: DataFrame) -> DataFrame:
    bad = results.where("label = 'malicious'")
    return bad.groupBy("attack_class").agg(F.count("*").alias("n"), F.count_if(detected(F.col("verdict"), F.col("max_severity"))).alias("detected"), F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, 3), ",").alias("rules"))


def scanner_comparison(results: DataFrame) -> DataFrame:
    """A row a tool: detected, missed, not attempted, recall over attempted, and false positives."""
    bad, skipped, hit = F.col("label") == "malicious", F.col("verdict") == "SKIPPED", detected(F.col("verdict"), F.col("max_severity"))
    sums = results.groupBy("tool").agg(F.count_if(bad & ~skipped & hit).alias("detected"), F.count_if(bad & ~skipped & ~hit).alias("missed"), F.count_if(bad & skipped).alias("not_attempted"), F.count_if(~bad & F.col("verdict").isin("FAIL", "BLOCKED")).alias("false_positives"))
    return sums.withColumn("recall", F.round(F.try_divide(F.col("detected").cast("double"), F.col("detected") + F.col("missed")), 9))


def evasion_recall(results: DataFrame) -> DataFrame:
    """One row: recall over what should resist, and what is known to be open."""
    bad = results.where("label = 'malicious'")
    return bad.agg(F.count_if(~F.col("known_open")).alias("n"), F.count_if(~F.col("known_open") & F.col("resisted")).alias("resisted"), F.count_if(F.col("known_open") & ~F.col("resisted")).alias("open"), F.round(F.avg(F.when(~F.col("known_open"), F.col("resisted").cast("double"))), 9).alias("recall"))


# --- licences and locks ---------------------------------------------------------

#: Licence spellings by their lower-case form.
LICENCES = {
    "mit license": "MIT",
    "mit": "MIT",
    "mit no attribution license (mit-0)": "MIT-0",
    "apache software license": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "bsd license": "BSD-3-Clause",
    "isc license (iscl)": "ISC",
    "mozilla public license 2.0 (mpl 2.0)": "MPL-2.0",
    "the unlicense (unlicense)": "Unlicense",
    "python software foundation license": "PSF-2.0",
}


def normal_licence(x: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in LICENCES.items() for v in kv)), F.lower(F.trim(x))), F.trim(x))


def licence_summary(components: DataFrame) -> DataFrame:
    """(licence, n): packages by licence, each name and version once."""
    once = components.groupBy("name", "version").agg(F.min(normal_licence(F.col("licence"))).alias("licence"))
    return once.groupBy("licence").agg(F.count("*").alias("n"))


def lock_packages(lines: DataFrame) -> DataFrame:
    """(file, name, version, hashes): hash lines belong to the last package line above them."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    package = F.when(F.col("line").rlike(r"^[A-Za-z0-9_.-]+=="), F.col("line_no"))
    own = lines.withColumn("at", F.last(package, ignorenulls=True).over(w)).where("at IS NOT NULL")
    head = F.min_by("line", "line_no")
    return own.groupBy("file", "at").agg(
        F.regexp_extract(head, r"^([A-Za-z0-9_.-]+)==", 1).alias("name"), F.regexp_extract(head, r"==([^\s;]+)", 1).alias("version"),
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.regexp_extract("line", "--hash=sha256:([0-9a-f]{64})", 1), F.lit("")))), ",").alias("hashes"),
    )
