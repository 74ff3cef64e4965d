"""Signals of others about a model: they may add findings, and never take one away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.helpers.bytes import json_facts

_VERDICT = "struct<scansDone:boolean,filesWithIssues:array<struct<path:string,level:string>>>"


#: Levels of an issue that make it unsafe; any other is suspicious.
UNSAFE_LEVELS = ["unsafe", "malicious", "dangerous", "blocked"]


def upstream_findings(verdicts: DataFrame, cap: int = 50) -> DataFrame:
    """(repo_id, rule_id, severity, path) of (repo_id, body): issues by level, at most ``cap`` a repo, then one row for the rest.

    A body that can't be read, or that says that scans are not done, leaves a gap row; one that does not say so does not.
    """
    v = verdicts.select("repo_id", F.from_json("body", _VERDICT).alias("v"))
    issues = v.select("repo_id", F.posexplode("v.filesWithIssues").alias("pos", "i")).select("repo_id", "pos", "i.*")
    bad = F.coalesce(F.lower(F.trim("level")), F.lit("")).isin(UNSAFE_LEVELS)
    found = issues.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy("pos")))
    shown = found.where(F.col("k") <= cap).select("repo_id", F.when(bad, "HF_UPSTREAM_UNSAFE").otherwise("HF_UPSTREAM_SUSPICIOUS").alias("rule_id"), F.when(bad, rules.HIGH).otherwise(rules.MEDIUM).alias("severity"), "path")
    rest = issues.groupBy("repo_id").count().where(F.col("count") > cap).select("repo_id", F.lit("HF_UPSTREAM_UNSAFE").alias("rule_id"), F.lit(rules.HIGH).alias("severity"), F.concat(F.lit("+"), (F.col("count") - cap).cast("string")).alias("path"))
    gaps = v.where("v IS NULL OR NOT v.scansDone").select("repo_id", F.lit("SIGNAL_UNAVAILABLE").alias("rule_id"), F.lit(rules.LOW).alias("severity"), F.lit(None).cast("string").alias("path"))
    return shown.unionByName(rest).unionByName(gaps)


def upstream_statuses(bodies: DataFrame) -> DataFrame:
    """(repo_id, path, scanner, status) of (repo_id, path, body): every text under a key that speaks of a status, in a blob of any shape, by the first part of its key path.

    A status at the top of the blob belongs to no scanner.
    """
    rows = bodies.select(F.col("repo_id").alias("target_id"), "path", F.encode("body", "UTF-8").alias("content"))
    at = F.regexp_replace(F.array_join("steps", ""), r"^\.", "")
    named = (F.col("kind") == "string") & F.contains(F.lower("key"), F.lit("status")) & F.startswith(F.element_at("steps", -1), F.lit("."))
    found = json_facts(rows).where((F.col("kind") != "error") & named).select("target_id", "path", at.alias("at"), F.lower(F.trim("value")).alias("status"))
    return found.where(F.contains("at", F.lit("."))).select(F.col("target_id").alias("repo_id"), "path", F.substring_index("at", ".", 1).alias("scanner"), "status")


def flagged_by(statuses: DataFrame) -> DataFrame:
    """(repo_id, path, scanners): the sorted distinct scanners whose status for a file is neither good nor pending."""
    bad = ~F.lower("status").isin("safe", "innocuous", "queued")
    return statuses.where(bad).groupBy("repo_id", "path").agg(F.array_join(F.array_sort(F.collect_set("scanner")), ",").alias("scanners"))


def missing_cards(models: DataFrame, cards: DataFrame) -> DataFrame:
    """(repo_id, rule_id): models without a card, and cards without evaluation results."""
    none = models.join(cards, "repo_id", "left_anti").select("repo_id", F.lit("CARD_MISSING").alias("rule_id"))
    results = F.flatten(F.transform(F.from_json(F.get_json_object("body", "$.model-index"), "array<struct<results:array<struct<metric:string>>>>"), lambda m: m["results"]))
    bare = models.join(cards, "repo_id").where(F.coalesce(F.size(results), F.lit(0)) <= 0).select("repo_id", F.lit("CARD_NO_EVALUATION").alias("rule_id"))
    return none.unionByName(bare)


def collected(targets: DataFrame, sources: dict[str, Callable[[DataFrame], DataFrame]], enabled: set[str] | None = None) -> DataFrame:
    """(target_id, rule_id, severity, source) of every enabled source; one that can't be built leaves a gap row a target."""
    out = None
    for name, build in sorted(sources.items()):
        if enabled is not None and name not in enabled:
            continue
        try:
            rows = build(targets).select("target_id", "rule_id", "severity", F.lit(name).alias("source"))
        except Exception:  # noqa: BLE001  a source's fault must not end the scan
            rows = targets.select("target_id", F.lit("SIGNAL_UNAVAILABLE").alias("rule_id"), F.lit(rules.LOW).alias("severity"), F.lit(name).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return targets.select("target_id").limit(0).selectExpr("target_id", "CAST(NULL AS STRING) AS rule_id", "CAST(NULL AS INT) AS severity", "CAST(NULL AS STRING) AS source") if out is None else out


def relevant(vulns: DataFrame, words: list[str], not_words: list[str], cwes: list[str]) -> DataFrame:
    """(id, cve, reason) of records about loading: no excluded word, and a weakness or a word that counts."""
    text = F.lower(F.concat_ws(" ", "summary", "details"))
    any_word = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w))
    own = F.array_sort(F.array_intersect("cwe_ids", F.array(*map(F.lit, cwes))))
    hit = F.filter(F.array(*map(F.lit, sorted(words))), lambda w: F.contains(text, w))
    reason = F.when(F.size(own) > 0, F.concat_ws(" ", F.lit("cwe"), F.array_join(own, ","))).when(F.size(hit) > 0, F.concat_ws(" ", F.lit("word"), F.array_join(hit, ",")))
    cve = F.coalesce(F.get(F.filter("aliases", lambda a: F.startswith(a, F.lit("CVE-"))), F.lit(0)), F.col("id"))
    return vulns.where(~any_word(not_words)).select("id", cve.alias("cve"), reason.alias("reason")).where("reason IS NOT NULL")
