"""Loader vulnerabilities: records to version ranges, and declared versions against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactgate.functions.dates import age_days, iso_time


def version(text: Column) -> Column:
    """The first dotted number as an array; empty without one."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)+)", 1)
    return F.when(found == "", F.array().cast("array<bigint>")).otherwise(F.split(found, r"\.").cast("array<bigint>"))


def _padded(x: Column, y: Column) -> Column:
    """x with zeros up to the length of y."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.size(y) - F.size(x), F.lit(0))))


def satisfies(have: Column, part: Column) -> Column:
    """A version array against one comparator such as ``>=3.0``; false where either can't be read."""
    op = F.regexp_extract(F.trim(part), r"^(>=|<=|==|<|>)\s*([\d.]+)", 1)
    bound = version(F.regexp_extract(F.trim(part), r"^(>=|<=|==|<|>)\s*([\d.]+)", 2))
    a, b = _padded(have, bound), _padded(bound, have)
    return F.when(F.size(have) == 0, False).when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == ">=", a >= b).when(op == "==", a == b).otherwise(False)


def affected(have: Column, spec: Column) -> Column:
    return F.forall(F.split(spec, ","), lambda p: satisfies(have, p))


def loader_findings(declared: DataFrame, cves: DataFrame) -> DataFrame:
    """(file, framework, n, summaries, clear_at): one row per file and framework with any affecting entry.

    Distinct versions meet the ranges, not files; clear_at is the largest strict upper bound.
    """
    versions = declared.select("channel", "version").distinct().withColumn("have", version(F.col("version")))
    hits = versions.join(F.broadcast(cves), "channel").where(affected(F.col("have"), F.col("affected")))
    bounds = F.transform(F.filter(F.split("affected", ","), lambda p: F.trim(p).rlike(r"^<\s*[\d.]+")), lambda p: F.regexp_extract(F.trim(p), r"^<\s*([\d.]+)", 1))
    once = hits.groupBy("channel", "version", "framework", "cve").agg(F.min("summary").alias("summary"), F.flatten(F.collect_set(bounds)).alias("bounds"))
    told = once.groupBy("channel", "version", "framework").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("cve", "summary"))).alias("all"), F.flatten(F.collect_list("bounds")).alias("bounds"))
    key = lambda b: F.struct(_padded(version(b), F.sequence(F.lit(1), F.lit(6))).alias("v"), b.alias("raw"))
    clear = F.array_max(F.transform("bounds", key))["raw"]
    first = F.array_join(F.transform(F.slice("all", 1, 3), lambda x: x["summary"]), "; ")
    more = F.when(F.col("n") > 3, F.concat(F.lit("; +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    told = told.select("channel", "version", "framework", "n", F.concat(first, more).alias("summaries"), clear.alias("clear_at"))
    return declared.join(told, ["channel", "version"]).select("file", "framework", "n", "summaries", "clear_at")


def one_per_cve(records: DataFrame) -> DataFrame:
    """One record a CVE: an advisory database's one before others, then the first."""
    best = F.row_number().over(Window.partitionBy("cve").orderBy(F.desc("is_ghsa"), "pos"))
    return records.withColumn("k", best).where("k = 1").drop("k")


def merged(curated: DataFrame, made: DataFrame) -> DataFrame:
    """Curated entries, and made ones of other CVEs, in order of framework and CVE."""
    return curated.unionByName(made.join(curated.select("cve"), "cve", "left_anti").select(*curated.columns)).orderBy("framework", "cve")


def specs_of(events: Column) -> Column:
    """Range events (introduced, fixed) to specs: a window opens at introduced and closes at fixed; an open one has no end."""
    kind = "array<string>"
    done = lambda intro, fixed: F.concat(F.when((intro == "0") | intro.isNull(), "").otherwise(F.concat(F.lit(">="), intro, F.lit(","))), F.lit("<"), fixed)
    fold = F.aggregate(
        events,
        F.struct(F.lit(None).cast("string").alias("intro"), F.array().cast(kind).alias("specs")),
        lambda s, e: F.struct(
            F.when(e["introduced"].isNotNull(), e["introduced"]).when(e["fixed"].isNotNull(), F.lit(None)).otherwise(s["intro"]).alias("intro"),
            F.when(e["fixed"].isNotNull(), F.array_append(s["specs"], done(s["intro"], e["fixed"]))).otherwise(s["specs"]).alias("specs"),
        ),
        lambda s: F.when(s["intro"].isNotNull(), F.array_append(s["specs"], F.when(s["intro"] == "0", ">=0").otherwise(F.concat(F.lit(">="), s["intro"])))).otherwise(s["specs"]),
    )
    return F.array_distinct(fold)


def invalid_entries(entries: DataFrame) -> DataFrame:
    """Entries without cve, framework or affected; a dataset with any, or without rows, is not taken."""
    missing = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return entries.where(missing("cve") | missing("framework") | missing("affected"))


#: What a data set says of its age, and the days after which it is old.
REFRESHED, STALE_AFTER = r"Last refreshed:\s*(\d{4}-\d{2}-\d{2})", 90


def dataset_ages(datasets: DataFrame, as_of: str, stale_after: int = STALE_AFTER) -> DataFrame:
    """(name, refreshed, age, stale) of (name, text): the date that a data set says it is of, and its days until ``as_of``; without a date that can be read, nulls and not stale."""
    stamp = F.regexp_extract("text", REFRESHED, 1)
    age = age_days(stamp, F.lit(as_of).cast("date"))
    return datasets.select("name", iso_time(stamp).cast("date").alias("refreshed"), age.alias("age"), F.coalesce(age > stale_after, F.lit(False)).alias("stale"))
