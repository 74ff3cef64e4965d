"""Reading artifacts, event tables and feeds; writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artifactgate.operators import formats, intel


def read_artifacts(spark: SparkSession, path: str, walk: bool = True) -> DataFrame:
    """(target_id, path, size, content) of the files under a folder; the first folder below it names the target.

    ``walk`` leaves out what a directory walk passes over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    inner = F.substring_index("path", f"/{root}/", -1)
    rows = files.select(F.substring_index(inner, "/", 1).alias("target_id"), inner.alias("path"), F.col("length").alias("size"), "content")
    return rows.where(formats.scannable(F.col("path"), F.col("content"))) if walk else rows


def read_intel(spark: SparkSession, path: str) -> DataFrame:
    """The vulnerability entries of a JSON dataset; one that is empty or holds an invalid entry is refused."""
    rows = spark.read.schema("cve string, framework string, channel string, affected string, summary string").json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} holds no entries")
    if not (bad := intel.invalid_entries(rows)).isEmpty():
        raise ValueError(f"{path} holds invalid entries, e.g. {bad.first().asDict()}")
    return rows


def write_reports(reports: DataFrame, path: str) -> None:
    """(target_id, body) documents as lines of JSON."""
    reports.select("body").write.mode("overwrite").text(path)
