"""Windowed rates, ratios and alerts over scans; the same functions serve streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN_SCHEMA = "scan_id bigint, ts timestamp, verdict string, digest string, replica string, origin string, format string, status string, category string, duration double, bytes bigint, errors int, user_id bigint"


def per_minute(scans: DataFrame, late: str = "10 minutes", by: str = "verdict") -> DataFrame:
    """(minute, value, n, bytes, errors): tumbling minutes."""
    rows = scans.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), F.col(by).alias("value"))
    return rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("errors").cast("bigint").alias("errors")).select(F.col("w.start").alias("minute"), "value", "n", "bytes", "errors")


def block_ratio(scans: DataFrame, length: str = "15 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(from_ts, total, ratio): share of FAIL and BLOCKED in sliding windows."""
    rows = scans.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("verdict").isin("FAIL", "BLOCKED")).alias("bad"))
    return rows.select(F.col("w.start").alias("from_ts"), "total", F.round(F.col("bad") / F.greatest("total", F.lit(1)), 9).alias("ratio"))


def block_ratio_from_minutes(scans: DataFrame, minutes: int = 15) -> DataFrame:
    """The sliding ratios of a table from one count a minute, spread over the windows that hold the minute."""
    one = scans.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin("FAIL", "BLOCKED")).alias("b"))
    spread = one.select(F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("k"), "*").select(F.expr("timestampadd(MINUTE, -k, minute)").alias("from_ts"), "n", "b")
    sums = spread.groupBy("from_ts").agg(F.sum("n").alias("total"), F.sum("b").alias("bad"))
    return sums.select("from_ts", "total", F.round(F.col("bad") / F.greatest("total", F.lit(1)), 9).alias("ratio"))


#: (alert, minutes of its window, count above which it is raised).
ALERTS = [("errors", 5, 0), ("blocks", 15, 3), ("capacity_rejects", 10, 0), ("auth_rejects", 5, 10)]


def alerts_of(scans: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """(alert, from_ts, n): windows of so many minutes in which a count passes the threshold of an alert of that length.

    Scans with errors and blocked ones count; so do rejects, rows whose verdict is
    REJECTED: those for want of capacity (status capacity or rate) and those for
    want of a right (status auth).
    """
    rejected = F.col("verdict") == "REJECTED"
    said = {"errors": F.col("errors") > 0, "blocks": F.col("verdict") == "BLOCKED", "capacity_rejects": rejected & F.col("status").isin("capacity", "rate"), "auth_rejects": rejected & (F.col("status") == "auth")}
    own = [(name, over) for name, length, over in ALERTS if length == minutes]
    rule = F.explode(F.array_compact(F.array(*(F.when(said[name], F.struct(F.lit(name).alias("alert"), F.lit(over).alias("over"))) for name, over in own))))
    rows = scans.withWatermark("ts", late).select("ts", rule.alias("r")).select("ts", "r.*")
    sums = rows.groupBy("alert", "over", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return sums.where("n > over").select("alert", F.col("w.start").alias("from_ts"), "n")


def alerts(scans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The alerts of all lengths."""
    first, *rest = sorted({minutes for _, minutes, _ in ALERTS})
    out = alerts_of(scans, first, late)
    for minutes in rest:
        out = out.unionByName(alerts_of(scans, minutes, late))
    return out


def silent_windows(scans: DataFrame, minutes: int = 10) -> DataFrame:
    """(from_ts): windows of the table's own span without any scan."""
    at = F.window("ts", f"{minutes} minutes")["start"]
    have = scans.select(at.alias("from_ts")).distinct()
    span = have.agg(F.min("from_ts").alias("a"), F.max("from_ts").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.expr(f"sequence(a, b, INTERVAL {minutes} MINUTES)")).alias("from_ts"))
    return every.join(have, "from_ts", "left_anti")


def once(scans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Deliveries of one scan_id count once; in a stream the state of ids goes with the watermark."""
    return scans.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scan_id"]) if scans.isStreaming else scans.dropDuplicates(["scan_id"])


def admitted(requests: DataFrame, approvals: DataFrame) -> DataFrame:
    """(uid, admitted) of (uid, digest) requests, a stream or a table, against the current approvals (digest)."""
    return requests.join(approvals.select("digest", F.lit(True).alias("known")), "digest", "left").select("uid", F.coalesce("known", F.lit(False)).alias("admitted"))


def bytes_rate(column: Column) -> Column:
    return column / F.lit(60.0)
