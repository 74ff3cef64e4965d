"""Indicators in strings: endpoints, secrets, code, and encoded payloads.

``runs_of`` cuts artifacts into printable runs; ``windowed`` cuts them into byte
ranges, and ``matches`` applies every rule to each of these in one pass;
``first_findings`` keeps one finding for each rule and key of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.functions import text as fn
from artifactgate.helpers import scan
from artifactgate.helpers.decode import payload_of

CAP = 500


def runs_of(artifacts: DataFrame, least: int = 8) -> DataFrame:
    """(target_id, path, run_no, run) of (target_id, path, text): printable runs, and behind them those in UTF-16 where there are zero bytes."""
    text = F.col("text")
    wide = F.when(F.contains(text, F.char(F.lit(0))), fn.wide_runs(text, least)).otherwise(F.array().cast("array<string>"))
    return artifacts.select("target_id", "path", F.posexplode(F.concat(fn.printable_runs(text, least), wide)).alias("run_no", "run"))


#: Bytes of a window, and of its neighbours that it sees on either side.
WINDOW, OVERLAP = 4 << 20, 4096


def windowed(artifacts: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(target_id, path, at, before, own, content) of (target_id, path, text or content): byte ranges, so that one huge file is many tasks' work.

    A window owns ``own`` bytes from offset ``at`` and sees ``overlap`` more on
    either side: a run of at most so many bytes is whole wherever a match starts.
    """
    content = F.col("content") if "content" in artifacts.columns else F.encode("text", "UTF-8")
    # Exploded, so that the bytes are made once, and cut as bytes, whose parts are found without reading from the start.
    rows = artifacts.select("target_id", "path", F.explode(F.array(F.struct(content.alias("c")))).alias("f")).select("target_id", "path", F.col("f.c").alias("content"))
    size = F.length("content")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(window)))

    def cut(at: Column) -> Column:
        before = F.least(at, F.lit(overlap))
        part = F.substring(F.col("content"), at - before + 1, before + F.lit(window + overlap))
        return F.struct(at.cast("bigint").alias("at"), before.alias("before"), F.least(F.lit(window), size - at).alias("own"), part.alias("content"))

    return rows.select("target_id", "path", F.explode(F.transform(starts, cut)).alias("w")).select("target_id", "path", "w.*")


def matches(artifacts: DataFrame, hosts: list[str] | None = None, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """One row for each match of each rule in (target_id, path, text or content), with its offset ``at``."""
    return scan.matches(windowed(artifacts, window, overlap), hosts)


def first_findings(found: DataFrame, cap: int = CAP, also: tuple[str, ...] = ()) -> DataFrame:
    """The first match of each rule and key of a file, and of those the first ``cap`` of the file in order of the scan; ``also``: more columns that name a file."""
    file, order = ["target_id", "path", *also], F.struct("kind", "run_at", "rule_no", "at")
    # min_by is combined before the shuffle, so a file with millions of matches sends one row a key.
    firsts = found.groupBy(*file, "rule_id", "key").agg(F.min(F.struct(order.alias("order"), "severity", "match")).alias("f"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy(*file).orderBy("f.order")))
    return ranked.where(F.col("rank") <= cap).select(*file, "rule_id", "key", "f.severity", "f.match", "rank")


def indicator_findings(artifacts: DataFrame, hosts: list[str] | None = None, cap: int = CAP) -> DataFrame:
    return first_findings(matches(artifacts, hosts), cap)


def encoded_findings(artifacts: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """(target_id, path, encoding, blob, severity, reason): long encoded runs that decode to a payload.

    Distinct blobs are decoded once, whatever the number of files that hold them.
    """
    runs = runs_of(artifacts, 64)
    kinds = (("base64", rules.BASE64), ("hex", rules.HEX), ("base32", rules.BASE32), ("base85", rules.BASE85))
    named = lambda k, p: F.transform(F.regexp_extract_all("run", F.lit(p), F.lit(0)), lambda b: F.struct(F.lit(k).alias("encoding"), b.alias("blob")))
    blobs = F.flatten(F.array(*(named(k, p) for k, p in kinds)))
    found = runs.select("target_id", "path", F.explode(blobs).alias("b")).select("target_id", "path", "b.*").distinct()
    decoded = found.select("encoding", "blob").distinct().withColumn("text", payload_of("encoding", "blob")).where("text IS NOT NULL")
    return found.join(payload_verdict(decoded, hosts), ["encoding", "blob"]).select("target_id", "path", "encoding", "blob", "severity", "reason")


def payload_verdict(decoded: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Rows of (text, ...) whose plain text is a payload, with severity and reason."""
    text = F.col("text")
    code = F.coalesce(*(F.when(text.rlike(p), F.lit(f"decodes to text containing a {label}")) for label, p, _, _ in rules.CODE))
    url = F.exists(F.regexp_extract_all(text, F.lit(rules.URL), F.lit(0)), lambda u: ~fn.is_benign_url(u, hosts))
    script = F.contains(text, F.lit("import ")) | F.contains(text, F.lit("#!/"))
    reason = F.when(code.isNotNull(), code).when(url, "decodes to text containing a non-allowlisted URL").when(script, "decodes to script-like text")
    return decoded.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("severity", F.when(code.isNotNull(), rules.CRITICAL).otherwise(rules.HIGH)).drop("text")


def windowed_findings(artifacts: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(target_id, path, rule_id, key, severity, n): distinct findings over windows, and how many matches each has; a match counts where it starts."""
    return matches(artifacts, window=window, overlap=overlap).groupBy("target_id", "path", "rule_id", "key").agg(F.max("severity").alias("severity"), F.count("*").alias("n"))


def truncated(files: DataFrame, limit: int) -> DataFrame:
    """A finding for each of (target_id, path, size) over the scan limit."""
    return files.where(F.col("size") > limit).select("target_id", "path", F.lit("SCAN_TRUNCATED").alias("rule_id"), F.lit(rules.MEDIUM).alias("severity"), F.col("size").cast("bigint").alias("file_bytes"), F.lit(limit).cast("bigint").alias("scanned_bytes"))
