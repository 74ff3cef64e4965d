"""Column functions over text and bytes, all inside the JVM."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from artifactgate.rules import BENIGN_HOSTS, SEVERITIES


def latin1(content: Column) -> Column:
    """Bytes as text, a character for each byte."""
    return F.decode(content, "ISO-8859-1")


def printable_runs(text: Column, least: int = 8) -> Column:
    """Runs of printable ASCII of at least that length."""
    return F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]{%d,}" % least), F.lit(0))


def wide_runs(text: Column, least: int = 8) -> Column:
    """Runs of printable ASCII in UTF-16, either byte order, from the latin-1 view of the bytes."""
    little = F.regexp_extract_all(text, F.lit(r"(?:[\x20-\x7e]\x00){%d,}" % least), F.lit(0))
    big = F.regexp_extract_all(text, F.lit(r"(?:\x00[\x20-\x7e]){%d,}" % least), F.lit(0))
    return F.transform(F.concat(little, big), lambda r: F.replace(r, F.char(F.lit(0)), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: (F.size(F.filter(chars, lambda x: x == c)) / n))
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def is_weighty(run: Column) -> Column:
    """A long run without spaces and of high entropy, as weights give by chance."""
    return F.when((F.length(run) >= 64) & ~F.contains(run, F.lit(" ")), entropy(run) > 4.5).otherwise(False)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/:]+)", 1))


def is_benign_url(url: Column, hosts: list[str] | None = None) -> Column:
    """The URL's host is an allowed one or under one; an empty list allows none."""
    hosts = BENIGN_HOSTS if hosts is None else hosts
    host = host_of(url)
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | F.endswith(host, F.lit(f".{h}"))
    return out


def path_escapes(path: Column) -> Column:
    """A URL, an absolute or drive path, or one with a parent part."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | F.startswith(plain, F.lit("/")) | path.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(plain, "/"), "..")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java pattern for the whole value."""
    return "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z").replace("(?s:", "(?s:")


def glob_match(value: Column, pattern: Column) -> Column:
    """``value`` matches the Java pattern that ``glob_regex`` made."""
    return F.rlike(value, pattern)


def model_names(repo_id: Column, target: Column) -> Column:
    """Distinct lower-case names of a model: its repo id, the last part of it, and the target's."""
    name = lambda c: F.lower(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(name(target), "^hf://", "")
    parts = F.array(name(repo_id), F.element_at(F.split(name(repo_id), "/"), -1), F.when(F.startswith(name(target), F.lit("hf://")), bare).otherwise(""), F.element_at(F.split(bare, "/"), -1))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def client_id(key: Column, host: Column) -> Column:
    return F.when(key.isNotNull() & (key != ""), F.concat(F.lit("k:"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))).otherwise(F.concat(F.lit("ip:"), F.coalesce(host, F.lit("unknown"))))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def little_endian(content: Column, start: int, width: int) -> Column:
    """An unsigned integer of so many bytes at the 1-based byte; null beyond the end."""
    part = F.substring(content, start, width)
    digits = F.concat(*(F.substring(F.hex(part), 2 * k + 1, 2) for k in reversed(range(width))))
    return F.when(F.length(part) == width, F.conv(digits, 16, 10).cast("decimal(20,0)"))
