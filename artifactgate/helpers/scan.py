"""Indicators in windows of bytes.

An Arrow helper looks at each window once: pieces that a rule's matches must hold
are sought in the whole window, and only rules with such a piece are tried, run
by run. A match carries its offset, and belongs to the window in which it starts;
what stands before and behind a window's own bytes is context for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from artifactgate import rules

LEAST = 8
#: Printable runs, and those in UTF-16, with the zero byte behind each character or in front of it. Of a run that reads either way, only the reading counts that has all of its characters.
RUNS = [(0, re.compile(rb"[\x20-\x7e]{%d,}" % LEAST)), (1, re.compile(rb"(?<!\x00)(?:[\x20-\x7e]\x00){%d,}" % LEAST)), (2, re.compile(rb"(?<![\x20-\x7e])(?:\x00[\x20-\x7e]){%d,}" % LEAST))]

#: Label -> pieces of which any match holds one, for rules that name no piece or one that is everywhere.
PIECES = {
    "AWS access key ID": [b"AKIA", b"ASIA", b"ABIA", b"ACCA"],
    "GitHub token": [b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"],
    "network client call": [b"requests.", b"urlopen", b"socket.socket", b"http.client"],
    "dynamic code execution": [b"exec", b"eval", b"__import__", b"compile"],
    "shell command": [b"os.", b"subprocess."],
    "reverse-shell idiom": [b"/dev/tcp/", b"nc -e ", b"sh -i >&"],
    "env-var harvesting": [b"os.environ", b"getenv"],
}


class Rule(NamedTuple):
    number: int
    rule_id: str
    label: str
    pattern: re.Pattern
    severity: int
    pieces: list[bytes]
    key_chars: int


def _rules() -> list[Rule]:
    rows = [("EXFIL_WEBHOOK", label, p, rules.CRITICAL, piece, 120) for label, p, piece in rules.WEBHOOKS]
    rows += [("EXFIL_URL", "url", rules.URL, rules.MEDIUM, "://", 120), ("EXFIL_IP_ENDPOINT", "ip", rules.IP_PORT, rules.HIGH, ":", 60)]
    rows += [("EXFIL_SECRET", label, p, severity, piece, 64) for label, p, severity, piece in rules.SECRETS]
    rows += [("EXFIL_CODE_INDICATOR", label, p, severity, piece, 60) for label, p, severity, piece in rules.CODE]
    return [Rule(n, rule, label, re.compile(p.encode()), severity, PIECES.get(label, [piece.encode()]), chars) for n, (rule, label, p, severity, piece, chars) in enumerate(rows)]


RULES = _rules()
_HOST = re.compile(rb"(?i)^[a-z]+://([^/:]+)")
_DIGITS = re.compile(rb"\d:\d\d")


def entropy(data: bytes) -> float:
    """Shannon entropy of the bytes, in bits, from one histogram."""
    n = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=1)
    share = n[n > 0] / max(1, len(data))
    return float(-(share * np.log2(share)).sum())


def is_weighty(run: bytes) -> bool:
    """A long run without spaces and of high entropy, as weights give by chance."""
    return len(run) >= 64 and b" " not in run and entropy(run) > 4.5


def is_benign(url: bytes, hosts: list[str]) -> bool:
    """The URL's host is an allowed one or under one."""
    found = _HOST.match(url)
    host = found[1].decode().lower() if found else ""
    return any(host == h or host.endswith(f".{h}") for h in hosts)


def _counts(rule: Rule, m: bytes, hosts: list[str]) -> bool:
    if rule.rule_id == "EXFIL_URL":
        return not is_benign(m, hosts)
    return rule.rule_id != "EXFIL_IP_ENDPOINT" or int(m.rpartition(b":")[2]) > 10


def _plain_runs(data: bytes, live: list[Rule]) -> Iterator[tuple[int, bytes, list[Rule]]]:
    """(offset, run, rules) of the printable runs that hold a piece of a rule, in order: other runs are not looked at."""
    odd = None
    of: dict[tuple[int, int], list[Rule]] = {}
    for rule in live:
        seen = set()
        for piece in rule.pieces:
            at = data.find(piece)
            while at >= 0:
                if odd is None:
                    a = np.frombuffer(data, dtype=np.uint8)
                    odd = np.flatnonzero((a < 0x20) | (a > 0x7E))
                k = int(np.searchsorted(odd, at))
                lo, hi = int(odd[k - 1]) + 1 if k else 0, int(odd[k]) if k < len(odd) else len(data)
                if hi - lo >= LEAST and lo not in seen:
                    seen.add(lo)
                    of.setdefault((lo, hi), []).append(rule)
                at = data.find(piece, max(hi, at + 1))
    for (lo, hi), own in sorted(of.items(), key=lambda x: x[0]):
        yield lo, data[lo:hi], own


def _wide_runs(data: bytes, kind: int, runs: re.Pattern, live: list[Rule]) -> Iterator[tuple[int, bytes, list[Rule]]]:
    for found in runs.finditer(data):
        run = found[0][kind - 1 :: 2]
        own = [r for r in live if any(p in run for p in r.pieces)]
        if own:
            yield found.start(), run, own


def matches_in(data: bytes, lo: int, hi: int, hosts: list[str]) -> Iterator[tuple[int, int, Rule, int, bytes]]:
    """(kind of run, offset of the run, rule, offset, match) of the matches that start in data[lo:hi]."""
    for kind, runs in RUNS if b"\0" in data else RUNS[:1]:
        text = data if not kind else data.replace(b"\0", b"")  # a piece in UTF-16 is there without the zero bytes
        live = [r for r in RULES if any(p in text for p in r.pieces) and (r.label != "ip" or _DIGITS.search(text))]
        if not live:
            continue
        for begin, run, own in _wide_runs(data, kind, runs, live) if kind else _plain_runs(data, live):
            weighty = None
            for rule in own:
                for m in rule.pattern.finditer(run):
                    at = begin + (m.start() if not kind else 2 * m.start() + kind - 1)
                    if not lo <= at < hi or not _counts(rule, m[0], hosts):
                        continue
                    if rule.rule_id == "EXFIL_SECRET":
                        if weighty is None:
                            weighty = len(run) < 14 or is_weighty(run)
                        if weighty:
                            break
                    yield kind, begin, rule, at, m[0]


_OUT = "kind int, run_at bigint, rule_no int, at bigint, rule_id string, severity int, key string, match string"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]


def matches(windows: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """One row for each match of each rule in windows (target_id, path, ..., at, before, own, content): ``own`` bytes from offset ``at``, with ``before`` bytes in front of them.

    Columns beyond these are handed on.
    """
    hosts = rules.BENIGN_HOSTS if hosts is None else hosts
    extra = [c for c in windows.columns if c not in ("at", "before", "own", "content")]
    kinds = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, row = [], []
            for i, (at, before, own, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                for kind, run_at, rule, offset, m in matches_in(content or b"", before, before + own, hosts):
                    key = m[: rule.key_chars].decode()
                    out.append((kind, at - before + run_at, rule.number, at - before + offset, rule.rule_id, rule.severity, f"{rule.label}:{key}" if rule.rule_id == "EXFIL_CODE_INDICATOR" else key, m[:200].decode()))
                    row.append(i)
            own_columns = [pa.array([r[c] for r in out], k) for c, k in enumerate(_KINDS)]
            handed = [c.take(pa.array(row, pa.int64())) for c in batch.columns[4:]]
            yield pa.RecordBatch.from_arrays([*handed, *own_columns], [*extra, *(x.split()[0] for x in _OUT.split(", "))])

    return windows.select("at", "before", "own", "content", *(f"`{c}`" for c in extra)).mapInArrow(run, f"{kinds}, {_OUT}")


# --- single-byte XOR ------------------------------------------------------------

#: What an obfuscated payload is looked for by; bytes decoded to either side, printable bytes in a row at least, hits of one anchor in a chunk, and bytes of a chunk.
ANCHORS = [b"http", b"-----BEGIN ", b"os.system", b"socket.", b"eval(", b"import ", b"/dev/tcp/", b"api.telegram", b"hooks.slack", b"discord.com/api"]
SIDE, LEAST_XOR, MOST_HITS, CHUNK = 512, 16, 4096, 8 << 20
_PRIVATE_KEY = re.compile(rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----")
_URL = re.compile(rules.URL.encode())


def structural(text: bytes, hosts: list[str]) -> tuple[int, str] | None:
    """(severity, reason) of the strongest indicator by its form: a webhook, code, a private key, or a URL that is not allowed."""
    for label, pattern, _ in rules.WEBHOOKS:
        if re.search(pattern.encode(), text):
            return rules.CRITICAL, f"{label} endpoint"
    for label, pattern, severity, _ in rules.CODE:
        if re.search(pattern.encode(), text):
            return severity, label
    if _PRIVATE_KEY.search(text):
        return rules.CRITICAL, "private key material"
    for url in _URL.findall(text):
        host = url.split(b"://", 1)[1].split(b"/")[0]
        if b"." in host and not is_benign(url, hosts):
            return rules.HIGH, "non-allowlisted URL"
    return None


def xor_hits(content: bytes) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """(anchor, offset of the anchor, key, offset of the run, plain run) of anchors under one key, in printable runs; at most MOST_HITS of an anchor in a chunk.

    Neighbouring bytes keep their differences under any single key, so an anchor
    is looked for among the differences, once for all 255 keys.
    """
    a = np.frombuffer(content, dtype=np.uint8)
    if len(a) < LEAST_XOR:
        return
    for chunk in range(0, len(a), CHUNK):
        part = a[chunk : chunk + CHUNK + SIDE + 64]
        steps = (part[1:] ^ part[:-1]).tobytes()
        for anchor in ANCHORS:
            b = np.frombuffer(anchor, dtype=np.uint8)
            sign = (b[1:] ^ b[:-1]).tobytes()
            at, tried = steps.find(sign), 0
            while at >= 0 and tried < MOST_HITS and at < CHUNK:
                tried += 1
                key = int(part[at]) ^ anchor[0]
                if key:
                    where = chunk + at
                    lo = max(0, where - SIDE)
                    plain = a[lo : where + SIDE] ^ np.uint8(key)
                    odd = np.flatnonzero((plain < 0x20) | (plain > 0x7E))
                    k = np.searchsorted(odd, where - lo)
                    i = int(odd[k - 1]) + 1 if k else 0
                    j = int(odd[k]) if k < len(odd) else len(plain)
                    if j - i >= LEAST_XOR:
                        yield anchor, where, key, lo + i, plain[i:j].tobytes()
                at = steps.find(sign, at + 1)


def xor_findings(artifacts: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """(target_id, path, rule_id, key, severity, reason, xor_key, plain) of (target_id, path, content): runs that one key turns into an indicator.

    ``key`` is the hex of 24 obfuscated bytes from the anchor; each is a finding once, its first.
    """
    hosts = rules.BENIGN_HOSTS if hosts is None else hosts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for target, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                seen = set()
                for _, at, key, _, plain in xor_hits(content or b""):
                    sample = content[at : at + 24].hex()
                    hit = structural(plain, hosts) if sample not in seen else None
                    if hit:
                        seen.add(sample)
                        out.append((target, path, "EXFIL_XOR_PAYLOAD", sample, *hit, key, plain.decode()))
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["target_id", "path", "rule_id", "key", "severity", "reason", "xor_key", "plain"])

    return artifacts.select("target_id", "path", "content").mapInArrow(run, "target_id string, path string, rule_id string, key string, severity int, reason string, xor_key int, plain string")
