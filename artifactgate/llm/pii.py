"""Personal data: fixed patterns, and further spans by weak supervision.

Four base kinds (email, ip, card, phone) are found by fixed patterns, leftmost
and non-overlapping, and always kept. Further candidates (runs of digits, names,
spelled-out addresses, account numbers, secrets) get votes from labellers of
three sorts: shape patterns, gazetteers, and words of the context.
Expectation-maximisation over the counts of vote patterns estimates each
labeller's reliability, and the share of personal data, for each kind, from a few
votes that stand beforehand and all that are counted; the posteriors label at most ``SAMPLE``
candidates, from which a logistic span classifier over shape and context
features is fitted. It decides about every candidate of every text, those on
which all labellers abstain included. The sample holds the candidates of the
smallest hashes of document and place, equal ones once.

Texts are read once, in a narrow pass; what goes on is base spans and candidates
by document. Only vote-pattern counts (at most 3**7 a kind) and the bounded
sample reach the driver or the fit.

Defined results: a null text counts as empty; without candidates only base spans
are returned; where the posteriors of all candidates stand on one side of a half,
all are decided alike. A candidate that overlaps a base span, or one before it, is
dropped. Offsets are code points, the end exclusive. Columns named _base, _spans
and _candidates are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artifactgate.llm.common import stored
from artifactgate.llm.weak import posteriors

KINDS = ("email", "ip", "card", "phone", "number", "name", "address", "account", "secret")
BASE = KINDS[:4]
SAMPLE = 20_000
THRESHOLD = 0.5
#: Times that a vote against counts at the start, votes that stand for each labeller beforehand, candidates that stand for a kind's share, and the share of them that is personal.
AGAINST_WEIGHT, TRUST, STANDING, PERSONAL = 3.0, 20.0, 10.0, 0.45

# Equal to the plain patterns of the contract, but linear in long runs: a start
# inside a run can only match if the run's own start does.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(x * 2 - 9 * (x > 4) for x in own[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then kind as listed."""
    out = [(s, e, 0) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


#: Common given names and titles; words before a span that speak for or against it, by kind; beginnings of well-known credentials.
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony anna "
    "maria peter paul hans klaus jean pierre marie luis carmen jose juan sofia laura mark emily andrew emma george olivia edward grace henry alice walter helen frank ruth stefan monika jürgen "
    "ursula wolfgang petra dieter sabine heinz renate françois nathalie michel isabelle philippe sylvie jacques martine antonio josé ana miguel lucía javier pilar francisco dolores".split()
)
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora sir".split())
FOR = frozenset("phone tel telephone mobile cell call fax contact whatsapp ssn social passport account iban card customer patient born name named telefon handy konto téléphone teléfono nombre nom reach email mail write".split())
AGAINST = frozenset("page chapter figure table isbn version total line vol volume issue year section lines code build ticket order item".split())
FOR_SECRET = frozenset("token key apikey api_key secret password passwd pwd auth authorization bearer credential credentials access_key secret_key private_key client_secret".split())
AGAINST_SECRET = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision etag uuid integrity fingerprint".split())
CREDENTIALS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "hf_", "eyJ", "npm_", "pypi-")

_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9](?:[().\x20-]{0,2}[0-9]){6,18}(?![\w])")
_NAME = re.compile(r"\b[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+\x20[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+\b")
_ADDRESS = re.compile(r"\b[A-Za-z0-9._+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z]{2,24}\b")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
# A run of 20 and more, looked for only behind what can't be part of it, so that long runs stay linear.
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{20,}={0,2}(?![A-Za-z0-9_/+=-])")
_DIGIT_AND_LETTER = re.compile(r"(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])")
_HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64})$", re.I)
_PHONE_SHAPE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
_ID_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}$")
_WORD = re.compile(r"\w+")

LABELLERS = 7
FEATURES = 2 * LABELLERS + 10


def mod97(account: str) -> bool:
    """Whether an account number's check digits are right: the rest of its letters and digits, as a number, is 1."""
    own = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _candidates(text: str) -> Iterator[tuple[int, int, str]]:
    for kind, pattern, needs in (("number", _NUMBER, ""), ("name", _NAME, ""), ("address", _ADDRESS, "at"), ("account", _ACCOUNT, ""), ("secret", _SECRET, "")):
        if needs in text:
            for m in pattern.finditer(text):
                if kind != "secret" or _DIGIT_AND_LETTER.match(m.group()):
                    yield *m.span(), kind


def _shape(span: str, digits: str, kind: str) -> int:
    if kind == "number":
        return 1 if _PHONE_SHAPE.match(span) or _ID_SHAPE.match(span) or 13 <= len(digits) <= 19 else -1 if span.isdigit() and len(span) < 9 else 0
    if kind == "secret":
        # A token and a digest may both be bare hexadecimal digits: their looks say nothing.
        return 0 if _HEX.match(span) else 1 if span.startswith(CREDENTIALS) else -1 if span.count("/") > 1 or span.count("-") > 2 or len(digits) < 3 else 0
    return int(kind == "address")


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """Each labeller's vote: 1 personal, -1 not, 0 abstains."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 25])][:2]
    around = text[max(0, start - 30) : start] + text[end : end + 30]
    words = [w.lower() for w in _WORD.findall(span)]
    speaks, denies = (FOR_SECRET, AGAINST_SECRET) if kind == "secret" else (FOR, AGAINST)
    check = 0
    if kind == "account":
        check = 1 if mod97(span) else -1
    elif kind == "secret":
        check = -1 if len(set(span)) < 8 else 0
    elif 13 <= len(digits) <= 16 and luhn(digits):
        check = 1
    gazetteer = (1 if words and words[0] in GIVEN else -1) if kind == "name" else int(kind == "secret" and span.startswith(CREDENTIALS))
    title = 1 if before and before[-1] in TITLES else 0
    context = int(not speaks.isdisjoint(before)) - int(not denies.isdisjoint(before))
    behind = -1 if not denies.isdisjoint(after) or text[end : end + 1] in ("%", "$", "€") and kind == "number" else 0
    crowd = 0
    if kind != "secret":
        crowd = -1 if sum(c.isdigit() for c in around) > 20 or len(set(digits)) == 1 or (kind == "name" and (start == 0 or text[max(0, start - 2) : start].strip() in (".", "!", "?", ""))) else 0
    return [_shape(span, digits, kind), check, gazetteer, title, context, behind, crowd]


def span_features(text: str, start: int, end: int, kind: str, own: list[int]) -> list[float]:
    span = text[start:end]
    n = max(1, len(span))
    return [*(float(v == 1) for v in own), *(float(v == -1) for v in own), float(kind == "number"), float(kind == "name"), float(kind == "address"), float(kind == "account"), float(kind == "secret"), n / 20.0, sum(c.isdigit() for c in span) / n, span.count("-") / 3.0, span.count(" ") / 3.0, float("." in span)]


_SPAN = T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("kind", T.StringType())])
_CANDIDATE = T.StructType([*_SPAN.fields, T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("f", T.ArrayType(T.DoubleType()))])


def extracted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_base`` and ``_candidates`` of every row."""
    docs = docs.drop("_base", "_candidates", "_spans")
    place = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names]
            base, found = [], []
            for text in batch.column(place).to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append([{"lo": s, "hi": e, "kind": k} for s, e, k in own])
                rows, taken, b = [], 0, 0
                for s, e, k in sorted(_candidates(text)):
                    while b < len(own) and own[b][1] <= s:
                        b += 1
                    if s < taken or (b < len(own) and own[b][0] < e):
                        continue
                    taken = e
                    v = votes(text, s, e, k)
                    rows.append({"lo": s, "hi": e, "kind": k, "votes": v, "f": span_features(text, s, e, k, v)})
                found.append(rows)
            kept = [batch.column(k) for k in range(len(names)) if k != place]
            span = [("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(base, pa.list_(pa.struct(span))), pa.array(found, pa.list_(pa.struct([*span, ("votes", pa.list_(pa.int32())), ("f", pa.list_(pa.float64()))])))],
                [*(n for k, n in enumerate(names) if k != place), "_base", "_candidates"],
            )

    rest = [f for k, f in enumerate(docs.schema.fields) if k != place]
    return docs.mapInArrow(scan, T.StructType([*rest, T.StructField("_base", T.ArrayType(_SPAN)), T.StructField("_candidates", T.ArrayType(_CANDIDATE))]))


def fitted(rows: DataFrame, id_col: str | None) -> np.ndarray | None:
    """Weights of the span classifier, the intercept last; None without candidates."""
    document = F.col(f"`{id_col}`") if id_col else F.lit(0)
    every = rows.select(document.alias("of"), F.explode("_candidates").alias("c")).select(F.xxhash64("of", "c.kind", "c.lo", "c.hi", "c.votes").alias("h"), "c.kind", "c.votes", "c.f")
    counts = every.groupBy("kind", "votes").count().collect()
    known = []
    for kind in sorted({r["kind"] for r in counts}):
        own = sorted(((list(r["votes"]), r["count"]) for r in counts if r["kind"] == kind))
        found = posteriors(own, against=AGAINST_WEIGHT, silent=False, trust=TRUST, prior=(STANDING * PERSONAL, STANDING * (1 - PERSONAL)))
        # Where all are silent there is nothing to learn from but the share held beforehand; the classifier decides.
        known += [(kind, p, float(q) if any(p) else PERSONAL) for (p, _), q in zip(own, found)]
    if not known:
        return None
    sides = {q >= THRESHOLD for _, _, q in known}
    if len(sides) < 2:
        return np.append(np.zeros(FEATURES), 1.0 if sides.pop() else -1.0)
    labels = rows.sparkSession.createDataFrame(known, "kind string, votes array<int>, p double")
    chosen = every.select("h").distinct().orderBy("h").limit(SAMPLE)
    # SAMPLE hashes at most, and as many patterns as were counted.
    sample = every.join(F.broadcast(stored(chosen, "chosen")), "h").dropDuplicates(["h"]).join(F.broadcast(labels), ["kind", "votes"])
    both = sample.select(array_to_vector("f").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x")).select("features", "x.*")
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50).fit(stored(both, "spans"))
    return np.append(model.coefficients.toArray(), model.intercept)


def spans_of(docs: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``_base`` and ``_spans``: arrays of (lo, hi, kind); _spans holds the base ones and the further ones in order.

    id_col: by which the candidates of the sample are told apart, besides their place and kind.
    """
    rows = stored(extracted(docs, text_col), "spans")
    weights = fitted(rows, id_col)
    names = rows.columns[:-1]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, found in zip(batch.column(len(names) - 1).to_pylist(), batch.column(len(names)).to_pylist()):
                more = []
                if found and weights is not None:
                    z = np.array([c["f"] for c in found]) @ weights[:-1] + weights[-1]
                    more = [{k: c[k] for k in ("lo", "hi", "kind")} for c, x in zip(found, z) if x >= np.log(THRESHOLD / (1 - THRESHOLD))]
                out.append(sorted([*base, *more], key=lambda s: (s["lo"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.string())])))], [*names, "_spans"])

    return rows.mapInArrow(decide, T.StructType([*rows.schema.fields[:-1], T.StructField("_spans", T.ArrayType(_SPAN))]))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans, a row per document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = spans_of(rows, id_col="doc_id")
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
