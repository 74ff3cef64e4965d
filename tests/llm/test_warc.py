import io
import zipfile
import zlib

import pytest

from artifactgate.llm import warc


class File:
    def __init__(self, raw):
        self.raw = io.BytesIO(raw)
        self.seek, self.read = self.raw.seek, self.raw.read

    def size(self):
        return len(self.raw.getvalue())


def expected(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(same, default=None)
        revisit = first is not None and page != first and len(payload) >= warc.REVISIT_BYTES
        out.append((page, len(payload), warc.digest_of(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(k, f"http://x.example/{k}", f"<p>{'ä' * (k % 7)}\r\n\r\n{k % 11}</p>") for k in range(200)]
    rows += [(500, None, None), (501, "http://y.example/", ""), (None, "http://n.example/ a", "<p>0</p>"), (3, "http://x.example/3", rows[3][2]), (502, "u", "x" * 300_000)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, digest string")
    assert sorted((tuple(r) for r in warc.round_trip(frame).collect()), key=repr) == expected(rows)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_zip64_directory_and_stored_members():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open(zipfile.ZipInfo("a/ü.txt"), "w", force_zip64=True) as m:
            m.write(b"one two three")
        z.writestr(zipfile.ZipInfo("b"), b"stored")
        z.writestr("c", b"packed" * 50, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK comment"
    p = warc.Package(File(raw.getvalue()))
    assert p.range(*p.stored_at("a/ü.txt")) == b"one two three" and p.range(*p.stored_at("b")) == b"stored"
    with pytest.raises(ValueError):
        p.stored_at("c")
    with pytest.raises(ValueError):
        warc.Package(File(b"no package at all"))


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(9):
            z.writestr(f"m{k}", str(k) * k)
    assert b"PK\x06\x06" in raw.getvalue()
    p = warc.Package(File(raw.getvalue()))
    assert [p.range(*p.stored_at(f"m{k}")).decode() for k in range(9)] == [str(k) * k for k in range(9)]


def test_records_parse_back():
    raw = warc.record("7", "http://x/", b"a\r\n\r\nb", "D", None)
    assert warc.parse(raw)[1] == b"a\r\n\r\nb"
    assert zlib.decompress(warc.gzip.compress(raw), 31) == raw
