"""URL filters and web archives."""

import base64
import hashlib
import io
import random

import pytest

from treeline.llm import url_filter, warc
from treeline.llm.queries import URL_RULES
from treeline.llm.shared import shared_dir


def by_rules(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    best = max(fits, key=len, default=None)
    return host, path, best, rules[best] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://a.com", "http://A.COM/x", "https://www.example.com/en/1", "https://blog.example.com/en/", "http://example.com/en", "http://example.com/en/?q=/", "http://x.net/es/1", "http://net/fr/", "http://y.net/de/", "http://z.org/#com/", "ftp://example.com?/en/", "http://example.com#/en/", "a://b://c.com/x", "http://com/", "http://notcom/", "http://x..com/", "http://ex.com/\n"]


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 0])
def test_judged_urls(spark, max_bits):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, URLS[5]])] + [(None, URLS[6], "h")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(pages, URL_RULES, max_bits=max_bits).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[6] if r.page_id is None else [*URLS, URLS[5]][r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == by_rules(url, URL_RULES), url
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, {}).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    r = random.Random(2)
    keys = [f"host{i}.example/{r.random()}" for i in range(4000)]
    listed = set(r.sample(keys, 150))
    universe = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "key string")
    from pyspark.sql import functions as F

    levels = url_filter.cascade(universe, spark.createDataFrame([(k,) for k in [*listed, keys[0], "not in the universe"]], "key string"))
    got = {row.key for row in universe.where("key is not null").where(url_filter.in_cascade(F.col("key"), levels)).collect()}
    assert got == listed | {keys[0]} and len(levels) > 1


BODY = b"<html>" + b"x" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/ c", "x" * 200), (3, None, "short"), (4, "http://d/", "short"), (5, "u", None), (6, "u", ""), (7, "é", "é" * 99), (0, "u", "x" * 200), (0, "u", "x" * 200), (None, "u", "x" * 200), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 30)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    got = sorted(map(tuple, warc.archive_round_trip(pages).collect()), key=str)
    want = []
    for r in pages.collect():
        body = (r.html or "").encode()
        hot = r.html == "x" * 200
        kind = "revisit" if hot and r.page_id != 0 else "response"
        want.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), kind, 0 if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, pages):
    folder = shared_dir(spark, "warc")
    rows = warc.read_archives(warc.write_archives(pages, folder), folder).where("record_type = 'response'").collect()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == html[r.page_id] for r in rows)


def records(n=12):
    return [warc.record({"WARC-Type": "response", "X-Page-Id": str(i)}, warc.HTTP_HEAD + bytes([65 + i]) * (50 + 700 * i)) for i in range(n)]


def read(data):
    log = warc.Salvage()
    return [h["x-page-id"] for _, h, _ in warc.read_records(io.BytesIO(data), log)], log.gaps


@pytest.mark.parametrize("wrap", [warc.member, lambda raw: raw], ids=["gzip", "plain"])
def test_salvage(wrap):
    parts = [wrap(r) for r in records()]
    every = [str(i) for i in range(len(parts))]
    assert read(b"".join(parts)) == (every, [])
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    hurt = bytearray(b"".join(parts))
    for i in (3, 7):
        hurt[starts[i] + len(parts[i]) // 2] ^= 0xFF
    got, gaps = read(bytes(hurt))
    assert got == [x for x in every if x not in ("3", "7")]
    assert [(at, size) for at, size, _ in gaps] == [(starts[3], len(parts[3])), (starts[7], len(parts[7]))]
    junk = b"junk \x1f\x8b\x08 more WARC/1.1 junk"
    got, gaps = read(junk + parts[0] + junk + parts[1])
    assert got == ["0", "1"] and sum(size for _, size, _ in gaps) == 2 * len(junk)
    got, gaps = read(b"".join(parts[:5])[:-10])
    assert got == every[:4] and gaps[-1][0] == starts[4]
    got, gaps = read(parts[0][: len(parts[0]) // 2] + b"".join(parts[1:]))
    assert got == every[1:]
    assert read(b"") == ([], [])


def test_salvage_of_old_versions_and_members_of_many_records():
    raw = [r.replace(b"WARC/1.1", b"WARC/1.0") for r in records(5)]
    ids = list("01234")
    assert read(b"".join(raw)) == (ids, [])
    assert read(warc.member(b"".join(raw))) == (ids, [])
    assert read(warc.member(b"") + warc.member(raw[0] + raw[1]) + b"".join(raw[2:])) == (ids, [])
    damaged = warc.member(raw[0] + raw[1].replace(b"BBBB", b"bbbb", 1) + b"junk" + raw[2])
    got, gaps = read(damaged + warc.member(raw[3]))
    assert got == ["0", "2", "3"]
    assert [g[:2] for g in gaps] == [(0, len(damaged))] and gaps[0][2].startswith(f"{len(raw[1]) + 4} bytes inside a member")


def test_salvage_of_large_members(monkeypatch):
    monkeypatch.setattr(warc, "HELD", 100)
    monkeypatch.setattr(warc, "READ", 64)
    raw = records(6)
    both = warc.member(b"".join(raw[:4])) + warc.member(raw[4] + raw[5])
    assert read(both) == (list("012345"), [])
    cut, gaps = read(both[:-9])
    assert cut == list("0123") and len(gaps) == 1


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha256"])
def test_block_digests_of_both_writings(algorithm):
    block = b"some block"
    own = hashlib.new(algorithm, block).digest()
    for value in (own.hex(), base64.b32encode(own).decode()):
        assert not warc._differs(f"{algorithm}:{value}", block)
        assert warc._differs(f"{algorithm}:{value}", block + b"x")
    assert not warc._differs("blake9:00", block)


class Counted(io.BytesIO):
    """A stream that knows its size and counts the bytes read."""

    read_bytes = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        part = super().read(n)
        self.read_bytes += len(part)
        return part


@pytest.mark.parametrize("length", [99999999999, 5_000_000])
def test_a_damaged_length_is_not_read_ahead(length, monkeypatch):
    monkeypatch.setattr(warc, "READ", 1 << 12)
    block = b"x" * 3000
    raw = [warc.record({"WARC-Type": "response", "X-Page-Id": str(i)}, block) for i in range(3000)]
    raw[1] = raw[1].replace(b"Content-Length: 3000", f"Content-Length: {length}".encode())
    stream, log = Counted(b"".join(raw)), warc.Salvage()
    found = warc.read_records(stream, log)
    first = [next(found)[1]["x-page-id"] for _ in range(2)]
    assert first == ["0", "2"] and stream.read_bytes < 100_000
    assert [g[:2] for g in log.gaps] == [(len(raw[0]), len(raw[1]))]
    assert sum(1 for _ in found) == 2997
