import base64
import gzip
import hashlib
import random
import time

import pytest
from graphloom.scratch import Scratch
from graphloom.llm.warc import Gap, Record, archive_pages, build_record, gzip_member, read_archive, read_archives, with_revisits, write_archives


def archive(compressed, n=12):
    records = [build_record("response", i, f"http://x.example/{i}", (f"<p>{i} WARC/1.1\r\n\x1f\x8b\x08</p>" * (i + 1)).encode()) for i in range(n)]
    return [gzip_member(r) if compressed else r for r in records]


def pages_of(data):
    return [int(x.headers["x-page-id"]) for x in read_archive(data) if isinstance(x, Record)]


@pytest.mark.parametrize("compressed", [True, False])
def test_whole_archive(compressed):
    data = b"".join(archive(compressed))
    assert pages_of(data) == list(range(12)) and not [x for x in read_archive(data) if isinstance(x, Gap)]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_after_damage(compressed):
    parts = archive(compressed)
    for damage in (lambda p: p[: len(p) // 2], lambda p: p[:30] + b"\0\xff\0" + p[33:], lambda p: p[:-3], lambda p: b"junk" + p[9:], lambda p: b""):
        broken = [*parts]
        broken[4] = damage(broken[4])
        data = b"".join(broken)
        found = list(read_archive(data))
        assert [i for i in range(12) if i != 4] == pages_of(data)
        assert sum(x.size for x in found if isinstance(x, Gap)) == len(broken[4])
    for junk in (b"\x1f\x8b\x08" * 50, b"WARC/1.0\r\n\r\n", b"noise"):
        assert pages_of(junk + b"".join(parts) + junk) == list(range(12))


def test_bit_flips_never_give_wrong_records():
    rnd, parts = random.Random(1), archive(True)
    good = {x.headers["x-page-id"]: x.block for x in read_archive(b"".join(parts))}
    for _ in range(150):
        data = bytearray(b"".join(parts))
        data[rnd.randrange(len(data))] ^= 1 << rnd.randrange(8)
        found = list(read_archive(bytes(data)))
        records = [x for x in found if isinstance(x, Record)]
        assert len(records) >= 11 and all(good[x.headers["x-page-id"]] == x.block for x in records)


def test_members_are_gzip():
    assert gzip.decompress(gzip_member(b"abc")) == b"abc"


def rows():
    return [(1, "http://a/1", "<p>one</p>", "z"), (2, "http://a/2", "<p>two</p>", "z"), (3, "http://a/ 3\n", "<p>one</p>", "z"), (4, None, None, "z"), (5, "u", "", "z"), (6, "u", "é" * 200_000, "z"), (2, "http://a/2", "<p>two</p>", "z"), (None, "u", "<p>one</p>", "z"), (-7, "u", "", "z")]


def test_pages(spark):
    d = spark.createDataFrame(rows(), "page_id long, url string, html string, record_type string")
    out = archive_pages(d).collect()
    assert len(out) == len(rows())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    last = {"<p>one</p>": 3, "<p>two</p>": 2, "": 5, "é" * 200_000: 6}
    wanted = [(i, len((h or "").encode()), sha(h or ""), "revisit" if i is not None and i < last[h or ""] else "response", last[h or ""] if i is not None and i < last[h or ""] else None) for i, _, h, _ in rows()]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in out)
    assert archive_pages(d.limit(0)).count() == 0
    assert archive_pages(d, least_bytes=11).where("record_type = 'revisit'").count() == 0


def test_files_of_binary_file_source(spark, tmp_path):
    d = spark.createDataFrame(rows(), "page_id long, url string, html string, record_type string")
    for compressed in (True, False):
        folder = tmp_path / str(compressed)
        folder.mkdir()
        for r in write_archives(with_revisits(d, Scratch(spark, "test")), compressed).collect():
            (folder / r.name).write_bytes(bytes(r.content)[:-2] + b"??")
        files = spark.read.format("binaryFile").load(str(folder)).selectExpr("path AS name", "content")
        found = read_archives(files).collect()
        assert any(r.gap for r in found) and all(r.block is not None for r in found if not r.gap)


def test_members_of_several_records(spark):
    parts = archive(False)
    bad = [*parts]
    bad[4] = bad[4].replace(b"<p>4 ", b"<p>X ", 1)
    data = gzip_member(b"".join(bad)) + gzip_member(parts[0])
    assert pages_of(data) == [i for i in range(12) if i != 4] + [0] and sum(isinstance(x, Gap) for x in read_archive(data)) == 1
    whole = gzip_member(b"".join(parts))
    assert pages_of(whole[:-3]) == list(range(11)) and 0 < len(pages_of(whole[: len(whole) * 2 // 3])) < 12
    ids = [(1 << 63) - 1, -(1 << 63), 10**18, 1 << 63]
    rows = [("a", gzip_member(b"".join(build_record("response", i, "u", b"x") for i in ids)))]
    assert [r.page_id for r in read_archives(spark.createDataFrame(rows, "name string, content binary")).collect()] == [*ids[:3], None]


def facts(data):
    return [(x.headers["x-page-id"], x.headers.get("x-refers-to-page"), x.headers["warc-type"], x.block) for x in read_archive(data) if isinstance(x, Record)]


def gaps(data):
    return [(x.at, x.size) for x in read_archive(data) if isinstance(x, Gap)]


@pytest.mark.parametrize("compressed", [True, False])
def test_every_cut_of_a_record(compressed):
    made = [build_record("response", 1, "http://x.example/1", b"<p>one</p>"), build_record("revisit", 9, "http://x.example/WARC/1.1", b"<p>five</p>", 5), build_record("response", 5, "http://x.example/5", b"<p>five</p>"), build_record("revisit", 7, "http://x.example/7", b"<p>one</p>", 1)]
    parts = [gzip_member(r) for r in made] if compressed else made
    wanted = facts(b"".join(parts))
    assert [f[:2] for f in wanted] == [("1", None), ("9", "5"), ("5", None), ("7", "1")]
    for hurt in range(4):
        at = sum(map(len, parts[:hurt]))
        for n in range(len(parts[hurt])):
            data = b"".join([*parts[:hurt], parts[hurt][:n], *parts[hurt + 1 :]])
            rest = wanted[:hurt] + wanted[hurt + 1 :]
            assert facts(data) == rest or (compressed and facts(data) == wanted), (hurt, n)  # a member may lose its end after the whole record was read
            assert gaps(data) == ([(at, n)] if n else []), (hurt, n)


def test_headers_of_other_writers():
    def record(*lines, block=b"HTTP/1.1 200 OK\r\n\r\nx"):
        return b"WARC/1.0\r\n" + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"

    must = (b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:1>", b"warc-date:2024-01-01T00:00:00Z", b"Content-Length: 20")
    sha = hashlib.sha1(b"HTTP/1.1 200 OK\r\n\r\nx").hexdigest().encode()
    good = [record(*must), record(*must, b"WARC-Concurrent-To: <a>", b"WARC-Concurrent-To: <b>"), record(*must, b"X-Long: one", b"\ttwo"), record(*must, b"WARC-Block-Digest: SHA1:" + sha), record(*must, b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + b"A" * 32), record(must[0], b"WARC-Target-URI: http://x/WARC/1.0", *must[1:])]
    for one in good:
        assert [type(x) for x in read_archive(one)] == [Record], one
    for i in range(4):
        assert gaps(record(*must[:i], *must[i + 1 :]))
    for bad in (record(*must, must[1]), record(*must, b"no colon"), record(*must, b"WARC-Payload-Digest: sha1:" + b"A" * 32), record(*must, b"WARC-Block-Digest: sha1:" + b"A" * 32), record(*must[:3], b"Content-Length: -1"), record(*must[:3], b"Content-Length: " + b"9" * 30)):
        assert not facts_or_none(bad) and gaps(bad) == [(0, len(bad))]


def facts_or_none(data):
    return [x for x in read_archive(data) if isinstance(x, Record)]


@pytest.mark.parametrize("compressed", [True, False])
def test_time_grows_with_the_bytes_not_with_the_gaps(compressed):
    body = random.Random(5).randbytes(2500)
    made = []
    for i in range(20_000):
        part = build_record("response", i, "http://x.example/", body)
        part = gzip_member(part, 1) if compressed else part
        made.append(part[:1300] + b"\0\0\0\0" + part[1304:] if i % 2 else part)
    data = b"".join(made)
    began = time.perf_counter()
    found = list(read_archive(data))
    assert time.perf_counter() - began < 30
    assert sum(isinstance(x, Record) for x in found) == 10_000 and sum(isinstance(x, Gap) for x in found) == 10_000


def test_record_ids_of_unnamed_pages(spark):
    d = spark.createDataFrame([(None, "u", str(i)) for i in range(5)], "page_id long, url string, html string")
    data = [bytes(r.content) for r in write_archives(with_revisits(d, Scratch(spark, "test")).coalesce(1)).collect()]
    assert len({x.headers["warc-record-id"] for a in data for x in read_archive(a)}) == 5
