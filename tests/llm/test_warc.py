import gzip
import hashlib

from kinweave.llm import warc


def record(i, payload, kind="response", digest=None):
    sha = digest or hashlib.sha1(payload).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + warc.END


def read(data):
    found = list(warc.salvage(data))
    return [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)], [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]


def test_salvage():
    a, b, c = record(1, b"one"), record(2, b"two WARC/1.0\r\nnot a record"), record(3, b"three")
    ids = lambda *n: [f"<urn:page:{i}>" for i in n]
    assert read(a + b + c) == (ids(1, 2, 3), [])
    assert read(b"junk" + a) == (ids(1), [(0, 4)])
    assert read(a + b[:30] + c) == (ids(1, 3), [(len(a), len(a) + 30)])
    assert read(a + b.replace(b"two", b"TWO") + c) == (ids(1, 3), [(len(a), len(a + b))])
    assert read(a + c[:-2]) == (ids(1), [(len(a), len(a + c) - 2)])
    assert read(a + b"Content" + c) == (ids(1, 3), [(len(a), len(a) + 7)])
    assert read(b"") == ([], [])


def test_salvage_of_members():
    a, b, c = (gzip.compress(record(i, b"payload %d" % i), mtime=0) for i in (1, 2, 3))
    ids = lambda *n: [f"<urn:page:{i}>" for i in n]
    assert read(a + b + c) == (ids(1, 2, 3), [])
    broken = b[:20] + bytes([b[20] ^ 0xFF]) + b[21:]
    assert read(a + broken + c) == (ids(1, 3), [(len(a), len(a + b))])
    assert read(a + b[:-9] + c)[0] == ids(1, 3)
    assert read(a + record(9, b"plain") + c) == (ids(1, 9, 3), [])


def test_round_trip(spark, tmp_path):
    big, other = "é<p>" * 400, "ü\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a", big), (2, "http://b\r\n", big), (5, None, big), (3, "c", "small"), (4, "c", "small"), (6, "d", None), (7, "e", ""), (8, "f", other), (None, "g", other), (5, "h", big)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, sha string, refers_to int")
    got = warc.read(spark, warc.write(df, str(tmp_path / "a"))).collect()
    assert len(got) == len(rows) and not any(r.gap for r in got)
    seen = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in got))
    def want(i, html):
        data = (html or "").encode()
        same = [j or 0 for j, _, h in rows if (h or "").encode() == data]
        again = len(data) >= 1000 and i is not None and i != max(same)
        return (i or 0, "revisit" if again else "response", max(same) if again else 0, len(data), hashlib.sha1(data).hexdigest())
    assert seen == sorted(want(i, h) for i, _, h in rows)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in rows}
    assert warc.records(df.limit(0)).collect() == []


def test_salvage_is_linear():
    import time

    members = b"".join(gzip.compress(record(i, bytes([i % 251]) * 20_000), 1, mtime=0) for i in range(5000))
    plain = b"".join(record(i, b"x" * 2000) for i in range(10_000))
    cases = {
        "members": (members, 5000),
        "plain with faults": (plain.replace(b"Content-Length: 2000", b"Content-Length: 1999", 5000), 5000),
        "version lines only": (b"WARC/1.1\r\n" * 200_000, 0),
        "member signs only": (warc.MEMBER * 200_000, 0),
        "one large member": (gzip.compress(plain, 1, mtime=0), 10_000),
    }
    for name, (data, n) in cases.items():
        began = time.process_time()
        assert sum(isinstance(r, warc.Record) for r in warc.salvage(data)) == n, name
        assert time.process_time() - began < 10, name


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(warc.write, "__defaults__", (None,))
    monkeypatch.setattr(warc.classes, "__defaults__", (1 << 20, 200))
    sizes = [10] * 300 + [9_000] * 60 + [100_000] * 20 + [2_000_000]
    df = spark.createDataFrame([(i, "u", f"{i} " + "x" * n) for i, n in enumerate(sizes)], "page_id bigint, url string, html string").coalesce(1)
    path = warc.write(df, str(tmp_path / "a"))
    files = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert sorted(files)[-2] <= 1 << 20 and max(files) < 2_100_000 and len(files) > 4
    got = warc.read(spark, path).collect()
    assert sorted(r.page_id for r in got) == list(range(len(sizes))) and not any(r.gap for r in got)


def test_records_have_what_the_standard_asks_for(spark, tmp_path):
    big = "y" * 2000
    df = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", big), (2, "http://b/", big), (3, "http://c/", "z")], "page_id bigint, url string, html string")
    path = warc.write(df, str(tmp_path / "a"), date="2024-01-31T00:00:00Z")
    data = b"".join(p.read_bytes() for p in (tmp_path / "a").glob("part-*"))
    found = [r.headers for r in warc.salvage(data)]
    assert len({h["warc-record-id"] for h in found}) == 4 and all(h["warc-date"] == "2024-01-31T00:00:00Z" for h in found)
    again = [h for h in found if h["warc-type"] == "revisit"]
    assert [(h["warc-profile"], h["warc-refers-to-target-uri"], h["x-refers-to-page-id"]) for h in again] == [(warc.PROFILE, "http://b/", "2")]


def test_the_query_fails_on_a_gap(spark, tmp_path, monkeypatch):
    import pytest

    spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.page_id for r in warc.op2_warc(spark, str(tmp_path)).collect()] == [1]
    whole = warc.write

    def broken(pages, path):
        whole(pages, path)
        (tmp_path / "junk").mkdir()
        pages.sparkSession.createDataFrame([("junk",)], "value string").write.mode("append").text(path)
        return path

    monkeypatch.setattr(warc, "write", broken)
    with pytest.raises(Exception, match="a gap in"):
        warc.op2_warc(spark, str(tmp_path)).collect()
