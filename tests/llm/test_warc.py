import hashlib
import io

import pytest
import zstandard

from sparktrail.llm import warc

BIG = "<p>" + "abc é " * 300


def pages(spark):
    rows = [(1, "http://a/x y\r\nz", BIG, 1), (2, None, BIG, 2), (5, "u", BIG, 3), (5, "u", BIG, 3), (3, "v", None, 4), (4, "", "", 5), (6, "w", "small", 6), (7, "w", "small", 7), (None, "n", BIG, 8), (8, "q", BIG + "\r\n\r\n", 9)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, sha int")


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    manifest = warc.write_archives(df, str(tmp_path / "w"))
    out = warc.read_archives(manifest, str(tmp_path / "w"), payloads=True).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    texts = {i: h or "" for i, _, h, _ in rows}
    for i, found in by.items():
        for r in found:
            raw = texts[i].encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
            assert r["payload"] is None if r["record_type"] == "revisit" else r["payload"] == raw
    assert {i: (r[0]["record_type"], r[0]["refers_to"]) for i, r in by.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 5), 8: ("response", None)}
    assert by[1][0]["url"] == "http://a/x y\r\nz" and len(by[5]) == 2


def test_empty(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_archives(manifest, str(tmp_path / "w")).count() == 0


def archive(dictionary=b"", n=3):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, dictionary)
    for i in range(n):
        raw = f"{BIG}{i}".encode()
        w.add(warc.record(i, "http://x", raw, hashlib.sha1(raw).digest(), None))
    return out.getvalue()


def test_dictionary_is_used():
    samples = [f"{BIG}{i} {'z' * i}".encode() for i in range(200)]
    dictionary = warc.train_dictionary(samples)
    assert dictionary
    raw = archive(dictionary)
    assert [r["page_id"] for r in warc.read_archive(io.BytesIO(raw))] == [0, 1, 2]
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and len(archive(b"")) != len(raw)


@pytest.mark.parametrize("harm", ["cut", "magic", "body", "header", "length", "tail"])
def test_broken_archives(harm):
    raw = archive()
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None)
    frame = lambda x: warc._leading_frame(b"") + zstandard.ZstdCompressor().compress(x)
    bad = {"cut": raw[:-5], "magic": b"x" + raw[1:], "body": frame(good.replace(b"abc\r\n", b"abd\r\n")), "header": frame(good.replace(b"WARC-Date", b"WARC Date")), "length": frame(good.replace(b"abc\r\n", b"abcd\r\n")), "tail": frame(good[:-2])}[harm]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(bad)))


def test_long_record():
    raw = b"q" * 5_000_000
    out = io.BytesIO()
    warc.ArchiveWriter(out, b"").add(warc.record(1, "u", raw, hashlib.sha1(raw).digest(), None))
    assert next(warc.read_archive(io.BytesIO(out.getvalue())))["payload"] == raw
