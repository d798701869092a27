import base64
import hashlib

import pytest
from pipespark.llm import queries, warc
from pipespark.llm.common import Workspace

SF = "/root/testdata/sf0.01"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_whole_table(spark):
    pages = queries.table(spark, SF, "pages").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    got = {r.page_id: r for r in queries.op2_warc_chain(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        data, r = (p.html or "").encode(), got[p.page_id]
        again = first[p.html or ""] != p.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), b32(data))
        assert (r.record_type, r.refers_to) == (("revisit", first[p.html or ""]) if again else ("response", None))


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
ODD = [
    (1, "http://a/", "plain"), (2, None, None), (3, "http://b/ x\r\ny", ""), (4, "http://c/", FAKE * 3 + "tail"), (5, "http://d/", "x" * 5000 + FAKE), (6, "http://e/", FAKE),
    (7, "http://f/", "WARC/1.0\r\n"), (8, "http://g/", "\r\n\r\n" * 9), (9, "http://h/", "plain"), (10, "u", "é \x00" * 999), (11, "u", "plain"), (12, "u", FAKE * 400),
    (13, "u", "y" * 200_000), (14, "u", FAKE.replace("0\r\n\r\n\r\n\r\n", "99999999\r\n\r\nzz")),
]


@pytest.mark.parametrize("split", ["128m", "3k"])
@pytest.mark.parametrize("block", [64 << 20, 700])
def test_magic_in_payloads_and_small_splits(spark, split, block, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", block)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        work = Workspace(spark)
        df = spark.createDataFrame([(*r, "clash") for r in ODD], "page_id long, url string, html string, value string").repartition(2)
        path = work.path("warc")
        warc.write(df, path, work)
        full = {r.id: r for r in warc.read(spark, path, work, payloads=True).collect()}
        slim = {r.id: r for r in warc.read(spark, path, work).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(full) == set(slim) == {f"<urn:page:{r[0]}>" for r in ODD}
    for k, _, html in ODD:
        r, data = full[f"<urn:page:{k}>"], (html or "").encode()
        assert r.said_digest == "sha1:" + b32(data) and r.said_bytes == len(data)
        if k in (3, 9, 11):
            assert r.type == "revisit" and r.refers == ("<urn:page:2>" if k == 3 else "<urn:page:1>") and not r.payload
        else:
            assert r.type == "response" and bytes(r.payload) == data, k
            assert (r.payload_bytes, r.payload_digest) == (len(data), b32(data))
        assert (slim[r.id].payload_digest, slim[r.id].payload_bytes) == (r.payload_digest, r.payload_bytes)


def test_truncated_empty_and_null_ids(spark, tmp_path):
    work = Workspace(spark)
    rec = lambda n, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes((rec(1, "one") + rec(2, "two") + rec(3, "three")[:-6]).encode())
    (tmp_path / "w/b.warc").write_bytes(b"")
    (tmp_path / "w/c.warc").write_bytes(("junk" + rec(9, "nine")).encode())  # doesn't start with a record: nothing is reachable
    got = {(r.id, bytes(r.payload)) for r in warc.read(spark, f"file://{tmp_path}/w", work, payloads=True).collect()}
    assert got == {("<urn:page:1>", b"one"), ("<urn:page:2>", b"two")}
    df = spark.createDataFrame([(None, "u", "same"), (5, "u", "same")], "page_id long, url string, html string")
    path = work.path("w")
    warc.write(df, path, work)
    assert {(r.id, r.type) for r in warc.read(spark, path, work).collect()} == {("<urn:page:5>", "response"), ("<urn:page:null>", "revisit")}
    path = work.path("w")
    warc.write(df.limit(0), path, work)
    assert warc.read(spark, path, work).count() == 0


def test_records_do_not_depend_on_how_files_are_split(spark):
    work = Workspace(spark)
    path = work.path("warc")
    warc.write(spark.createDataFrame([(*r, "clash") for r in ODD], "page_id long, url string, html string, value string").repartition(3), path, work)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")
    seen = []
    for payloads in (False, True):
        try:
            for k, v in zip(names, ("128m", "4m", "4"), strict=True):
                spark.conf.set(k, v)
            found = warc.read(spark, path, work, payloads=payloads)
            for k, v in zip(names, ("2k", "1k", "24"), strict=True):  # between planning and running
                spark.conf.set(k, v)
            seen.append(sorted((r.id, r.payload_bytes, r.payload_digest) for r in found.collect()))
        finally:
            for k in names:
                spark.conf.unset(k)
    assert seen[0] == seen[1] and len(seen[0]) == len(ODD)


def test_bytes_that_are_not_text_and_blocks_that_are_not_http(spark, tmp_path):
    rec = lambda n, body, kind="response": b"WARC/1.0\r\nWARC-Type: " + kind.encode() + f"\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: \xe9\r\n\r\n"
    blocks = {1: b"\xff\xfe\x00raw\r\n\r\nmore", 2: http + bytes(range(256)), 3: http + b"\xc3(" + FAKE.encode() + b"\xff", 4: b"HTTP/1.1 but no end", 5: b""}
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(b"".join(rec(n, b) for n, b in blocks.items()))
    got = {r.id: bytes(r.payload) for r in warc.read(spark, f"file://{tmp_path}/w", Workspace(spark), payloads=True).collect()}
    assert got == {f"<urn:page:{n}>": b.removeprefix(http) for n, b in blocks.items()}
    slim = {r.id: r.payload_digest for r in warc.read(spark, f"file://{tmp_path}/w", Workspace(spark)).collect()}
    assert slim == {k: b32(v) for k, v in got.items()}
