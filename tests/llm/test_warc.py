import gzip
import hashlib
import io

import pytest

from inkframe.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, first int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], SCHEMA)


def test_records_round_trip():
    payloads = [b"", b"x" * 99, bytes(range(256)) * 2000, "é\r\n\r\nWARC/1.1\r\n".encode()]
    data = b"".join(warc.write_record(warc.RESPONSE, i, "http://a b\r\nX: y", p) for i, p in enumerate(payloads)) + warc.write_record(warc.REVISIT, 9, None, payloads[2], 2)
    found = [warc.page_of(h, b) for h, b in warc.read_records(io.BytesIO(data))]
    assert [f["payload"] for f in found] == [*payloads, None]
    assert found[-1]["refers_to"] == 2 and found[-1]["payload_digest"] == hashlib.sha256(payloads[2]).hexdigest() and found[-1]["payload_bytes"] == len(payloads[2])
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == 5


def test_chunked_reads_give_the_same(monkeypatch):
    data = b"".join(warc.write_record(warc.RESPONSE, i, "u", b"abc" * i * 50) for i in range(30))
    whole = [b for _, b in warc.read_records(io.BytesIO(data))]
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert [b for _, b in warc.read_records(io.BytesIO(data))] == whole


def test_damage_is_found():
    record = warc.write_record(warc.RESPONSE, 1, "u", b"payload" * 30)
    with pytest.raises(warc.WarcError, match="ends within"):
        list(warc.read_records(io.BytesIO(record[:-20])))
    plain = gzip.decompress(record).replace(b"payloadpayload", b"payloadpayLoad", 1)
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(gzip.compress(plain))))
    with pytest.raises(warc.WarcError, match="framed"):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(record) + b"more"))))


def test_pages_round_trip(spark):
    long, short = "<p>" + "z" * 200, "<p>"
    rows = [(5, "u5", long), (3, "u3", long), (9, None, long), (1, "u1", short), (2, "u2", short), (4, "u4", None), (None, "u", "<b>" * 50), (None, "u", long), (7, "u7", "é" * 100_000), (3, "u3", long)]
    out = {}
    for r in warc.round_trip(spark, pages(spark, rows)).collect():
        out.setdefault(r.page_id, []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    assert [r.record_type for r in out[3]] == ["response"] * 2 and out[5][0].refers_to == out[9][0].refers_to == 3
    assert out[1][0].record_type == out[2][0].record_type == "response" and out[4][0].payload_bytes == 0
    assert out[7][0].payload_bytes == 200_000 and out[7][0].payload_digest == hashlib.sha256(("é" * 100_000).encode()).hexdigest()
    assert sorted(str(r.record_type) for r in out[None]) == ["response", "revisit"]
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


def test_archives_keep_payloads_and_roll_over(spark, tmp_path, monkeypatch):
    df = pages(spark, [(i, f"http://h/{i}", "text %d " % i * 40) for i in range(50)])
    archives = warc.write_archives(df, f"file://{tmp_path}/w")
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives).collect()}
    assert back == {i: "text %d " % i * 40 for i in range(50)} and archives.agg({"n_records": "sum"}).first()[0] == 50


def member(head, block):
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_records_of_other_writers():
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    sha1 = hashlib.sha1(b"hello")
    heads = [
        ["WARC/1.0", "warc-type: response", "content-LENGTH:  %d" % len(block), "WARC-Payload-Digest: sha1:" + warc.base64.b32encode(sha1.digest()).decode()],
        ["WARC/1.0", "WARC-Type: response", "Content-Length: %d" % len(block), "WARC-Block-Digest: SHA-1:" + hashlib.sha1(block).hexdigest(), "X-Long: a", " folded"],
        ["WARC/1.1", "WARC-Type: response", "Content-Length: %d" % len(block), "WARC-Block-Digest: blake9:abc"],
    ]
    found = list(warc.read_records(io.BytesIO(b"".join(member(h, block) for h in heads))))
    assert found[1][0]["x-long"] == "a folded"
    for page in (warc.page_of(*f) for f in found):
        assert page["payload"] == b"hello" and page["page_id"] is None and page["payload_digest"] == hashlib.sha256(b"hello").hexdigest()
    for head in (["WARC/1.1", "WARC-Type: response"], ["WARC/1.1", "Content-Length: x"], ["HTTP/1.1 200 OK", "Content-Length: 1"], ["WARC/1.1", "no field", "Content-Length: 1"], ["WARC/1.1", f"Content-Length: {len(block)}", "WARC-Block-Digest: sha1:%%"], ["WARC/1.1", f"Content-Length: {len(block)}", "WARC-Block-Digest: sha1:" + "0" * 40]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(member(head, block))))
    record = bytearray(warc.write_record(warc.RESPONSE, 1, "u", bytes(range(256)) * 20))
    record[40:80] = b"\xff" * 40
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bytes(record))))
    with pytest.raises(warc.WarcError, match="payload"):
        warc.page_of({"warc-type": "response", "warc-payload-digest": "sha1:" + "0" * 40}, block)


def test_revisits_follow_their_record(spark):
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"
    resolve = lambda rows: {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    response, alone = (3, 500, "d", "response", None, "a", None), (9, None, "e", "revisit", 4, "c", "elsewhere")
    out = resolve([response, response, (5, None, None, "revisit", None, "b", "a"), alone])
    assert len(out) == 3 and (out["b"].refers_to, out["b"].payload_bytes, out["b"].payload_digest) == (3, 500, "d")
    assert (out["c"].refers_to, out["c"].payload_bytes, out["c"].payload_digest) == (None, None, "e")
    for wrong in ((5, 501, "d", "revisit", 3, "b", "a"), (5, 500, "x", "revisit", 3, "b", "a"), (5, 500, "d", "revisit", 4, "b", "a")):
        with pytest.raises(Exception, match="does not match its response"):
            resolve([response, wrong])
