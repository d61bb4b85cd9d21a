import base64
import gzip
import hashlib
import random

import pytest

from sameword.llm import warc

b32 = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
ODD = ["", "\r\n", "\n", "\r", "\r\r\n", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nb\r\n\r\n", "\r\n\r\nx", "é😀\x00\x7f" * 3, "x\r\n", "x\r", " y ", "no line end " * 30]


def brute(rows):
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (text or "").encode()
        out.append((i, len(body), b32(body), "revisit" if body in first else "response", first.get(body)))
        first.setdefault(body, i)
    return sorted(out, key=repr)


def read(spark, path):
    return warc.records(warc.read_chunks(spark, path, bodies=False))


def test_round_trip_of_odd_payloads(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "last"), (7, "last"), (900, "é" * 200)]
    rows += [(200 + i, "".join(draw.choice(["\r", "\n", "\r\n", "a", "é", "<p>"]) for _ in range(draw.randrange(150)))) for i in range(60)]
    docs = spark.createDataFrame([(i, None if i is None else f"http://h/{i} é\r\nX: y", t) for i, t in rows], "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as name", "3 as file", "4 as first")
    warc.write(docs, str(tmp_path / "w"), chunk=50)
    got = read(spark, str(tmp_path / "w")).collect()
    num = lambda x: None if x is None else int(x)
    # two rows have no identifier, and the one with an empty text is a revisit of page 0
    assert sorted(((num(r.identifier), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_identifier)) for r in got), key=repr) == brute(rows)
    assert all(r.sound for r in got) and {r.uri for r in got if r.identifier == "8"} == {"http://h/8%20é%0D%0AX:%20y"}
    own = {r.record_id: r for r in got}
    assert len(own) == len(rows) and all(own[r.refers_to].payload_digest == r.payload_digest for r in got if r.record_type == "revisit")
    chunks = warc.read_chunks(spark, str(tmp_path / "w"), chunk=50).collect()
    texts = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        held = texts.setdefault(c.record_id, bytearray())
        assert c.offset == len(held) and c.size == len(c.body) <= 50
        held += c.body
        assert c.record_type == "revisit" or (c.payload_digest, c.payload_bytes) == (b32(bytes(held)), len(held))  # a digest at each chunk
    assert sorted(bytes(texts[r.record_id]) for r in got if r.record_type == "response") == sorted({(t or "").encode() for _, t in rows})


def test_files_are_archives_by_the_format(spark, tmp_path):
    docs = spark.createDataFrame([(1, "http://a/", "0123456789abcdefghijXYZ"), (2, "http://b/", "0123456789abcdefghijXYZ")], "page_id long, url string, html string")
    warc.write(docs, str(tmp_path / "w"), chunk=10)
    data, kinds = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.gz"))), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        kinds.append((fields["WARC-Type"], fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Total-Length"), rest[:n].partition(b"\r\n\r\n")[2] or rest[:n]))
        data = rest[n + 4 :]
    total = str(len(warc.HTTP.format(23)) + 23)
    assert sorted(kinds, key=repr) == sorted([("response", "1", None, b"0123456789"), ("continuation", "2", None, b"abcdefghij"), ("continuation", "3", total, b"XYZ"), ("revisit", None, None, b"")], key=repr)


def test_foreign_archive_in_chunks(spark, tmp_path):
    """Several gzip members, folded headers, a long record that isn't segmented, a wrong digest."""
    long = b"\r\n".join(b"line %d" % i for i in range(200))
    one = lambda kind, body, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + kind + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(gzip.compress(one(b"warcinfo", b"k: v\r\n")) + gzip.compress(one(b"resource", long, b"WARC-Target-URI: http://x/\r\n  y\r\nWARC-Payload-Digest: sha1:" + b32(long).encode() + b"\r\n")))
    (folder / "b.warc.gz").write_bytes(gzip.compress(one(b"resource", b"abc", b"WARC-Payload-Digest: sha1:" + b32(b"abd").encode() + b"\r\n")))
    got = {(r.record_type, r.payload_bytes): (r.payload_digest, r.sound, r.uri) for r in read(spark, str(folder)).collect()}
    assert got == {("warcinfo", 6): (b32(b"k: v\r\n"), True, None), ("resource", len(long)): (b32(long), True, "http://x/ y"), ("resource", 3): (b32(b"abc"), False, None)}
    assert warc.read_chunks(spark, str(folder), chunk=100).where(f"payload_bytes <= {len(long)} and uri is not null").count() > 10


@pytest.mark.parametrize("size", [65530, 200_000])
def test_line_ends_across_buffers(spark, tmp_path, size):
    draw = random.Random(size)
    texts = ["".join(draw.choices(["\r", "\n", "a"], [8, 2, 1], k=size + i)) for i in range(12)]
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    warc.write(docs, str(tmp_path / "w"))
    assert sorted((int(r.identifier), r.payload_digest, r.sound) for r in read(spark, str(tmp_path / "w")).collect()) == [(i, b32(t.encode()), True) for i, t in enumerate(texts)]


def test_cut_archive_and_empty_table(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 30\r\n\r\nabc"))
    with pytest.raises(Exception, match="ends within a record"):
        read(spark, str(folder)).collect()
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert read(spark, str(tmp_path / "e")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(["ab", "ab", "abc", "abc"])], "page_id long, url string, html string")
    warc.write(docs, str(tmp_path / "w"), least=3)
    assert sorted((r.identifier, r.record_type) for r in read(spark, str(tmp_path / "w")).collect()) == [("0", "response"), ("1", "response"), ("2", "response"), ("3", "revisit")]
