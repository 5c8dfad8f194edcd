import gzip
import io
import struct
import zipfile

import pytest

from corpuslens.llm import archives as A


def pack(members, stored=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = b"PK\x05\x06 a comment with a signature and more text behind"
    return out


def zip64(members):
    """An archive whose every offset, size and count stands in ZIP64 fields."""
    out, entries = io.BytesIO(), []
    for name, data in members:
        entries.append((name.encode(), len(data), out.tell()))
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data)
    start = out.tell()
    for name, size, at in entries:
        out.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, size, size, at))
    end = out.tell()
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(entries), len(entries), end - start, start))
    out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
    out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    return out


def records(n=5):
    return [A.record(i, f"http://x/{i}", f"page {i}".encode() * (i * 50), None) for i in range(n)]


@pytest.mark.parametrize("make", [pack, zip64])
def test_walks_members_without_an_index(make):
    raw = [gzip.compress(r) for r in records()]
    file = make([("note.txt", b"hello"), (A.DATA, b"".join(raw))])
    length = file.getbuffer().nbytes
    places = list(A.locate(file, length))
    assert [A.read_at(file, o, n) for o, n in places] == raw
    assert A.parse(gzip.decompress(A.read_at(file, *places[3])))["payload"] == b"page 3" * 150
    assert [(m.name, m.size) for m in A.directory(file, length)] == [("note.txt", 5), (A.DATA, sum(map(len, raw)))]


def test_refuses_what_it_cannot_read():
    with pytest.raises(ValueError, match="compressed"):
        f = pack([(A.DATA, b"x" * 100)], stored=False)
        list(A.locate(f, f.getbuffer().nbytes))
    with pytest.raises(ValueError, match="not a ZIP"):
        A.directory(io.BytesIO(b"nothing"), 7)
    with pytest.raises(ValueError, match="cut off"):
        f = pack([(A.DATA, gzip.compress(records()[4])[:-9])])
        list(A.locate(f, f.getbuffer().nbytes))
    raw = A.record(1, "u", b"payload", None).replace(b"payload", b"pay1oad")
    with pytest.raises(ValueError, match="digest"):
        A.parse(raw)


def test_round_trip_edges(spark):
    long = "ü" * 3_000_000
    rows = [(5, "http://b/\r\nx", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (None, "u", "same"), (9, "u", long), (11, "é", "a\r\n\r\nb"), (11, "é", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, first string")
    folder = A.scratch(spark, "t")
    got = A.read_archives(A.write_archives(df, folder), folder, with_payload=True).collect()
    key = lambda r: (r.page_id or 0, r.payload_bytes)
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in sorted(got, key=key)] == [
        (None, 4, "response", None), (3, 4, "response", None), (5, 4, "revisit", 3), (7, 0, "response", None), (8, 0, "revisit", 7), (9, 6_000_000, "response", None), (11, 6, "response", None), (11, 6, "response", None)
    ]
    by = {r.page_id: r for r in got}
    assert bytes(by[9].payload).decode() == long and by[5].payload is None and by[3].url is None and by[5].url == "http://b/%0D%0Ax"
    assert by[5].payload_digest == by[3].payload_digest == A.digest(b"same")
    assert A.round_trip(df.limit(0)).count() == 0


def test_many_archives(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "repeat(sha2(cast(id AS string), 256), 20) AS html")
    folder = A.scratch(spark, "t")
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 5000)
    made = A.write_archives(df.coalesce(2), folder)
    assert made.agg({"records": "sum"}).first()[0] == 300
    assert sorted(r.page_id for r in A.read_archives(made, folder).collect()) == list(range(300))


def test_one_id_with_several_payloads(spark):
    rows = [(3, "AAA"), (5, "AAA"), (5, "BBBBB"), (9, "BBBBB"), (9, "AAA"), (None, "AAA"), (5, "AAA")] + [(i, "hot") for i in range(20, 60)]
    df = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    folder = A.scratch(spark, "t")
    got = A.read_archives(A.write_archives(df, folder), folder, with_payload=True).collect()
    assert len(got) == len(rows)
    want = []
    for i, h in rows:
        first = min(j for j, x in rows if x == h and j is not None)
        want.append((i or 0, A.digest(h.encode()), "revisit" if i is not None and i != first else "response", first if i is not None and i != first else None))
    assert sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: x[:3])
    stored = {(r.page_id, r.payload_digest): bytes(r.payload).decode() for r in got if r.payload is not None}
    # every payload can be read where its record refers to
    assert all(stored[(r.refers_to or r.page_id, r.payload_digest)] in ("AAA", "BBBBB", "hot") for r in got)


def test_ranges_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE_BYTES", 20_000)
    df = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id AS string), 512), 30) AS html")
    back = A.round_trip(df)
    assert back.count() == 200 and back.rdd.getNumPartitions() > 2
