import hashlib

from tallyspark.llm import warc


def test_round_trip(spark):
    big, small = "<p>" + "x" * 2000, "y" * 999
    rows = [(1, "http://a/ b\n", big), (2, None, big), (9, "u", big), (3, "u", small), (4, "u", small), (5, "u", None), (None, "u", big), (9, "u", big), (7, "u", "é" * 600)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.read(warc.write(warc.plan(df), archive_bytes=3000)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h for i, _, h in rows if i == r.page_id) or ""
        data = text.encode()
        revisit = text == big and r.page_id != 9
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert (bytes(r.payload) if r.payload is not None else None) == (None if revisit else data)
    assert warc.read(warc.write(warc.plan(df.limit(0)))).count() == 0


def test_dictionary_frame_and_many_records():
    records = [warc.record("response", i, f"http://x/{i}", f"<html><body>page {i} with common words {i * 7}</body>".encode() * 40, "d", None, "t") for i in range(400)]
    archive = warc.pack(records)
    assert archive[:4] == bytes.fromhex("5d2a4d18") and list(warc.unpack(archive)) == records
    assert len(archive) < sum(map(len, records)) / 4


def test_joined_without_broadcast(spark):
    rows = [(i, "u", "z" * (1000 + i % 3) if i % 2 else "s") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.plan(df).collect())
    assert known == sorted((r.page_id, r.record_type, r.refers_to) for r in warc.plan(df, broadcast_keepers=0).collect())
    assert sum(k == "revisit" for _, k, _ in known) == 27
    only = warc.read(warc.write(warc.plan(df), archive_bytes=5000), payload=False)
    assert known == sorted((r.page_id, r.record_type, r.refers_to) for r in only.collect())
