"""WARC archives: round trips through ranges of every size, repeated payloads, embedded archives, damaged files."""

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from framewright.llm import warc


def rows_of(df):
    number = lambda c: warc.key_of(F.col(c)).cast("bigint").alias(c)
    return {r.record_id: r for r in warc.checked(df).select(number("record_id"), "record_type", "target_uri", number("refers_to"), "payload_bytes", "payload_digest", "payload").collect()}


def test_round_trip_in_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(5)
    noise = bytes(rng.randrange(256) for _ in range(30_000))
    inner = b"".join(warc.member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n") for _ in range(40))
    same, long = b"x" * 100, b"long " * 400_000
    bodies = [noise, inner, inner + noise, noise + warc.MAGIC * 50, same, same, b"y" * 99, b"y" * 99, None, b"", long, same, noise, "ünï\r\n\r\n".encode() * 30]
    rows = [(len(bodies) - i, f"http://h/{i}\r\nX: 1" if i % 3 else None, b, "own") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page bigint, url string, body binary, record_type string").repartition(2)
    warc.write(df, f"file://{tmp_path}/a", "page", "url", "body")
    first = {}
    for page, _, b, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(b or b"", page)
    for size in (997, 20_011, 1 << 26):
        got = rows_of(warc.read(spark, f"file://{tmp_path}/a", range_bytes=size))
        assert len(got) == len(rows)
        for page, url, b, _ in rows:
            b, r = b or b"", got[page]
            again = len(b) >= 100 and first[b] != page
            assert (r.record_type, r.refers_to) == (("revisit", first[b]) if again else ("response", None))
            assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
            assert r.payload == (None if again else b)
            assert r.target_uri == (url and url.replace("\r\n", "%0D%0A"))
    found = warc.read(spark, f"file://{tmp_path}/a", range_bytes=997).select("file", "offset").distinct().count()
    assert found == len(rows)


def test_many_repeats_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_KEYS", 1)
    rows = [(k, ("hot" if k % 3 else f"pair {k // 6}") * 40) for k in range(3, 6000)] + [(None, "hot" * 40), (None, "z" * 200), (7000, "q" * 200), (7000, "q" * 200), (7001, "q" * 200)]
    got = warc.with_revisits(spark.createDataFrame(rows, "k bigint, body string"), "k", "body").collect()
    least = {}
    for k, b in rows:
        if k is not None:
            least[b] = min(k, least.get(b, k))
    assert len(got) == len(rows)
    for r in got:
        want = least.get(r.body.decode())
        assert (r.record_type, r.refers_to) == (("response", None) if want is None or want == r.k else ("revisit", want))


def test_empty_table_commits_appends_and_left_over_files(spark, tmp_path):
    folder = f"{tmp_path}/b"
    none = spark.createDataFrame([], "k bigint, u string, b string")
    assert warc.read(spark, folder).count() == 0
    warc.write(none, folder, "k", "u", "b")
    assert warc.read(spark, folder).count() == 0
    for k in (1, 2):
        warc.write(spark.createDataFrame([(k, "u", f"text {k}")], none.schema), folder, "k", "u", "b")
    (tmp_path / "b" / f"{'0' * 32}.warc.gz").write_bytes(warc.member(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))  # of an attempt that was lost before its commit
    assert sorted(r.payload.decode() for r in warc.read(spark, folder).collect()) == ["text 1", "text 2"]
    assert warc.read(spark, folder).count() == 2


def test_archives_of_other_makers_and_damage(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    one = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Type: text/plain\r\ncontent-length: 5\r\n\r\nhell%d\r\n\r\n"
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    good = info + b"".join(gzip.compress(one % (k, k)) for k in range(4))
    (folder / "a.warc.gz").write_bytes(good)
    df = warc.read(spark, str(folder), range_bytes=50)
    assert sorted((r.record_type, bytes(r.payload)) for r in df.collect()) == [("resource", b"hell%d" % k) for k in range(4)] + [("warcinfo", b"")]
    assert df.where(warc.key_of(F.col("record_id")).isNotNull()).count() == 0
    packed = bytearray(gzip.compress(one % (9, 9)))
    packed[-6] ^= 1  # its checksum
    (folder / "b.warc.gz").write_bytes(info + bytes(packed) + gzip.compress(one % (5, 5)) + gzip.compress(one % (6, 6))[:-9])
    with pytest.raises(Exception, match="damaged|cut off"):
        warc.read(spark, str(folder), range_bytes=60).collect()
    assert warc.read(spark, str(folder), range_bytes=60, corrupt="skip").count() == 5 + 2


def test_flush_keeps_embedded_members_apart():
    inner = zlib.compressobj(9, zlib.DEFLATED, 31)
    inner = inner.compress(b"WARC/1.1\r\n") + inner.flush()
    data = inner + random.Random(1).randbytes(5000) + inner
    packed = warc.member(data)
    assert packed.find(warc.MAGIC, 1) < 0 and gzip.decompress(packed) == data
