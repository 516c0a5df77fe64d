import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from landheat.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 254, 255, 4800, 4801, 65025, 70000, 300000])
def test_round_trip(size):
    text = bytes(i * 7 % 251 for i in range(size))
    media = ogg.encode(text)
    payload, n, feature = ogg.read_back(media)
    assert n == size and payload[:size] == text and set(payload[size:]) <= {32}
    assert len(payload) % 192 == 0 and len(payload) >= max(192, size) and len(payload) - size < 192 + (size == 0)
    assert "streams=2;" in feature
    streams = ogg.decode(media)
    samples = next(s for s in streams.values() if s.packets[0].startswith(ogg.MAGIC))
    assert samples.granules[-1] == len(payload) and sorted(samples.granules) == samples.granules
    assert (samples.continued > 0) == (size > 62400)


def test_checksum_is_that_of_the_container():
    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.checksum(data) == slow_checksum(data)


def test_damage_is_seen():
    media = ogg.encode(b"some text " * 9000)
    for at in (0, 5, 30, 500, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.read_back(bytes(broken))
    with pytest.raises((ValueError, IndexError)):
        ogg.read_back(media[:-200])


def test_lacing_of_whole_multiples():
    pages = b"".join(ogg.pages_of(9, [b"h", b"a" * 255, b"", b"b" * 510], [0, 255, 255, 765]))
    assert ogg.decode(pages)[9].packets == [b"h", b"a" * 255, b"", b"b" * 510]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in ogg.media_features(ogg.media_column(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100000), (4, "x"), (4, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = ogg.media_features(ogg.media_column(docs)).collect()
    assert len(got) == len(rows)
    same = {tuple(r)[1:] for r in got if r.doc_id in (4, None)}
    assert len(same) == 1 and {r.payload_bytes for r in got if r.doc_id in (1, 2)} == {192}
    assert ogg.media_features(ogg.media_column(docs.limit(0))).count() == 0


def test_packet_times(spark):
    text = "some words " * 30000
    rows = ogg.media_packets(ogg.media_column(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"))).collect()
    sounds = sorted((r.packet, r.begin_s, r.end_s, bytes(r.content)) for r in rows if r.doc_id == 1 and r.bytes and not bytes(r.content).startswith((b"\x7f", b"{")))
    payload = ogg.payload_of(text.encode())
    assert b"".join(s[3] for s in sounds) == payload
    for k, (packet, begin, end, _) in enumerate(sounds):
        assert packet == k + 1 and begin == k * ogg.PACKET / ogg.RATE and end == min((k + 1) * ogg.PACKET, len(payload)) / ogg.RATE
    assert {r.stream for r in rows if r.doc_id == 2} and {r.end_s for r in rows if r.doc_id == 2} == {0.0, 192 / ogg.RATE}


def test_damaged_rows_end_no_job(spark):
    good = ogg.encode(b"fine")
    broken = good[:40] + b"x" + good[41:]
    media = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(broken)), (3, None), (4, bytearray(b"")), (5, bytearray(good[:-3]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in ogg.media_features(media).collect()}
    assert got[1].error is None and got[1].n_bytes == 4
    assert all(got[k].error and got[k].n_bytes is None for k in (2, 3, 4, 5))
    assert {r.doc_id for r in ogg.media_packets(media).collect()} == {1}
