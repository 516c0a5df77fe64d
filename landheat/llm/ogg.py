"""Media columns in Ogg: texts stored as 8-bit samples in a container of two logical streams, and read back from it."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from landheat.llm.common import slices

#: Payloads are padded with spaces to a positive multiple of this.
UNIT = 192
#: Samples a packet and a second; segments a page holds at most.
PACKET, RATE, SEGMENTS = 4800, 8000, 255
MAGIC, NOTES = b"\x7fSAMPLES8", b"\x7fNOTES"
CONTINUED, FIRST, LAST = 1, 2, 4
#: Granule position of a page on which no packet ends.
NO_END = (1 << 64) - 1
#: What reading a damaged container can raise.
DAMAGE = (ValueError, KeyError, IndexError, StopIteration, TypeError)

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of the container: polynomial 04c11db7, first bit first, from 0 and without a final turn.

    zlib has the mirrored one, so the bytes go in mirrored, and so does the result.
    """
    found = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(found.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little") + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
    tail = bytes([len(lacing)]) + lacing + body
    return head + checksum(head + bytes(4) + tail).to_bytes(4, "little") + tail


def pages_of(serial: int, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """The pages of one logical stream; ends: the granule position at each packet's end. The first packet has its own."""
    out = [_page(FIRST, ends[0], serial, 0, _lacing(packets[0]), packets[0])]
    lacing, body = b"".join(map(_lacing, packets[1:])), b"".join(packets[1:])
    done, at, open_ = 0, 0, False
    for k in range(0, max(1, len(lacing)), SEGMENTS):
        part = lacing[k : k + SEGMENTS]
        size, closed = sum(part), len(part) - part.count(255)
        done += closed
        flags = CONTINUED * open_ | LAST * (k + SEGMENTS >= len(lacing))
        out.append(_page(flags, ends[done] if closed else NO_END, serial, len(out), part, body[at : at + size]))
        at, open_ = at + size, part[-1:] == b"\xff"
    return out


def _lacing(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def payload_of(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)


def encode(text: bytes) -> bytes:
    """The container of one text: a stream of its samples and one of notes (its length), page by page in turn."""
    payload = payload_of(text)
    own = zlib.crc32(payload)
    head = MAGIC + RATE.to_bytes(4, "little") + len(payload).to_bytes(8, "little")
    packets = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    ends = [0, *np.cumsum([len(p) for p in packets]).tolist()]
    samples = pages_of(own, [head, *packets], ends)
    notes = pages_of(own ^ 0xFFFFFFFF, [NOTES, json.dumps({"bytes": len(text)}).encode()], [0, ends[-1]])
    # both streams' first pages come before all others
    return b"".join([samples[0], notes[0], *samples[1:-1], notes[1], samples[-1]])


@dataclass
class Stream:
    """A logical stream as read: its packets, the page each ends on and that page's granule position, and page counts."""

    packets: list[bytes]
    granules: list[int]
    pages: int
    continued: int
    closed: bool
    ends_on: list[int]

    def spans(self, lengths: list[int]) -> list[tuple[int, int]]:
        """Begin and end of each packet in samples, if packet i holds lengths[i] of them.

        A page's granule position is the end of the last packet that ends on it; a packet before that ends earlier by
        what the later ones of the page hold.
        """
        out, after = [], 0
        for k in range(len(lengths) - 1, -1, -1):
            after = 0 if k + 1 == len(lengths) or self.ends_on[k] != self.ends_on[k + 1] else after + lengths[k + 1]
            out.append((self.granules[k] - after - lengths[k], self.granules[k] - after))
        return out[::-1]


def decode(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages.

    Every page's checksum and number are verified; packets are put together from the lacing values, over page ends
    where they go on. Raises ValueError on damage.
    """
    parts: dict[int, list] = {}
    at = 0
    while at < len(media):
        if media[at : at + 5] != b"OggS\0" or at + 27 > len(media):
            raise ValueError(f"no page at byte {at}")
        flags, n = media[at + 5], media[at + 26]
        granule, serial, number = (int.from_bytes(media[at + a : at + b], "little") for a, b in ((6, 14), (14, 18), (18, 22)))
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if len(page) != end - at or checksum(page[:22] + bytes(4) + page[26:]) != int.from_bytes(page[22:26], "little"):
            raise ValueError(f"damaged page at byte {at}")
        own = parts.setdefault(serial, [])
        if number != len(own) or bool(flags & FIRST) != (not own) or (own and own[-1][0] & LAST):
            raise ValueError(f"page out of turn at byte {at}")
        if own and bool(flags & CONTINUED) != (own[-1][2][-1:] == b"\xff"):
            raise ValueError(f"packet cut at byte {at}")
        own.append((flags, granule, lacing, page[27 + n :]))
        at = end
    return {serial: _stream(own) for serial, own in parts.items()}


def _stream(pages: list) -> Stream:
    lacing = np.frombuffer(b"".join(p[2] for p in pages), np.uint8)
    body = b"".join(p[3] for p in pages)
    ends = np.cumsum(lacing, dtype=np.int64)
    last = np.flatnonzero(lacing < 255)
    stops = ends[last].tolist()
    packets = [body[a:b] for a, b in zip([0, *stops[:-1]], stops)]
    page = np.repeat(np.arange(len(pages)), [len(p[2]) for p in pages])[last].tolist()
    return Stream(packets, [pages[k][1] for k in page], len(pages), sum(p[0] & CONTINUED for p in pages), bool(pages[-1][0] & LAST), page)


def packet_lengths(stream: Stream) -> list[int]:
    """Samples in each packet: a byte each, but none in heads and notes."""
    sounds = stream.packets[0].startswith(MAGIC)
    return [len(p) if sounds and k else 0 for k, p in enumerate(stream.packets)]


def read_back(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and features of a container of `encode`."""
    streams = decode(media)
    samples = next(s for s in streams.values() if s.packets[0].startswith(MAGIC))
    notes = next(s for s in streams.values() if s.packets[0].startswith(NOTES))
    head = samples.packets[0][len(MAGIC) :]
    rate, total = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:12], "little")
    payload = b"".join(samples.packets[1:])
    if len(payload) != total or samples.granules[-1] != total or not (samples.closed and notes.closed):
        raise ValueError("samples are missing")
    spans = samples.spans(packet_lengths(samples))
    if any(a[1] != b[0] for a, b in zip(spans, spans[1:])):
        raise ValueError("packets leave gaps in time")
    values = np.frombuffer(payload, np.uint8)
    features = {
        "streams": len(streams),
        "pages": samples.pages + notes.pages,
        "packets": len(samples.packets) + len(notes.packets),
        "continued": samples.continued,
        "seconds": f"{total / rate:.3f}",
        "last_packet": f"{spans[-1][0] / rate:.3f}-{spans[-1][1] / rate:.3f}",
        "mean": f"{values.mean():.3f}",
        "peak": int(values.max()),
        "turns": int((np.diff(values.astype(np.int16)) < 0).sum()),
    }
    return payload, json.loads(notes.packets[1])["bytes"], ";".join(f"{k}={v}" for k, v in features.items())


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 512):
        texts = part.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(t or b"") for t in texts], pa.binary())], names=["doc_id", "media"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    for batch in slices(batches, 512):
        rows = []
        for media in batch.column(1).to_pylist():
            known = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
            try:
                payload, n, feature = read_back(media or b"")
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *known, feature, None))
            except DAMAGE as e:
                rows.append((None, None, None, None, *known, None, "no media" if media is None else f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
    for batch in slices(batches, 64):
        ids, rows = [], []
        for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                for serial, stream in decode(media or b"").items():
                    head = stream.packets[0]
                    rate = int.from_bytes(head[len(MAGIC) : len(MAGIC) + 4], "little") if head.startswith(MAGIC) else RATE
                    for k, ((a, b), packet) in enumerate(zip(stream.spans(packet_lengths(stream)), stream.packets)):
                        ids.append(doc_id)
                        rows.append((serial, k, len(packet), a / rate, b / rate, packet))
            except DAMAGE:
                continue
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["doc_id", "stream", "packet", "bytes", "begin_s", "end_s", "content"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text (null: empty) as UTF-8, padded with spaces, in a container of its own.

    Equal texts give equal bytes, of any length; null ids and repeated rows keep their rows; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encoded, f"doc_id {kind}, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Verifies and reads each container of (doc_id, media), one row each; `error` tells what is damaged, else null.

    Damaged and null media have no features and end no job; repeated rows, null ids and long media keep their rows; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    kind = dict(media.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "media").mapInArrow(_measured, out)


def media_packets(media: DataFrame) -> DataFrame:
    """(doc_id, stream, packet, bytes, begin_s, end_s, content): the packets of every logical stream with their times.

    Media that are null or damaged give no rows; media_features tells which those are.
    """
    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "media").mapInArrow(_packets, f"doc_id {kind}, stream long, packet int, bytes long, begin_s double, end_s double, content binary")
