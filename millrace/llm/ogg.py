"""Byte payloads as media columns in Ogg pages, written and read back.

The container is that of RFC 3533: pages with a checksum, packets cut into segments
whose lacing values give their lengths, several logical streams in one physical
stream, and granule positions as the clock. Here the first stream carries a payload
as 8-bit mono samples, the second a packet with the length before padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, releasing

RATE = 8000
PACKET = 960
UNIT = 192
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: The identification packets of the two streams.
AUDIO, TRACK = b"\x01pcm8u" + struct.pack("<IB", RATE, 1), b"\x01length"

_MIRROR = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC (0x04c11db7, most significant bit first, no inversions) by way of
    zlib's, which is that polynomial mirrored."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    bare = HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + page_checksum(bare).to_bytes(4, "little") + bare[26:]


def _lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def _pages(serial: int, lengths: list[int], body: bytes, granules: np.ndarray, number: int, last: bool) -> Iterator[bytes]:
    """Pages of packets of these lengths; granules: the position at the end of each."""
    lacing = b"".join(map(_lacing, lengths))
    values = np.frombuffer(lacing, dtype=np.uint8)
    ends = np.cumsum(values, dtype=np.int64)
    done = np.cumsum(values < 255)
    continued = False
    for start in range(0, len(values), 255):
        stop = min(start + 255, len(values))
        before, after = (int(done[start - 1]) if start else 0), int(done[stop - 1])
        granule = int(granules[after - 1]) if after > before else -1
        kind = CONTINUED * continued | LAST * (last and stop == len(values))
        yield _page(kind, granule, serial, number, lacing[start:stop], body[int(ends[start - 1]) if start else 0 : int(ends[stop - 1])])
        continued, number = values[stop - 1] == 255, number + 1


def encode(payload: bytes, unpadded: int) -> bytes:
    """The physical stream of a payload. The same payload and length give the same
    bytes: serial numbers come from the payload."""
    serial = zlib.crc32(payload)
    lengths = [PACKET] * (len(payload) // PACKET) + ([len(payload) % PACKET] if len(payload) % PACKET else [])
    pages = [_page(FIRST, 0, serial, 0, _lacing(len(AUDIO)), AUDIO), _page(FIRST, 0, serial ^ 1, 0, _lacing(len(TRACK)), TRACK)]
    audio = list(_pages(serial, lengths, payload, np.cumsum(lengths, dtype=np.int64), 1, True))
    note = struct.pack("<q", unpadded)
    track = list(_pages(serial ^ 1, [len(note)], note, np.array([len(payload)]), 1, True))
    return b"".join([*pages, *audio[:1], *track, *audio[1:]])


@dataclass
class Stream:
    """A logical stream: its packets, each with the granule position at its end, or
    -1 where no page with a position has closed it."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)

    def add(self, kind: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number != self.pages or self.ended:
            raise ValueError(f"stream {self.serial:08x}: page {number} after {self.pages} pages")
        if bool(kind & CONTINUED) != bool(self._open):
            raise ValueError(f"stream {self.serial:08x}: a packet breaks off at page {number}")
        start, at, closed = 0, 0, False
        for value in lacing:
            at += value
            if value < 255:
                packet = body[start:at]
                self.packets.append(b"".join([*self._open, packet]) if self._open else packet)
                self.granules.append(-1)
                self._open, start, closed = [], at, True
        if start < at or (lacing and lacing[-1] == 255):
            self._open.append(body[start:at])
        if closed:
            self.granules[-1] = granule
        self.pages += 1
        self.ended = bool(kind & LAST)


def demultiplex(media: bytes) -> list[Stream]:
    """The logical streams in order of appearance. Raises ValueError for a wrong
    checksum, a lost page, or a packet or stream that breaks off."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if media[at : at + 5] != b"OggS\x00" or at + HEADER.size > len(media):
            raise ValueError(f"no page at byte {at}")
        _, _, kind, granule, serial, number, checksum, segments = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + segments]
        end = at + HEADER.size + segments + sum(lacing)
        page = media[at:end]
        if len(page) != end - at or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise ValueError(f"page at byte {at}: wrong checksum")
        if bool(kind & FIRST) == (serial in streams):
            raise ValueError(f"page at byte {at}: stream {serial:08x} begins twice or not at all")
        streams.setdefault(serial, Stream(serial)).add(kind, granule, number, lacing, page[HEADER.size + segments :])
        at = end
    for stream in streams.values():
        if not stream.ended or stream._open:
            raise ValueError(f"stream {stream.serial:08x} breaks off")
    return list(streams.values())


def packet_times(stream: Stream, rate: int = RATE) -> list[tuple[float, float]]:
    """Start and end in seconds of each data packet of a sample stream: granule
    positions give the ends that pages close, packet lengths those between, and the
    two must agree."""
    ends = np.cumsum([len(p) for p in stream.packets[1:]])
    for end, granule in zip(ends.tolist(), stream.granules[1:], strict=True):
        if granule not in (-1, end):
            raise ValueError(f"stream {stream.serial:08x}: position {granule} after {end} samples")
    return [((end - len(p)) / rate, end / rate) for end, p in zip(ends.tolist(), stream.packets[1:], strict=True)]


def decode(media: bytes) -> tuple[bytes, int, str]:
    """The payload, its length before padding, and features of the media."""
    audio, track = demultiplex(media)
    if audio.packets[0] != AUDIO or track.packets[0] != TRACK:
        raise ValueError("not the streams that encode() writes")
    times = packet_times(audio)
    payload = b"".join(audio.packets[1:])
    samples = np.frombuffer(payload, dtype=np.uint8)
    level = int(samples.sum(dtype=np.int64)) // len(samples)
    crossings = int(np.count_nonzero(np.diff(samples >= level)))
    feature = f"streams=2;pages={audio.pages + track.pages};packets={len(audio.packets) + len(track.packets)};millis={round(times[-1][1] * 1000)};level={level};crossings={crossings}"
    return payload, struct.unpack("<q", track.packets[1])[0], feature


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media of every document, written to the shared scratch folder."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.record_batch([part.column(0), pa.array([encode(*padded(x)) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return materialize(docs.select("doc_id", F.col("text")).mapInArrow(releasing(written), "doc_id long, media binary"), "ogg-media")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """Decode the media column and digest what was read."""

    def row(doc_id: int | None, stored: bytes) -> tuple:
        payload, unpadded, feature = decode(stored)
        return doc_id, unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(d, m.as_py()) for d, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if rows:
                kinds = [pa.string() if " string" in f else pa.int64() for f in READ.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])

    return media.select("doc_id", "media").mapInArrow(releasing(read), READ)


def media_table(docs: DataFrame) -> DataFrame:
    """Store every document's text as Ogg media, read the media back, and return the
    columns of ``READ``.

    A null text is empty, an empty one a payload of one unit of spaces; repeated rows
    stay; an empty table gives no rows; other columns are left out. Damaged media
    raise ValueError.
    """
    return read_media(write_media(docs))
