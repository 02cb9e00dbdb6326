"""Media columns: texts or other bytes carried by MPEG-1 Layer III streams, and a reader of such streams.

``store`` makes one audio stream of each payload: an ID3v2.4 tag, a frame with the table of a
variable bitrate stream, and frames of silence whose ancillary data is the payload. ``probe`` reads
any MPEG audio bytes: it skips tags, finds frame headers again after damage, checks the CRC of
protected frames, reads the variable-bitrate table, and gives the exact duration and the byte
offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.llm.common import id_and_text, map_batches, texts_of

#: Payloads are filled up with bytes 0 to a positive multiple of this.
UNIT = 64

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version is 1, layer) and index, Hz by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2, 3: 1}
LAYERS = {1: 3, 2: 2, 3: 1}

#: Of the streams made here: mono at 48 kHz, so that every frame has three bytes a kbit/s and 24 ms.
RATE, SAMPLES = 48000, 1152
SIDE_INFO = 17
FRAME_HEAD = 4 + 2 + SIDE_INFO
TABLE_KBITS = 64


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """What the four bytes say, or None if they can't begin a frame. Free-format streams aren't read."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), LAYERS.get(four[1] >> 1 & 3)
    index, rate_index = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer is None or index in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    kbits, rate, padding = BITRATES[version == 1, layer][index], RATES[version][rate_index], four[2] >> 1 & 1
    mono = four[3] >> 6 == 3
    if layer == 1:
        size, samples = (12000 * kbits // rate + padding) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples // 8 * 1000 * kbits // rate + padding
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, kbits, rate, mono, size, samples, side if layer == 3 else 0)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The CRC of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


def synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def from_synchsafe(four: bytes) -> int:
    return sum((b & 0x7F) << shift for b, shift in zip(four, (21, 14, 7, 0), strict=True))


def _frame_head(kbits: int, protected: bool) -> bytes:
    """Header, CRC if protected, and the side information of silence."""
    index = BITRATES[True, 3].index(kbits)
    head = bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC4))
    side = bytes(SIDE_INFO)
    return head + (struct.pack(">H", crc16(head[2:] + side)) if protected else b"") + side


HEADS = {kbits: _frame_head(kbits, True) for kbits in BITRATES[True, 3][1:]}
LARGEST = 3 * 320 - FRAME_HEAD


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        content = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + synchsafe(len(content)) + b"\0\0" + content
    return b"ID3\x04\0\0" + synchsafe(len(body)) + body


def padded(data: bytes) -> bytes:
    return data + bytes(UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def encode(payload: bytes) -> bytes:
    """An audio stream from which ``decode`` gets the payload back."""
    step = LARGEST
    full = len(payload) // step
    rest = payload[full * step :]
    parts = [x for k in range(full) for x in (HEADS[320], payload[k * step : (k + 1) * step])]
    sizes = [960] * full
    if rest or not payload:
        kbits = next(k for k in HEADS if 3 * k - FRAME_HEAD >= len(rest))
        parts += [HEADS[kbits], rest, bytes(3 * kbits - FRAME_HEAD - len(rest))]
        sizes.append(3 * kbits)
    lead = 3 * TABLE_KBITS
    total = lead + sum(sizes)
    frames = len(sizes)
    # Frames before the last have one size, so the byte at each hundredth of the duration follows directly.
    toc = bytes(min(255, 256 * (lead + min(k * frames // 100, frames - 1) * sizes[0]) // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    first = _frame_head(TABLE_KBITS, False) + table
    first += bytes(lead - len(first))
    tag = _tag({"payload_bytes": str(len(payload)), "payload_crc32": f"{zlib.crc32(payload):08x}"})
    return b"".join([tag, first, *parts])


@dataclass
class Probe:
    """What a stream holds. offsets: the first byte of each audio frame; samples by rate give the duration."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    rate: int = 0
    by_kbits: dict[int, int] = field(default_factory=dict)
    crc_checked: int = 0
    crc_failed: int = 0
    skipped: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    offsets: array = field(default_factory=lambda: array("q"))
    bodies: list[bytes] = field(default_factory=list)


def _read_tag(data: bytes, at: int, tags: dict[str, str]) -> int:
    """The end of the ID3v2 tag at this place; its user text frames go to tags."""
    major, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + from_synchsafe(data[at + 6 : at + 10]))
    p = at + 10
    while p + 10 <= end and data[p : p + 4].isalnum():
        size = from_synchsafe(data[p + 4 : p + 8]) if major >= 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        content = data[p + 10 : min(end, p + 10 + size)]
        if data[p : p + 4] == b"TXXX" and content[:1] in (b"\0", b"\x03"):
            key, _, value = content[1:].partition(b"\0")
            tags[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        p += 10 + size
    return end + (10 if flags & 0x10 else 0)


def _of_stream(h: Header | None, kind: tuple | None) -> bool:
    """Whether a header fits the stream, whose version, layer and rate never change."""
    return h is not None and (kind is None or (h.version, h.layer, h.rate) == kind)


def _resync(data: bytes, at: int, end: int, kind: tuple | None) -> int:
    """The next place with a header whose frame another header, or the end, follows; end if there is none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        h = header(data[at : at + 4])
        if _of_stream(h, kind):
            after = at + h.size
            if after == end or (after < end and _of_stream(header(data[after : after + 4]), (h.version, h.layer, h.rate))):
                return at
        at += 1
    return end


def probe(data: bytes) -> Probe:
    out, at, end = Probe(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _read_tag(data, at, out.tags)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags.setdefault("title", data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1"))
        end -= 128
    first, kind = True, None
    if (found := _resync(data, at, end, None)) > at:
        out.skipped += found - at
        at = found
    while at < end:
        h = header(data[at : at + 4])
        if not _of_stream(h, kind) or at + h.size > end:
            found = _resync(data, at + 1, end, kind)
            out.skipped += found - at
            at = found
            continue
        kind = kind or (h.version, h.layer, h.rate)
        frame = data[at : at + h.size]
        body = 4 + 2 * h.protected + h.side
        if first:
            first = False
            mark = frame[4 + h.side : 8 + h.side] if h.layer == 3 else b""
            if mark in (b"Xing", b"Info"):
                p, flags = 8 + h.side, int.from_bytes(frame[8 + h.side : 12 + h.side], "big")
                p += 4
                if flags & 1:
                    out.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
                if flags & 2:
                    out.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
                if flags & 4:
                    out.toc = frame[p : p + 100]
                at += h.size
                continue
        if h.protected and h.layer == 3:
            out.crc_checked += 1
            if crc16(frame[2:4] + frame[6:body]) != frame[4] << 8 | frame[5]:
                out.crc_failed += 1
        out.frames += 1
        out.samples += h.samples
        out.rate = out.rate or h.rate
        out.by_kbits[h.kbits] = out.by_kbits.get(h.kbits, 0) + 1
        out.offsets.append(at)
        out.bodies.append(frame[body:])
        at += h.size
    return out


def decode(data: bytes) -> bytes:
    """The payload of a stream that ``encode`` made; ValueError if it is damaged."""
    found = probe(data)
    payload = b"".join(found.bodies)[: int(found.tags.get("payload_bytes", -1))]
    if found.crc_failed or found.skipped or f"{zlib.crc32(payload):08x}" != found.tags.get("payload_crc32"):
        raise ValueError("the stream is damaged")
    return payload


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of (doc_id, text): the text's stored form.

    A null text counts as empty. Rows stay as they are, repeated ones too; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [t.encode("utf-8") for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([encode(padded(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(id_and_text(documents), run, "doc_id long, n_bytes long, media binary")


MEDIA_SCHEMA = """doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, frames long, samples long, rate int,
 duration_s double, crc_checked long, crc_failed long, skipped_bytes long, table_frames long, seek_offsets array<long>, bitrates string"""


def read(media: DataFrame) -> DataFrame:
    """The stored bytes read back: payload, exact duration, checks and the frames' seek offsets.

    A null media value gives nulls. Damaged frames are counted, and payload is null if it isn't whole.
    """

    def one(doc: int | None, n: int | None, data: bytes | None) -> tuple:
        if data is None:
            return (doc, n, *[None] * 13)
        p = probe(data)
        payload = b"".join(p.bodies)[: int(p.tags.get("payload_bytes", 0))]
        whole = not p.crc_failed and not p.skipped and f"{zlib.crc32(payload):08x}" == p.tags.get("payload_crc32")
        rates = ",".join(f"{k}x{v}" for k, v in sorted(p.by_kbits.items()))
        return (doc, n, payload if whole else None, len(data), hashlib.sha256(data).hexdigest(), p.frames, p.samples, p.rate, p.samples / p.rate if p.rate else 0.0, p.crc_checked, p.crc_failed, p.skipped, p.table_frames, p.offsets.tolist(), rates)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        names = [x.split()[0] for x in MEDIA_SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, MEDIA_SCHEMA)
