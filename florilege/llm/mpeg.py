"""MPEG audio: a writer and a reader of MPEG-1 Layer III streams, and media columns made with them.

The writer carries any payload losslessly: an ID3v2 tag with the payload's
length, a frame with a variable-bitrate table, then frames whose granules are
silent and whose bytes after the (empty) main data hold the payload. The reader
knows nothing of the writer: it skips tags, looks for frame headers and
resynchronises after damage, verifies each frame's checksum, and notes exact
durations and every frame's offset.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: kbit/s of MPEG-1 and MPEG-2 Layers I, II, III by index, sampling rates, samples of a frame.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
OWNER = b"florilege.payload\x00"


def _table(poly: int) -> list[int]:
    out = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = (r << 1 ^ poly if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


_CRC = _table(0x8005)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, started with ones."""
    r = 0xFFFF
    for b in data:
        r = (r << 8 & 0xFFFF) ^ _CRC[r >> 8 ^ b]
    return r


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    kbps: int
    hertz: int
    channels: int
    size: int
    samples: int
    guarded: bool
    side: int  # bytes of Layer III side information

    @property
    def body(self) -> int:
        return 4 + 2 * self.guarded + self.side


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """A frame header's fields, or None where the four bytes are none (free format included)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version_bits, layer_bits = four[1] >> 3 & 3, four[1] >> 1 & 3
    rate, hertz = four[2] >> 4, four[2] >> 2 & 3
    if version_bits == 1 or layer_bits == 0 or rate in (0, 15) or hertz == 3:
        return None
    one, layer, mono = version_bits == 3, 4 - layer_bits, four[3] >> 6 == 3
    kbps, hz, pad = KBPS[1 if one else 2, layer][rate], HERTZ[version_bits][hertz], four[2] >> 1 & 1
    if layer == 1:
        size, samples = (12_000 * kbps // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or one else 576
        size = samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return Header({3: 1, 2: 2, 0: 25}[version_bits], layer, kbps, hz, 1 if mono else 2, size, samples, not four[1] & 1, side)


#: Runs of Layer II subbands: (bits of an allocation, subbands).
_FULL, _LOW, _HALF = ((4, 11), (3, 12), (2, 7)), ((4, 2), (3, 10)), ((4, 4), (3, 7), (2, 19))


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in Layers I and II."""
    if h.layer == 1:
        return [4] * 32
    kbps = h.kbps // h.channels
    if h.version != 1:
        runs, bands = _HALF, 30
    elif kbps < 56:
        runs, bands = _LOW, 12 if h.hertz == 32000 else 8
    else:
        runs, bands = _FULL, 30 if kbps >= 96 and h.hertz != 48000 else 27
    return [bits for bits, n in runs for _ in range(n)][:bands]


def guard(h: Header, frame: bytes) -> int:
    """The checksum of what a guarded frame's covers: half of the header, and side information (III), bit allocations (I), or these and the choices of scale factors (II)."""
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side])
    widths, mode = _allocation(h), frame[3] >> 6
    both = 32 if mode != 1 else 4 + 4 * (frame[3] >> 4 & 3)  # from here on, channels share an allocation
    body = frame[6:]
    bits, end = int.from_bytes(body, "big"), 8 * len(body)
    at = chosen = 0
    for band, width in enumerate(widths):
        for _ in range(h.channels if band < both else 1):
            used = bits >> max(end - at - width, 0) & (1 << width) - 1
            chosen += bool(used) * (1 if band < both else h.channels)
            at += width
    at += 2 * chosen if h.layer == 2 else 0
    whole, rest = divmod(at, 8)
    r = crc16(frame[2:4] + body[:whole])
    for i in range(rest):
        bit = bits >> max(end - at + rest - 1 - i, 0) & 1
        r = r << 1 & 0xFFFF ^ (0x8005 if (r >> 15) ^ bit else 0)
    return r


def _vbri_table(frame: bytes) -> list[int]:
    n, scale, size = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58))
    steps = [int.from_bytes(frame[i : i + size], "big") * scale for i in range(62, 62 + n * size, size)] if size and 62 + n * size <= len(frame) else []
    return list(accumulate(steps))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@lru_cache(64)
def _head(index: int) -> tuple[bytes, Header]:
    """Header, checksum and silent side information of a guarded mono Layer III frame at 44.1 kHz."""
    four = bytes((0xFF, 0xFA, index << 4, 0xC0))
    h = header(four)
    side = bytes(h.side)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side, h


def encode(payload: bytes) -> bytes:
    """A stream that carries the payload."""
    full, h = _head(14)
    room = h.size - len(full)
    frames = [full + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(frames) * room :]:
        for index in range(1, 15):
            head, h = _head(index)
            if h.size - len(head) >= len(rest):
                frames.append((head + rest).ljust(h.size, b"\x00"))
                break
    total, ends, at = sum(map(len, frames)), [], 0
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[len(ends) * p // 100] * 256 // max(1, total)) for p in range(100)) if ends else bytes(100)
    head, h = _head(9)
    info = (head + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (total + h.size).to_bytes(4, "big") + toc).ljust(h.size, b"\x00")
    private = OWNER + len(payload).to_bytes(8, "big")
    tag = b"PRIV" + len(private).to_bytes(4, "big") + b"\x00\x00" + private
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + info + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds."""

    tags: dict[str, bytes] = field(default_factory=dict)
    hertz: int = 0
    channels: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    bad_checksums: int = 0
    unguarded: int = 0
    resyncs: int = 0
    skipped: int = 0
    kbit: int = 0
    vbr: str = ""
    vbr_frames: int = -1
    vbr_bytes: int = -1
    vbr_seek: list[int] = field(default_factory=list)  # bytes up to each percent (Xing), or up to each step's end (VBRI)
    bodies: list[tuple[int, int]] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def parse(data: bytes) -> Stream:
    """Read a stream; damaged parts are skipped to the next header that a second one, or the end, confirms."""
    out, at, end = Stream(), 0, len(data)
    while data[at : at + 3] == b"ID3" and end - at >= 10:
        size, p = _unsafe(data[at + 6 : at + 10]), at + 10
        stop = min(end, p + size)
        while p + 10 <= stop and data[p : p + 4].strip(b"\x00"):
            n = int.from_bytes(data[p + 4 : p + 8], "big") if data[at + 3] < 4 else _unsafe(data[p + 4 : p + 8])
            out.tags[data[p : p + 4].decode("latin-1")] = data[p + 10 : p + 10 + n]
            p += 10 + n
        at += 10 + size
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags["ID3v1"], end = data[end - 125 : end], end - 128
    first = True
    while at < end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end:
            start, at = at, at + 1
            while True:
                at = data.find(b"\xff", at, end)
                if at < 0:
                    at = end
                    break
                h = header(data[at : at + 4])
                if h and at + h.size <= end and (at + h.size == end or header(data[at + h.size : at + h.size + 4])):
                    break
                at += 1
            out.resyncs += 1
            out.skipped += at - start
            continue
        if h.guarded:
            if int.from_bytes(data[at + 4 : at + 6], "big") != guard(h, data[at : at + h.size]):
                out.bad_checksums += 1
        else:
            out.unguarded += 1
        name = data[at + h.body : at + h.body + 4]
        if first and h.layer == 3 and name in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[at + h.body + 4 : at + h.body + 8], "big"), at + h.body + 8
            out.vbr = name.decode()
            if flags & 1:
                out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4 and p + 100 <= at + h.size:
                total = out.vbr_bytes if flags & 2 else end - at
                out.vbr_seek = [x * total // 256 for x in data[p : p + 100]]
        elif first and data[at + 36 : at + 40] == b"VBRI":
            out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
            out.vbr_seek = _vbri_table(data[at : at + h.size])
        else:
            out.offsets.append(at)
            out.bodies.append((at + h.body, at + h.size))
            out.samples += h.samples
            out.kbit += h.kbps
        out.hertz, out.channels, first = h.hertz, h.channels, False
        at += h.size
    return out


def decode(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stream that encode() wrote."""
    stream = stream or parse(data)
    n = int.from_bytes(stream.tags["PRIV"].removeprefix(OWNER), "big")
    return b"".join([data[a:b] for a, b in stream.bodies])[:n]


def padded(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 of the text, filled with zeros to a positive multiple of 64; its length without them). Null counts as empty."""
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00"), len(raw)


def feature(s: Stream) -> str:
    crc = zlib.crc32(b"".join(o.to_bytes(8, "big") for o in s.offsets))
    return f"layer3 {s.hertz} Hz {s.channels} ch frames {len(s.offsets)} samples {s.samples} kbit {s.kbit} bad {s.bad_checksums} resync {s.resyncs} {s.vbr} {s.vbr_frames}/{s.vbr_bytes} seek {crc:08x}"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: str = "media") -> DataFrame:
    """Store each text in a media column and read it back.

    outputs "media": doc_id, media binary, duration_s, n_frames, seek_offsets; "digests": what the
    stored form and the payload read back from it hash to. A null text counts as empty.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                payload, n = padded(text)
                stored = encode(payload)
                s = parse(stored)
                if outputs == "media":
                    rows.append((stored, s.seconds, len(s.offsets), s.offsets))
                else:
                    back = decode(stored, s)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(s)))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], ["doc_id", *kinds])

    if outputs == "media":
        kinds = {"media": pa.binary(), "duration_s": pa.float64(), "n_frames": pa.int64(), "seek_offsets": pa.list_(pa.int64())}
        schema = "doc_id long, media binary, duration_s double, n_frames long, seek_offsets array<long>"
    else:
        kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
        schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
