"""Media columns: MPEG audio streams that carry bytes, and a scanner that resynchronises, checks and indexes them.

`encode` stores a payload losslessly as the ancillary data of MPEG-1 layer III frames (48 kHz, mono, 256 kbit/s, 768 bytes a frame,
with checksum): 576 bytes a frame, the format's unit. An ID3v2 tag holds the payload's length, an Info frame the frame and byte counts
and the seek table. `scan` takes any MPEG audio bytes: it skips tags, finds the first frame header that a second confirms, follows frame
lengths, resynchronises after garbage, verifies the CRC-16 of protected frames, parses Xing/Info tables, and returns exact duration,
frame seek offsets and the ancillary payload.

Defined results: null and empty texts are an empty payload, padded to one frame. Bytes without a frame give zero frames and no payload. Equal
texts give equal values. Texts of any length work; a text's stream is built in one array of 4/3 of its size. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common

UNIT, FRAME, HEADER, SIDE = 576, 768, 4, 17
#: kbit/s by index, for MPEG-1 layers I, II, III and MPEG-2 layers I, II/III; fixed values of the format.
KBIT = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = ((t << 1) ^ np.where(t & 0x8000, 0x8005, 0)) & 0xFFFF
    return t.astype(np.uint16)


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, start 0xFFFF) of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for j in range(rows.shape[1]):
        c = ((c << np.uint16(8)) & np.uint16(0xFFFF)) ^ CRC[(c >> np.uint16(8)) ^ rows[:, j]]
    return c


@dataclass
class Header:
    version: int
    layer: int
    protected: bool
    kbit: int
    hertz: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header(b: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format and reserved values are no headers."""
    if len(b) < 4 or b[0] != 255 or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz, pad = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3, b[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    kbit, hertz = KBIT[1 if version == 3 else 2, layer][rate], HERTZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbit * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hertz + pad
    return Header(version, layer, not b[1] & 1, kbit, hertz, b[3] >> 6 == 3, size, samples)


HEAD = bytes([0xFF, 0xFA, 0xD4, 0xC4])  # MPEG-1, layer III, protected, 256 kbit/s, 48 kHz, mono


def padded(raw: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def encode(raw: bytes) -> bytes:
    """The stream that carries padded(raw)."""
    payload = padded(raw)
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEAD, np.uint8)
    crc = crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6 : 6 + SIDE]], 1))[0]
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[1:, 6 + SIDE : 6 + SIDE + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, 6 + SIDE : 6 + SIDE + len(info)] = np.frombuffer(info, np.uint8)
    text = b"\x00payload\x00" + str(len(raw)).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag + frames.tobytes()


@dataclass
class Scan:
    tags: dict = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    samples: int = 0
    hertz: int = 0
    skipped: int = 0
    crc_bad: int = 0
    crc_seen: int = 0
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def _id3(data: bytes, out: Scan) -> int:
    """Parse ID3v2 tags at the beginning; where audio may begin."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((data[at + 6 + i] & 127) << (21 - 7 * i) for i in range(4))
        p, end, major = at + 10, min(len(data), at + 10 + size), data[at + 3]
        while major >= 3 and p + 10 <= end and data[p : p + 4].isalnum():
            raw = data[p + 4 : p + 8]
            n = sum((x & 127) << (21 - 7 * i) for i, x in enumerate(raw)) if major == 4 else int.from_bytes(raw, "big")
            body = data[p + 10 : min(end, p + 10 + n)]
            name = data[p : p + 4].decode()
            if name == "TXXX" and body[:1] == b"\x00":
                key, _, value = body[1:].partition(b"\x00")
                out.tags[f"TXXX:{key.decode('latin-1')}"] = value.decode("latin-1")
            elif name[0] == "T":
                out.tags[name] = body[1:].decode("latin-1" if body[:1] == b"\x00" else "utf-16" if body[:1] == b"\x01" else "utf-8", "replace").strip("\x00")
            p += 10 + n
        at = min(len(data), at + 10 + size)
    return at


def _table(body: bytes, h: Header, out: Scan) -> bool:
    """Parse a Xing, Info or VBRI table in a frame's bytes after the header (and checksum)."""
    p = h.side
    if body[p : p + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(body[p + 4 : p + 8], "big")
        out.vbr["kind"], q = body[p : p + 4].decode(), p + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out.vbr[name] = int.from_bytes(body[q : q + 4], "big")
                q += 4
        if flags & 4:
            out.vbr["toc"] = list(body[q : q + 100])
        return True
    if body[32:36] == b"VBRI":
        out.vbr |= {"kind": "VBRI", "bytes": int.from_bytes(body[42:46], "big"), "frames": int.from_bytes(body[46:50], "big")}
        return True
    return False


def scan(data: bytes) -> Scan:
    """Tags, variable-bitrate table, frame offsets, exact duration, checksums and ancillary payload of a stream."""
    out = Scan()
    at, end, first, chunks, synced = _id3(data, out), len(data), True, [], False
    if data[-128:-125] == b"TAG" and end - 128 >= at:
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    view, protected = memoryview(data), []
    while at + 4 <= end:
        h = header(data[at : at + 4])
        # a lone match is no frame: a second header, or the end, must follow the first one after a loss of sync
        if h and at + h.size <= end and (synced or at + h.size == end or header(data[at + h.size : at + h.size + 4])):
            synced = True
            begin = at + HEADER + 2 * h.protected
            if h.protected and h.layer == 3:
                protected.append((at, h.side))
            is_table = first and h.layer == 3 and _table(bytes(view[begin : at + min(h.size, 256)]), h, out)
            if not is_table:
                out.offsets.append(at)
                out.samples, out.hertz = out.samples + h.samples, h.hertz
                chunks.append(view[begin + h.side : min(begin + h.side + UNIT, at + h.size)])
            first, at = False, at + h.size
            continue
        if synced:
            synced = False
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        out.skipped += step - at
        at = step
    rows = np.frombuffer(data, np.uint8)
    for side in {s for _, s in protected}:
        starts = np.array([a for a, s in protected if s == side])
        for k in range(0, len(starts), 4096):
            mine = starts[k : k + 4096, None]
            held = np.concatenate([rows[mine + [2, 3]], rows[mine + np.arange(6, 6 + side)]], 1)
            stored = rows[mine[:, 0] + 4].astype(np.uint16) << 8 | rows[mine[:, 0] + 5]
            out.crc_bad += int((crc16(held) != stored).sum())
        out.crc_seen += len(starts)
    out.payload = b"".join(chunks)
    return out


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media (the stream) and n_bytes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([encode((t or "").encode("utf-8", "surrogatepass")) for t in b], dtype=object)

    return docs.withColumns({"media": run(F.col(text)), "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


SCANNED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, seconds double, seek_offsets array<long>"


def features(data: bytes) -> tuple:
    s = scan(data)
    feature = f"mpeg1-l3;hz={s.hertz};frames={len(s.offsets)};samples={s.samples};vbr={s.vbr.get('kind', '-')}:{s.vbr.get('frames', 0)}:{s.vbr.get('bytes', 0)};crc={s.crc_seen - s.crc_bad}/{s.crc_seen};skipped={s.skipped};tag={s.tags.get('TXXX:payload', '-')};seek={zlib.crc32(np.array(s.offsets, '<u8').tobytes()):08x}"
    return len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(s.offsets), s.seconds, s.offsets


def scanned(media: DataFrame, column: str = "media") -> DataFrame:
    """media with the scanner's columns, from the stored bytes alone. Null bytes scan as empty."""

    @F.pandas_udf(SCANNED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCANNED.split(", ")]
        for b in batches:
            yield pd.DataFrame([features(bytes(x or b"")) for x in b], columns=names)

    names = [x.split()[0] for x in SCANNED.split(", ")]
    tmp = common.unused(media, "scan")
    out = media.withColumn(tmp, run(F.col(column)))
    return out.select(*[F.col(f"`{c}`") for c in media.columns if c not in names], *[F.col(f"{tmp}.{n}").alias(n) for n in names])


def op8(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return scanned(common.saved(stored(docs).select("doc_id", "n_bytes", "media"), "media")).drop("media")
