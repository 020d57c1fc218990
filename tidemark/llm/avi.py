"""AVI motion-JPEG columns: index parsing, intra-frame decoding, shot detection.

A baseline JPEG block has 64 quantised coefficients.  The lossless store uses
them as its unit: byte b is coefficient b + 256, in size category 9, so each one
takes a 7-bit code and 9 bits whatever its value, and a unit of 192 bytes is one
8 x 8 block of each of three components.  Restart markers after every unit reset
the DC prediction.  The decoder handles general baseline frames; streams whose
tables make all coefficients equally long are decoded in one numpy step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
UNITS_A_FRAME = 16
FPS = 25
BINS = 32
SHIFT, CATEGORY, CODE_BITS = 256, 9, 7

# Encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(units: int) -> bytes:
    one = bytes([0] * (CODE_BITS - 1) + [1] + [0] * (16 - CODE_BITS))
    tables = b"".join(bytes([kind << 4]) + one + bytes([CATEGORY]) for kind in (0, 1))
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * units, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3)))
        + _segment(0xC4, tables)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x03" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\x00\x3f\x00")
    )


_HEADS = {u: _frame_head(u) for u in range(1, UNITS_A_FRAME + 1)}


def encode_frame(payload: bytes) -> bytes:
    """One JPEG of len(payload) / UNIT blocks a component."""
    units = len(payload) // UNIT
    scan = np.empty((units, 2 * UNIT + 2), dtype=np.uint8)
    scan[:, 0 : 2 * UNIT : 2] = 1  # code 0000000, then the leading bit of b + 256
    scan[:, 1 : 2 * UNIT : 2] = np.frombuffer(payload, dtype=np.uint8).reshape(units, UNIT)
    scan[:, -2] = 0xFF
    scan[:, -1] = 0xD0 + np.arange(units) % 8
    if b"\xff" in payload:
        data = b"".join(row[:-2].tobytes().replace(b"\xff", b"\xff\x00") + row[-2:].tobytes() for row in scan)[:-2]
    else:
        data = scan.tobytes()[:-2]
    return _HEADS[units] + data + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """AVI with one motion-JPEG stream and an idx1 index; the payload's length is a positive multiple of UNIT."""
    step = UNIT * UNITS_A_FRAME
    frames = [encode_frame(payload[i : i + step]) for i in range(0, len(payload), step)]
    width, height, n = 8 * min(UNITS_A_FRAME, len(payload) // UNIT), 8, len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, max(map(len, frames)), width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    at, index, movi = 4, [], [b"movi"]
    for frame in frames:
        packed = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        movi.append(packed)
        at += len(packed)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


# Parsing


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(microseconds a frame, [(begin, end) of each video frame]) from idx1, or from the movi list where there is no usable index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    period, movi, index = 1_000_000 // FPS, None, []
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, x, _ in _chunks(data, a + 4, b):
                if inner == b"avih":
                    period = struct.unpack_from("<I", data, x)[0]
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, x) for x in range(a, b - 15, 16)]
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    for name, _, offset, size in index:
        if name[2:4] in (b"dc", b"db"):
            begin = movi[0] + offset  # offsets count from the list's type; some writers count from the file's start
            if data[begin : begin + 4] != name:
                begin = offset
            if data[begin : begin + 4] != name:
                frames = []
                break
            frames.append((begin + 8, begin + 8 + size))
    return period, frames or [(a, b) for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:4] in (b"dc", b"db")]


ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))), dtype=np.int64)


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * len(data) + 64

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("scan ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        x = self.take(size) if size else 0
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _huffman(body: bytes, tables: dict) -> None:
    at = 0
    while at < len(body):
        counts, values, code, table = body[at + 1 : at + 17], at + 17, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[values]
                values, code = values + 1, code + 1
            code <<= 1
        tables[body[at]] = table
        at = values


def decode_frame(data: bytes) -> dict:
    """Quantised coefficients (blocks x 64, zigzag order) of each component of a baseline JPEG, with its quantisation tables."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, restart, parts = 2, {}, {}, 0, []
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            x = 0
            while x < len(body):
                wide = body[x] >> 4
                quant[body[x] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, x + 1).astype(np.float32)
                x += 65 + 64 * wide
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            parts = [{"id": body[i], "h": body[i + 1] >> 4, "v": body[i + 1] & 15, "q": body[i + 2]} for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            _huffman(body, huff)
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                part = next(p for p in parts if p["id"] == body[1 + 2 * i])
                part["dc"], part["ac"] = body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15
            break
    across, down = max(p["h"] for p in parts), max(p["v"] for p in parts)
    units = -(-width // (8 * across)) * -(-height // (8 * down))
    blocks = sum(p["h"] * p["v"] for p in parts)
    end = data.rfind(b"\xff\xd9")
    scan = data[at : end if end >= at else len(data)]
    table = huff[parts[0]["dc"]]
    uniform = restart == 1 and all(huff[p["dc"]] == table == huff[p["ac"]] for p in parts) and list(table) == [(CODE_BITS, 0)] and list(table.values()) == [16 - CODE_BITS]
    if uniform and len(scan) == units * (128 * blocks + 2) - 2:
        rows = np.frombuffer(scan + b"\xff\xd0", dtype=np.uint8).reshape(units, 128 * blocks + 2)
        if (rows[:, 0:-2:2] == 1).all() and (rows[:, -2] == 0xFF).all():  # positive values of category 9 throughout
            all_blocks = rows[:, 1:-2:2].astype(np.int32).reshape(units, blocks, 64) + SHIFT
            return _components(all_blocks, parts, quant, width, height)
    out = np.zeros((units, blocks, 64), dtype=np.int32)
    pieces = [scan]
    if restart:
        cuts = [i for i in range(len(scan) - 1) if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7]
        pieces = [scan[a:b] for a, b in zip([0, *[c + 2 for c in cuts]], [*cuts, len(scan)], strict=True)]
    unit = 0
    for piece in pieces:
        bits, last = _Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for _ in range(restart or units):
            if unit == units:
                break
            block = 0
            for c, part in enumerate(parts):
                for _ in range(part["h"] * part["v"]):
                    last[c] += bits.number(bits.symbol(huff[part["dc"]]))
                    out[unit, block, 0] = last[c]
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.symbol(huff[part["ac"]]), 16)
                        if not size and run != 15:
                            break
                        k += run
                        if size:
                            out[unit, block, k] = bits.number(size)
                        k += 1
                    block += 1
            unit += 1
    return _components(out, parts, quant, width, height)


def _components(blocks: np.ndarray, parts: list, quant: dict, width: int, height: int) -> dict:
    found, at = [], 0
    for p in parts:
        n = p["h"] * p["v"]
        found.append((blocks[:, at : at + n].reshape(-1, 64), quant[p["q"]]))
        at += n
    return {"width": width, "height": height, "units": len(blocks), "components": found, "blocks": blocks}


def _idct() -> np.ndarray:
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, 8**-0.5, 0.5)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


IDCT = _idct()


def luma(frame: dict) -> np.ndarray:
    """8-bit samples of the first component, block by block."""
    coefficients, quant = frame["components"][0]
    return np.clip(np.rint((coefficients * quant) @ IDCT + 128), 0, 255).astype(np.uint8)


# Shots


def histogram(frame: dict) -> np.ndarray:
    samples = luma(frame)
    return np.bincount(samples.ravel() >> 3, minlength=BINS) / samples.size


def shots(histograms: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.15) -> list[tuple[int, int]]:
    """[begin, end) frame ranges.  A cut is where the histogram difference exceeds mean + factor * deviation of the last `window` differences, and `least`."""
    if not len(histograms):
        return []
    steps = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for i, d in enumerate(steps):
        past = steps[max(since, i - window) : i]
        limit = max(least, past.mean() + factor * past.std()) if len(past) else max(least, 0.5)
        if d > limit:
            cuts.append(i + 1)
            since = i + 1
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True))


CLIP_SCHEMA = "clip int, start_ms long, end_ms long, frames int, error string"


def clips_of(data: bytes | None) -> list[tuple]:
    """(clip, start_ms, end_ms, frames, error) rows; one row with the reason where the file is damaged, none for null."""
    if data is None:
        return []
    try:
        period, frames = parse_avi(data)
        found = shots(np.array([histogram(decode_frame(data[a:b])) for a, b in frames]))
    except (ValueError, IndexError, KeyError, StopIteration, struct.error) as why:
        return [(0, 0, 0, 0, str(why) or type(why).__name__)]
    return [(i, a * period // 1000, b * period // 1000, b - a, None) for i, (a, b) in enumerate(found)]


def timed_clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each shot of each AVI value: (id, clip, start_ms, end_ms, frames, error)."""

    def run(batches):
        for batch in batches:
            for i, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = clips_of(data.as_py())
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(rows), i.type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "clip", "start_ms", "end_ms", "frames", "error"])

    kind = dict(media.dtypes)[id_col]
    return media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {kind}, {CLIP_SCHEMA}")


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_digest(text: bytes) -> tuple:
    """Store a text as AVI, read the stored bytes back, and describe both."""
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    media = encode_avi(payload)
    period, places = parse_avi(media)
    frames = [decode_frame(media[a:b]) for a, b in places]
    back = b"".join((f["blocks"] - SHIFT).astype(np.uint8).tobytes() for f in frames)
    found = shots(np.array([histogram(f) for f in frames]))
    feature = f"frames={len(frames)};clips=" + ",".join(f"{a * period // 1000}-{b * period // 1000}" for a, b in found)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            rows = [stored_digest(x.as_py() or b"") for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, DIGEST_SCHEMA)
