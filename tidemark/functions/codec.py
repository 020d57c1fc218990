"""CRC32C, vectorised over numpy, and the binary records of framed logs."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np

from tidemark.model import Corruption

#: Fixed values of the framed log: block and header sizes, fragment types, operation tags, and the reflected Castagnoli polynomial.
BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
PUT, DELETE, BATCH = 1, 2, 3
POLYNOMIAL = 0x82F63B78

LANE = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _table()


def _slices() -> list[np.ndarray]:
    """For k = 0 .. 7, what a byte contributes with k bytes behind it."""
    out = [TABLE]
    for _ in range(7):
        out.append((out[-1] >> 8) ^ TABLE[out[-1] & 255])
    return out


SLICES = _slices()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _doublings(n: int) -> list[np.ndarray]:
    """For k < n, the map of a checksum to that with 2**k zero bytes behind, as four tables of 256."""
    values = np.arange(256, dtype=np.uint32)
    places = [values << np.uint32(8 * i) for i in range(4)]
    out = [np.stack([(x >> 8) ^ TABLE[x & 255] for x in places])]
    for _ in range(n - 1):
        out.append(np.stack([_apply(out[-1], _apply(out[-1], x)) for x in places]))
    return out


ZEROS = _doublings(32)


def crc32c_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC32C of many byte ranges of `data` (uint8).

    Each range is cut into lanes of LANE bytes, with zeros before the first, which
    change nothing; all lanes are reduced at once, eight bytes a step, and the lanes
    of a range are then folded two by two."""
    out = np.zeros(len(starts), dtype=np.uint32)
    if not lengths.any():
        return out
    lanes = np.maximum(1, -(-lengths // LANE))
    width = 1 << np.ceil(np.log2(lanes)).astype(np.int64)
    for w in np.unique(width):
        for part in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum() * w * LANE) >> 24)):
            block = np.zeros((len(part), w * LANE), dtype=np.uint8)
            for row, start, n in zip(block, starts[part].tolist(), lengths[part].tolist(), strict=True):
                row[w * LANE - n :] = data[start : start + n]
            words = block.reshape(-1, LANE).view("<u4")
            crc = np.zeros(len(words), dtype=np.uint32)
            for i in range(0, LANE // 4, 2):
                x, y = words[:, i] ^ crc, words[:, i + 1]
                crc = _apply(SLICES[7:3:-1], x) ^ _apply(SLICES[3::-1], y)
            crc = crc.reshape(-1, w)
            step = LANE.bit_length() - 1
            while crc.shape[1] > 1:
                crc = _apply(ZEROS[step], crc[:, 0::2]) ^ crc[:, 1::2]
                step += 1
            out[part] = crc[:, 0]
    first = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = lengths >> k & 1 == 1
        first[some] = _apply(ZEROS[k], first[some])
    return out ^ first ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many(np.frombuffer(data, dtype=np.uint8), np.array([0]), np.array([len(data)]))[0])


def frame(records: list[bytes], at: int = 0) -> bytes:
    """Records as checksummed fragments in fixed blocks, beginning at log position `at`."""
    out, heads = bytearray(), []
    for record in records:
        done, first = 0, True
        while done < len(record):
            left = BLOCK - (at + len(out)) % BLOCK
            if left < HEADER:
                out += bytes(left)
                continue
            part = record[done : done + left - HEADER]
            done += len(part)
            last = done == len(record)
            kind = FULL if first and last else FIRST if first else LAST if last else MIDDLE
            heads.append(len(out))
            out += struct.pack("<IHB", 0, len(part), kind) + part
            first = False
    if heads:
        place = np.array(heads)
        sizes = np.array([struct.unpack_from("<H", out, h + 4)[0] for h in heads])
        sums = crc32c_many(np.frombuffer(bytes(out), dtype=np.uint8), place + 6, sizes + 1)
        for h, c in zip(heads, sums.tolist(), strict=True):
            struct.pack_into("<I", out, h, c)
    return bytes(out)


def fragments(data: bytes, check: bool = True, base: int = 0) -> list[tuple[int, int, bytes]]:
    """(position, type, payload) of each fragment; a torn last header is tolerated, all else that is wrong is corruption.

    `base` is where `data` begins in its log, at the start of a block."""
    at, found, sums = 0, [], []
    while at < len(data):
        left = BLOCK - at % BLOCK
        if left < HEADER:
            at += left
            continue
        head = data[at : at + HEADER]
        if len(head) < HEADER:
            break
        if not any(head):
            at += left
            continue
        crc, size, kind = struct.unpack("<IHB", head)
        part = data[at + HEADER : at + HEADER + size]
        if kind not in (FULL, FIRST, MIDDLE, LAST) or size > left - HEADER or len(part) < size:
            raise Corruption(f"bad fragment at {base + at}")
        found.append((at, kind, part))
        sums.append(crc)
        at += HEADER + size
    if check and found:
        places = np.array([f[0] for f in found])
        right = crc32c_many(np.frombuffer(data, dtype=np.uint8), places + 6, np.array([len(f[2]) + 1 for f in found]))
        wrong = np.flatnonzero(right != np.array(sums, dtype=np.uint32))
        if len(wrong):
            raise Corruption(f"checksum differs at {base + places[wrong[0]]}")
    return [(base + at, kind, part) for at, kind, part in found] if base else found


def records(data: bytes) -> Iterator[bytes]:
    return records_of([data])


def records_of(slices: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a log that comes in slices of whole blocks; only the last may be shorter."""
    held, base = None, 0
    for data in slices:
        for at, kind, part in fragments(data, base=base):
            if (kind in (FULL, FIRST)) != (held is None):
                raise Corruption(f"fragment out of order at {at}")
            if kind == FULL:
                yield part
            elif kind == LAST:
                yield bytes(held + part)
                held = None
            else:
                held = bytearray() if held is None else held
                held += part
        base += len(data)
    if held is not None:
        raise Corruption("record does not end")


def encode(seq: int, ops: list[tuple[int, bytes, bytes]]) -> bytes:
    """One record for a batch of (op, key, value); a single operation has no count."""
    packed = [struct.pack("<BHI", op, len(k), len(v)) + k + v for op, k, v in ops]
    if len(ops) == 1:
        return struct.pack("<Q", seq) + packed[0]
    return struct.pack("<QBH", seq, BATCH, len(ops)) + b"".join(packed)


def decode(record: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(seq, op, key, value) of each operation; the i-th has the base sequence plus i."""
    try:
        seq, tag = struct.unpack_from("<QB", record)
        n, at = (struct.unpack_from("<H", record, 9)[0], 11) if tag == BATCH else (1, 8)
        found = []
        for i in range(n):
            op, klen, vlen = struct.unpack_from("<BHI", record, at)
            at += 7
            if op not in (PUT, DELETE) or at + klen + vlen > len(record):
                raise Corruption("bad operation")
            found.append((seq + i, op, record[at : at + klen], record[at + klen : at + klen + vlen]))
            at += klen + vlen
    except struct.error as why:
        raise Corruption("record too short") from why
    if at != len(record):
        raise Corruption("bytes behind the record")
    return found


def encode_timed(ts: int, tomb: bool, key: bytes, value: bytes) -> bytes:
    return struct.pack("<qBHH", ts, tomb, len(key), len(value)) + key + value


def decode_timed(record: bytes) -> tuple[int, bool, bytes, bytes]:
    if len(record) < 13:
        raise Corruption("record too short")
    ts, tomb, klen, vlen = struct.unpack_from("<qBHH", record)
    if len(record) != 13 + klen + vlen or tomb > 1:
        raise Corruption("bad record")
    return ts, bool(tomb), record[13 : 13 + klen], record[13 + klen :]
