"""Byte-order key bounds, for Python values and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import InvalidConfig


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None where there is none (empty or all 0xFF)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def text_prefix_end(prefix: str) -> str | None:
    """prefix_end for UTF-8 text keys: the next code point after the last one that has a successor."""
    chars = list(prefix)
    while chars:
        code = ord(chars[-1]) + 1
        if code <= 0x10FFFF:
            return "".join(chars[:-1]) + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
        chars.pop()
    return None


def check_bounds(start, end) -> None:
    if start is not None and end is not None and start > end:
        raise InvalidConfig(f"start {start!r} is after end {end!r}")


def in_bounds(k: Column, start=None, end=None) -> Column:
    """start <= k < end; a missing side is open."""
    check_bounds(start, end)
    low = F.lit(True) if start is None else k >= F.lit(start)
    return low if end is None else low & (k < F.lit(end))


def file_overlaps(min_k: Column, max_k: Column, start: Column, end: Column) -> Column:
    """Whether [min_k, max_k] meets [start, end); null bounds are open."""
    return (end.isNull() | (min_k < end)) & (start.isNull() | (max_k >= start))


def ranges_overlap(min_a: Column, max_a: Column, min_b: Column, max_b: Column) -> Column:
    return (max_a >= min_b) & (max_b >= min_a)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Bytes that both begin with, for keys up to 131,071 bytes; found by halving, so each step is one comparison of bytes."""
    a, b = a.cast("binary"), b.cast("binary")
    shorter = F.least(F.octet_length(a), F.octet_length(b))

    def longer(n, step):
        return F.when((n + step <= shorter) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)

    return F.when(shorter.isNotNull(), F.aggregate(F.array(*[F.lit(1 << i) for i in range(16, -1, -1)]), F.lit(0), longer))


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned LEB128 number."""
    return F.greatest(F.ceil(F.length(F.bin(x)) / 7), F.lit(1)).cast("int")


def varint(x: Column) -> Column:
    """Unsigned LEB128 bytes of a number: seven bits a byte, the least significant first, all but the last with the top bit."""
    x, n = x.cast("bigint"), varint_size(x)
    more = lambda i: F.when(i < n - 1, F.lit(128)).otherwise(F.lit(0))
    byte = lambda i: F.call_function("shiftrightunsigned", x, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + more(i)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def integer(bytes_: Column, at: Column, size: int) -> Column:
    """The unsigned little-endian integer of `size` bytes (7 at most, or 8 below 2**63) at offset `at`; null where it does not fit."""
    parts = F.transform(F.sequence(F.lit(size - 1), F.lit(0)), lambda i: F.hex(F.substring(bytes_, at + i + 1, F.lit(1))))
    return F.when((at >= 0) & (at + size <= F.octet_length(bytes_)), F.conv(F.array_join(parts, ""), 16, 10).cast("bigint"))


def varint_value(bytes_: Column) -> Column:
    """The number that unsigned LEB128 bytes begin with; null where they do not end."""
    byte = lambda i: F.conv(F.hex(F.substring(bytes_, i + 1, F.lit(1))), 16, 10).cast("bigint")
    places = F.when(F.octet_length(bytes_) > 0, F.sequence(F.lit(0), F.octet_length(bytes_) - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("done"))

    def step(s, i):
        b = byte(i)
        scaled = b.bitwiseAND(F.lit(127)) * F.pow(F.lit(2.0), i * 7).cast("bigint")
        return F.when(s["done"], s).otherwise(F.struct((s["n"] + scaled).alias("n"), (b < 128).alias("done")))

    return F.aggregate(places, zero, step, lambda s: F.when(s["done"], s["n"]))
