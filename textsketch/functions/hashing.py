"""Deterministic 64-bit hashes: columns for relational plans, and plain functions for kernels."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def md5_bits(col: Column) -> Column:
    """The first 64 bits of md5 in binary digits, without leading zeros ('0' for none). DuckDB has the same."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 16), 16, 2)


def md5_64(col: Column) -> Column:
    """The same bits as a bigint (negative from 2^63 on)."""
    hexed = F.md5(col.cast("string"))
    high = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def unsigned(col: Column) -> Column:
    """A key whose signed order is the unsigned order of a bigint's bits."""
    return col.bitwiseXOR(F.lit(-(1 << 63)))


def signed(x: int) -> int:
    """The bigint with the bits of an unsigned number."""
    return x - (1 << 64) if x >> 63 else x


def _rotate(x: int, n: int) -> int:
    return (x << n | x >> 64 - n) & M64


class SipHash13:
    """SipHash-1-3 with a zero key, fed in parts; copies share what was fed."""

    def __init__(self, data: bytes = b""):
        self.data = data

    def feed(self, data: bytes) -> SipHash13:
        return SipHash13(self.data + data)

    def u64(self, x: int) -> SipHash13:
        return self.feed(struct.pack("<Q", x & M64))

    def i32(self, x: int) -> SipHash13:
        return self.feed(struct.pack("<i", x))

    def finish(self) -> int:
        a, b, c, d = 0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573

        def mixed(a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
            a = (a + b) & M64
            c = (c + d) & M64
            b, d = _rotate(b, 13) ^ a, _rotate(d, 16) ^ c
            a, c = _rotate(a, 32), (c + b) & M64
            a = (a + d) & M64
            return a, _rotate(b, 17) ^ c, _rotate(c, 32), _rotate(d, 21) ^ a

        n, whole = len(self.data), len(self.data) // 8 * 8
        for k in range(0, whole, 8):
            word = int.from_bytes(self.data[k : k + 8], "little")
            d ^= word
            a, b, c, d = mixed(a, b, c, d)
            a ^= word
        last = int.from_bytes(self.data[whole:], "little") | (n & 255) << 56
        d ^= last
        a, b, c, d = mixed(a, b, c, d)
        a, c = a ^ last, c ^ 255
        for _ in range(3):
            a, b, c, d = mixed(a, b, c, d)
        return a ^ b ^ c ^ d


def fnv1a(data: bytes) -> int:
    x = 0xCBF29CE484222325
    for byte in data:
        x = (x ^ byte) * 0x100000001B3 & M64
    return x


def splitmix64(x: int) -> int:
    x = (x + GOLDEN) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31
