"""An index over the bytes of a text, for many positions in one: built once, each look-up is a rank or a search.

The same positions as in `offsets`, whose expressions read the text anew each time. `probe` is the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spread


class BitRank:
    """A bit vector that counts the ones before a place: words of 64 bits, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, place: np.ndarray | int) -> np.ndarray:
        """Ones before each place; beyond the end, all."""
        at = np.clip(np.asarray(place, dtype=np.int64), 0, self.size)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)

    def max_rank(self) -> int:
        return int(self.before[-1])

    def get(self, place: np.ndarray | int) -> np.ndarray:
        at = np.asarray(place, dtype=np.int64)
        inside = (at >= 0) & (at < self.size)
        at = np.where(inside, at, 0)
        return inside & ((self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) == 1)

    def select(self, number: np.ndarray | int) -> np.ndarray:
        """The place of the one of each number (from 0); the size where there is none."""
        k = np.atleast_1d(np.asarray(number, dtype=np.int64))
        out = np.full(k.shape, self.size, dtype=np.int64)
        some = np.nonzero((k >= 0) & (k < self.max_rank()))[0]
        word = np.searchsorted(self.before, k[some], "right") - 1
        left, own = k[some] - self.before[word], self.words[word]
        low = np.zeros(len(some), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(own >> low.astype(np.uint64) & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = left >= count
            left, low = left - count * beyond, low + step * beyond
        out[some] = 64 * word + low
        return out.reshape(np.shape(number))


class OffsetIndex:
    """Line breaks, beginnings of characters, and characters of two UTF-16 units, as three bit vectors. Positions saturate."""

    def __init__(self, text: str | bytes):
        self.data = text.encode() if isinstance(text, str) else text
        of = np.frombuffer(self.data, dtype=np.uint8)
        self.length = len(of)
        self.breaks, self.chars, self.wide = BitRank(of == 10), BitRank((of & 0xC0) != 0x80), BitRank(of >= 0xF0)
        self.lines = self.breaks.max_rank() + int(self.length > 0 and of[-1] != 10)

    def is_empty(self) -> bool:
        return not self.length

    def utf8_to_line(self, byte):
        return np.where(np.asarray(byte) >= self.length, self.lines, self.breaks.rank(byte))

    def utf8_to_char(self, byte):
        """The character that holds a byte."""
        byte = np.maximum(np.asarray(byte), 0)
        return np.where(byte >= self.length, self.chars.max_rank(), self.chars.rank(byte + 1) - 1)

    def char_to_utf8(self, char):
        return self.chars.select(np.maximum(np.asarray(char), 0))

    def utf8_to_utf16(self, byte):
        return self.utf8_to_char(byte) + self.wide.rank(byte)

    def line_to_utf8_begin(self, line):
        line = np.asarray(line)
        return np.where(line <= 0, 0, np.minimum(self.length, self.breaks.select(line - 1) + 1))

    def line_to_utf8_end(self, line):
        return self.line_to_utf8_begin(np.asarray(line) + 1)

    def line_to_char_begin(self, line):
        return self.utf8_to_char(self.line_to_utf8_begin(line))

    def line_to_char_end(self, line):
        return self.utf8_to_char(self.line_to_utf8_end(line))

    def line_to_utf16_begin(self, line):
        return self.utf8_to_utf16(self.line_to_utf8_begin(line))

    def line_to_utf16_end(self, line):
        return self.utf8_to_utf16(self.line_to_utf8_end(line))

    def utf8_to_char_pos(self, byte):
        line = self.utf8_to_line(byte)
        return line, self.utf8_to_char(byte) - self.line_to_char_begin(line)

    def utf8_to_utf16_pos(self, byte):
        line = self.utf8_to_line(byte)
        return line, self.utf8_to_utf16(byte) - self.line_to_utf16_begin(line)

    def utf8s_to_lines(self, start, end):
        """Lines of a range of bytes: an empty range is in one."""
        start = np.asarray(start)
        return self.utf8_to_line(start), np.minimum(self.lines, self.utf8_to_line(np.maximum(np.asarray(end) - 1, start)) + 1)

    def chars_to_lines(self, start, end):
        return self.utf8s_to_lines(self.char_to_utf8(start), self.char_to_utf8(end))

    def only_whitespaces(self, line):
        """Whether lines have tabs, carriage returns and spaces only; true for lines that aren't there."""
        begin, end = self.line_to_utf8_begin(line), self.line_to_utf8_end(line)
        dark = self._dark()
        return dark.rank(end) == dark.rank(begin)

    def _dark(self) -> BitRank:
        if not hasattr(self, "_other"):
            of = np.frombuffer(self.data, dtype=np.uint8)
            self._other = BitRank(~np.isin(of, np.frombuffer(b"\t\r\n ", dtype=np.uint8)))
        return self._other


_FIELDS = ("byte", "line", "char", "line_begin", "line_end", "char_begin", "col", "utf16", "utf16_col", "line_char_begin", "line_char_end", "line_utf16_begin", "line_utf16_end")


def _found(index: OffsetIndex, byte: np.ndarray) -> list[np.ndarray]:
    line, char, utf16 = index.utf8_to_line(byte), index.utf8_to_char(byte), index.utf8_to_utf16(byte)
    chars, units = index.line_to_char_begin(line), index.line_to_utf16_begin(line)
    return [byte, line, char, index.line_to_utf8_begin(line), index.line_to_utf8_end(line), index.char_to_utf8(char), char - chars, utf16, utf16 - units, chars, index.line_to_char_end(line), units, index.line_to_utf16_end(line), index.only_whitespaces(line)]


def probe(df: DataFrame, key: str, text: str, bytes_: Column | None = None) -> DataFrame:
    """(key, byte, line, char, line_begin, line_end, char_begin, col, utf16, utf16_col, ..., blank): positions of each byte of an array, or without one of each line's first.

    A text is indexed once, and its bytes are looked up all together. A null text or array gives no rows.
    """
    lines = bytes_ is None
    schema = f"key {dict(df.dtypes)[key]}, " + ", ".join(f"{n} int" for n in _FIELDS) + ", blank boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken: list[int] = []
            parts: list[list[np.ndarray]] = []
            for k, (own, of) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if own is not None and (of or lines):
                    index = OffsetIndex(own)
                    at = index.line_to_utf8_begin(np.arange(index.lines)) if lines else np.array(of, dtype=np.int64)
                    parts.append(_found(index, at))
                    taken += [k] * len(at)
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * (len(_FIELDS) + 1)
            arrays = [batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(c.astype(np.int32)) for c in columns[:-1]), pa.array(columns[-1].astype(bool))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *_FIELDS, "blank"])

    return spread(df.select(F.col(key), F.col(text).cast("string"), (F.array() if lines else bytes_).cast("array<int>"))).mapInArrow(run, schema)
