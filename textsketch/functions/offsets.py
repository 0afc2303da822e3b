"""Positions in a text: bytes, characters, UTF-16 units and lines. All from 0, saturating; native but for the table of lines.

A line owns the line break that ends it, and an unterminated rest is a line. Byte positions within a
character belong to it. Expressions read hexadecimal text, two digits for each byte, so that a
position may fall within a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spread, stretches


def _prefix(text: Column, n: Column) -> Column:
    return F.substring(F.hex(F.encode(text, "UTF-8")), F.lit(1), 2 * F.greatest(n, F.lit(0)).cast("int"))


def _marks(prefix: Column, wanted: str) -> Column:
    """Bytes of a hexadecimal prefix that match; two digits are read at a time."""
    return (F.length(F.regexp_replace(prefix, f"({wanted})|..", "$1")) / 2).cast("int")


def length(text: Column) -> Column:
    return F.octet_length(text)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def lines(text: Column) -> Column:
    rest = (text != "") & ~F.endswith(text, F.lit("\n"))
    return _breaks(text) + rest.cast("int")


def is_empty(text: Column) -> Column:
    """No bytes (and so no lines)."""
    return F.octet_length(text) == 0


def line_to_utf8_begin(text: Column, line: Column) -> Column:
    before = F.array_join(F.slice(F.split(text, "\n"), F.lit(1), F.greatest(line, F.lit(0)).cast("int")), "\n")
    return F.when(line <= 0, 0).when(line > _breaks(text), length(text)).otherwise(F.octet_length(before) + 1)


def line_to_utf8_end(text: Column, line: Column) -> Column:
    return line_to_utf8_begin(text, line + 1)


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def line_to_utf8s(text: Column, line: Column) -> Column:
    return _range(line_to_utf8_begin(text, line), line_to_utf8_end(text, line))


def lines_to_utf8s(text: Column, start: Column, end: Column) -> Column:
    return _range(line_to_utf8_begin(text, start), line_to_utf8_begin(text, end))


def utf8_to_line(text: Column, byte: Column) -> Column:
    return F.when(byte >= length(text), lines(text)).otherwise(_marks(_prefix(text, byte), "0A"))


def utf8s_to_lines(text: Column, start: Column, end: Column) -> Column:
    last = utf8_to_line(text, F.greatest(end - 1, start)) + 1
    return _range(utf8_to_line(text, start), F.least(lines(text), last))


def utf8_to_char(text: Column, byte: Column) -> Column:
    """The character that holds a byte."""
    return F.when(byte >= length(text), F.char_length(text)).otherwise(_marks(_prefix(text, byte + 1), "[0-7C-F].") - 1)


def utf8s_to_chars(text: Column, start: Column, end: Column) -> Column:
    return _range(utf8_to_char(text, start), utf8_to_char(text, end))


def char_to_utf8(text: Column, char: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), F.greatest(char, F.lit(0)).cast("int")))


def chars_to_utf8s(text: Column, start: Column, end: Column) -> Column:
    return _range(char_to_utf8(text, start), char_to_utf8(text, end))


def utf8_to_utf16(text: Column, byte: Column) -> Column:
    """Meant for the beginnings of characters: within one of four bytes, one unit is counted already."""
    return utf8_to_char(text, byte) + _marks(_prefix(text, byte), "F.")


def line_to_char_begin(text: Column, line: Column) -> Column:
    return utf8_to_char(text, line_to_utf8_begin(text, line))


def line_to_char_end(text: Column, line: Column) -> Column:
    return utf8_to_char(text, line_to_utf8_end(text, line))


def line_to_chars(text: Column, line: Column) -> Column:
    return _range(line_to_char_begin(text, line), line_to_char_end(text, line))


def lines_to_chars(text: Column, start: Column, end: Column) -> Column:
    return _range(line_to_char_begin(text, start), line_to_char_begin(text, end))


def line_chars(text: Column, line: Column) -> Column:
    return line_to_char_end(text, line) - line_to_char_begin(text, line)


def line_to_utf16_begin(text: Column, line: Column) -> Column:
    return utf8_to_utf16(text, line_to_utf8_begin(text, line))


def line_to_utf16_end(text: Column, line: Column) -> Column:
    return utf8_to_utf16(text, line_to_utf8_end(text, line))


def utf8_to_char_pos(text: Column, byte: Column) -> Column:
    line = utf8_to_line(text, byte)
    return F.struct(line.alias("line"), (utf8_to_char(text, byte) - line_to_char_begin(text, line)).alias("col"))


def utf8_to_utf16_pos(text: Column, byte: Column) -> Column:
    line = utf8_to_line(text, byte)
    return F.struct(line.alias("line"), (utf8_to_utf16(text, byte) - line_to_utf16_begin(text, line)).alias("col"))


def chars_to_lines(text: Column, start: Column, end: Column) -> Column:
    return utf8s_to_lines(text, char_to_utf8(text, start), char_to_utf8(text, end))


def only_whitespaces(text: Column, line: Column) -> Column:
    """Whether a line has tabs, carriage returns and spaces only; true for lines that aren't there."""
    own = F.get(F.split(text, "\n"), line.cast("int"))
    return F.when(own.isNull(), F.lit(True)).otherwise(own.rlike(r"\A[\t\r ]*\z"))


def _lines_of(texts: list[bytes]) -> list[np.ndarray]:
    """(text, line, utf8_begin, char_begin, utf16_begin, blank) of the lines of many texts."""
    size = np.array([len(x) for x in texts], dtype=np.int64)
    first = np.cumsum(size) - size
    data, of = np.frombuffer(b"".join(texts), dtype=np.uint8), np.repeat(np.arange(len(texts)), size)
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[first[size > 0]] = True
    begins[np.nonzero(data == 10)[0] + 1] = True  # what follows the last line break of a text is the next text
    begin = np.nonzero(begins[:-1])[0]
    own, stop = of[begin], np.append(begin[1:], len(data))
    before = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    chars, pairs = before((data & 0xC0) != 0x80), before(data >= 0xF0)
    dark = before(~np.isin(data, np.frombuffer(b"\t\r \n", dtype=np.uint8)))
    head = first[own]
    char = chars[begin] - chars[head]
    return [own, np.arange(len(own)) - np.searchsorted(own, own), begin - head, char, char + pairs[begin] - pairs[head], dark[begin] == dark[stop[: len(begin)]]]


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, utf8_begin, char_begin, utf16_begin, blank): a row for each line, by a kernel in the task that reads the text."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole)):
            own, *rest = _lines_of([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *(pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(rest, kinds, strict=True))], names=["key", "line", "utf8_begin", "char_begin", "utf16_begin", "blank"])

    found = spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"key {dict(df.dtypes)[key]}, line int, utf8_begin bigint, char_begin bigint, utf16_begin bigint, blank boolean")
    return found.withColumnRenamed("key", key)
