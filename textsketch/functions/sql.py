"""The native scalar functions as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .fold_table import FROM, TO

_PREFIX = "substring(hex(encode(t, 'UTF-8')), 1, 2 * greatest({n}, 0))"
_MARKS = "cast(length(regexp_replace({p}, '({w})|..', '$1')) / 2 as int)"
_LINES = "length(t) - length(translate(t, '\\n', '')) + cast(t <> '' and not endswith(t, '\\n') as int)"

_RANGE = "STRUCT<start: INT, `end`: INT>"
_POSITION = "STRUCT<line: INT, col: INT>"
_range = "named_struct('start', {}, 'end', {})".format


FUNCTIONS = {
    "simple_fold(t STRING) RETURNS STRING": f"CASE WHEN t RLIKE '[^\\\\x00-\\\\x7F]' THEN translate(t, '{FROM}', '{TO}') ELSE lower(t) END",
    "utf8_len(b INT) RETURNS INT": "CASE WHEN b < 192 THEN 1 WHEN b < 224 THEN 2 WHEN b < 240 THEN 3 ELSE 4 END",
    "md5_64(x STRING) RETURNS BIGINT": "shiftleft(cast(conv(substring(md5(x), 1, 8), 16, 10) as bigint), 32) | cast(conv(substring(md5(x), 9, 8), 16, 10) as bigint)",
    "unsigned_order(x BIGINT) RETURNS BIGINT": "x ^ (-9223372036854775807L - 1L)",
    "text_length(t STRING) RETURNS INT": "octet_length(t)",
    "text_is_empty(t STRING) RETURNS BOOLEAN": "octet_length(t) = 0",
    "text_lines(t STRING) RETURNS INT": _LINES,
    "line_to_utf8_begin(t STRING, l INT) RETURNS INT": "CASE WHEN l <= 0 THEN 0 WHEN l > length(t) - length(translate(t, '\\n', '')) THEN octet_length(t) ELSE octet_length(array_join(slice(split(t, '\\n'), 1, greatest(l, 0)), '\\n')) + 1 END",
    "line_to_utf8_end(t STRING, l INT) RETURNS INT": "line_to_utf8_begin(t, l + 1)",
    "line_to_utf8s(t STRING, l INT) RETURNS " + _RANGE: _range("line_to_utf8_begin(t, l)", "line_to_utf8_begin(t, l + 1)"),
    "lines_to_utf8s(t STRING, a INT, b INT) RETURNS " + _RANGE: _range("line_to_utf8_begin(t, a)", "line_to_utf8_begin(t, b)"),
    "utf8_to_line(t STRING, b INT) RETURNS INT": f"CASE WHEN b >= octet_length(t) THEN {_LINES} ELSE {_MARKS.format(p=_PREFIX.format(n='b'), w='0A')} END",
    "utf8s_to_lines(t STRING, a INT, b INT) RETURNS " + _RANGE: _range("utf8_to_line(t, a)", "least(text_lines(t), utf8_to_line(t, greatest(b - 1, a)) + 1)"),
    "utf8_to_char(t STRING, b INT) RETURNS INT": f"CASE WHEN b >= octet_length(t) THEN char_length(t) ELSE {_MARKS.format(p=_PREFIX.format(n='b + 1'), w='[0-7C-F].')} - 1 END",
    "utf8s_to_chars(t STRING, a INT, b INT) RETURNS " + _RANGE: _range("utf8_to_char(t, a)", "utf8_to_char(t, b)"),
    "char_to_utf8(t STRING, c INT) RETURNS INT": "octet_length(substring(t, 1, greatest(c, 0)))",
    "chars_to_utf8s(t STRING, a INT, b INT) RETURNS " + _RANGE: _range("char_to_utf8(t, a)", "char_to_utf8(t, b)"),
    "utf8_to_utf16(t STRING, b INT) RETURNS INT": f"utf8_to_char(t, b) + {_MARKS.format(p=_PREFIX.format(n='b'), w='F.')}",
    "line_to_char_begin(t STRING, l INT) RETURNS INT": "utf8_to_char(t, line_to_utf8_begin(t, l))",
    "line_to_char_end(t STRING, l INT) RETURNS INT": "utf8_to_char(t, line_to_utf8_begin(t, l + 1))",
    "line_to_chars(t STRING, l INT) RETURNS " + _RANGE: _range("line_to_char_begin(t, l)", "line_to_char_end(t, l)"),
    "lines_to_chars(t STRING, a INT, b INT) RETURNS " + _RANGE: _range("line_to_char_begin(t, a)", "line_to_char_begin(t, b)"),
    "line_chars(t STRING, l INT) RETURNS INT": "line_to_char_end(t, l) - line_to_char_begin(t, l)",
    "line_to_utf16_begin(t STRING, l INT) RETURNS INT": "utf8_to_utf16(t, line_to_utf8_begin(t, l))",
    "line_to_utf16_end(t STRING, l INT) RETURNS INT": "utf8_to_utf16(t, line_to_utf8_begin(t, l + 1))",
    "utf8_to_char_pos(t STRING, b INT) RETURNS " + _POSITION: "named_struct('line', utf8_to_line(t, b), 'col', utf8_to_char(t, b) - line_to_char_begin(t, utf8_to_line(t, b)))",
    "utf8_to_utf16_pos(t STRING, b INT) RETURNS " + _POSITION: "named_struct('line', utf8_to_line(t, b), 'col', utf8_to_utf16(t, b) - line_to_utf16_begin(t, utf8_to_line(t, b)))",
    "chars_to_lines(t STRING, a INT, b INT) RETURNS " + _RANGE: "utf8s_to_lines(t, char_to_utf8(t, a), char_to_utf8(t, b))",
    "only_whitespaces(t STRING, l INT) RETURNS BOOLEAN": "coalesce(get(split(t, '\\n'), l) RLIKE '\\\\A[\\\\t\\\\r ]*\\\\z', true)",
}


def register(spark: SparkSession) -> list[str]:
    """Create or replace them; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
