"""Constant arrays as one literal each: thousands of elements cost one call to the JVM, and fold to a constant."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_array(values: Iterable[int], kind: str = "bigint") -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
