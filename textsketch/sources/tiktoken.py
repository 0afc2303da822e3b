"""Tiktoken dictionaries as relations, and sketches and folding tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, bytes) of a text file with lines `base64 rank`; empty lines are skipped."""
    lines = spark.read.text(path).where("value <> ''")
    parts = F.split("value", " ")
    return lines.select(F.get(parts, F.lit(1)).cast("int").alias("token_id"), F.unbase64(F.get(parts, F.lit(0))).alias("bytes"))


def write_csv(df: DataFrame, path: str) -> None:
    """Accuracy figures, separated by semicolons."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def case_foldings(spark: SparkSession, path: str) -> DataFrame:
    """(cp, folded) of a Unicode case-folding file: foldings of one character to one (status C and S)."""
    lines = spark.read.text(path).select(F.split(F.regexp_replace("value", "#.*", ""), ";").alias("f")).where("size(f) >= 3")
    status = F.trim(F.get("f", F.lit(1)))
    number = lambda k: F.conv(F.trim(F.get("f", F.lit(k))), 16, 10).cast("int")
    return lines.where(status.isin("C", "S")).select(number(0).alias("cp"), number(2).alias("folded"))
