"""Term maps: aggregation by key, kept and merged in the order of a hash.

A map is a relation (hash, key, value); hashes are ordered as unsigned numbers. Nothing is deleted from
a map. Tables bucketed and sorted by hash merge without a shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_64, unsigned


def _hashed(df: DataFrame, key: Column, hashed: Column | None) -> list[Column]:
    return [(md5_64(key) if hashed is None else hashed).alias("hash"), key.alias("key")]


def term_counts(df: DataFrame, keys: list[str], key: Column, hashed: Column | None = None) -> DataFrame:
    """(keys, hash, key, value): how often each key occurs."""
    return df.where(key.isNotNull()).select(*keys, *_hashed(df, key, hashed)).groupBy(*keys, "hash", "key").agg(F.count("*").alias("value"))


def upsert(df: DataFrame, key: Column, value: Column, combine=F.sum, hashed: Column | None = None) -> DataFrame:
    """One value for each key by any aggregate: entry, or_insert and and_modify of a map in one."""
    return df.where(key.isNotNull()).select(*_hashed(df, key, hashed), value.alias("value")).groupBy("hash", "key").agg(combine("value").alias("value"))


def insert(df: DataFrame, key: Column, value: Column, at: Column, hashed: Column | None = None) -> DataFrame:
    """(hash, key, value, replaced): the last value by `at` wins; replaced counts earlier ones."""
    rows = df.where(key.isNotNull()).select(*_hashed(df, key, hashed), value.alias("value"), at.alias("at"))
    return rows.groupBy("hash", "key").agg(F.max_by("value", "at").alias("value"), (F.count("*") - 1).alias("replaced"))


def get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value): null where the map has none."""
    return keys.join(table.select("key", "value"), "key", "left")


def size(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("len"), (F.count("*") == 0).alias("is_empty"))


def merge(*tables: DataFrame, combine=F.sum) -> DataFrame:
    """One map of several: values of a key are combined."""
    return functools.reduce(DataFrame.unionByName, tables).groupBy("hash", "key").agg(combine("value").alias("value"))


def sort_by_hash(table: DataFrame) -> DataFrame:
    """Total order: hash as an unsigned number, then key. A range shuffle and a sort within partitions."""
    return table.orderBy(unsigned(F.col("hash")), "key")


def hash_ranges(table: DataFrame, partitions: int) -> DataFrame:
    """Partitions that are sorted, and follow each other, by hash."""
    order = unsigned(F.col("hash"))
    return table.repartitionByRange(partitions, order).sortWithinPartitions(order, "key")


def save(table: DataFrame, name: str, buckets: int) -> None:
    """A table bucketed and sorted by hash, which later merges read without an exchange."""
    table.write.mode("overwrite").bucketBy(buckets, "hash").sortBy("hash", "key").saveAsTable(name)
