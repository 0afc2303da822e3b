"""Mergeable geometric sketches as relations of (key, bucket): distinct counts (union) and differences (xor).

A hash falls into the bucket of its position on a scale of falling powers of phi = 2^(-1/2^b). A distinct
sketch is the set of buckets hit, a difference sketch the set of those hit an odd number of times: both
are plain aggregates, partial on the map side, and merge by union and aggregation again. Packed
bytes are an edge format.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import M64, fnv1a, md5_bits
from ..functions.literals import int_array
from ..functions.shared import materialise

SIM_BITS, SIM_RING = 6, 20
#: Sketches of a block when all are compared with all (of the others four times as many), those that are compared at once, and rows of a batch of results.
COMPARED, TILE, ROWS = 1024, 256, 1 << 18


@dataclass(frozen=True)
class Config:
    """b: buckets of a level are 2^b; width: bytes of a stored bucket; size: bytes in all; msb: buckets kept singly."""

    b: int
    width: int
    size: int
    msb: int
    kind: str = "diff"

    @property
    def phi(self) -> float:
        return 0.5 ** (1.0 / (1 << self.b))

    @property
    def phi32(self) -> float:
        return float(np.float32(self.phi))

    @property
    def blocks(self) -> int:
        """64-bit blocks of the dense window below the buckets kept singly."""
        return (self.size - self.width * self.msb) // 8

    def merges_with(self, other: Config) -> bool:
        return self == other


DIFF7, DIFF10, DIFF13 = Config(7, 2, 112, 12), Config(10, 4, 896, 64), Config(13, 4, 7138, 384)
DISTINCT7, DISTINCT13 = Config(7, 2, 136, 8, "distinct"), Config(13, 4, 9216, 320, "distinct")


# buckets


@functools.lru_cache(maxsize=16)
def bucket_table(b: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """For each value of the b + 1 bits after the leading one: a bucket, and the limit below which it is the next."""
    phi, cells = 0.5 ** (1.0 / (1 << b)), 2 << b
    base, limit, filled = [0] * cells, [0] * cells, cells
    for bucket in range(1 << b):
        cut = int((phi ** (bucket + 1) - 0.5) * 2.0**33)
        while filled > cut >> (31 - b):
            filled -= 1
            base[filled], limit[filled] = bucket, cut & 0xFFFFFFFF
    return tuple(base), tuple(limit)


def hash_to_bucket(h: int, b: int) -> int:
    levels = 64 - h.bit_length()
    after = (h << (levels - 31) if levels > 31 else h >> (31 - levels)) & 0xFFFFFFFF
    base, limit = bucket_table(b)
    cell = after >> (31 - b)
    return base[cell] + (after < limit[cell]) + (levels << b)


def bucket(item: Column, b: int) -> Column:
    """The bucket of an item by its md5 hash; small tables are literals of the plan (b up to 10)."""
    return bucket_of_bits(md5_bits(item), b)


def bucket_of_bits(bits: Column, b: int) -> Column:
    """The bucket of a 64-bit hash in binary digits without leading zeros."""
    base, limit = bucket_table(b)
    levels = F.when(bits == "0", 64).otherwise(64 - F.length(bits))
    after = F.conv(F.rpad(F.substring(bits, 2, 32), 32, "0"), 2, 10).cast("bigint")
    cell = F.shiftright(after, 31 - b).cast("int") + 1
    first = F.element_at(int_array(base, "int"), cell)
    beyond = (after < F.element_at(int_array(limit), cell)).cast("int")
    return (first + beyond + F.shiftleft(levels, b)).cast("int")


# sketches as relations


def distinct_sketch(df: DataFrame, keys: list[str], item: Column, config: Config = DISTINCT7) -> DataFrame:
    return df.where(item.isNotNull()).select(*keys, bucket(item, config.b).alias("bucket")).distinct()


def diff_sketch(df: DataFrame, keys: list[str], item: Column, config: Config = DIFF7) -> DataFrame:
    """Adding an item twice takes it out again."""
    hits = df.where(item.isNotNull()).select(*keys, bucket(item, config.b).alias("bucket"))
    return parity(hits, keys)


def parity(hits: DataFrame, keys: list[str]) -> DataFrame:
    odd = hits.groupBy(*keys, "bucket").agg(F.count("*").alias("__n")).where("__n % 2 = 1")
    return odd.drop("__n")


def union(*sketches: DataFrame) -> DataFrame:
    """The distinct sketch of all items of several."""
    return functools.reduce(DataFrame.unionByName, sketches).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The difference sketch of the items in one of two sketches."""
    return parity(a.unionByName(b), keys)


# estimates


def expected_diff(phi: float, items: float) -> tuple[float, float]:
    """Buckets with an odd number of so many items, and the derivative."""
    steps = int(max(0, np.ceil(np.log(max(items, 1.0)) / -np.log(phi)))) + 2
    p = phi ** np.arange(steps)
    cut = int(np.argmax(p * items < 1.0))
    q = 1.0 - 2.0 * p[:cut] * (1.0 - phi)
    power = q**items
    return float((0.5 * (1.0 - power)).sum() + p[cut] * items), float((-0.5 * power * np.log(q)).sum() + p[cut])


def expected_distinct(phi: float, items: float) -> tuple[float, float]:
    """Buckets hit by so many items: a series of 59 terms, and its derivative."""
    factor, total, slope, harmonic = -1.0, 0.0, 0.0, 0.0
    for k in range(1, 60):
        left = items + 1.0 - k
        if left <= 0.0001:
            break
        factor *= (phi - 1.0) * left / k
        harmonic += 1.0 / left
        term = factor / (1.0 - phi**k)
        total, slope = total + term, slope + harmonic * term
    return total, slope


_G = 0.5772156649015329


def expected_diff_approx(phi: float, items: float) -> tuple[float, float]:
    """A closed form of expected_diff, within a hundredth."""
    if items <= 0:
        return 0.0, 1.0
    eg, r1, r2, r3 = float(np.exp(_G)), 0.384417, 0.130468, 0.442202
    s, a = -0.5 / np.log(phi), 2.0 * (1.0 - phi)
    x = a * items
    top, under = x * (1 + eg * r1 * x + eg * r2 * x * x), 1 + r3 * x + r2 * x * x
    d_top, d_under = 1 + 2 * eg * r1 * x + 3 * eg * r2 * x * x, r3 + 2 * r2 * x
    y, dy = top / under, (d_top * under - top * d_under) / (under * under)
    return float(s * np.log1p(y) + 0.25 * (1 - np.exp(-x))), float(a * (s * dy / (1 + y) + 0.25 * np.exp(-x)))


def estimate_count_approx(phi: float, ones: float) -> float:
    """Items that leave so many ones, by three steps from an asymptotic guess."""
    if ones <= 0:
        return 0.0
    s = -0.5 / np.log(phi)
    with np.errstate(over="ignore"):
        items = float(np.exp((ones - 0.25) / s - _G) / (2.0 * (1.0 - phi)))
    if not np.isfinite(items) or items <= 0:
        items = float(ones)
    for _ in range(3):
        m, dm = expected_diff_approx(phi, items)
        items = max(items - (m - ones) / dm, float(np.finfo(float).tiny))
    return items


@functools.lru_cache(maxsize=16)
def knots(config: Config) -> tuple[int, list[tuple[float, float]]]:
    """(step, [(items, slope)]): the inverse of the expected buckets at equal steps, in single precision."""
    f = expected_diff if config.kind == "diff" else expected_distinct
    step, top = max(1, (5 << config.b) // 32), 10 << config.b
    out = []
    for k in range(-(-top // step) + 1):
        ones, items, slope = float(step * k), float(step * k), 1.0
        for _ in range(6 if ones else 0):
            m, dm = f(config.phi, items)
            items, slope = items - (m - ones) / dm, 1.0 / dm
        out.append((float(np.float32(items)), float(np.float32(slope))))
    return step, out


def expected_items(config: Config, ones: int) -> float:
    """Items for so many ones in a window that reaches the top: a cubic between knots."""
    step, of = knots(config)
    k = ones // step
    (u, du), (v, dv) = of[k], of[k + 1]
    c, e, x = du * step, dv * step, (ones - k * step) / step
    return u + x * (c + x * ((3 * v - e - 3 * u - 2 * c) + x * (e - 2 * v + 2 * u + c)))


def knot_table(spark: SparkSession, config: Config) -> DataFrame:
    """(k, x0, step, u, du, v, dv) for joins: a few hundred rows."""
    step, of = knots(config)
    rows = [(k, k * step, step, *of[k], *of[k + 1]) for k in range(len(of) - 1)]
    return spark.createDataFrame(rows, "k int, x0 int, step int, u double, du double, v double, dv double")


def _counted(sketch: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys, total, lowest): ones in the window that the top buckets leave, and the window's lowest bucket."""
    of = Window.partitionBy(*keys)
    ranked = sketch.withColumn("__r", F.row_number().over(of.orderBy(F.desc("bucket"))))  # at most 65 * 2^b rows a key
    top = F.coalesce(F.max(F.when(F.col("__r") == config.msb, F.col("bucket"))).over(of), F.lit(0))
    block = F.greatest(F.floor((top + 63) / 64) - config.blocks, F.lit(0))
    ranked = ranked.withColumn("__b", block)
    inside = (F.col("__r") <= config.msb) | (F.col("bucket") >= F.col("__b") * 64)
    out = ranked.groupBy(*keys).agg(F.count(F.when(inside, 1)).cast("int").alias("total"), F.max("__b").alias("__b"))
    return out.select(*keys, "total", F.when(F.col("total") <= config.msb, 0).otherwise(F.col("__b") * 64).alias("lowest"))


def _differing(pairs: DataFrame, config: Config) -> DataFrame:
    """(a, b, distance, total, lowest) of pairs (a, b, bits_a, bits_b): what _counted tells of their difference."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), TILE):
                batch = whole.slice(at, TILE)
                bits = [batch.column(c).to_pylist() for c in (2, 3)]
                width = max(1, *(len(x) for of in bits for x in of))
                odd = _dense(bits[0], width) != _dense(bits[1], width)
                up = np.cumsum(odd[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]  # ones from each bucket up
                n = up[:, 0]
                top = np.where(n >= config.msb, (up >= config.msb).sum(axis=1) - 1, 0)
                block = np.maximum((top + 63) // 64 - config.blocks, 0)
                inside = np.where(64 * block < 8 * width, up[np.arange(len(n)), np.minimum(64 * block, 8 * width - 1)], 0)
                total = np.maximum(np.minimum(n, config.msb), inside)  # the top ones, or all above the window's end
                lowest = np.where(total <= config.msb, 0, 64 * block)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(lowest.astype(np.int64))], names=["a", "b", "distance", "total", "lowest"])

    kinds = dict(pairs.dtypes)
    return pairs.select("a", "b", "bits_a", "bits_b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, distance int, total int, lowest bigint")


def estimate(sketch: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys, total, lowest, estimate) of each sketch that has a bucket; an empty one is not there: nought."""
    return _by_knots(_counted(sketch, keys, config), keys, config)


def _by_knots(counted: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys, total, lowest, estimate) from (keys, total, lowest)."""
    step, _ = knots(config)
    counted = counted.withColumn("k", F.floor(F.col("total") / step).cast("int"))
    joined = counted.join(F.broadcast(knot_table(counted.sparkSession, config)), "k")
    x = (F.col("total") - F.col("x0")) / F.col("step")
    c, e, u, v = F.col("du") * F.col("step"), F.col("dv") * F.col("step"), F.col("u"), F.col("v")
    est = u + x * (c + x * ((3.0 * v - e - 3.0 * u - 2.0 * c) + x * (e - 2.0 * v + 2.0 * u + c)))
    scaled = F.when(F.col("lowest") > 0, (est + 1.0) / F.pow(F.lit(config.phi32), F.col("lowest").cast("double")) - 1.0).otherwise(est)
    return joined.select(*keys, "total", "lowest", scaled.alias("estimate"))


def estimate_sql(table: str, keys: list[str], config: Config) -> str:
    """estimate() as a query over a relation (keys, bucket)."""
    step, of = knots(config)
    by, rows = ", ".join(keys), ", ".join(f"({k}, {k * step}, {float(of[k][0])!r}::DOUBLE, {float(of[k][1])!r}::DOUBLE, {float(of[k + 1][0])!r}::DOUBLE, {float(of[k + 1][1])!r}::DOUBLE)" for k in range(len(of) - 1))
    return f"""SELECT {by}, CAST(total AS INT) AS total, CAST(lowest AS BIGINT) AS lowest, CASE WHEN lowest > 0 THEN (_est + 1.0) / pow({config.phi32!r}::DOUBLE, lowest::DOUBLE) - 1.0 ELSE _est END AS estimate FROM (
SELECT *, _u + _x * (_c + _x * ((3.0 * _v - _e - 3.0 * _u - 2.0 * _c) + _x * (_e - 2.0 * _v + 2.0 * _u + _c))) AS _est FROM (
SELECT _s.*, (total - _x0) / {step}::DOUBLE AS _x, _du * {step}::DOUBLE AS _c, _dv * {step}::DOUBLE AS _e, _u, _v FROM (
SELECT {by}, total, CASE WHEN total <= {config.msb} THEN 0 ELSE _b * 64 END AS lowest FROM (
SELECT {by}, count(*) FILTER (_r <= {config.msb} OR bucket >= _b * 64) AS total, max(_b) AS _b FROM (
SELECT *, greatest(CAST(floor((coalesce(max(bucket) FILTER (_r = {config.msb}) OVER (PARTITION BY {by}), 0) + 63) / 64) AS BIGINT) - {config.blocks}, 0) AS _b FROM (
SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY bucket DESC) AS _r FROM {table})) GROUP BY {by})) _s
JOIN (VALUES {rows}) AS _knot(_k, _x0, _u, _du, _v, _dv) ON _knot._k = _s.total // {step}))"""


def bucket_sql(item: str, b: int) -> str:
    """bucket() in DuckDB's SQL, for a column or constant."""
    base, limit = bucket_table(b)
    bits = f"bin(('0x' || substr(md5(CAST({item} AS VARCHAR)), 1, 16))::UBIGINT)"
    return f"""(SELECT CAST(({list(base)})[(w >> {31 - b}) + 1] + CASE WHEN w < ({list(limit)})[(w >> {31 - b}) + 1] THEN 1 ELSE 0 END + (CASE WHEN s = '0' THEN 64 ELSE 64 - length(s) END << {b}) AS INT)
FROM (SELECT s, CAST('0b' || rpad(substr(s, 2, 32), 32, '0') AS BIGINT) AS w FROM (SELECT {bits} AS s)))"""


# comparison


def ones(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys).agg(F.count("*").cast("int").alias("ones"))


def ones_to_items(config: Config, n: int | None) -> float:
    """Items of so many ones; None stands for infinity."""
    return float("inf") if n is None else float(np.float32(estimate_count_approx(config.phi, float(n))))


def items_to_ones(config: Config, items: float) -> int | None:
    if not np.isfinite(items):
        return None
    n = int(np.floor(expected_diff_approx(config.phi, max(items, 0.0))[0] + 0.5))
    return n if n < (1 << 8 * config.width) - 1 else None


def ones_add(config: Config, a: int | None, b: int | None) -> int | None:
    top = (1 << 8 * config.width) - 1
    return None if a is None or b is None or a + b >= top else a + b


def _bits(lists: DataFrame) -> DataFrame:
    """(key, bits): sketches of (key, buckets) as bytes, a bit for each bucket up to the highest."""

    def run(batches):
        for batch in batches:
            own = [np.array(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            bits = [np.packbits(np.bincount(x) > 0, bitorder="little").tobytes() if len(x) else b"" for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["key", "bits"])

    return lists.mapInArrow(run, f"key {dict(lists.dtypes)['key']}, bits binary")


def _dense(bits: list[bytes], width: int) -> np.ndarray:
    """Rows of 0 and 1."""
    whole = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in bits), dtype=np.uint8).reshape(len(bits), width)
    return np.unpackbits(whole, axis=1, bitorder="little")


def _compared(best: int | None, bound: int | None):
    """Of a block of sketches (a, bits_a) and another (b, bits_b): distances of pairs that share a bucket, or each a's `best` nearest."""

    def run(keys, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = (pa.Table.from_batches(list(x)).combine_chunks() for x in (left, right))
        if not len(one) or not len(other):
            return
        other = other.take(pc.sort_indices(other, sort_keys=[("b", "ascending")]))
        bits = [one["bits_a"].to_pylist(), other["bits_b"].to_pylist()]
        width = max(max(map(len, x)) for x in bits)
        right_ = _dense(bits[1], width).astype(np.float32)
        n = right_.sum(axis=1).astype(np.int32)
        a, b = one["a"].combine_chunks(), other["b"].combine_chunks()
        self_ = pc.index_in(a, b).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)  # where a sketch is itself the other
        for low in range(0, len(a), TILE):
            own = _dense(bits[0][low : low + TILE], width).astype(np.float32)
            m = own.sum(axis=1).astype(np.int32)
            shared = (own @ right_.T).astype(np.int32)  # exact: fewer than 2^24 buckets
            apart = m[:, None] + n[None, :] - 2 * shared
            good = shared > 0
            if bound is not None:
                good &= np.abs(m[:, None] - n[None, :]) < bound
            if best is None:
                i, j = np.nonzero(good)
            else:
                key = apart.astype(np.int64) * len(b) + np.arange(len(b))  # by distance, then by b
                key[~good] = 1 << 62
                same = np.nonzero(self_[low : low + TILE] >= 0)[0]
                key[same, self_[low + same]] = 1 << 62
                k = min(best, len(b))
                j = np.argpartition(key, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(m)), k)
                kept = np.take_along_axis(key, j, axis=1).ravel() < 1 << 62
                i, j = i[kept], j.ravel()[kept]
            for at in range(0, len(i), ROWS):
                x, y = i[at : at + ROWS], j[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([a.take(pa.array(x + low)), b.take(pa.array(y)), pa.array(apart[x, y].astype(np.int32))], names=["a", "b", "distance"])

    return run


def _by_blocks(a: DataFrame, b: DataFrame, best: int | None, bound: int | None) -> DataFrame:
    """Each block of a (key, bits) meets each block of b in a task of its own; what is returned is for the caller to bound."""
    cores = a.sparkSession.sparkContext.defaultParallelism
    counts = [x.count() for x in (a, b)]
    blocks = [max(1, -(-counts[0] // COMPARED), min(cores, -(-counts[0] // 64))), max(1, -(-counts[1] // (4 * COMPARED)))]
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = a.select(F.col("key").alias("a"), F.col("bits").alias("bits_a"), dealt("key", blocks[0]).alias("qa"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("qb"))
    right = b.select(F.col("key").alias("b"), F.col("bits").alias("bits_b"), dealt("key", blocks[1]).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("qa"))
    schema = f"a {dict(a.dtypes)['key']}, b {dict(b.dtypes)['key']}, distance int"
    work = _compared(best, bound)

    def run(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        out = list(work(key, iter(one.to_batches()), iter(other.to_batches()))) if len(one) and len(other) else []
        return pa.Table.from_batches(out) if out else pa.table([one["a"].slice(0, 0), other["b"].slice(0, 0), pa.array([], pa.int32())], names=["a", "b", "distance"])

    return left.groupBy("qa", "qb").cogroup(right.groupBy("qa", "qb")).applyInArrow(run, schema)


def distances(a: DataFrame, b: DataFrame, bound: int | None = None) -> DataFrame:
    """(a, b, distance) of the sketches of two relations (key, bucket): differing buckets; null from the bound on.

    Blocks of sketches are compared by a product of their bits. With a bound, pairs whose numbers of ones alone are too far
    apart are left out; pairs without a shared bucket are not returned. The result has all other pairs: `nearest` doesn't.
    """
    own = materialise(_bits(listed(a)))
    out = _by_blocks(own, own if b is a else materialise(_bits(listed(b))), None, bound)
    return out if bound is None else out.withColumn("distance", F.when(F.col("distance") < bound, F.col("distance")))


def nearest(queries: DataFrame, sketches: DataFrame, k: int, shortlist: int, config: Config, expected: int | None = None) -> DataFrame:
    """(a, b, estimate, rank): for each query the k sketches of least estimated difference among the nearest by ones.

    Every query is compared with all sketches, in blocks that return `shortlist` rows a query each. With `expected`, the number of items that
    neighbours differ by, only those that the similarity keys bring together are compared, which may miss some.
    """
    own = materialise(_bits(listed(queries)))
    other = own if sketches is queries else materialise(_bits(listed(sketches)))
    named = lambda df, x: df.select(F.col("key").alias(x), F.col("bits").alias(f"bits_{x}"))
    if expected is None:
        near = _by_blocks(own, other, shortlist, None)
    else:
        met = sim_lookup(queries, sketches, config, expected).select("a", "b")
        near = _differing(met.join(named(own, "a"), "a").join(named(other, "b"), "b"), config).select("a", "b", "distance")
    short = near.withColumn("__r", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("__r") <= shortlist).select("a", "b")
    pairs = _differing(short.join(named(own, "a"), "a").join(named(other, "b"), "b"), config)
    empty = F.when(F.col("distance") > 0, F.col("estimate"))
    found = _by_knots(pairs, ["a", "b", "distance"], config).select("a", "b", F.round(F.coalesce(empty, F.lit(0.0)), 3).alias("estimate"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("estimate", "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def masked(buckets: Column, mask: int, size: int) -> Column:
    """The buckets of an array under a mask that repeats every `size` bits, falling; orders like the masked sketches."""
    kept = F.filter(buckets, lambda p: F.call_function("shiftright", F.lit(mask), p % size).bitwiseAND(F.lit(1)) == 1)
    return F.sort_array(kept, asc=False)


def masked_key(buckets: Column, mask: int, size: int, width: int) -> Column:
    """The highest masked buckets packed into a bigint, in binary order of its bits: a prefix of the order."""
    own, n, key = masked(buckets, mask, size), 8 // width, F.lit(0).cast("bigint")
    for k in range(n):
        key = F.shiftleft(key, 8 * width).bitwiseOR(F.coalesce(F.get(own, F.lit(k)), F.lit(0)).cast("bigint"))
    return key


# packed sketches and similarity keys: kernels over the buckets of one sketch


def pack(buckets: list[int], config: Config) -> bytes:
    """The single buckets, falling, little-endian; then, if more are left, the unused bits and the dense blocks."""
    own = sorted(set(buckets), reverse=True)
    head, rest = own[: config.msb], own[config.msb :]
    out = b"".join(x.to_bytes(config.width, "little") for x in head)
    n = head[-1] if len(head) == config.msb else 0
    if not n:
        return out
    dense = sum(1 << x for x in rest)
    blocks = -(-n // 64)
    return out + bytes([63 - (n - 1) % 64]) + dense.to_bytes(8 * blocks, "little")


def bytes_in_memory(buckets: list[int], config: Config) -> int:
    """What a sketch holds: its single buckets, and of those below them a bit each in blocks of 64."""
    own = sorted(set(buckets), reverse=True)
    head = own[: config.msb]
    return len(head) * config.width + (8 * -(-head[-1] // 64) if len(head) == config.msb else 0)


def unpack(data: bytes, config: Config) -> list[int]:
    n = min(len(data) // config.width, config.msb)
    head = [int.from_bytes(data[k * config.width : (k + 1) * config.width], "little") for k in range(n)]
    rest = data[n * config.width :]
    if not rest:
        return head
    if rest[0] > 63 or (len(rest) - 1) % 8:
        raise ValueError("not a packed sketch")
    dense = int.from_bytes(rest[1:], "little")
    return head + [k for k in range(dense.bit_length() - 1, -1, -1) if dense >> k & 1]


def sim_hashes(buckets: list[int]) -> list[tuple[int, int]]:
    """(place, hash), places falling: six buckets at a time are mixed into a ring of twenty states."""
    ones_, state = set(buckets), [0] * SIM_RING
    place, out = (max(ones_) // SIM_BITS if ones_ else 0) + SIM_RING, []
    while place:
        place -= 1
        bits = sum(1 << k for k in range(SIM_BITS) if place * SIM_BITS + k in ones_)
        old = state[place % SIM_RING]
        now = bits ^ (old << SIM_BITS | old >> (64 - SIM_BITS)) & M64
        state[place % SIM_RING] = now
        out.append((place, max(1, fnv1a(struct.pack("<QQ", place, now)))))
    return out


def sim_hash_range(expected: int, config: Config) -> range:
    """The places that two sketches are likely to share if their items differ by about so many."""
    least = expected_items(config, SIM_RING // 2)
    start = int(max(0.0, np.floor((np.log2(expected + 1.0) - np.log2(least + 1.0)) * (1 << config.b) / SIM_BITS)))
    return range(start, start + SIM_RING)


def sim_indexing(buckets: list[int]) -> list[int]:
    """The hashes worth indexing."""
    own = sorted(set(buckets), reverse=True)
    end = (own[SIM_RING // 2 - 1] // SIM_BITS if len(own) >= SIM_RING // 2 else 0) + SIM_RING
    return [h for place, h in sim_hashes(buckets) if place < end]


def sim_search(buckets: list[int], expected: int, config: Config) -> tuple[list[int], int]:
    """The hashes to look up, and how many must match."""
    of, wanted = sim_hashes(buckets), sim_hash_range(expected, config)
    return [h for place, h in of if place in wanted], max(min(len(wanted), len(of)) - expected, SIM_RING // 2)


def _sim(kind: str, expected: int, config: Config):
    def run(batches):
        from ..functions.hashing import signed

        for batch in batches:
            rows = []
            for key, buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, least = (sim_indexing(buckets), 0) if kind == "index" else sim_search(buckets, expected, config)
                rows += [(key, signed(h), least) for h in hashes]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["key", "hash", "least"])

    return run


def sim_index(sketch: DataFrame, config: Config, expected: int | None = None) -> DataFrame:
    """(key, hash, least) postings of a relation (key, bucket): for the index, or for searches at an expected difference."""
    kind = "index" if expected is None else "search"
    lists = sketch.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))
    return lists.mapInArrow(_sim(kind, expected or 0, config), f"key {dict(sketch.dtypes)['key']}, hash bigint, least int")


def _rings(held: bool, expected: int, config: Config):
    """(key, ring): the states that sim_hashes would hash at the places of the expected difference, null at those that are not indexed or not there."""
    start = sim_hash_range(expected, config).start

    def run(batches):
        for batch in batches:
            lists, n = batch.column(1), len(batch)
            sizes = np.diff(lists.offsets.to_numpy())
            bucket, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(n), sizes)
            order = np.lexsort((-bucket, row))
            bucket, first = bucket[order], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            tops = np.where(sizes > 0, bucket[np.minimum(first, max(0, len(bucket) - 1))] // SIM_BITS, 0) if len(bucket) else np.zeros(n, np.int64)
            stop = tops + SIM_RING
            if held:
                many = sizes >= SIM_RING // 2
                stop = np.full(n, SIM_RING)
                stop[many] += bucket[first[many] + SIM_RING // 2 - 1] // SIM_BITS
            place = bucket // SIM_BITS - start
            inside = place >= 0
            place, row, bit = place[inside], row[inside], bucket[inside] % SIM_BITS
            turned = ((bit + SIM_BITS * (place // SIM_RING)) % 64).astype(np.uint64)
            state = np.zeros((n, SIM_RING), dtype=np.uint64)
            np.bitwise_xor.at(state, (row, place % SIM_RING), np.uint64(1) << turned)
            absent = np.arange(start, start + SIM_RING)[None, :] >= stop[:, None]
            rings = pa.array(state.view(np.int64).ravel(), mask=absent.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SIM_RING), rings)], names=["key", "ring"])

    return run


def _ringed(sketch: DataFrame, held: bool, expected: int, config: Config) -> DataFrame:
    """(key, ring, class): the class of sketches with the same states is their least key."""
    lists = listed(sketch)
    rings = materialise(lists.mapInArrow(_rings(held, expected, config), f"key {dict(lists.dtypes)['key']}, ring array<bigint>"))
    return rings.join(rings.groupBy("ring").agg(F.min("key").alias("class")), "ring")


def listed(sketch: DataFrame) -> DataFrame:
    """(key, buckets) of a relation (key, bucket); one that has lists already stays."""
    return sketch if "buckets" in sketch.columns else sketch.groupBy("key").agg(F.collect_list("bucket").alias("buckets"))


def sim_lookup(queries: DataFrame, sketches: DataFrame, config: Config, expected: int) -> DataFrame:
    """(a, b, matches): pairs that share enough similarity keys to differ by about `expected` items. Sketches are (key, bucket) or (key, buckets).

    Enough is all but a few of twenty places, so that of one group of places more than may differ, one at least agrees as a whole:
    sketches meet by groups, not by single places, which short sketches share with most others. Those with the same states
    at all places meet once, as a class, and a pair counts in the first group in which it meets: nothing is lost or found twice.
    """
    asked, held = _ringed(queries, False, expected, config), _ringed(sketches, True, expected, config)
    least = max(SIM_RING - expected, SIM_RING // 2)
    n = SIM_RING + 1 - least
    cuts = [SIM_RING * g // n for g in range(n + 1)]

    def classes(df: DataFrame, name: str) -> DataFrame:
        own = df.groupBy(F.col("class").alias(name)).agg(F.first("ring").alias(f"ring_{name}"))
        ring = lambda k: F.get(f"ring_{name}", F.lit(k))
        # null, which meets nothing, where a place of the group is
        keys = F.array(*(F.when(F.lit(True) if low >= high else ~F.exists(F.slice(f"ring_{name}", low + 1, high - low), F.isnull), F.xxhash64(F.lit(g), *map(ring, range(low, high)))) for g, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))))
        return own.withColumn(f"keys_{name}", keys)

    def met(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, f"ring_{name}", f"keys_{name}", F.posexplode(f"keys_{name}").alias("group", "key")).where("key is not null")

    both = met(classes(asked, "qa"), "qa").join(met(classes(held, "qb"), "qb"), ["group", "key"])
    both = both.where(F.array_position(F.zip_with("keys_qa", "keys_qb", lambda x, y: F.coalesce(x == y, F.lit(False))), True) == F.col("group") + 1)
    same = F.size(F.filter(F.zip_with("ring_qa", "ring_qb", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    near = both.select("qa", "qb", same.alias("matches")).where(F.col("matches") >= least)
    found = near.join(asked.select(F.col("class").alias("qa"), F.col("key").alias("a")), "qa").join(held.select(F.col("class").alias("qb"), F.col("key").alias("b")), "qb")
    return found.where("a <> b").select("a", "b", "matches")


def packed(sketch: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """(keys, sketch): the bytes of each."""
    size = F.pandas_udf(lambda s: s.map(lambda x: pack([int(v) for v in x], config)), "binary")
    return sketch.groupBy(*keys).agg(F.collect_list("bucket").alias("__all")).select(*keys, size("__all").alias("sketch"))


def unpacked(table: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """The relation of packed sketches."""
    lists = F.pandas_udf(lambda s: s.map(lambda x: unpack(bytes(x), config)), "array<int>")
    return table.select(*keys, F.explode(lists("sketch")).alias("bucket"))


def hyperloglog(df: DataFrame, keys: list[str], item: Column, p: int) -> DataFrame:
    """(keys, estimate) by the HyperLogLog of 2^p registers that the engine has, for comparison: expected error 1.04 / 2^(p/2)."""
    return df.where(item.isNotNull()).groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg(item.cast("string"), p)).cast("double").alias("estimate"))


def set_sizes(most: int, per_decade: int = 10) -> list[int]:
    """A grid of sizes at equal steps of the logarithm, from 1 to `most`."""
    steps = math.ceil(math.log10(most) * per_decade)
    return sorted({min(most, round(10 ** (k / per_decade))) for k in range(steps + 1)})


def relative_errors(spark: SparkSession, config: Config | int, sizes: list[int], samples: int) -> DataFrame:
    """(size, mean, variance, median, least, most) of the relative error over random sets, made in tasks.

    A number instead of a configuration is the precision of a HyperLogLog to compare with.
    """
    runs = spark.range(samples).select(F.col("id").alias("sample")).join(spark.createDataFrame([(n,) for n in sizes], "size int"))
    items = runs.select("sample", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    named = F.concat_ws("/", F.col("sample").cast("string"), F.col("size").cast("string"), F.col("i").cast("string"))
    if isinstance(config, int):
        found = hyperloglog(items, ["sample", "size"], named, config)
    else:
        make = diff_sketch if config.kind == "diff" else distinct_sketch
        found = estimate(make(items, ["sample", "size"], named, config), ["sample", "size"], config)
    error = found.select("size", ((F.col("estimate") - F.col("size")) / F.col("size")).alias("e"))
    # the median is the upper one of two in the middle
    middle = F.get(F.sort_array(F.collect_list("e")), F.floor(F.count("*") / 2).cast("int"))
    return error.groupBy("size").agg(F.avg("e").alias("mean"), F.var_pop("e").alias("variance"), middle.alias("median"), F.min("e").alias("least"), F.max("e").alias("most"))
