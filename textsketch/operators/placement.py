"""Consistent placement: hashes that move few keys, rankings of nodes, keyed permutations and reservoirs."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import GOLDEN, M64, SipHash13, splitmix64
from ..functions.shared import fresh, materialise, spread

_NEXT = 54387634019
_BATCH = 1 << 16


class Source:
    """Hash streams of a key: a mask of levels, a stream for each level, and a source for each rank."""

    def __init__(self, state: SipHash13):
        self.state = state

    @classmethod
    def of(cls, key: int) -> Source:
        return cls(SipHash13().u64(key))

    def mask(self) -> int:
        return self.state.finish()

    def stream(self, bit: int) -> Iterator[int]:
        state = self.state.u64(bit)
        while True:
            state = state.u64(_NEXT)
            yield state.finish()

    def ranked(self, k: int) -> Source:
        return Source(self.state.u64(k))


class MixSource(Source):
    """The same with SplitMix64: an order of magnitude faster, other numbers."""

    def __init__(self, key: int):
        self.key = key & M64

    @classmethod
    def of(cls, key: int) -> MixSource:
        return cls(splitmix64(key & M64))

    def mask(self) -> int:
        return splitmix64(self.key ^ GOLDEN)

    def stream(self, bit: int) -> Iterator[int]:
        x = splitmix64(self.key + bit & M64)
        while True:
            x = splitmix64(x)
            yield x

    def ranked(self, k: int) -> MixSource:
        return MixSource(splitmix64(self.key + (k + 1) * GOLDEN & M64))


def _level(stream: Iterator[int], bit: int, n: int) -> Iterator[int]:
    """Falling hashes in [bit, 2 bit) below n. The first draw always lies there; a later one below ends the level."""
    first = (next(stream) & bit - 1) + bit
    if first < n:
        n = first
        yield n
    while True:
        x = next(stream) & 2 * bit - 1
        if not x & bit:
            return
        if x < n:
            n = x
            yield n


def hashes_below(source: Source, n: int) -> Iterator[int]:
    """All consistent hashes of a key below n, falling, 0 at last."""
    if n == 0:
        return
    bits = source.mask() & (1 << (n - 1).bit_length()) - 1
    while bits:
        bit = 1 << bits.bit_length() - 1
        bits ^= bit
        for x in _level(source.stream(bit), bit, n):
            n = x
            yield x
    yield 0


def hashes_from(source: Source, n: int) -> Iterator[int]:
    """All consistent hashes of a key from n on, rising; for n one below a power of two, from n + 1 on."""
    if n == 0:
        yield 0
    least = 1 << (n + 1).bit_length() >> 1
    bits = source.mask() & ~(least - 1) & M64
    while bits:
        bit = bits & -bits
        bits ^= bit
        own = []
        for x in _level(source.stream(bit), bit, 2 * bit):
            if x < n:
                break
            own.append(x)
        yield from reversed(own)


def prev_hash(source: Source, n: int) -> int | None:
    return next(hashes_below(source, n), None)


def next_hash(source: Source, n: int) -> int | None:
    return next(hashes_from(source, n), None)


class ChooseK:
    """k different nodes of n, ranked: few change with k or n."""

    def __init__(self, source: Source, n: int):
        self.source, self.n, self.samples = source, n, []

    @classmethod
    def with_k(cls, source: Source, n: int, k: int) -> ChooseK:
        if k > n:
            raise ValueError("n must be at least k")
        self = cls(source, n)
        own = [self._sample(i, n) for i in range(k)]
        for i in range(k - 1, -1, -1):
            own[i] = top = max(own[: i + 1])
            for j in range(i):
                if own[j] == top:
                    own[j] = self._sample(j, top)
        self.samples = own
        return self

    @property
    def k(self) -> int:
        return len(self.samples)

    def _sample(self, k: int, n: int) -> int:
        return prev_hash(self.source.ranked(k), n - k) + k

    def shrink_n(self) -> int:
        """Lower n to the largest node chosen; the index of the node that is new."""
        if not self.samples or self.samples[-1] < self.k:
            raise ValueError("no node to spare")
        self.n = self.samples[-1]
        return self._shrink(self.n)

    def _shrink(self, n: int) -> int:
        own = self.samples
        for i in range(len(own) - 1, -1, -1):
            if own[i] < n:
                return i + 1
            new = self._sample(i, n)
            n = own[i] = max(own[i - 1], new) if i else new
        return 0

    def grow_k(self) -> int:
        """Choose one more; the index of the node that is new."""
        if self.k >= self.n:
            raise ValueError("all nodes are chosen")
        new = self._sample(self.k, self.n)
        if not self.samples or self.samples[-1] < new:
            self.samples.append(new)
            return self.k - 1
        last = self.samples[-1]
        at = self._shrink(last)
        self.samples.append(last)
        return at

    def __iter__(self) -> Iterator[int]:
        while self.k < self.n:
            yield self.samples[self.grow_k()]


class NodeMap:
    """Slots of nodes that come and go; a key's node is the first live one of its ranking."""

    def __init__(self, total: int = 0, deleted: Iterable[int] = ()):
        self.total, self.deleted = total, set(deleted)

    def add(self) -> int:
        """The smallest free slot."""
        if self.deleted:
            slot = min(self.deleted)
            self.deleted.remove(slot)
            return slot
        self.total += 1
        return self.total - 1

    def remove(self, slot: int) -> bool:
        if not self.is_active(slot):
            return False
        if slot == self.total - 1:
            self.total -= 1
        else:
            self.deleted.add(slot)
        return True

    def __len__(self) -> int:
        return self.total - len(self.deleted)

    def is_empty(self) -> bool:
        return not len(self)

    def slot_count(self) -> int:
        return self.total

    def is_active(self, slot: int) -> bool:
        return 0 <= slot < self.total and slot not in self.deleted

    def get(self, source: Source) -> int | None:
        return None if self.is_empty() else next(x for x in ChooseK(source, self.total) if x not in self.deleted)


# the same for many keys at once

_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x + _U(GOLDEN)
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


class _MixKeys:
    """MixSource of many keys."""

    def __init__(self, state: np.ndarray):
        self.state = state

    @classmethod
    def of(cls, keys: np.ndarray) -> _MixKeys:
        return cls(_splitmix(keys))

    def __getitem__(self, at: np.ndarray) -> _MixKeys:
        return _MixKeys(self.state[at])

    def ranked(self, k: int) -> _MixKeys:
        return _MixKeys(_splitmix(self.state + _U((k + 1) * GOLDEN & M64)))

    def mask(self) -> np.ndarray:
        return _splitmix(self.state ^ _U(GOLDEN))

    def stream(self, bit: np.ndarray) -> _MixKeys:
        return _MixKeys(_splitmix(self.state + bit.astype(_U)))

    def draw(self) -> tuple[_MixKeys, np.ndarray]:
        x = _splitmix(self.state)
        return _MixKeys(x), x


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << _U(n) | x >> _U(64 - n)


def _round(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    a, c = a + b, c + d
    b, d = _turned(b, 13) ^ a, _turned(d, 16) ^ c
    a, c = _turned(a, 32), c + b
    a = a + d
    return a, _turned(b, 17) ^ c, _turned(c, 32), _turned(d, 21) ^ a


class _SipKeys:
    """Source of many keys: the four words of SipHash-1-3 after what was fed, and how many words that was."""

    def __init__(self, words: tuple[np.ndarray, ...], fed: int):
        self.words, self.fed = words, fed

    @classmethod
    def of(cls, keys: np.ndarray) -> _SipKeys:
        start = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
        return cls(tuple(np.full(len(keys), x, _U) for x in start), 0).u64(keys)

    def __getitem__(self, at: np.ndarray) -> _SipKeys:
        return _SipKeys(tuple(x[at] for x in self.words), self.fed)

    def u64(self, x: np.ndarray | np.uint64) -> _SipKeys:
        a, b, c, d = self.words
        a, b, c, d = _round(a, b, c, d ^ x)
        return _SipKeys((a ^ x, b, c, d), self.fed + 1)

    def finish(self) -> np.ndarray:
        a, b, c, d = self.u64(_U((8 * self.fed & 255) << 56)).words
        c = c ^ _U(255)
        for _ in range(3):
            a, b, c, d = _round(a, b, c, d)
        return a ^ b ^ c ^ d

    def ranked(self, k: int) -> _SipKeys:
        return self.u64(_U(k))

    def mask(self) -> np.ndarray:
        return self.finish()

    def stream(self, bit: np.ndarray) -> _SipKeys:
        return self.u64(bit.astype(_U))

    def draw(self) -> tuple[_SipKeys, np.ndarray]:
        now = self.u64(_U(_NEXT))
        return now, now.finish()


#: Sources that have a form for many keys.
_MANY = {Source: _SipKeys, MixSource: _MixKeys}


def _prev_hashes(source: _MixKeys | _SipKeys, n: np.ndarray) -> np.ndarray:
    """prev_hash of each key below its own n, which is 1 at least."""
    n = n.astype(np.int64)
    top = np.ones(len(n), dtype=np.int64)
    while (low := top < n).any():
        top[low] <<= 1
    bits = (source.mask() & (top - 1).astype(_U)).astype(np.int64)
    out = np.zeros(len(n), dtype=np.int64)
    left = np.nonzero(bits)[0]
    while len(left):
        own = bits[left]
        bit = np.int64(1) << (np.frexp(own.astype(np.float64))[1] - 1).astype(np.int64)
        bits[left] = own ^ bit
        stream, x = source[left].stream(bit).draw()
        first = (x & (bit - 1).astype(_U)).astype(np.int64) + bit
        good = first < n[left]
        out[left[good]] = first[good]
        rest = np.nonzero(~good)[0]  # within the level still
        while len(rest):
            stream, at = (stream[~good] if len(rest) != len(good) else stream), left[rest]
            stream, x = stream.draw()
            low = (x & (2 * bit[rest] - 1).astype(_U)).astype(np.int64)
            inside, good = (low & bit[rest]) > 0, low < n[at]
            found = inside & good
            out[at[found]] = low[found]
            stay = inside & ~good
            good, rest = ~stay, rest[stay]
            if len(rest):
                stream = stream[stay]
                good = np.zeros(len(rest), dtype=bool)
        left = left[(out[left] == 0) & (bits[left] > 0)]
    return out


class _Chosen:
    """ChooseK of many keys, each with the same n and k."""

    def __init__(self, source: _MixKeys | _SipKeys, size: int, n: int, k: int):
        self.source, self.n = source, n
        self.ranks = [source.ranked(i) for i in range(k)]
        self.own = np.zeros((size, k), dtype=np.int64)

    def _sample(self, i: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _prev_hashes(self.ranks[i][at], n - i) + i

    def chosen(self) -> np.ndarray:
        """The nodes of each key, rising: with_k."""
        own, size = self.own, len(self.own)
        every = np.arange(size)
        for i in range(own.shape[1]):
            own[:, i] = self._sample(i, every, np.full(size, self.n))
        for i in range(own.shape[1] - 1, -1, -1):
            own[:, i] = top = own[:, : i + 1].max(axis=1)
            for j in range(i):
                at = np.nonzero(own[:, j] == top)[0]
                if len(at):
                    own[at, j] = self._sample(j, at, top[at])
        return own

    def ranking(self) -> np.ndarray:
        """The nodes of each key as they are chosen one by one: grow_k."""
        own, size = self.own, len(self.own)
        out, every = np.zeros_like(own), np.arange(size)
        for k in range(own.shape[1]):
            new = self._sample(k, every, np.full(size, self.n))
            if not k:
                own[:, 0] = out[:, 0] = new
                continue
            last = own[:, k - 1].copy()
            own[:, k] = np.where(last < new, new, last)
            spot = np.full(size, k)
            at = np.nonzero(last >= new)[0]
            n = last[at]
            for i in range(k - 1, -1, -1):
                if not len(at):
                    break
                fresh = self._sample(i, at, n)
                own[at, i] = n = np.maximum(own[at, i - 1], fresh) if i else fresh
                spot[at] = i
                if i:
                    going = own[at, i - 1] >= n
                    at, n = at[going], n[going]
            out[:, k] = own[every, spot]
        return out


#: Keys that are worked on at once.
_KEYS = 1 << 14


def _mapped_many(df: DataFrame, key: str, source: Callable, n: int, k: int, ranking: bool, each: Callable[[int], list[int]]) -> DataFrame:
    """(key, nodes): by arrays of keys where the source has a form for them, else key by key."""
    many = _MANY.get(getattr(source, "__self__", None))
    if many is None or n < 1 or k < 1 or getattr(source, "__name__", "") != "of":
        return _mapped(df, key, each, pa.list_(pa.int32()), "nodes", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), _KEYS):
                keys = whole.column(0).slice(at, _KEYS)
                own = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
                work = _Chosen(many.of(own), len(own), n, k)
                nodes = work.ranking() if ranking else work.chosen()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * k), pa.array(nodes.ravel().astype(np.int32)))
                if keys.null_count:
                    lists = lists.take(pa.array(np.arange(len(own)), mask=keys.is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([keys, lists], names=["key", "nodes"])

    return spread(df.select(F.col(key).cast("bigint"))).mapInArrow(run, "key bigint, nodes array<int>")


# permutations


def _layer(bits: int, key: int, x: int) -> int:
    """A keyed bijection of numbers of an even number of bits: a Feistel network."""
    rounds = {2: 12, 4: 10, 6: 6}.get(bits, 4)
    half = bits // 2
    mask = (1 << half) - 1
    left, right, k = x >> half & mask, x & mask, key
    for _ in range(rounds):
        mixed = (right ^ k & 0xFFFFFFFF) * (k >> 32 | 1) & M64
        left, right = right, left ^ (mixed + (mixed >> 32)) & mask
        k = ((k >> bits | k << 64 - bits) + GOLDEN) & M64
    return left << half | right


def permutation(n: int, key: int) -> Iterator[int]:
    """Each of 0 .. n-1 once. Layers of two bits: what has none of the top bits is left to the layer below."""
    if not 0 < n <= 1 << 30:
        raise ValueError("n must be 1 to 2^30")
    top = (n - 1).bit_length() - 1 >> 1 if n > 1 else 0
    counters = [0] * (top + 1)
    while True:
        for j in range(top, -1, -1):
            found = None
            while True:
                if counters[j] >> 2 * j + 2:
                    return
                x = _layer(2 * j + 2, key, counters[j])
                counters[j] += 1
                if not x >> 2 * j:
                    break
                if x < n:
                    found = x
                    break
                if j < top:  # only the top layer goes beyond n
                    raise AssertionError
            if found is not None:
                yield found
                break
            if j == 0:
                yield 0


class Reservoir:
    """The first k of a permutation of n, as n grows: a stream of (added, evicted)."""

    def __init__(self, k: int, n: int, key: int):
        if k < 1:
            raise ValueError("k must be at least 1")
        self.k, self.key, self.n = k, key, n
        self.j = (n - 1).bit_length() - 1 >> 1 if n > 1 else 0
        self.values, inside = [], 0
        for x in permutation(4 << 2 * self.j, key):
            self.values.append(x)
            inside += x < n
            if inside == k:
                break
        self._wait(n)

    def _wait(self, least: int) -> None:
        """Ranks of values from `least` on, by falling value: the next one to come in is last."""
        self.pending = sorted((r for r, v in enumerate(self.values) if v >= least), key=lambda r: -self.values[r])

    def reservoir(self) -> list[int]:
        return [v for v in self.values if v < self.n]

    def grow_layer(self) -> None:
        if self.j >= 14:
            raise ValueError("2^30 is the end")
        old, least = iter(self.values[: self.k]), 4 << 2 * self.j
        self.j += 1
        self.values, taken, c = [], 0, 0
        while taken < self.k:
            x = _layer(2 * self.j + 2, self.key, c)
            c += 1
            if x >> 2 * self.j:
                self.values.append(x)
            else:
                self.values.append(next(old))
                taken += 1
        self._wait(least)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while True:
            while len(self.values) <= self.k:
                if self.j >= 14:
                    return
                self.grow_layer()
            evicted = self.values.pop()
            rank = self.pending.pop()
            while rank >= len(self.values):
                rank = self.pending.pop()
            added = self.values[rank]
            self.n = added + 1
            while len(self.values) > self.k and self.values[-1] >= self.n:
                self.values.pop()
            yield added, evicted


# DataFrame operators


def _mapped(df: DataFrame, key: str, each: Callable[[int], object], kind: pa.DataType, name: str, sql: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([None if k is None else each(k) for k in keys], type=kind)], names=["key", name])

    return df.select(F.col(key).cast("bigint")).mapInArrow(run, f"key bigint, {name} {sql}")


def place(df: DataFrame, key: str, n: int, source: Callable = Source.of) -> DataFrame:
    """(key, node): one of n nodes; growing n moves a key only to the new node."""
    return _mapped(df, key, lambda k: prev_hash(source(k), n), pa.int32(), "node", "int")


def next_hashes(df: DataFrame, key: str, n: int, source: Callable = Source.of) -> DataFrame:
    """(key, next): the least consistent hash from n on; null if there is none."""
    return _mapped(df, key, lambda k: next_hash(source(k), n), pa.decimal128(20, 0), "next", "decimal(20,0)")


def choose(df: DataFrame, key: str, n: int, k: int, source: Callable = Source.of) -> DataFrame:
    """(key, nodes): k different nodes, rising."""
    if k > n:
        raise ValueError("n must be at least k")
    return _mapped_many(df, key, source, n, k, False, lambda x: ChooseK.with_k(source(x), n, k).samples)


def ranking(df: DataFrame, key: str, n: int, k: int, source: Callable = Source.of) -> DataFrame:
    """(key, rank, node): the first k of a key's ranking of n nodes."""
    return ranked(df, key, n, k, source).select("key", F.posexplode("nodes").alias("rank", "node"))


def ranked(df: DataFrame, key: str, n: int, k: int, source: Callable = Source.of) -> DataFrame:
    """(key, nodes): the same as one array, in the order of the ranking."""
    return _mapped_many(df, key, source, n, min(k, n), True, lambda x: list(islice(ChooseK(source(x), n), k)))


def assign(df: DataFrame, key: str, nodes: NodeMap, source: Callable = Source.of) -> DataFrame:
    """(key, node): the first live node of each key's ranking; null if none is live."""
    return _mapped(df, key, lambda x: nodes.get(source(x)), pa.int32(), "node", "int")


def sample(df: DataFrame, order: list[str], k: int, key: int) -> DataFrame:
    """A reservoir of k rows: those whose places (by `order`) come first in the keyed permutation."""
    n = df.count()
    if not n:
        return df.limit(0)
    first = list(islice(permutation(n, key), k))
    spark = df.sparkSession
    ranks = spark.createDataFrame([(int(v), r) for r, v in enumerate(first)], "__place bigint, rank int")
    return _with_places(df, order).join(ranks, "__place").drop("__place")


def _with_places(df: DataFrame, order: list[str]) -> DataFrame:
    """Places from 0 in a total order, without sorting all rows in one task: ranks within range partitions, and counts of those before.

    The ranges are cut once, and rows and counts are read from the same written partitions. Rows that are equal in
    `order` are placed by a hash of all columns, so that a value of many rows is spread over partitions too.
    """
    order = [F.col(c) for c in order] + [F.xxhash64(*df.columns)]
    ranged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))  # a row for each partition
    return ranged.withColumn("__part", part).join(F.broadcast(counts), "__part").withColumn("__place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")


def permuted(df: DataFrame, n: int, key: int) -> DataFrame:
    """(rank, value) of a keyed permutation of 0 .. n-1: one kernel, as its state is sequential, which gives batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, rank = permutation(of, seed & M64), 0
                while own := list(islice(values, _BATCH)):
                    n = len(own)
                    yield pa.RecordBatch.from_pydict({"seed": pa.array([seed] * n, pa.int64()), "n": pa.array([of] * n, pa.int32()), "rank": pa.array(range(rank, rank + n), pa.int32()), "value": pa.array(own, pa.int32())})
                    rank += n

    return df.select(F.lit(n).cast("int").alias("n"), F.lit(key).cast("bigint").alias("seed")).mapInArrow(run, "seed bigint, n int, rank int, value int")


#: Rows of a ranking that one task of bounded_load holds.
LOADED = 1 << 20


def _taken(rows: pa.Table, k: int, cap: int, full: set[int] | None, load: dict[int, int]) -> tuple[np.ndarray, pa.Table]:
    """Which of a stretch of rows (key, rank, node), which come back sorted, are taken: while just `full` nodes are, or else one by one from a load on, which is brought up to date."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("key", "ascending"), ("rank", "ascending"), ("node", "ascending")], null_placement="at_start"))
    keys, node = rows["key"].combine_chunks(), rows["node"].to_numpy()
    own, null = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (null[1:] != null[:-1])
    if full is not None:
        free = ~np.isin(node, np.fromiter(full, dtype=np.int64, count=len(full)))
        so_far = np.cumsum(free)
        return free & (so_far - (so_far - free)[new][np.cumsum(new) - 1] <= k), rows
    out, n = np.zeros(len(own), dtype=bool), 0
    for i, (first, x) in enumerate(zip(new.tolist(), node.tolist(), strict=True)):
        n = 0 if first else n
        if n < k and load.get(x, 0) < cap:
            load[x], n, out[i] = load.get(x, 0) + 1, n + 1, True
    return out, rows


def bounded_load(ranks: DataFrame, k: int, cap: int) -> DataFrame:
    """(key, rank, node): each key, in order, takes the first k nodes of its ranking whose load is below the cap.

    What a key takes depends on all keys before it, but only by which nodes are full. So stretches of keys are read side by side
    as if no more nodes became full; loads summed over stretches tell the first one in which one does. Those before it are settled, it is read
    key by key from the load that it meets, and those after it are read anew, fewer at a time if nodes fill up soon.
    The driver holds the loads of the nodes, and their sums in the stretches at hand.
    """
    spark = ranks.sparkSession
    own = materialise(ranks.select(F.col("key").cast("bigint").alias("key"), "rank", "node"))
    parts = max(1, -(-own.count() // LOADED))
    path = fresh(spark)
    own.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    cut = spark.read.schema("key bigint, rank int, node int, part int").parquet(path)

    def loads(low: int, high: int, full: set[int] | None, load: dict[int, int]) -> list:
        """(part, node, n) of stretches."""

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            taken, rows = _taken(rows, k, cap, full, dict(load))
            nodes, n = np.unique(rows["node"].to_numpy()[taken], return_counts=True)
            return pa.table([pa.array([key[0].as_py()] * len(n), pa.int32()), pa.array(nodes, pa.int32()), pa.array(n, pa.int64())], names=["part", "node", "n"])

        return cut.where(F.col("part").between(low, high - 1)).groupBy("part").applyInArrow(run, "part int, node int, n bigint").collect()  # bounded: nodes times stretches

    load: dict[int, int] = {}
    how: list[tuple[set[int] | None, dict[int, int]]] = []  # of each stretch
    wide = parts
    while (low := len(how)) < parts:
        full = {x for x, n in load.items() if n >= cap}
        high = min(parts, low + wide)
        found: dict[int, list] = {}
        for r in loads(low, high, full, {}):
            found.setdefault(r["part"], []).append((r["node"], r["n"]))
        for part in range(low, high):
            if any(load.get(x, 0) + n > cap for x, n in found.get(part, ())):
                how.append((None, dict(load)))
                for r in loads(part, part + 1, None, load):
                    load[r["node"]] = load.get(r["node"], 0) + r["n"]
                break
            how.append((full, {}))
            for x, n in found.get(part, ()):
                load[x] = load.get(x, 0) + n
        wide = max(1, 2 * (len(how) - low - 1)) if len(how) < high else 4 * wide

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        full, met = how[key[0].as_py()]
        taken, rows = _taken(rows, k, cap, full, dict(met))
        return rows.select(["key", "rank", "node"]).filter(pa.array(taken))

    return cut.groupBy("part").applyInArrow(run, "key bigint, rank int, node int")


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(moved): how many (key, node) of one placement are not in another."""
    return before.select("key", "node").join(after.select("key", "node"), ["key", "node"], "left_anti").agg(F.count("*").alias("moved"))


def load_stddev(placement: DataFrame, n: int) -> DataFrame:
    """(mean, stddev) of the loads of n nodes, idle ones included."""
    loads = placement.groupBy("node").agg(F.count("*").alias("load"))
    mean = F.sum("load") / n
    return loads.agg(mean.alias("mean"), F.sqrt(F.sum(F.col("load") * F.col("load")) / n - mean * mean).alias("stddev"))


def chi_squared(counts: DataFrame, cells: int) -> DataFrame:
    """(chi2) of a column n against equal shares of so many cells, those that are missing included."""
    expected = F.sum("n") / cells
    return counts.agg((F.sum(F.col("n") * F.col("n")) / expected - F.sum("n")).alias("chi2"))


def ring(nodes: DataFrame, points: int) -> DataFrame:
    """(place, node): a hash ring with so many points of each node, as unsigned order keys."""
    from ..functions.hashing import md5_64, unsigned

    spread = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return spread.select(unsigned(md5_64(F.concat_ws("/", F.col("node").cast("string"), F.col("point").cast("string")))).alias("place"), "node")


def on_ring(keys: DataFrame, key: str, points: DataFrame) -> DataFrame:
    """(key, node): the first point from a key's place on, or the first of all.

    The ring is cut into about as many cells as it has points; a key looks through the few points of its cell, and
    beyond them is the first one of a later cell, which the cell holds too. Cells are joined by their number.
    """
    from ..functions.hashing import md5_64, unsigned

    n = points.count()
    bits = max(1, min(30, (max(1, n) - 1).bit_length()))
    cell = lambda place: F.shiftright(place, 64 - bits)
    own = points.groupBy(cell(F.col("place")).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("points"))
    every = keys.sparkSession.range(-(1 << bits - 1), 1 << bits - 1).withColumnRenamed("id", "cell").join(own, "cell", "left")
    later = F.first(F.get("points", F.lit(0)), ignorenulls=True).over(Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing))
    first = F.first(F.get("points", F.lit(0)), ignorenulls=True).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cells = every.select("cell", "points", F.coalesce(later, first)["node"].alias("after"))
    asked = keys.select(F.col(key).alias("key"), unsigned(md5_64(F.col(key).cast("string"))).alias("at"))
    met = asked.withColumn("cell", cell(F.col("at"))).join(cells, "cell", "left")
    found = F.filter("points", lambda p: p["place"] >= F.col("at"))
    return met.select("key", F.coalesce(F.get(found, F.lit(0))["node"], F.col("after")).alias("node"))


# comparators and tests of a reservoir


def algorithm_r(k: int, n: int, seed: int) -> list[int]:
    """A reservoir of k of 0 .. n-1 by a draw for each item: what Reservoir is compared with."""
    rng = random.Random(seed)
    out = list(range(min(k, n)))
    for x in range(k, n):
        at = rng.randrange(x + 1)
        if at < k:
            out[at] = x
    return out


def algorithm_l(k: int, n: int, seed: int) -> list[int]:
    """The same by skips of geometric lengths: about k ln(n / k) draws."""
    rng = random.Random(seed)
    out, at, w = list(range(min(k, n))), k - 1, 1.0
    while True:
        w *= math.exp(math.log(1.0 - rng.random()) / k)
        at += math.floor(math.log(1.0 - rng.random()) / math.log1p(-w)) + 1 if w < 1.0 else 1
        if at >= n:
            return out
        out[rng.randrange(k)] = at


def balance(chosen: DataFrame, n: int) -> DataFrame:
    """(test, cells, chi2) of rankings (key, nodes): the node at each place, the pair of the first two, and each bit of a node, against equal shares.

    For the bits, only nodes below the greatest power of two in n count.
    """
    at = chosen.select(F.posexplode("nodes").alias("rank", "node"))
    width = n.bit_length() - 1
    one = at.select(F.concat(F.lit("node "), F.col("rank").cast("string")).alias("test"), F.lit(n).alias("cells"), F.col("node").cast("string").alias("cell"))
    pair = F.array_join(F.array_sort(F.slice("nodes", 1, 2)), "/")
    two = chosen.where(F.size("nodes") > 1).select(F.lit("pair"), F.lit(n * (n - 1) // 2), pair)
    bits = at.where(F.col("node") < 1 << width).withColumn("bit", F.explode(F.expr(f"sequence(0, {width - 1})")) if width else F.lit(None).cast("int"))
    bits = bits.select(F.concat(F.lit("bit "), F.col("bit").cast("string")), F.lit(2), F.expr("cast(shiftright(node, bit) & 1 as string)"))
    counts = one.union(two).union(bits).where("test is not null").groupBy("test", "cells", "cell").agg(F.count("*").alias("n"))
    expected = F.sum("n") / F.col("cells")
    return counts.groupBy("test", "cells").agg((F.sum(F.col("n") * F.col("n")) / expected - F.sum("n")).alias("chi2"))
