"""Sparse n-grams for substring search: an index side, and a query side that covers a query with fewest grams.

A gram is any pair of bytes, or a stretch of three to eight whose outer pairs are both rarer than every
pair within. A document has few such grams, and a query that occurs in it is covered by some of them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bigram_table import priority
from ..functions.fold import fold_text, index_fold_bytes, simple_fold
from ..functions.literals import int_array
from ..functions.shared import spread, stretches

_U = np.uint64
LONGEST, MASK, PAYLOAD = 8, (1 << 27) - 1, 24
_MULTIPLIER = 0x9E3779B97F4A7C15


# keys


def _mix(x: int) -> int:
    x ^= x >> 15
    x = x * 0x2C1B3C6D & MASK
    x ^= x >> 12
    x = x * 0x297A2D39 & MASK
    return x ^ x >> 15


def _unmix(x: int) -> int:
    x ^= x >> 15
    x = x * pow(0x297A2D39, -1, 1 << 27) & MASK
    x ^= x >> 12 ^ x >> 24
    x = x * pow(0x2C1B3C6D, -1, 1 << 27) & MASK
    return x ^ x >> 15


def gram_key(gram: bytes) -> int:
    """27 bits: length and content of two or three bytes, or length and 24 bits of a hash; scrambled."""
    if len(gram) <= 3:
        payload = int.from_bytes(gram, "big")
    else:
        payload = (int.from_bytes(gram, "little") * _MULTIPLIER & (1 << 64) - 1) >> 64 - PAYLOAD
    return _mix((len(gram) - 2) << PAYLOAD | payload)


def gram_length(key: int) -> int:
    return (_unmix(key) >> PAYLOAD & 7) + 2


def max_sparse_grams(n: int) -> int:
    """A text of n bytes has no more grams than this."""
    return 3 * (n - 1) if n > 1 else 0


# index side


@functools.cache
def priorities() -> np.ndarray:
    table = np.zeros((256, 256), dtype=np.uint32)
    for a in range(128):
        for b in range(128):
            table[a, b] = priority(a, b)
    return table


def _by_size(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of all grams, for each length."""
    n = len(data)
    if n < 2:
        return
    p = priorities()[data[:-1], data[1:]].astype(np.int64)
    yield 2, np.arange(n - 1)
    within = np.full(max(0, n - 2), 1 << 40)  # the least pair inside, for stretches from each start
    for size in range(3, LONGEST + 1):
        m = n - size + 1
        if m <= 0:
            return
        if size > 3:
            within = np.minimum(within[:m], p[size - 3 : size - 3 + m])
        yield size, np.nonzero(np.maximum(p[:m], p[size - 2 : size - 2 + m]) < within[:m])[0]


def sparse_spans(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ends, lengths) of all grams, by end and then length."""
    own = [(at + size, np.full(len(at), size)) for size, at in _by_size(np.frombuffer(content, dtype=np.uint8))]
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    e, size = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.lexsort((size, e))
    return e[order], size[order]


def _scrambled(x: np.ndarray) -> np.ndarray:
    mask = np.uint64(MASK)
    x = x ^ x >> np.uint64(15)
    x = x * np.uint64(0x2C1B3C6D) & mask
    x = x ^ x >> np.uint64(12)
    x = x * np.uint64(0x297A2D39) & mask
    return x ^ x >> np.uint64(15)


def _grams_of(texts: list[bytes], held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, end) of all grams of many texts, in no order; of those held alone, if any."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    content = b"".join(texts)
    data, of = np.frombuffer(content, dtype=np.uint8), np.repeat(np.arange(len(texts)), sizes)
    words = np.ndarray((len(content),), dtype="<u8", buffer=content + bytes(LONGEST), strides=(1,))  # eight bytes from each place on
    out = []
    for size, at in _by_size(data):
        at = at[of[at] == of[at + size - 1]]  # within one text
        x = words[at] & _U((1 << 8 * size) - 1)
        if size > 3:  # big-endian for short grams, little-endian for the hash of long ones
            x = (x * _U(_MULTIPLIER)) >> _U(64 - PAYLOAD)
        else:
            x = functools.reduce(lambda y, k: y << _U(8) | x >> _U(8 * k) & _U(255), range(size), np.zeros(len(x), np.uint64))
        keys = _scrambled(_U(size - 2 << PAYLOAD) | x).astype(np.int32)
        if held is not None:
            some = np.nonzero(held[1][keys & 0xFFFFF])[0]
            some = some[np.isin(keys[some], held[0])]
            keys, at = keys[some], at[some]
        out.append((of[at], keys, at + size - first[of[at]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))


def sparse_grams(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends) of all grams, by end and then length."""
    _, keys, ends = _grams_of([content])
    order = np.argsort(ends, kind="stable")  # they come by length
    return keys[order], ends[order]


def collect_sparse_grams(content: bytes) -> list[int]:
    return sparse_grams(content)[0].tolist()


def extract(df: DataFrame, key: str, text: str, fold: bool = True, distinct: bool = False, wanted: list[int] | None = None) -> DataFrame:
    """(key, gram, end) of each text, index-folded to one byte for each character; distinct: (key, gram). With `wanted`, only those grams."""
    held = None
    if wanted is not None:  # low bits that any of them has, then the grams themselves
        own, low = np.array(sorted(wanted), dtype=np.int32), np.zeros(1 << 20, dtype=bool)
        low[own & 0xFFFFF] = True
        held = df.sparkSession.sparkContext.broadcast((own, low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole)):
            texts = [b"" if t is None else index_fold_bytes(t) if fold else t.encode() for t in batch.column(1).to_pylist()]
            of, grams, ends = _grams_of(texts, held.value if held is not None else None)
            if distinct:
                both = np.unique(of.astype(np.int64) << 32 | grams)
                of, grams = both >> 32, both & 0xFFFFFFFF
            columns = [batch.column(0).take(pa.array(of)), pa.array(grams.astype(np.int32))]
            if not distinct:
                columns.append(pa.array(ends.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "gram", "end"][: len(columns)])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text)).mapInArrow(run, f"key {kind}, gram int" + ("" if distinct else ", end int"))


def native_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, length) by array expressions alone, over the bytes of the text: the definition, unoptimised."""
    hexed = F.hex(F.encode(F.col(text), "UTF-8"))
    n = F.octet_length(text)
    byte = lambda k: F.conv(F.substring(F.col("__h"), 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    table = int_array(priorities()[:128, :128].ravel().tolist())
    pair = lambda k: F.when((byte(k) < 128) & (byte(k + 1) < 128), F.element_at(table, byte(k) * 128 + byte(k + 1) + 1)).otherwise(0)
    base = df.select(F.col(key).alias("key"), n.alias("n"), hexed.alias("__h")).where("n > 1")
    base = base.withColumn("p", F.transform(F.sequence(F.lit(0), F.col("n") - 2), pair)).select("key", "n", "p")
    spans = base.select("key", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("start"), "n")
    spans = spans.select("key", "p", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.col("n") - F.col("start")))).alias("length"))
    left, right = F.element_at("p", F.col("start") + 1), F.element_at("p", F.col("start") + F.col("length") - 1)
    inner = F.array_min(F.slice("p", F.col("start") + 2, F.greatest(F.col("length") - 3, F.lit(0))))
    return spans.where((F.col("length") == 2) | (F.greatest(left, right) < F.coalesce(inner, F.lit(1 << 40)))).select("key", "start", "length")


# query side

Emit = Callable[[bytes, int, int | None], None]


class QueryGrams:
    """Fed a query's characters, it tells the grams of a least cover as soon as they are certain.

    Held are the pairs that may still end a gram: rising priorities, the first one being the left end.
    """

    def __init__(self) -> None:
        self.content, self.size = b"", 0
        self.queue: list[tuple[int, int]] = []  # end of a pair, priority

    def state(self) -> tuple[int, bytes]:
        """What distinguishes it from others, whatever comes: the bytes from the left end on."""
        begin = self.queue[0][0] - 2 if self.queue else 0
        n = self.size - begin
        return n, self.content[len(self.content) - n :] if n else b""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, QueryGrams) and self.state() == other.state()

    def __hash__(self) -> int:
        return hash(self.state())

    def min_priority(self) -> int:
        return self.queue[0][1] if self.queue else (1 << 32) - 1

    def _tell(self, begin: int, end: int, emit: Emit) -> None:
        base = self.size - len(self.content)
        gram = self.content[begin - 2 - base : end - base]
        emit(gram, end, self.content[end - base] if end < self.size else None)

    def append_char(self, char: str, emit: Emit) -> None:
        for byte in index_fold_bytes(char):
            self.append_byte(byte, emit)

    def append_byte(self, byte: int, emit: Emit) -> None:
        self.content = (self.content + bytes([byte]))[-LONGEST:]
        self.size += 1
        if self.size == 1:
            return
        end, value = self.size, int(priorities()[self.content[-2], byte])
        if self.queue and value < self.queue[0][1]:  # no longer gram begins further left
            begin, least = self.queue.pop(0)
            while self.queue and self.queue[0][1] == least:
                nxt, _ = self.queue.pop(0)
                self._tell(begin, nxt, emit)
                begin = nxt
            self.queue = [(end, value)]
            self._tell(begin, end, emit)
        else:
            while self.queue and self.queue[-1][1] > value:
                self.queue.pop()
            self.queue.append((end, value))
        if end - self.queue[0][0] + 2 >= LONGEST and len(self.queue) > 1:
            begin, _ = self.queue.pop(0)
            self._tell(begin, self.queue[0][0], emit)

    def flush(self, emit: Emit) -> None:
        if self.size == 2:
            self._tell(2, 2, emit)
        while len(self.queue) > 1:
            begin, _ = self.queue.pop(0)
            self._tell(begin, self.queue[0][0], emit)

    def consume_first(self, emit: Emit) -> None:
        """Tell the first gram and forget what is left of it; at last it is as new."""
        if len(self.queue) > 1:
            begin, _ = self.queue.pop(0)
            self._tell(begin, self.queue[0][0], emit)
        elif self.size == 2:
            self._tell(2, 2, emit)
        if len(self.queue) <= 1:
            self.queue = []
            self.size = 1 if self.size > 1 else 0
            self.content = self.content[-1:] if self.size else b""


def cover(query: str, fold: bool = True) -> list[tuple[bytes, int]]:
    """(gram, end) of a least cover of a query; none if it has fewer than two bytes."""
    state, out = QueryGrams(), []
    emit = lambda gram, end, _: out.append((gram, end))
    for byte in index_fold_bytes(query) if fold else query.encode():
        state.append_byte(byte, emit)
    state.flush(emit)
    return out


def least_cover_size(query: str) -> int:
    """By dynamic programming over all grams of the query: what cover() attains."""
    data = index_fold_bytes(query)
    n = len(data)
    if n <= 2:
        return int(n == 2)
    spans = [(int(e - s) + 1, int(e) - 1) for e, s in zip(*sparse_spans(data), strict=True)]
    best = [0] * n  # from each inner byte on
    for at in range(n - 2, 0, -1):
        best[at] = min((1 + best[min(end, n - 1)] for begin, end in spans if begin <= at < end), default=1 << 30)
    return best[1]


def covers(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, end) of a least cover of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, gram_key(g), e) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t is not None for g, e in cover(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["key", "gram", "end"])

    return queries.select(key, text).mapInArrow(run, f"key {dict(queries.dtypes)[key]}, gram int, end int")


# search

#: Grams of all queries that are sent to every task.
GRAMS = 1 << 18
#: Bytes of queries that are.
SENT = 64 << 20


def _contained(docs: DataFrame, doc: str, text: str, queries: DataFrame, grams: list[int]) -> DataFrame:
    """(__q, __d): where all cover grams of a query are among those of a text, the text is looked through, in the task that reads it: no posting leaves it."""
    spark = docs.sparkSession
    own = [(r["q"], r["f"], sorted({gram_key(g) for g, _ in cover(r["w"])})) for r in queries.where("w is not null").collect()]  # whose grams are few, as are the queries
    own = [x for x in own if x[2]]
    sorted_, low = np.array(sorted(grams), dtype=np.int32), np.zeros(1 << 20, dtype=bool)
    low[sorted_ & 0xFFFFF] = True
    at = {g: i for i, g in enumerate(sorted_.tolist())}
    asking: list[list[int]] = [[] for _ in at]
    for i, (_, _, keys) in enumerate(own):
        for g in keys:
            asking[at[g]].append(i)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in asking])]).astype(np.int64)
    flat = np.array([i for x in asking for i in x], dtype=np.int64)
    sent = spark.sparkContext.broadcast((sorted_, low, offsets, flat, np.array([len(x[2]) for x in own], dtype=np.int64), [x[1] for x in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, offsets, flat, needed, folded = sent.value
        for batch in (part for whole in batches for part in stretches(whole)):
            texts = batch.column(1).to_pylist()
            of, keys, _ = _grams_of([b"" if t is None else index_fold_bytes(t) for t in texts], (held, low))
            both = np.unique(of.astype(np.int64) << 32 | np.searchsorted(held, keys))
            where = np.searchsorted(both >> 32, np.arange(len(texts) + 1))
            docs_, found = [], []
            for k, t in enumerate(texts):
                mine = both[where[k] : where[k + 1]] & 0xFFFFFFFF
                if not len(mine):
                    continue
                sizes = offsets[mine + 1] - offsets[mine]
                asked = flat[np.repeat(offsets[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                n = np.bincount(asked, minlength=len(needed))
                for i in np.nonzero(n == needed)[0].tolist():
                    docs_.append(k)
                    found.append(i)
            if docs_:
                whole = {k: fold_text(texts[k]) for k in set(docs_)}
                good = [(k, i) for k, i in zip(docs_, found, strict=True) if folded[i] in whole[k]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in good], pa.int64())), pa.array([i for _, i in good], pa.int64())], names=["__d", "__i"])

    met = spread(docs.select(doc, text)).mapInArrow(run, f"__d {dict(docs.dtypes)[doc]}, __i bigint")
    names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(own)], f"__i bigint, __q {dict(queries.dtypes)['q']}")
    return met.join(F.broadcast(names), "__i").select("__q", "__d")


def search(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", wanted: str = "text") -> DataFrame:
    """(query, doc): documents that contain a query, case-folded: cover grams meet postings, then texts are verified.

    While the covers have at most GRAMS different grams, these and the queries go to the tasks that extract, which verify too; beyond,
    postings are joined. Queries of one character have no grams: they are looked for among the characters of each text, all at once. Empty ones find nothing.
    """
    asked = covers(queries, query, wanted).select(F.col("key").alias("__q"), "gram").distinct()
    needed = asked.groupBy("__q").agg(F.count("*").alias("__n"))
    grams = asked.select("gram").distinct()
    few = [r["gram"] for r in grams.limit(GRAMS + 1).collect()]  # bounded: GRAMS
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(wanted)), F.lit(0)).alias("bytes")).first()
    if len(few) <= GRAMS and size["n"] <= GRAMS and size["bytes"] <= SENT:
        found = _contained(docs, doc, text, queries.select(F.col(query).alias("q"), F.col(wanted).alias("w"), simple_fold(F.col(wanted)).alias("f")), few)
    else:
        held = extract(docs, doc, text, distinct=True).withColumnRenamed("key", "__d").join(grams, "gram", "left_semi")
        met = held.join(asked, "gram").groupBy("__q", "__d").agg(F.count("*").alias("__m"))
        able = met.join(needed, "__q").where("__m = __n").select("__q", "__d")
        full = able.join(docs.select(F.col(doc).alias("__d"), F.col(text).alias("__t")), "__d")
        full = full.join(queries.select(F.col(query).alias("__q"), F.col(wanted).alias("__w")), "__q")
        found = full.where(F.contains(simple_fold(F.col("__t")), simple_fold(F.col("__w")))).select("__q", "__d")
    folded = simple_fold(F.col(wanted))
    short = queries.where(F.col(wanted).isNotNull()).where(F.char_length(folded) == 1).select(F.col(query).alias("__q"), folded.alias("__c"))
    if not short.isEmpty():
        texts = docs.where(F.col(text).isNotNull())
        chars = texts.select(F.col(doc).alias("__d"), F.explode(F.array_distinct(F.split(simple_fold(F.col(text)), ""))).alias("__c"))
        found = found.union(chars.join(short, "__c").select("__q", "__d"))
    return found.distinct().select(F.col("__q").alias(query), F.col("__d").alias(doc))


def bigram_priority(a: Column, b: Column) -> Column:
    """The priority of two bytes."""
    table = int_array(priorities()[:128, :128].ravel().tolist())
    return F.when((a < 128) & (b < 128), F.element_at(table, (a * 128 + b + 1).cast("int"))).otherwise(F.lit(0).cast("bigint"))
