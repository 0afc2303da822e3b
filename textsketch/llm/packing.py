"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised once, in place; every task cuts its own pieces into shards of a bounded
number of pieces, so nothing is shuffled to form them. A shard starts from best-fit decreasing.
Where that misses the lower bound, several islands evolve the shard: crossover injects whole
well-filled bins of one parent into another, drops the bins that held the same pieces and
best-fits the displaced ones; mutation dissolves the emptiest bins. After each epoch the elites
migrate along a ring. Bins left with room are released by all shards and packed once more
in shards of their own, so that the loss per shard doesn't add up.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, materialise, one_row, pick

CAPACITY, SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ROOM = 2048, 4096, 3, 2, 12, 4, 24
#: Tasks for each island and shard that evolves (more than one, as rows are dealt by chance), and at most.
SPREAD, TASKS = 2, 20_000
#: A shard's number holds whether it is of the second round, its task and its place in the task; a sequence's also the bin: all are different.
_TASK, _PLACE, _BIN = 21, 28, 12


class _Encoder:
    """encode(text), the ids of plain text, and the names and ids of added tokens."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        path = public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        #: Names of tokens that are found before all else, in the file of the same name for the other library.
        self.added: dict[str, bytes] = {}
        if os.path.exists(own := os.path.splitext(path)[0] + ".json"):
            with open(own, encoding="utf-8") as file:
                self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in json.load(file).get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> _Encoder:
    return _Encoder(vocabulary)


def token_bytes(text: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers; the name of an added token is that token."""
    own = _encoder(vocabulary)
    if any(name in text for name in own.added):
        return b"".join(own.added.get(x) or array("I", own.encode(x)).tobytes() for x in own.split(text) if x)
    return array("I", own.encode(text)).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, after a shorter first piece."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


# one shard


def _place(order: list[int], lengths: list[int], bins: list[list[int]], capacity: int) -> None:
    """Best fit of the items, in this order, into these bins or new ones."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        if free > lengths[i]:
            insort(room, (free - lengths[i], k))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    _place(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, bins, capacity)
    return bins


def _replace(loose: list[int], lengths: list[int], bins: list[list[int]], capacity: int) -> list[int]:
    """Swap displaced items into bins that they fill better than what is there; what is then displaced, largest first."""
    free = sorted((lengths[i], i) for i in loose)
    for own in bins:
        room = capacity - sum(lengths[i] for i in own)
        for k, i in enumerate(own):
            if not room:
                break
            at = bisect_left(free, (lengths[i] + room + 1, -1)) - 1  # the largest that fits in its place
            if at >= 0 and free[at][0] > lengths[i]:
                size, better = free.pop(at)
                room -= size - lengths[i]
                own[k] = better
                insort(free, (lengths[i], i))
    return [i for _, i in reversed(free)]


def _fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject a random half of b's best-filled third into a; place what a's dropped bins held besides."""
    loads = sorted(((sum(lengths[i] for i in x), k) for k, x in enumerate(b)), reverse=True)
    chosen = [b[k] for _, k in loads[: max(1, len(b) // 3)] if rng.random() < 0.5] or [b[loads[0][1]]]
    taken = {i for x in chosen for i in x}
    kept = [list(x) for x in a if taken.isdisjoint(x)]
    loose = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
    loose = _replace(loose, lengths, kept, capacity)
    child = [list(x) for x in chosen] + kept
    _place(loose, lengths, child, capacity)
    return child


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolve the emptiest bins and a few at random, swap their items in where they fill better, and best-fit the rest."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = set(order[: 1 + len(bins) // 50]) | set(rng.integers(0, len(bins), 2 + len(bins) // 50).tolist())
    child = [list(x) for k, x in enumerate(bins) if k not in gone]
    _place(_replace([i for k in gone for i in bins[k]], lengths, child, capacity), lengths, child, capacity)
    return child


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """The best grouping after so many generations, or as soon as the lower bound is met."""
    rng, least = np.random.default_rng(seed), -(-sum(lengths) // capacity)
    population = [list(map(list, s)) for s in seeds] or [best_fit(lengths, capacity)]
    while len(population) < POPULATION:
        bins: list[list[int]] = []
        noise = rng.uniform(0.85, 1.15, len(lengths))
        _place(sorted(range(len(lengths)), key=lambda i: -lengths[i] * noise[i]), lengths, bins, capacity)
        population.append(bins)
    ranked = sorted(((_fitness(p, lengths, capacity), k, p) for k, p in enumerate(population)), reverse=True)
    for g in range(generations):
        if -ranked[0][0][0] <= least:
            break
        a, b = ranked[0][2], ranked[int(rng.integers(1, len(ranked)))][2]
        for n, child in enumerate((crossover(a, b, lengths, capacity, rng), mutate(crossover(b, a, lengths, capacity, rng), lengths, capacity, rng))):
            ranked.append((_fitness(child, lengths, capacity), -(2 * g + n + 1), child))
        ranked = sorted(ranked, reverse=True)[:POPULATION]
    return ranked[0][2]


def _bins(of: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
    for i, b in enumerate(of):
        out[b].append(i)
    return out


def _numbers(bins: list[list[int]], n: int) -> list[int]:
    of = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            of[i] = b
    return of


# distributed

_ITEMS = [("doc_id", "bigint", pa.int64()), ("piece", "int", pa.int32()), ("start", "bigint", pa.int64()), ("length", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64())]
_SHARD = "shard bigint, " + ", ".join(f"{n} array<{t}>" for n, t, _ in _ITEMS)


def _number(again: int, task: int, place: int) -> int:
    if task >> _TASK or place >> _PLACE:
        raise ValueError("too many tasks or shards for numbers of 62 bits")
    return (again << _TASK | task) << _PLACE | place


def _row(number: int, items: list[tuple], capacity: int, ids: bool) -> pa.RecordBatch:
    lengths = [x[3] for x in items]
    bins = best_fit(lengths, capacity)
    lists = [pa.array([[x[k] for x in items]], pa.list_(t)) for k, (_, _, t) in enumerate(_ITEMS)]
    names = ["shard", *(n for n, _, _ in _ITEMS), "bin", "over"]
    more = [pa.array([_numbers(bins, len(items))], pa.list_(pa.int32())), pa.array([len(bins) - -(-sum(lengths) // capacity)], pa.int32())]
    if ids:
        more, names = [*more, pa.array([[x[5] for x in items]], pa.list_(pa.binary()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *more], names=names)


def _tokenised(capacity: int, vocabulary: str, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, items = TaskContext.get().partitionId(), 0, []
        for doc_id, text in one_row(batches):
            of = memoryview(token_bytes(text or "", vocabulary) + bytes(4))
            for k, (start, length) in enumerate(cut(len(of) // 4, capacity)):
                own = of[4 * start : 4 * (start + length)]
                items.append((doc_id, k, start, length, zlib.crc32(own), *([bytes(own)] if ids else [])))
                if len(items) == SHARD:
                    yield _row(_number(0, task, n), items, capacity, ids)
                    n, items = n + 1, []
        if items:
            yield _row(_number(0, task, n), items, capacity, ids)

    return run


def _islands(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, island, lengths, seeds in one_row(batches):
            seed = zlib.crc32(f"{shard}/{island}/{epoch}".encode())
            bins = evolve(lengths, capacity, [_bins(s) for s in seeds], seed)
            count, fit = _fitness(bins, lengths, capacity)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "island": pa.array([island], pa.int32()), "fit": pa.array([count + fit]), "elite": pa.array([_numbers(bins, len(lengths))], pa.list_(pa.int32()))})

    return run


def _evolved(shards: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """The shards that best fit left above the lower bound, with the best bins of all islands."""
    ring = F.sequence(F.lit(0), F.lit(islands - 1))
    tasks = min(TASKS, max(1, SPREAD * islands * shards.count()))
    now = shards.select("shard", F.explode(ring).alias("island"), "length", F.array("bin").alias("seeds"))
    for epoch in range(epochs):
        best = now.repartition(tasks, "shard", "island").mapInArrow(_islands(capacity, epoch), f"shard {shards.schema['shard'].dataType.simpleString()}, island int, fit double, elite array<int>")
        elites = best.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("island", "fit", "elite"))).alias("ring"))
        if epoch < epochs - 1:  # an elite moves to the next island of its ring
            to = elites.select("shard", F.posexplode("ring").alias("island", "own"), "ring")
            seeds = F.array("own.elite", F.element_at("ring", F.pmod(F.col("island") + 1, F.size("ring")) + 1)["elite"])
            now = to.select("shard", "island", seeds.alias("seeds")).join(shards.select("shard", "length"), "shard").select("shard", "island", "length", "seeds")
    return elites.select("shard", F.array_max(F.transform("ring", lambda x: F.struct(x["fit"], -x["island"], x["elite"])))["elite"].alias("found"))


def _settled(shards: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """A row for each piece, with the bin of its shard and the room left in that bin."""
    found = _evolved(shards.where("over > 0"), capacity, islands, epochs)
    lists = [c for c in shards.columns if c not in ("shard", "bin", "over")]
    done = shards.join(found, "shard", "left").select("shard", F.arrays_zip(*lists, F.coalesce("found", "bin").alias("bin")).alias("z"))
    flat = done.select("shard", F.inline("z"))
    from pyspark.sql import Window

    of = Window.partitionBy("shard", "bin")
    before = of.orderBy("doc_id", "piece", "start", "ids_crc32", "place").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("place", F.monotonically_increasing_id())
    return flat.select("*", (capacity - F.sum("length").over(of)).alias("room"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")).drop("place")


def _released(capacity: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, items = TaskContext.get().partitionId(), 0, []
        for item in one_row(batches):
            items.append(item)
            if len(items) == SHARD:
                yield _row(_number(1, task, n), items, capacity, ids)
                n, items = n + 1, []
        if items:
            yield _row(_number(1, task, n), items, capacity, ids)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken", keep_ids: bool = False, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`, little-endian
    unsigned 32-bit, if keep_ids). A null or empty text is one end-of-text id (0). Repeated rows
    are packed as often as they occur; a null doc_id stays null; an empty table gives no rows;
    other columns are ignored. Sequence ids are made of the shard's and the bin's numbers, so that no two
    sequences share one. A very long text is cut into whole sequences after a shorter first
    piece. A shard holds at most SHARD pieces, whatever the input.
    """
    bounded_batches(docs.sparkSession)
    schema = f"{_SHARD}, bin array<int>, over int" + ", ids array<binary>" * keep_ids
    docs = pick(docs, doc_id="bigint", text="string")
    shards = materialise(docs.mapInArrow(_tokenised(capacity, vocabulary, keep_ids), schema))
    first = materialise(_settled(shards, capacity, islands, epochs))
    own = [n for n, _, _ in _ITEMS] + ["ids"] * keep_ids
    loose = first.where(F.col("room") > ROOM).select(*own)
    n = max(1, -(-loose.count() // SHARD))  # one shard for each partition
    again = materialise(loose.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(_released(capacity, keep_ids), schema))
    out = first.where(F.col("room") <= ROOM).unionByName(_settled(again, capacity, islands, epochs))
    return out.select(*own[:5], F.shiftleft("shard", _BIN).bitwiseOR(F.col("bin").cast("bigint")).alias("sequence_id"), F.col("offset").cast("bigint").alias("offset"), *own[5:])
