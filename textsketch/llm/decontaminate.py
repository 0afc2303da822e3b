"""Benchmark passages in documents: random-walk embedding and bit-sampling hashes over windows, exact edit verification.

Texts are sequences of words. Windows of an item's length are looked at where enough of the item's
word pairs lie near one diagonal to be within reach of it: an edit costs at most two pairs, so nothing
within the limit is lost. Item and windows are embedded by walks (the CGK embedding): at each step a walk
writes the word that it stands on, and a hash of walk, step and word tells whether it goes on to the next. So few edits
become few differences at equal steps. Samples of steps are compared; their number and size follow from the
item's length, by a simulation of pairs at the edit limit, so that RECALL of these meet in some sample.
Places that meet are aligned first, ends free. Those that don't are aligned too, unless their common pairs show that
they can't be better than what was found: sampling saves alignments and loses nothing.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, filtered, pick

#: Edits allowed, as a share of an item's words. Fewer words than these don't make a document unclean (matches() reports items of any length).
EDITS, CLEAN_WORDS = 0.2, 5
#: Share of pairs at the edit limit that meet in a sample; walks, samples of each, steps in a sample at most; pairs of the simulation.
RECALL, WALKS, SAMPLES, POSITIONS, SIMULATED = 0.97, 8, 32, 10, 120
#: Items, and characters of them, that are looked for at once; with more, documents are read once for each block of items.
BLOCK, BLOCK_CHARS = 20_000, 8 << 20
#: A pair with more places in the items than this isn't looked up, if an item has enough others.
COMMON = 64
#: Numbers of an embedding that are held at once.
_HELD = 1 << 22
_word = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _word((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embed(rows: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """The words that each walk writes, in three steps for each word of a row: rows x walks x steps; -1 after the end."""
    count, n = rows.shape
    padded = np.concatenate([rows, np.full((count, 1), -1)], axis=1)
    at, out = np.zeros((count, len(walks)), dtype=np.int64), np.empty((count, len(walks), 3 * n), dtype=np.int64)
    own = np.arange(count)[:, None]
    for step in range(3 * n):
        word = padded[own, at]
        out[:, :, step] = word
        key = _mix((walks.astype(np.uint64) << np.uint64(32)) + np.uint64(step + 1))
        at = np.minimum(n, at + (_mix(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key) >> np.uint64(63)).astype(np.int64))
    return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """So many random edits (half of them substitutions) by words that occur nowhere else."""
    own = words.tolist()
    for k in range(edits):
        at, kind = int(rng.integers(0, max(1, len(own)))), rng.random()
        own[at : at + (kind < 0.75)] = [] if kind < 0.25 else [-2 - k]
    return np.array(own, dtype=np.int64)


@functools.lru_cache(maxsize=1024)
def _shape(n: int) -> tuple[int, int]:
    """(walks, positions of a sample) for items of n words: the longest samples of which RECALL meet at the limit, by a simulation."""
    rng, limit = np.random.default_rng(n), int(EDITS * n)
    pairs = [(x := rng.permutation(4 * n)[:n], edited(x, limit, rng)) for _ in range(SIMULATED)]
    others = np.stack([np.concatenate([b[:n], -100 - np.arange(n - len(b))]) if len(b) < n else b[:n] for _, b in pairs])
    walks = WALKS
    while True:
        same = (embed(np.stack([a for a, _ in pairs]), np.arange(walks)) == embed(others, np.arange(walks))).mean(axis=2)
        for positions in range(min(POSITIONS, 3 * n), 0, -1):
            if (1 - ((1 - same**positions) ** SAMPLES).prod(axis=1)).mean() >= RECALL or positions == 1 and walks >= 8 * WALKS:
                return walks, positions
        walks *= 2


@functools.lru_cache(maxsize=4096)
def plan(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(walks, steps of each sample: walks x samples x positions) for items of n words; beyond 64, shaped like the next of four lengths to a doubling."""
    step = max(1, 1 << n.bit_length() - 3 if n > 64 else 1)
    walks, positions = _shape(-(-n // step) * step)
    return np.arange(walks), np.random.default_rng(n).integers(0, 3 * n, (walks, SAMPLES, positions))


def meet(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which of these windows, as long as the item, equal it in all steps of some sample."""
    walks, steps = plan(len(item))
    own, out = embed(item[None], walks)[0], []
    size = max(1, _HELD // (3 * len(item) * len(walks)))
    for k in range(0, len(windows), size):
        same = embed(windows[k : k + size], walks) == own
        out.append(same[:, np.arange(len(walks))[:, None, None], steps].all(axis=3).any(axis=(1, 2)))
    return np.concatenate(out)


@dataclass
class Items:
    """A block of benchmark items, indexed."""

    ids: list[int] = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    single: dict[int, list[int]] = field(default_factory=dict)

    def build(self, rows: list[tuple[int, str]], least: int = 1) -> Items:
        """From (id, text) rows; items of fewer words than `least` are left out."""
        for item, text in rows:
            of = words(text)
            if len(of) >= max(1, least):
                self.ids.append(item)
                self.tokens.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in of], dtype=np.int64))
                if len(of) == 1:
                    self.single.setdefault(int(self.tokens[-1][0]), []).append(item)
        self._postings()
        return self

    def _postings(self) -> None:
        """The places of each word pair in the items, but for very common pairs of items that can do without."""
        self.allowed = np.array([int(EDITS * len(t)) for t in self.tokens], dtype=np.int64)
        item = np.concatenate([np.full(len(t) - 1, k) for k, t in enumerate(self.tokens)] or [np.zeros(0, int)]).astype(np.int64)
        place = np.concatenate([np.arange(len(t) - 1) for t in self.tokens] or [np.zeros(0, int)]).astype(np.int64)
        code = np.concatenate([self.code(t) for t in self.tokens] or [np.zeros(0, int)]).astype(np.int64)
        _, back, n = np.unique(code, return_inverse=True, return_counts=True)
        rare = n[back] <= COMMON
        own = np.bincount(item[rare], minlength=len(self.tokens)) if len(item) else np.zeros(0, int)
        without = own - 2 * self.allowed >= 1
        counted = rare | ~without[item]
        self.own = np.where(without, own, [len(t) - 1 for t in self.tokens]).astype(np.int64)
        self.need = np.maximum(1, self.own - 2 * self.allowed)
        order = np.argsort(code[counted], kind="stable")
        self.codes, first = np.unique(code[counted][order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.place = item[counted][order], place[counted][order]

    def code(self, t: np.ndarray) -> np.ndarray:
        return t[:-1] * (len(self.vocabulary) + 1 << 8) + t[1:]

    def starts(self, t: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each item within reach, the starts of windows to look at, where pairs in common lie near one diagonal, and the diagonals of all pairs."""
        known = (t[:-1] > 0) & (t[1:] > 0)
        at = np.nonzero(known)[0]
        if not len(at) or not len(self.codes):
            return {}
        code = self.code(t)[at]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[k] == code
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        posting = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = self.item[posting], np.repeat(at, n) - self.place[posting]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        end = np.arange(len(item)) + self.need[item] - 1
        good = np.nonzero(end < len(item))[0]
        good = good[(item[end[good]] == item[good]) & (diagonal[end[good]] - diagonal[good] <= 2 * self.allowed[item[good]])]
        found: dict[int, set[int]] = defaultdict(set)
        for g in good.tolist():
            found[int(item[g])].update(range(int(diagonal[g]), int(diagonal[end[g]]) + 1))
        return {x: (np.array(sorted(v)), diagonal[slice(*np.searchsorted(item, [x, x + 1]))]) for x, v in found.items()}

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, words of it, first word, end, edits) of the best place of each item that is there."""
        t = np.array(list(map(self.vocabulary.get, words(text), repeat(0))), dtype=np.int64)
        found = []
        for word, items in self.single.items():
            if len(at := np.nonzero(t == word)[0]):
                found += [(x, 1, int(at[0]), int(at[0]) + 1, 0) for x in items]
        for item, (at, diagonals) in self.starts(t).items():
            tokens, slack = self.tokens[item], int(self.allowed[item])
            n = len(tokens)
            where = at[:, None] + np.arange(n)
            windows = np.where((where >= 0) & (where < len(t)), t[np.clip(where, 0, len(t) - 1)], 0)
            equal = np.nonzero((windows == tokens).all(axis=1))[0]
            if len(equal):  # no place is better
                found.append((self.ids[item], n, int(at[equal[0]]), int(at[equal[0]]) + n, 0))
                continue
            if not slack:
                continue
            met = meet(tokens, windows)
            spans: list[list[int]] = []  # first and last start, and whether one of its windows meets the item
            for start, hit in zip(at.tolist(), met.tolist(), strict=True):
                if spans and start - spans[-1][1] <= n:
                    spans[-1][1:] = [start, max(spans[-1][2], hit)]
                else:
                    spans.append([start, start, hit])
            best = None
            for k in sorted(range(len(spans)), key=lambda k: (not spans[k][2], k)):
                first, last, _ = spans[k]
                pairs = np.searchsorted(diagonals, last + 2 * slack, "right") - np.searchsorted(diagonals, first - 2 * slack)
                least = -(-max(0, int(self.own[item]) - int(pairs)) // 2)
                if best and (least, k) > best[:2]:  # neither fewer edits nor an earlier place
                    continue
                a, b = max(0, first - 2 * slack), min(len(t), last + n + 2 * slack)
                edits, start, stop = align(tokens, t[a:b])
                if edits <= slack and (best is None or (edits, k) < best[:2]):
                    best = (edits, k, (self.ids[item], n, a + start, a + stop, edits))
            if best:
                found.append(best[2])
        return sorted(found)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any stretch of the text, with that stretch; the first one at a tie."""
    m = len(text)
    cost, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    step = np.arange(m + 1)
    for x in item:
        best = cost + 1
        origin = start.copy()
        swap = cost[:-1] + (text != x)
        better = swap <= best[1:]
        best[1:], origin[1:] = np.where(better, swap, best[1:]), np.where(better, start[:-1], origin[1:])
        low = np.minimum.accumulate((best - step) * (m + 1) * 2 + step)  # insertions come from the left
        source = low % ((m + 1) * 2)
        cost, start = best[source] + (step - source), origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


def _blocks(texts: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Different item texts (key, text) in blocks of a bounded number and size; each is read and looked for by itself."""
    count, size = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, -(-count // BLOCK), -(-(size or 0) // BLOCK_CHARS))
    for k in range(n):
        yield sorted((r["key"], r["text"]) for r in texts.where(F.pmod(F.xxhash64(F.lit("block"), "key"), F.lit(n)) == k).collect())  # bounded: BLOCK, BLOCK_CHARS


def _texts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, key) of each item, and (key, text) of each different text: repeated items are looked for once."""
    own = pick(benchmark, item_id="bigint", text="string").where("text is not null").withColumn("key", F.xxhash64("text"))
    return own.select(F.coalesce("item_id", F.lit(-1)).alias("item_id"), "key"), own.groupBy("key").agg(F.first("text").alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, first_word, end_word, edits, similarity): the best place of each item in a document.

    Words are runs of letters, digits and _ in lower case. An item counts from a similarity of
    1 - EDITS on: edits of words against its number of words, so that items of fewer than five words must be
    there exactly; of equal places the first is named. Null and empty texts match nothing, nor do items without words;
    repeated rows of documents are returned again, repeated items too; a null item_id is -1; other columns are
    ignored, whatever they are called; an empty table on either side gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = pick(docs, doc_id="bigint", text="string")
    schema, out = "doc_id bigint, key bigint, n_words int, first_word bigint, end_word bigint, edits int, similarity double", None
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]
    ids, texts = _texts(benchmark)
    for rows in _blocks(texts):
        shared = docs.sparkSession.sparkContext.broadcast(Items().build(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *x, 1 - x[4] / x[1]) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in shared.value.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=t) for k, t in enumerate(types)], names=names)

        of = docs.mapInArrow(run, schema)
        out = of if out is None else out.union(of)
    return out.join(ids, "key").select("doc_id", "item_id", *names[2:])


def clean(docs: DataFrame, benchmark: DataFrame, least: int = CLEAN_WORDS) -> DataFrame:
    """The rows of docs, all columns, in which no item of at least so many words is found (a null or empty text stays)."""
    bounded_batches(docs.sparkSession)
    out = docs
    for rows in _blocks(_texts(benchmark)[1]):
        shared = docs.sparkSession.sparkContext.broadcast(Items().build(rows, least))
        out = filtered(out, "text", lambda texts, shared=shared: [not shared.value.find(t) for t in texts])
    return out
