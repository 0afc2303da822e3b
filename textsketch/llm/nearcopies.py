"""Near copies of documents: MinHash candidates, verified by the Jaccard similarity of their 5-word shingles.

Texts of one set of shingles are one node. A node has BANDS keys of ROWS minimum hashes each; nodes
that share a key are candidates: at similarity 0.8 a pair is missed with probability
(1 - 0.8 ** ROWS) ** BANDS = 0.0004. Each text with a candidate is read once more, with all that keys
lead to; there, pairs that share a key are compared by their sets unless they are linked already,
so that a group of near copies costs little more than its size and no list of pairs is made.
Groups of more than CHUNK nodes are compared in blocks of two chunks. Fingerprints within the
distance of `simhash` link as they do there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, connected_components, materialise, pick

SHINGLE, SIMILARITY, BANDS, ROWS, CHUNK = 5, 0.8, 20, 5, 512
_PART = 1 << 13
_TURNS = np.random.default_rng(11).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(simhash.shingles(text, SHINGLE))


def band_keys(own: np.ndarray) -> list[int]:
    """A key of each band: a hash of its minimum hashes; none without words."""
    if not len(own):
        return []
    low = np.min([(_TURNS * own[k : k + _PART]).min(axis=1) for k in range(0, len(own), _PART)], axis=0).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low)], dtype=np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def grouped(keys: list[list[int]], sets: list[np.ndarray], chunk: list[int], cross: bool) -> list[int]:
    """The least index that each reaches over similar pairs which share a key; if cross, over pairs of two chunks."""
    parent, buckets, failed = list(range(len(sets))), defaultdict(list), set()

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, of in enumerate(keys):
        for key in of:
            buckets[key].append(k)
    for members in buckets.values():
        for j, b in enumerate(members):
            for a in members[:j]:
                if cross and chunk[a] == chunk[b] or (a, b) in failed:
                    continue
                x, y = root(a), root(b)
                if x == y:
                    continue
                if alike(sets[a], sets[b]):
                    parent[max(x, y)] = min(x, y)
                else:
                    failed.add((a, b))
    return [root(k) for k in range(len(sets))]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, nodes, keys = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingle_set(text)
            fps.append(simhash.fingerprint(text))
            nodes.append(xxhash.xxh64_intdigest(own.tobytes()) if len(own) else 0)
            keys.append(band_keys(own))
        signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, nodes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "fp", "node", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) links of rows (block, cross, chunk, node, keys, text) that are sorted by block."""
    last, held = None, []

    def flush() -> pa.RecordBatch:
        cross, chunk, nodes, keys, sets = zip(*held, strict=True)
        group = grouped(keys, sets, chunk, cross[0])
        links = [(nodes[r], nodes[k]) for k, r in enumerate(group) if r != k]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for block, cross, chunk, node, keys, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and block != last:
                yield flush()
                held = []
            last = block
            held.append((cross, chunk, node, keys, shingle_set(text)))
    if held:
        yield flush()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): verified links of the nodes (node, least, keys), enough to connect all similar pairs that share a key."""
    narrow = nodes.select("node", F.explode("keys").alias("key"))
    low = narrow.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    parts = connected_components(narrow.join(low, "key").select(F.col("node").alias("a"), F.col("low").alias("b")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    chunks = F.when(F.col("n") <= CHUNK, 1).otherwise(F.ceil(F.col("n") / (CHUNK / 2))).cast("int")
    met = parts.join(sizes, "component").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.hash("node"), "chunks"))
    # of two chunks or more, each pair of chunks is a block, and each chunk by itself
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    least, most = F.least("chunk", "other"), F.greatest("chunk", "other")
    blocks = met.select("node", "chunk", F.xxhash64("component", least, most).alias("block"), (least != most).alias("cross"))
    none = F.lit(-(1 << 63))
    asked = parts.select("node").join(nodes, "node").select("node", "keys", F.coalesce("least.doc_id", none).alias("id"), F.col("least.same").alias("same"))
    texts = pick(docs, doc_id="bigint", text="string").select(F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("same"), "text")
    texts = materialise(asked.join(texts, ["id", "same"]).dropDuplicates(["node"]).select("node", "keys", "text"))
    rows = blocks.join(texts, "node").select("block", "cross", "chunk", "node", "keys", "text")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_verified, "a bigint, b bigint")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the row of the smallest doc_id.

    Near copies are texts whose 5-word shingles have a Jaccard similarity of 0.8 or whose fingerprints `simhash` links;
    groups are what links connect. Texts without words are one group; of fewer than five words, all words are
    one shingle. Rows with a null doc_id come last, and of rows that share id and text one stays.
    """
    bounded_batches(docs.sparkSession)
    marked = pick(docs, doc_id="bigint", text="string")
    marked = marked.select("doc_id", F.xxhash64("text").alias("same"), "text")
    marked = materialise(marked.mapInArrow(_marks, "doc_id bigint, same bigint, fp bigint, node bigint, keys array<bigint>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    nodes = materialise(marked.groupBy("node").agg(F.min(first).alias("least"), F.first("keys").alias("keys")))
    own = materialise(marked.select("fp", "node").distinct())
    heads = own.groupBy("fp").agg(F.min("node").alias("head"))
    near = simhash.links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    edges = links(docs, nodes).union(near.select("x", "y")).union(own.join(heads, "fp").select("node", "head"))
    parts = connected_components(edges)
    of = nodes.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("keeper"))
    return simhash.keep(docs, of.select("keeper.doc_id", "keeper.same"))
