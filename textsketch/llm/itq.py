"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learned that brings centred vectors close to the corners of a cube; the signs of
the rotated components are a balanced binary code. Each table indexes one substring of a code. Of vectors with
equal substrings, first only the codes meet: pairs whose Hamming distance over all codes is within reach of the threshold are
left, and only for vectors of these are the originals fetched and compared by their cosine in double precision.
Several rotations, learned from different beginnings, give as many tables as the wanted recall at
the threshold takes. Codes are of centred vectors: where vectors share a direction, pairs at the
threshold are further apart in angle after centring, so that agreement of bits is taken from there,
and substrings get shorter if there would be too many tables. A pair is counted in the first table in which it meets, so that no list of
pairs is ever made: tasks return counts and, for components, each vector's group in its block.
Equal vectors are one entry with a weight. A block of entries is named by two hashes of its table, label, dimension and
substring, and its rows are compared only where both are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, connected_components, materialise, pick

#: Cosine of a link; recall aimed at for pairs just above it; numbers (vectors times dimensions) that rotations are learned from, at most about.
THRESHOLD, RECALL, LEARNED = 0.93, 0.97, 1 << 21
BITS, STEPS, CHUNK, SMALL = 64, 25, 1024, 48
#: Tables at most, before substrings get shorter; vectors of the sample whose pairs are looked at; pairs just above the threshold that tell anything.
TABLES, COMPARED, TELLING = 128, 2048, 30


def learn(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal components, and a rotation fitted by turns to the signs and to their error."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(STEPS):
        signs = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        rotation = (left @ right).T
    return mean, axes @ rotation


def agreements(x: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Shares of bits in which pairs at the threshold agree: by the lengths of centred vectors, and of pairs in the sample."""
    x = x[:: max(1, len(x) // COMPARED)][:COMPARED]
    centred = x - x.mean(axis=0)
    lengths = np.maximum((centred * centred).sum(axis=1), 1e-12)
    cosines = [1 - (1 - threshold) / lengths]  # two of that length, as far apart as the threshold allows
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes[:, ::-1][:, :BITS]
    a, b = np.nonzero(np.triu((c := x @ x.T) >= threshold, 1) & (c < threshold + 0.02))
    if len(a) >= TELLING:
        norms = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
        cosines.append(np.array([v[i] @ v[j] / (norms[i] * norms[j]) for i, j in zip(a[:10_000].tolist(), b[:10_000].tolist(), strict=True)]))
    return [1 - np.arccos(np.clip(c, -1, 1)) / math.pi for c in cosines]


def tables_for(shares: list[np.ndarray], width: int, recall: float) -> int:
    """The least number of tables that gives the recall for each set of pairs; more than TABLES: too many."""
    n = 1
    while n <= TABLES and any((1 - (1 - s**width) ** n).mean() < recall for s in shares):
        n += 1
    return n


class Tables:
    """Rotations for each dimension met in the sample; others get rotations of no data."""

    def __init__(self, sample: list[np.ndarray], width: int, recall: float = RECALL, threshold: float = THRESHOLD):
        self.models: dict[int, list] = {}
        by: dict[int, list[np.ndarray]] = {}
        for x in sample:
            by.setdefault(len(x), []).append(x)
        own = {d: np.stack(rows) for d, rows in by.items()}
        self.shares = [np.array([1 - math.acos(threshold) / math.pi])] + [s for x in own.values() if len(x) > 1 for s in agreements(x, threshold)]
        while (tables := tables_for(self.shares, width, recall)) > TABLES and width:
            width -= 1
        self.width, self.tables = width, tables  # width 0: all are compared
        for d, x in own.items() if width else ():
            self.models[d] = self._rotations(x)

    def _rotations(self, x: np.ndarray) -> list:
        each = max(1, min(BITS, x.shape[1]) // self.width)
        return [learn(x, min(BITS, x.shape[1]), seed) for seed in range(-(-self.tables // each))]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A code for each rotation of each unit vector of one dimension: unsigned numbers, vectors x rotations."""
        d = x.shape[1]
        if not self.width:
            return np.zeros((len(x), 1), dtype=np.uint64)
        if d not in self.models:
            self.models[d] = self._rotations(np.zeros((0, d)))
        weights = np.uint64(1) << np.arange(min(BITS, d), dtype=np.uint64)
        return np.stack([(((x - mean) @ projection >= 0) * weights).sum(axis=1, dtype=np.uint64) for mean, projection in self.models[d]], axis=1)

    def substrings(self, codes: np.ndarray, d: int) -> np.ndarray:
        """The key of each code vector in each table: vectors x tables."""
        if not self.width:
            return np.zeros((len(codes), 1), dtype=np.int64)
        width, bits = min(self.width, d), min(BITS, d)
        mask = np.uint64((1 << width) - 1)
        out = [codes[:, c] >> np.uint64(k) & mask for c in range(codes.shape[1]) for k in range(0, bits - width + 1, width)]
        return np.stack(out[: self.tables], axis=1).astype(np.int64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        return self.substrings(self.codes(x), x.shape[1])

    def budget(self, codes: int, d: int) -> int:
        """The Hamming distance over so many codes that pairs at the threshold all but never exceed: five deviations above their mean."""
        bits = codes * min(BITS, d)
        if not self.width:
            return BITS
        return math.ceil(max(np.quantile(bits * (1 - s) + 5 * np.sqrt(bits * s * (1 - s)), 0.995) for s in self.shares))


def _unit(values: list | None) -> np.ndarray | None:
    if values is None or not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x)


def _packed(values: list) -> bytes:
    """A vector's own numbers: in single precision where that is exact."""
    x = np.array(values, dtype=np.float64)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _unpacked(data: bytes, d: int) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.float32 if len(data) == 4 * d else np.float64).astype(np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _indexed(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, labels, copies, k1, k2 = (c.to_pylist() for c in batch.columns)
            units = [_unit(v) for v in vectors]
            for d in sorted({len(u) for u in units if u is not None}):
                of = [k for k, u in enumerate(units) if u is not None and len(u) == d]
                codes = tables.value.codes(np.stack([units[k] for k in of]))
                keys = tables.value.substrings(codes, d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in of], pa.int64()), pa.array([labels[k] for k in of], pa.string()), pa.array([d] * len(of), pa.int32()), pa.array([_packed(vectors[k]) for k in of], pa.binary()),
                     *(pa.array(x.tolist(), pa.list_(pa.int64())) for x in (codes.view(np.int64), keys)), *(pa.array([c[k] for k in of], pa.int64()) for c in (copies, k1, k2))],
                    names=["vec_id", "label", "dim", "vector", "codes", "keys", "copies", "k1", "k2"],
                )

    return run


def _groups(links: np.ndarray) -> np.ndarray:
    """The least index that each reaches over a symmetric matrix of links."""
    label, n = np.arange(len(links)), len(links)
    while True:
        low = np.minimum(label, np.where(links, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _by_block(flush):
    """Runs `flush` on tables of whole blocks: rows come sorted by (block, check)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy()
            at = int(np.searchsorted(block, block[-1]))  # blocks before the last one are whole
            if at:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks())
                held = []
            held.append(batch.slice(at))
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin and end."""
    block, check = rows["block"].to_numpy(), rows["check"].to_numpy()
    edges = np.nonzero(np.r_[True, (block[1:] != block[:-1]) | (check[1:] != check[:-1]), True])[0]
    return edges[:-1], edges[1:]


def _codes(rows: pa.Table, of: np.ndarray) -> np.ndarray:
    """The codes of these rows, which are of one dimension."""
    return np.array(rows["codes"].take(pa.array(of)).to_pylist(), dtype=np.int64).view(np.uint64).reshape(len(of), -1)


def _first_met(keys: np.ndarray, table: int, fresh: np.ndarray) -> np.ndarray:
    for t in range(table):
        fresh &= keys[:, t][:, None] != keys[:, t][None, :]
    return fresh


def _near(tables):
    """Of each block, the rows with a partner near enough by its code that they first meet here."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        dim, table = rows["dim"].to_numpy(), rows["t"].to_numpy()
        chunk, cross = rows["chunk"].to_numpy(), rows["cross"].to_numpy(zero_copy_only=False)
        keep = np.zeros(len(dim), dtype=bool)
        first, stop = _runs(rows)
        for d in np.unique(dim).tolist():
            two = first[(stop - first == 2) & (dim[first] == d)]
            if len(two):  # pairs, all at once
                a, b = _codes(rows, two), _codes(rows, two + 1)
                good = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= tables.value.budget(a.shape[1], d)
                good &= ~(cross[two] & (chunk[two] == chunk[two + 1]))
                met = tables.value.substrings(a, d) == tables.value.substrings(b, d)
                good &= ~(met & (np.arange(met.shape[1]) < table[two][:, None])).any(axis=1)
                keep[two[good]] = keep[two[good] + 1] = True
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            if b - a > 2:
                d, codes = int(dim[a]), _codes(rows, np.arange(a, b))
                apart = np.zeros((b - a, b - a), dtype=np.int64)
                for c in range(codes.shape[1]):
                    apart += np.bitwise_count(codes[:, c][:, None] ^ codes[:, c][None, :])
                near = (apart <= tables.value.budget(codes.shape[1], d)) & ~np.eye(b - a, dtype=bool)
                if cross[a]:  # within a chunk, pairs meet in the chunk's own block
                    near &= chunk[a:b][:, None] != chunk[a:b][None, :]
                keep[a:b] = _first_met(tables.value.substrings(codes, d), int(table[a]), near).any(axis=1)
        return rows.select(["block", "check", "row", "t", "chunk", "cross"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pylist([], schema=rows.select(["block", "check", "row", "t", "chunk", "cross"]).schema)

    return _by_block(flush)


def _counted(tables, threshold: float):
    """For rows sorted by block: links that are first met in the block's table, and the links' groups."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        ids, dim, table = rows["vec_id"].to_numpy(), rows["dim"].to_numpy(), rows["t"].to_numpy()
        copies, chunk, cross = rows["copies"].to_numpy(), rows["chunk"].to_numpy(), rows["cross"].to_numpy(zero_copy_only=False)
        data = rows["vector"].to_pylist()
        n, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
        for a, b in zip(*(x.tolist() for x in _runs(rows)), strict=True):
            own = np.arange(a, b)[np.argsort(ids[a:b], kind="stable")]
            x, codes = np.stack([_unpacked(data[k], int(dim[a])) for k in own]), _codes(rows, own)
            links = (x @ x.T >= threshold) & (ids[own][:, None] != ids[own][None, :])
            if cross[a]:  # within a chunk, pairs were counted in the chunk's own block
                links &= chunk[own][:, None] != chunk[own][None, :]
            n[own] = _first_met(tables.value.substrings(codes, int(dim[a])), int(table[a]), links.copy()) @ copies[own]
            root[own] = ids[own][_groups(links)]
        some = (n > 0) | (root != ids)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (rows["row"].to_numpy(), ids, n, root)], names=["row", "vec_id", "n", "root"])

    return _by_block(flush)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Only vectors of one label and length are compared. A vector that is null, empty or zero, or has
    a null or non-finite component, one without a label and one without a vec_id link with nothing
    (component: its own vec_id; kept). Rows that share a vec_id count as one vector: repeated
    rows once, different ones with the links of each. An empty table gives no rows; columns
    other than these are ignored, whatever they are called. A crowded table entry is compared in chunks of a bounded size.
    """
    spark = vectors.sparkSession
    own = pick(vectors, vec_id="bigint", embedding="", label="string")
    valid = own.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    most = valid.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width = min(30, max(12, math.ceil(math.log2(most + 1)) + 3))
    dim = valid.select(F.max(F.size("embedding"))).first()[0] or 1
    picked = collected(valid.select("vec_id", "embedding"), None, max(1, LEARNED // dim), "learn", ["vec_id", "embedding"])  # bounded: LEARNED
    sample = [u for r in picked if (u := _unit(r["embedding"])) is not None]
    tables = spark.sparkContext.broadcast(Tables(sample, width, recall, threshold))
    marked = valid.select("vec_id", "embedding", "label", F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit("copies"), "embedding", "label").alias("k2"))
    copies = marked.dropDuplicates(["vec_id", "k1", "k2"]).groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.count("*").alias("copies"))
    schema = "vec_id bigint, label string, dim int, vector binary, codes array<bigint>, keys array<bigint>, copies bigint, k1 bigint, k2 bigint"
    indexed = materialise(copies.select("vec_id", "embedding", "label", "copies", "k1", "k2").mapInArrow(_indexed(tables), schema).withColumn("row", F.monotonically_increasing_id()))
    narrow = indexed.select("row", "label", "dim", F.posexplode("keys").alias("t", "key")).select("row", F.col("t").cast("short").alias("t"), F.xxhash64("t", "label", "dim", "key").alias("entry"))
    entries = narrow.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    met = narrow.join(entries, "entry")
    chunks = F.ceil(F.col("n") / (CHUNK / 2)).cast("int")
    met = met.withColumn("chunks", F.when(F.col("n") <= CHUNK, 1).otherwise(chunks)).withColumn("chunk", F.pmod(F.hash("row"), "chunks"))
    met = met.withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    blocks = met.select("row", "t", "chunk", F.xxhash64("entry", low, high).alias("block"), (low != high).alias("cross"))
    check = F.xxhash64(F.lit("check"), "t", "label", "dim", F.element_at("keys", F.col("t") + 1))
    narrow = indexed.select("row", "label", "dim", "keys", "codes")
    rows = blocks.join(narrow, "row").select("block", check.alias("check"), "row", "dim", "t", "chunk", "cross", "codes")
    sort = ("block", "check")
    near = rows.repartition("block").sortWithinPartitions(*sort).mapInArrow(_near(tables), "block bigint, check bigint, row bigint, t short, chunk int, cross boolean")
    near = materialise(near)
    rows = near.join(indexed.select("row", "vec_id", "dim", "vector", "codes", "copies"), "row").select("block", "check", "row", "vec_id", "dim", "t", "chunk", "cross", "vector", "codes", "copies")
    found = materialise(rows.repartition("block").sortWithinPartitions(*sort).mapInArrow(_counted(tables, threshold), "row bigint, vec_id bigint, n bigint, root bigint"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    first = indexed.select("row", "k1", "k2", F.col("vec_id").alias("node"), "copies").join(counts, "row", "left").join(parts, "node", "left")
    first = first.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    members = marked.select("vec_id", "k1", "k2").distinct().join(first, ["k1", "k2"])  # of many copies, each is counted once
    found = members.groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.min("component").alias("component"))
    out = own.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
