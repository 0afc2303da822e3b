"""SimHash near-duplicates: pigeonring candidates, exact Hamming links, components.

A fingerprint is split into eight segments on a ring. If two fingerprints differ in at most two
bits, then from some segment on every chain of l segments differs in at most floor(l * 2 / 8) bits:
none in the first three, at most one in the first four to seven, two in all eight. So one of
the two halves of the next four segments is equal too: that start, that half and its 40 equal
bits are the key under which a pair is looked up. The budgets of the chain are checked before
the full distance. All of this runs on distinct fingerprints, so copies cost nothing more.

A key that many distinct fingerprints share is not expanded into its pairs: each of them lists the 65
fingerprints at a distance of at most one, and those that list the same one are linked to the
least of them. They are at most two bits apart, and any two that are two apart meet this way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, materialise, numbered, pick, place

SHINGLE, SEED, DISTANCE, SEGMENTS, PAIRED = 3, 42, 2, 8, 32
_PART = 1 << 16


def shingles(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """The hash of each run of `size` words (of all words, if there are no more); words are maximal runs without ASCII white space, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        hashes = [digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[size - 1 :])]  # noqa: B905
    return np.array(hashes, dtype="<u8")


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits as an unsigned number."""
    of = shingles(text, size, seed)
    if not len(of):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(of), _PART):
        ones += np.unpackbits(of[k : k + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(of), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [fingerprint(x, size) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(of, dtype=np.uint64).view(np.int64))], names=["doc_id", "same", "fp"])

    return run


def _ring(fp: Column, start: int, first: int, n: int) -> Column:
    """Segments first .. first + n - 1 of the chain that begins at `start`, as a number."""
    shift = 8 * ((start + first) % SEGMENTS)
    turned = F.shiftrightunsigned(fp, shift).bitwiseOR(F.shiftleft(fp, 64 - shift)) if shift else fp
    return turned.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _keys(fps: DataFrame) -> DataFrame:
    """(fp, key): 16 keys for each fingerprint; a key holds the start, the half and 40 bits."""
    fp, keys = F.col("fp"), []
    for start in range(SEGMENTS):
        for half in (0, 1):
            bits = F.shiftleft(_ring(fp, start, 0, 3), 16).bitwiseOR(_ring(fp, start, 3 + 2 * half, 2))
            keys.append(bits.bitwiseOR(F.lit((2 * start + half) << 40)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _in_budget(x: Column, start: Column, distance: int) -> Column:
    """Whether every chain from `start` on keeps its share of the budget; x: the bits that differ."""
    turned = F.expr("shiftrightunsigned(x, cast(8 * (key >> 41) as int)) | shiftleft(x, cast((64 - 8 * (key >> 41)) % 64 as int))")
    turned = F.when(start == 0, x).otherwise(turned)
    good = F.lit(True)
    for n in range(1, SEGMENTS):
        good = good & (F.bit_count(turned.bitwiseAND(F.lit((1 << (8 * n)) - 1))) <= n * distance // SEGMENTS)
    return good


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b), a < b, at most two bits apart: enough links of distinct fingerprints (fp) to connect all that are."""
    keys = _keys(fps)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(keys.join(shared, "key"))
    few = met.where(F.col("n") <= paired)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b")
    pairs = pairs.select("key", "a", "b", F.expr("a ^ b").alias("x"))
    pairs = pairs.where(_in_budget(F.col("x"), F.shiftright("key", 41), DISTANCE)).where(F.bit_count("x") <= DISTANCE).select("a", "b")
    near = F.array(F.col("fp"), *(F.expr(f"fp ^ shiftleft(1L, {k})") for k in range(64)))
    balls = met.where(F.col("n") > paired).select("fp").distinct().select("fp", F.explode(near).alias("middle"))
    least = balls.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = balls.join(least, "middle").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same, fp) of each row, and (fp, keeper) of each fingerprint; `same` is a hash of the text."""
    bounded_batches(docs.sparkSession)
    marked = pick(docs, doc_id="bigint", text="string")
    marked = marked.select("doc_id", F.xxhash64("text").alias("same"), "text")
    marked = materialise(marked.mapInArrow(_fingerprints(size), "doc_id bigint, same bigint, fp bigint"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    own = materialise(marked.groupBy("fp").agg(F.min(first).alias("least")))
    parts = connected_components(links(own.select("fp")))
    of = own.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = of.groupBy("component").agg(F.min("least").alias("keeper"))
    return marked, of.join(roots, "component").select("fp", "keeper")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the smallest doc_id that links lead to, its own included.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.
    Repeated rows are returned as often as they occur. Rows with a null doc_id are linked too,
    and name a component only if no other id is in it (then it is null). An empty table gives no
    rows; columns other than doc_id and text are ignored; texts are read whole.
    """
    marked, classes = _classes(docs, size)
    out = marked.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("keeper.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the row of the smallest doc_id.

    Rows with a null doc_id come last, and of rows that share id and text one stays.
    """
    _, classes = _classes(docs, size)
    return keep(docs, classes.select("keeper.doc_id", "keeper.same"))


def keep(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each (doc_id, same) of keepers; columns may have any name."""
    keepers = materialise(keepers.distinct())
    none = F.lit(-(1 << 63))
    keys = keepers.select(F.coalesce("doc_id", none).alias("id"), "same")
    doc_id, text = (F.col(f"_{place(docs, c)}") for c in ("doc_id", "text"))
    own = numbered(docs).withColumns({"id": F.coalesce(doc_id.cast("bigint"), none), "same": F.xxhash64(text.cast("string"))})
    return own.join(keys, ["id", "same"], "left_semi").dropDuplicates(["id", "same"]).drop("id", "same").toDF(*docs.columns)
