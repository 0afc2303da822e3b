"""What the operators of this subpackage share: intermediate tables, batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import materialise

def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Arrow batches of at most `size` bytes (or one row), so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def one_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def fold_number(column: str, salt: int) -> F.Column:
    """crc32 of the id as text, mod `salt`: the fold that a row belongs to (a null id: -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % salt, F.lit(-1))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b) of any one orderable type.

    Alternating large-star and small-star steps: each round is two joins on a node with that
    node's minimum, so that no task ever holds a component; a round's edges are written to the
    shared folder. Self-links and repeated links change nothing; no edges give no rows.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if stars.join(stars.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():  # all stars: done
            break
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        stars = materialise(small.select(F.greatest("x.v", "x.m").alias("u"), F.least("x.v", "x.m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())


def place(df: DataFrame, name: str) -> int:
    """Where a column stands: the first of exactly this name, else the first of it in other case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for k, c in enumerate(df.columns):
            if same(c):
                return k
    raise ValueError(f"no column {name}")


def numbered(df: DataFrame) -> DataFrame:
    """df with columns _0, _1, ...: whatever they were called (dots, backticks, other case, twice), they can be told apart."""
    return df.toDF(*(f"_{k}" for k in range(len(df.columns))))


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The columns of these names, cast; all others are left out, whatever they are called."""
    own = numbered(df)
    return own.select(*(F.col(f"_{place(df, name)}").cast(t).alias(name) if t else F.col(f"_{place(df, name)}").alias(name) for name, t in types.items()))


def append(df: DataFrame, on: list[str], each, added: str) -> DataFrame:
    """df with the columns that `each`(list, ...) returns as dicts of lists, from the columns `on`.

    `added` is their schema; all other columns pass through untouched, whatever they are called,
    but a column of df that has an added name, in any case, gives way.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(added).fields
    names, types = [f.name for f in fields], [(f.name, to_arrow_type(f.dataType)) for f in fields]
    stay = [k for k, c in enumerate(df.columns) if c.lower() not in {x.lower() for x in names}]
    of = [place(df, c) for c in on]
    own = numbered(df).select(*(f"_{k}" for k in stay), *(F.col(f"_{k}").alias(f"on_{i}") for i, k in enumerate(of)))
    n = len(stay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = each(*(c.to_pylist() for c in batch.columns[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(found[c], type=t) for c, t in types)], names=[*batch.schema.names[:n], *(f"new_{c}" for c in names)])

    schema = StructType([*own.schema.fields[:n], *(type(f)(f"new_{f.name}", f.dataType) for f in fields)])
    return own.mapInArrow(run, schema).toDF(*(df.columns[k] for k in stay), *names)


def filtered(df: DataFrame, on: str, keep) -> DataFrame:
    """The rows of df, all columns, for which `keep`(list of the column `on`) says so."""
    at = place(df, on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    own = numbered(df)
    return own.mapInArrow(run, own.schema).toDF(*df.columns)


#: Values at most that rows can be sampled by.
GROUPS = 4096


def sampled(rows: DataFrame, by: str | None, most: int, salt: str, of: list[str]) -> DataFrame:
    """About `most` different rows at most for each value of `by` (of all rows, if None), and `h`, the hash of the columns `of` that chose them.

    Rows that are equal in `of` are one, however often they occur, so neither a repeated id nor a repeated text
    takes the others' place. No row is moved to count them; only those chosen are, to be made one.
    """
    own = rows.withColumns({"by_": F.lit(0) if by is None else F.col(by), "h": F.xxhash64(F.lit(salt), *of)})
    n = own.groupBy("by_").agg(F.approx_count_distinct("h", 0.02).alias("n_"))
    sizes = {r["by_"]: r["n_"] for r in n.limit(GROUPS + 1).collect()}
    if len(sizes) > GROUPS:
        raise ValueError(f"more than {GROUPS} values of {by}")
    if not sizes:
        return own.drop("by_").limit(0)
    limits = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, most * 1.1 / max(1, v)))))
    share = F.pmod(F.xxhash64(F.lit(salt), "h"), F.lit(1 << 30)) / float(1 << 30)
    few = own.where(share < limits[F.col("by_")])
    return few.groupBy("by_", "h").agg(*(F.first(c).alias(c) for c in rows.columns)).drop("by_")


def collected(rows: DataFrame, by: str | None, most: int, salt: str, of: list[str]) -> list[Row]:
    """The rows of sampled(), at most `most` for each value of `by`, in an order that only the data decide."""
    out: list[Row] = []
    n: dict = {}
    for r in sorted(sampled(rows, by, most, salt, of).collect(), key=lambda r: (r["h"], str(r[by]) if by else "")):  # bounded: about `most` for each of GROUPS
        key = r[by] if by else None
        n[key] = n.get(key, 0) + 1
        if n[key] <= most:
            out.append(r)
    return out


def stretch(text: str, longest: int, salt: str) -> F.Column:
    """A text of at most so many characters as it is; of a longer one, a stretch of that length at a place that its hash picks."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / longest).cast("int"))
    at = F.pmod(F.xxhash64(F.lit(salt), text), n.cast("bigint")).cast("int")
    return F.when(F.length(text) <= longest, F.col(text)).otherwise(F.substring(F.col(text), at * longest + 1, F.lit(longest)))
