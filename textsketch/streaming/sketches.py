"""Sketches over streams: a watermark bounds the state, windows are emitted once they are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import fresh
from ..operators import geo


def windowed_buckets(stream: DataFrame, at: str, keys: list[str], item: Column, config: geo.Config, window: str, late: str, slide: str | None = None) -> DataFrame:
    """(window_start, keys, bucket, hits) of a stream: what a distinct or a difference sketch of each window is made of.

    State holds one counter for each bucket of an open window. For a difference sketch, drop
    repeated deliveries first: each of them toggles.
    """
    rows = stream.withWatermark(at, late).where(item.isNotNull())
    spans = F.window(at, window, slide) if slide else F.window(at, window)
    hits = rows.select(spans.alias("w"), *keys, geo.bucket(item, config.b).alias("bucket")).groupBy("w", *keys, "bucket").agg(F.count("*").alias("hits"))
    return hits.select(F.col("w.start").alias("window_start"), *keys, "bucket", "hits")


def run_once(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there and return what was written; checkpoints and output are in the shared folder.

    In `complete` mode all windows are returned, in `append` mode those that the watermark has completed.
    """
    path = fresh(spark)
    last: list[str] = []

    def whole(rows: DataFrame, batch: int) -> None:  # each batch has all windows: the last one counts
        last[:] = [f"{path}/out-{batch}"]
        rows.write.mode("overwrite").parquet(last[0])

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = query.foreachBatch(whole) if mode == "complete" else query.format("parquet").option("path", f"{path}/out")
    query.start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def estimates(buckets: DataFrame, keys: list[str], config: geo.Config) -> DataFrame:
    """Estimates of completed windows."""
    odd = buckets.where("hits % 2 = 1") if config.kind == "diff" else buckets
    return geo.estimate(odd.select("window_start", *keys, "bucket"), ["window_start", *keys], config)
