"""Bars from an event stream: a bar comes out once, when the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.upsert import keep_last


def deduplicated(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Replayed rows go: the first of each key within the watermark stays."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def stream_bars(events: DataFrame, interval: str, delay: str, symbol: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """OHLC bars by event time. In append mode the forming bar is withheld and rows later than ``delay`` are
    dropped; open and close are ordered by (ts, tie), as in batch."""
    order = F.struct(ts, tie)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a zone; the session's is UTC
    rows = events.withWatermark(ts, delay).groupBy(F.window(ts, interval).alias("w"), F.col(symbol).alias("symbol"))
    out = rows.agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.sum(value).alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    )
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("open_time"), "open", "high", "low", "close", "volume", "n_trades")


def merge_batches(stream: DataFrame, path: str, key: list[str], checkpoint: str, buckets: int = 64):
    """Late rewrites of history: each micro-batch overwrites its keys' earlier versions in a Parquet table.

    Rows lie in ``buckets`` folders by their keys' hashes. A batch reads the newest version of the buckets that it touches and writes their next ones,
    ``staged/v<batch>/_bucket=<bucket>``, and then the list of newest versions, ``versions/<batch>``, so the table is always that of a whole batch and a
    batch that runs again gives the same. A missing list or version of an earlier batch is an error: history is never started anew."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, path, number - 1)
        now = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in now.select("_bucket").distinct().collect())  # ``buckets`` at most
            fresh = keep_last(now.drop("_bucket").withColumn("_batch", F.lit(1)), key, ["_batch", *[c for c in batch.columns if c not in key]])
            old = [f"{path}/staged/v{before[b]}/_bucket={b}" for b in touched if b in before]
            if old:
                fresh = keep_last(spark.read.schema(batch.schema).parquet(*old).withColumn("_batch", F.lit(0)).unionByName(fresh), key, ["_batch"])
            fresh = fresh.select(*batch.columns, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket"))
            if touched:
                fresh.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/staged/v{number}")
        finally:
            now.unpersist()
        after = before | dict.fromkeys(touched, number)
        rows = spark.createDataFrame(sorted(after.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """The batch that last wrote each bucket, as of batch ``number``."""
    if number < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/versions/v{number}").collect()}


def merged(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """The table as of batch ``number``."""
    parts = [f"{path}/staged/v{v}/_bucket={b}" for b, v in _versions(spark, path, number).items()]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
