"""Job state from updates: batch and Structured Streaming forms of last-write-wins, eviction and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(updates: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last non-null value of each field of a key; partial aggregates, no sort."""
    at = F.struct(*order)
    return updates.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields), F.max(at)[order[0]].alias("updated_at"))


def evicted(state: DataFrame, now: Column, ttl_seconds: int = 3600, over: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """Without finished jobs that are older than the time to live."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    return state.filter(~(F.col("status").isin(*over) & (age > ttl_seconds * 1_000_000)))


def progress(updates: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    """Running sum of positive steps."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return updates.withColumn("delivered", F.sum(F.greatest(F.col(step), F.lit(0))).over(w))


def shown(state: DataFrame) -> DataFrame:
    """What a reader of a job sees: results only when done, the message only on error."""
    hide = {"result": F.when(F.col("status") == "done", F.col("result")), "error": F.when(F.col("status") == "error", F.col("error"))}
    return state.withColumns({c: v for c, v in hide.items() if c in state.columns})


def streamed_state(updates: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """latest_state over a stream, for complete or update output."""
    return latest_state(updates, key, order, fields)


def windowed_counts(updates: DataFrame, at: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Updates in each window and key; ``at`` without a zone is taken as UTC so that it can carry a watermark."""
    stamped = updates.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def in_slices(table: DataFrame, at: str, n: int, folder: str) -> DataFrame:
    """A stream that reads a table in ``n`` micro-batches, cut at equal spans of time: each slice is written after the one before, as new files arrive."""
    spark = table.sparkSession
    ends = table.agg(F.min(at).alias("low"), F.max(at).alias("high")).select(F.unix_micros(F.col("low").cast("timestamp")), F.unix_micros(F.col("high").cast("timestamp"))).first()
    low, high = ends if ends[0] is not None else (0, 0)
    place = F.least(F.lit(n - 1), F.floor((F.unix_micros(F.col(at).cast("timestamp")) - low) * n / max(1, high - low)).cast("int"))
    for k in range(n):
        table.filter(place == k).coalesce(1 if n > 1 else 8).write.parquet(f"{folder}/slice={k:04d}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/slice=*")


def run_all(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there; the rows of all micro-batches, each a table of its own under ``folder`` that a batch made again replaces."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:06d}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}.checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch=*")


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its last result, which every batch writes as a table of its own under ``folder``."""
    spark, seen = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        seen.append(number)
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:06d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}.checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={seen[-1]:06d}") if seen else spark.createDataFrame([], stream.schema)
