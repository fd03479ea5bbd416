"""Structured Streaming: online aggregation over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import scratch


def online_max(spark: SparkSession, path: str, schema, column: str, by: str) -> DataFrame:
    """The running maximum of a column by key over a directory's files, drained with availableNow; the final state as a batch table.

    Each micro-batch replaces the state's table in the shared folder, and so does the checkpoint lie there; nothing meets on the driver.
    """
    stream = spark.readStream.schema(schema).parquet(path)
    agg = stream.groupBy(by).agg(F.max(column).alias("max_value"), F.count("*").alias("n"))
    out = scratch(spark, "online")

    def keep(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{out}/state")

    agg.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(agg.schema).parquet(f"{out}/state")


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window for an append-mode sink; rows later than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width)).count()
