"""Token counts over a stream of messages: event-time windows, late data bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexitide.runtime import work_dir


def windowed_counts(stream: DataFrame, tokens: Column, time: str, width: str = "1 hour", late: str = "2 hours", key: str | None = None) -> DataFrame:
    """(window_start, word, n). With ``key``, messages delivered again within the watermark count once."""
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late)
    if key:  # a message without a key can't be told from others, so all of these count
        rows = rows.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key]).unionByName(rows.where(F.col(key).isNull()))
    words = rows.select(time, F.explode(tokens).alias("word"))
    counted = words.groupBy(F.window(time, width).alias("w"), "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "word", "n")


def run_once(spark: SparkSession, counted: DataFrame, name: str = "counts") -> DataFrame:
    """Process all that is there (available-now) into a table of the shared folder, and read the table.

    Windows the watermark hasn't closed yet are there too: each batch writes the rows it changed, and a row's last state counts.
    """
    base = f"{work_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], counted.schema).write.parquet(f"{base}/rows/batch=-1")  # a stream without rows has no batch

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(StructType([*counted.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/rows")
    return states.groupBy("window_start", "word").agg(F.max_by("n", "batch").alias("n"))
