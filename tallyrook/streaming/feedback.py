"""Feedback as a stream: each event counted once, late ones within a watermark, sums kept by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators.store import fresh_path

c = F.col


def counted(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts of events by day and type, of a stream with ts, event_id and event_type; repeated events count once."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    once = at.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def run_to_end(spark: SparkSession, events_path: str, schema) -> DataFrame:
    """All that the stream finds in a folder or file now, as a table in the shared folder; state and progress are kept there."""
    at = fresh_path(spark, "stream")
    folder, _, name = events_path.rpartition("/")
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if "." in name else reader.parquet(events_path)
    held = f"held_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    # "update" gives the last word on a group in the last batch that touched it
    going = counted(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").queryName(held).trigger(availableNow=True).start()
    going.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    last = rows.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("x"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", c("x.n").alias("n"), c("x.value").alias("value"))
