"""Streams that write: documents indexed as they come, sessions' state, and what conversations leave to be remembered.

Each runs until all that is there has been read (trigger availableNow), with state, progress and output in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyrook.operators import store

c = F.col


def opened(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rpartition("/")[2])


def to_end(stream: DataFrame, at: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what is there now; each batch is handed over with its number, the same one if it has to be repeated."""
    going = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    going.awaitTermination()


def indexed(spark: SparkSession, stream: DataFrame, known: DataFrame) -> DataFrame:
    """path and action for what a stream of (path, digest) brings to an index known (path, digest, alive); what it does not bring is kept.

    A batch writes to a folder named after its number, so a repeated batch replaces its own.
    """
    at = store.fresh_path(spark, "stream")

    def each(batch: DataFrame, number: int) -> None:
        found = batch.groupBy("path").agg(F.max("digest").alias("digest"))
        store.index_diff(known.join(found, "path", "left_semi"), found, complete=False).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    to_end(stream, at, each)
    rows = spark.read.schema("path string, action string, batch int").parquet(f"{at}/out")
    return rows.groupBy("path").agg(F.max_by("action", "batch").alias("action"))


def session_state(spark: SparkSession, stream: DataFrame, key: str, order: Column, kind: str, recalls: tuple[str, ...]) -> DataFrame:
    """Of each session: its events, the last one's kind, and whether it waits for a recall (the last is of a kind that asks for one)."""
    at = store.fresh_path(spark, "stream")
    state = stream.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct(order.alias("order"), c(kind).alias("kind"))).alias("last"))
    told = state.select(key, "n", c("last.kind").alias("last"), c("last.kind").isin(*recalls).alias("waits"))
    schema = told.schema.add("batch", IntegerType())

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    to_end(told, at, each, "update")
    rows = spark.read.schema(schema).parquet(f"{at}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct("n", "last", "waits"), "batch").alias("x")).select(key, "x.*")


def kept(spark: SparkSession, stream: DataFrame, decision: Column) -> DataFrame:
    """What a stream of candidates leaves after a gate: the rows with their decision, accepted ones only."""
    at = store.fresh_path(spark, "stream")
    told = stream.withColumn("decision", decision).filter(c("decision") == "accept")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    to_end(told, at, each)
    return spark.read.schema(told.schema.add("batch", IntegerType())).parquet(f"{at}/out").drop("batch")
