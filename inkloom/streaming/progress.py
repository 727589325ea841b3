"""Progress as a stream: durable sums of usage, and events by time window.

Each micro-batch is written under its epoch, so that a repeated one overwrites itself; the state is read from the
epochs. A stream started again on the same folder goes on after its last finished epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import scratch


def epochs(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, writing every micro-batch under its epoch."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/epoch-{epoch:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """A table's folder as a stream of its files; a table of one file is found in the folder it lies in."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def usage_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """(state_key, batch_id, blocks, characters): every batch once, however often it was logged."""
    folder = folder or scratch(spark, "usage")
    epochs(read_stream(spark, path).select("state_key", "batch_id", "blocks", "characters"), folder)
    return spark.read.parquet(f"{folder}/rows/*").groupBy("state_key", "batch_id").agg(
        F.max("blocks").alias("blocks"),
        F.max("characters").alias("characters"),
    )


def windowed_events(spark: SparkSession, path: str, width: str = "1 day", late: str = "30 days", folder: str | None = None) -> DataFrame:
    """(start, event_type, n): events by window and type; what comes later than ``late`` is not counted."""
    folder = folder or scratch(spark, "events")
    events = read_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    epochs(counts.select(F.col("w.start").alias("start"), "event_type", "n"), folder, mode="update")
    last = spark.read.parquet(f"{folder}/rows/*").groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return last
