"""Weekly sums of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions.timeops import epoch_seconds, week_start
from rankflow.sources.tables import shared_path


def as_pattern(path: str) -> str:
    """The path as a pattern, so that a streaming source takes a single file too."""
    return f"{path[:-1]}[{path[-1]}]"


def weekly(events: DataFrame, late: str | None = "10 days") -> DataFrame:
    """Count and value of each type and week that starts on Monday; of a stream, weeks end once the watermark passes."""
    timed = events.withColumn("_t", epoch_seconds(F.col("ts")))
    if events.isStreaming and late:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("event_type", week_start(F.col("_t")).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_weekly(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Run the stream of the Parquet table at ``path`` to its end; the last state of each group."""
    schema, work = spark.read.parquet(path).schema, shared_path(spark, "weekly")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(as_pattern(path))
    query = (
        weekly(stream, None)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda part, number: part.write.mode("overwrite").parquet(f"{work}/out/batch={number}"))
        .start()
    )
    query.awaitTermination()
    changes = spark.read.parquet(f"{work}/out")
    # A group's count only grows, so its largest is its last.
    return changes.groupBy("event_type", "week").agg(F.max(F.struct("n", "value")).alias("s")).select("event_type", "week", "s.n", F.round("s.value", 4).alias("value"))
