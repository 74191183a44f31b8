"""Run records as a stream: each key once, totals as they come, late deliveries dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteglass.operators.rates import KEY, failed
from noteglass.operators.usage import TOKENS, used


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 100, pattern: str = "runs*.parquet") -> DataFrame:
    """New files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def once(stream: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Each record key once; state is kept for the lateness that deliveries have."""
    return stream.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["stage", *KEY])


def hourly(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Calls, failures and tokens by stage in windows of arrival."""
    return stream.groupBy(F.window("ingested_at", width), "stage").agg(F.count("*").alias("calls"), F.count_if(failed(F.col("output"))).alias("failed"), *(F.sum(used(t)).alias(t) for t in TOKENS))


def into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once, until nothing new is left."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
