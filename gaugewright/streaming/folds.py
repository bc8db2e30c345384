"""Running summaries of fold results as they arrive; an extension, as a batch run resumes by leaving out what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "ts timestamp, dataset string, model string, repetition_id int, fold_id int, metric string, value double"


def fold_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Fold metrics from Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def running_summary(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean, std and count by dataset, model and metric; a fold that is delivered again within ``late`` counts once."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dataset", "model", "repetition_id", "fold_id", "metric"])
    return once.groupBy("dataset", "model", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def windowed_throughput(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Folds finished in windows of time; later ones than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "model").agg(F.count(F.lit(1)).alias("n"))


def to_parquet(summary: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the whole summary anew for each batch, then end when no input is left."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return summary.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
