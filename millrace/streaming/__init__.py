"""Incremental runs over growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.registry import Policy


def masked_increment(spark: SparkSession, source: str, target: str, checkpoint: str, policy: Policy, name: str) -> int:
    """Copies the files that arrived since the last run, masked, each exactly once; returns the rows now there.

    The stream runs until nothing is left and stops; its checkpoint is what a resumed run goes on from."""
    schema = spark.read.parquet(source).schema
    stream = policy.apply(name, spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target).count()


def upsert_increment(spark: SparkSession, source: str, target: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Keeps the latest row per key by ``order``, at a tie the greatest by all columns, so that a late row never
    replaces a newer one: each increment is merged into a new version of the target."""
    schema = spark.read.parquet(source).schema

    def merge(batch: DataFrame, epoch: int) -> None:
        if epoch:
            batch = batch.unionByName(spark.read.parquet(f"{target}/v{epoch - 1}"))
        row = F.struct(*batch.columns)
        latest = batch.groupBy(*keys).agg(F.max_by(row, F.struct(order, *batch.columns)).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{target}/v{epoch}")  # a repeated epoch writes the same

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_totals(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and time window, closed once the watermark has passed."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
