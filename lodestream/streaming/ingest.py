"""Incremental ingest: new transcript files become manifest rows, once per session, also after a lost checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..session import exists


def sessions_of(batch: DataFrame) -> DataFrame:
    """Manifest rows of the sessions in a batch of transcript rows."""
    agg = batch.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.sum(F.coalesce(F.octet_length("msg_content"), F.lit(0)).cast("long")).alias("bronze_size_bytes"), F.min("loaded_at").alias("first_loaded_at")
    )
    return agg.withColumns({"status": F.when(ingest.size_bucket(F.col("bronze_size_bytes")) == "skipped-large", "skipped-large").otherwise("bronze"), "part_index": F.lit(None).cast("int")})


def run(spark: SparkSession, source: str, manifest_path: str, checkpoint: str) -> None:
    """Take in all files that arrived since the last run (``availableNow``) and append the sessions the manifest does not have."""
    schema = spark.read.parquet(source).schema

    def write(batch: DataFrame, epoch: int) -> None:
        new = sessions_of(batch)
        if exists(spark, manifest_path):
            new = new.join(spark.read.parquet(manifest_path).select("session_id").distinct(), "session_id", "left_anti")
        new.write.mode("append").parquet(manifest_path)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
