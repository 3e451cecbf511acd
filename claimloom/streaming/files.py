"""Arriving files as a stream: each batch adds its claims to a table, and profiles are fused again from all claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.engine import build_profiles
from claimloom.sources.files import normalized, parsed

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text, content) of files that appear in ``folder``."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", text.alias("text"), "content")


def follow(
    spark: SparkSession, folder: str, claims_path: str, checkpoint: str, on_profiles: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Append the claims of arriving files to ``claims_path``, a folder per batch, so a batch that is run again replaces its own.

    ``on_profiles`` gets the profiles of all claims so far after each batch.
    """

    def batch(files: DataFrame, number: int) -> None:
        # claims of later batches come after those of earlier ones
        normalized(parsed(files)).withColumn("seq", F.col("seq") + F.lit(number << 32)).write.mode("overwrite").parquet(f"{claims_path}/batch={number}")
        if on_profiles:
            on_profiles(build_profiles(spark.read.parquet(claims_path).drop("batch")), number)

    return (
        arriving(spark, folder)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
