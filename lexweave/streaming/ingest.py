"""Micro-batch ingest of document files with resume, dead letters and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexweave.operators.load import upsert


def ingest(spark: SparkSession, source: str, schema: StructType, load: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 25) -> StreamingQuery:
    """Loads Parquet files that haven't been seen, ``files_per_batch`` at a time, and ends; a restart goes on after the last batch loaded."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, at: str = "ts", by: str = "event_type", late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Counts by time window; events later than the watermark are left out."""
    return rows.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n"))


def partitioned_load(path: str, key: str, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A loader that keeps the batches by number, so that a batch loaded twice replaces itself."""

    def load(batch: DataFrame, number: int) -> None:
        batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return load


def upserting_load(path: str, staging: str, keys: list[str], parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A loader that keeps one row for each key at ``path``, the latest; of a batch's rows of a key the first by all columns.

    Only the parts that a batch touches are read and written; each is written beside first, then put
    in place of the old one. A batch loaded twice gives the same table.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        try:
            old = spark.read.schema(new.schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            old = new.limit(0)
        touched = [r[0] for r in new.select("part").distinct().collect()]
        merged = upsert(old.filter(F.col("part").isin(touched)), new, keys).drop("was_inserted")
        beside = f"{staging}/batch={number}"
        merged.write.mode("overwrite").parquet(beside)
        spark.read.schema(merged.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return load
