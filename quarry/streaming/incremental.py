"""Keeping tables up to date while files arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources import files, tables

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of whole files with their kind; ``max_files`` bounds a micro-batch."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(folder)
    probe = files.probe(F.col("content"), F.col("length"))
    return stream.withColumn("p", probe).select("path", "modificationTime", "length", "content", "p.kind", "p.serialized_version")


def counts_by_window(stream: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Arrivals per window and kind; files older than the watermark's delay come too late."""
    return stream.withWatermark("modificationTime", delay).groupBy(F.window("modificationTime", window), "kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the object tables of arriving files to ``target``; each batch is written under
    its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        source = tables.sources(batch)
        tables.objects_table(source).write.mode("overwrite").parquet(f"{target}/objects/batch={number}")
        tables.diagnostics(source).write.mode("overwrite").parquet(f"{target}/diagnostics/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
