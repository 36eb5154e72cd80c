"""Whole files as rows, and what kind each is."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.binary import unsigned

from .discovery import uris

FILES = "path string, length long, content binary, sha256 string"

PREFIX_BYTES = 96
HEADER_BYTES = 48


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark or Hadoop writes it, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a://", "s3n://")) else uri)


def files(spark: SparkSession, locations: list[str], max_bytes: int | None = None) -> DataFrame:
    """``path, length, content, sha256`` of files or folders; the size limit is pushed down
    to the listing, so longer files are never read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(locations)
    if max_bytes is not None:
        read = read.where(F.col("length") <= max_bytes)
    return read.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def prefixes(paths: DataFrame, size: int = PREFIX_BYTES) -> DataFrame:
    """``path, length, head`` of the files in ``path``: the first bytes only, whatever the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                system, path = opened(uri)
                with system.open_input_file(path) as f:
                    rows.append({"path": uri, "length": f.size(), "head": f.read(size)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("head", pa.binary())]))

    return paths.select("path").mapInArrow(run, "path string, length long, head binary")


def listed(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """The URIs of what discovery finds, spread over tasks."""
    found = [(p,) for p in uris(spark, inputs)]
    parts = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(found, "path string").repartition(parts)


def revalidate(found: DataFrame) -> DataFrame:
    """``path, status`` of files read before: unchanged, changed or missing, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, digest in zip(batch.column("path").to_pylist(), batch.column("sha256").to_pylist()):
                system, path = opened(uri)
                if not system.get_file_info(path).is_file:
                    rows.append({"path": uri, "status": "missing"})
                    continue
                h = hashlib.sha256()
                with system.open_input_stream(path) as f:
                    while chunk := f.read(1 << 20):
                        h.update(chunk)
                rows.append({"path": uri, "status": "unchanged" if h.hexdigest() == digest else "changed"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return found.select("path", "sha256").mapInArrow(run, "path string, status string")


def read_listed(paths: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The same columns for the rows of ``path`` as they are spelled, read one by one on the
    executors; also for names that Spark's listing hides (a leading ``_`` or ``.``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = opened(uri)
                if max_bytes is not None and system.get_file_info(path).size > max_bytes:
                    continue
                with system.open_input_file(path) as f:
                    content = f.read()
                yield pa.RecordBatch.from_pylist([{"path": uri, "length": len(content), "content": content, "sha256": hashlib.sha256(content).hexdigest()}])

    return paths.select("path").mapInArrow(run, FILES)


def listed_files(spark: SparkSession, inputs: list[str], max_bytes: int | None = None) -> DataFrame:
    """As ``files``, over what discovery finds, with hidden names and without links."""
    found = uris(spark, inputs)
    shown = [p for p in found if os.path.basename(p)[0] not in "_."]
    hidden = [(p,) for p in found if os.path.basename(p)[0] in "_."]
    out = read_listed(spark.createDataFrame(hidden, "path string"), max_bytes)
    return files(spark, shown, max_bytes).unionByName(out) if shown else out


def probe(content: Column, size: Column | None = None) -> Column:
    """``kind`` and ``serialized_version`` from a file's first 96 bytes, as native expressions."""
    size = F.octet_length(content).cast("decimal(20,0)") if size is None else size.cast("decimal(20,0)")
    starts = lambda text: F.substring(content, 1, len(text) + 1) == F.lit(bytes(text, "ascii") + b"\0")
    version = unsigned(content, 8, 4)
    metadata, file_size, data_offset = (unsigned(content, at, 8) for at in (16, 24, 32))
    marked = (F.octet_length(content) >= 20) & version.between(1, 100)
    plain = (unsigned(content, 16, 1) <= 1) & (unsigned(content, 17, 1) == 0) & (unsigned(content, 18, 2) == 0)
    sound = (
        (F.octet_length(content) >= HEADER_BYTES) & (unsigned(content, 40, 1) <= 1) & (file_size == size)
        & (data_offset <= file_size) & (metadata.cast("decimal(21,0)") + HEADER_BYTES <= data_offset))
    kind = (
        F.when(starts("UnityFS"), "archive")
        .when(starts("UnityRaw") | starts("UnityWeb") | starts("UnityArchive"), "unsupported-archive")
        .when(~F.coalesce(marked, F.lit(False)) | ((version != 22) & ~plain), "unrelated")
        .when((version == 22) & F.coalesce(sound, F.lit(False)), "serialized-file")
        .otherwise("unsupported-serialized-file"))
    is_serialized = kind.isin("serialized-file", "unsupported-serialized-file")
    return F.struct(kind.alias("kind"), F.when(is_serialized, version).alias("serialized_version"))


def header(content: Column) -> Column:
    """The header fields of a serialized file as a struct, full unsigned range."""
    return F.struct(
        unsigned(content, 16, 8).alias("metadata_size"), unsigned(content, 24, 8).alias("file_size"),
        unsigned(content, 32, 8).alias("data_offset"), unsigned(content, 40, 1).cast("int").alias("endian"))
