"""Token counts by a separator scan of flat token files that have no index.

A file is read in blocks of a fixed number of ids.  In each block a vectorised search
finds the end-of-document ids; a block reports how many there are and where the last
one is.  A prefix scan over a file's blocks (a sum for ordinals, a maximum for the start
of a document that began in an earlier block) stitches documents across block borders.
A second look at each block then gives one row for each document that ends in it.

Edge cases: two separators in a row hold an empty document of 0 tokens; ids after a
file's last separator are one document with ``ended`` false; an empty file has no rows;
an empty table gives an empty result.  A document's count leaves out its separator.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .storage import read_range, shared_dir, write_file
from .textvec import slices
from .workers import lean

#: <|endoftext|>, which the encoder never makes from a text.
SEPARATOR = 50256
WIDTH = 2
BLOCK_IDS = 1 << 20


def write_flat(documents: DataFrame, path: str, vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Encode ``documents`` as they lie, one flat file per partition, a separator after each
    document.  Returns ``uri, n_ids, ordinal, doc_id``: which document is where in its file."""
    spark = documents.sparkSession
    vocabulary = vocabulary or byte_bpe.vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names, total = byte_bpe.encoder(vocabulary), [], 0
        if coder.dtype.itemsize != WIDTH:
            raise ValueError(f"ids of this vocabulary don't fit {WIDTH} bytes")
        uri = f"{path}/{uuid.uuid4().hex}.ids"

        def ids() -> Iterator[bytes]:
            nonlocal total
            for batch in batches:
                for piece in slices(batch):
                    names.append(piece.column("doc_id"))
                    found, _ = coder.flat(piece.column("text"), separator)
                    total += len(found)
                    yield found.tobytes()

        feed = ids()
        first = next(feed, None)
        if first is None:
            return
        write_file(uri, (x for source in ([first], feed) for x in source))
        at = 0
        for part in names:
            n = len(part)
            yield pa.record_batch({"uri": pa.array([uri] * n), "n_ids": pa.array([total] * n, pa.int64()), "ordinal": pa.array(np.arange(at, at + n)), "doc_id": part})
            at += n

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(lean(write), "uri string, n_ids long, ordinal long, doc_id long").write.parquet(f"{path}/order")
    return spark.read.parquet(f"{path}/order")


def scan(files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``uri, ordinal, start, n_tokens, ended`` for every document of the files ``uri, n_ids``."""
    blocks = files.select("uri", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / F.lit(block_ids)))).alias("block"))
    blocks = blocks.where("n_ids > 0").repartition("uri", "block")

    def view(uri: str, block: int) -> np.ndarray:
        data = read_range(uri, block * block_ids * width, block_ids * width)
        return np.frombuffer(data, f"<u{width}", data.size // width)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, last = [], []
            for uri, block in zip(batch.column("uri").to_pylist(), batch.column("block").to_pylist()):
                at = np.flatnonzero(view(uri, block) == separator)
                n.append(len(at))
                last.append(block * block_ids + int(at[-1]) if len(at) else None)
            yield pa.record_batch({**dict(zip(batch.schema.names, batch.columns)), "n": pa.array(n, pa.int64()), "last": pa.array(last, pa.int64())})

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = row["block"] * block_ids
                ends = np.flatnonzero(view(row["uri"], row["block"]) == separator) + low
                tail = row["n_ids"] if low + block_ids >= row["n_ids"] else None
                starts = np.concatenate(([row["carry"] + 1], ends + 1))
                if tail is not None and starts[-1] < tail:
                    ends, ended = np.append(ends, tail), np.append(np.ones(len(ends), bool), False)
                else:
                    starts, ended = starts[:-1], np.ones(len(ends), bool)
                yield pa.record_batch({
                    "uri": pa.array([row["uri"]] * len(ends), pa.string()), "ordinal": pa.array(row["before"] + np.arange(len(ends))),
                    "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ended": pa.array(ended)})

    found = blocks.mapInArrow(lean(survey), "uri string, n_ids long, block long, n long, last long")
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumns({
        "before": F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")),
        "carry": F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")),
    }).drop("n", "last")
    return stitched.mapInArrow(lean(documents), "uri string, ordinal long, start long, n_tokens long, ended boolean")


def token_counts(documents: DataFrame, path: str | None = None, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``doc_id, n_tokens`` of every row of ``documents``, counted in flat files written from it."""
    spark: SparkSession = documents.sparkSession
    path = path or shared_dir(spark, "flat-tokens")
    order = write_flat(documents, path, vocabulary)
    files = order.groupBy("uri").agg(F.max("n_ids").alias("n_ids"))
    counts = scan(files, block_ids=block_ids)
    # A row for each document: never to be broadcast, however small it is taken to be.
    return order.select("uri", "ordinal", "doc_id").join(counts.hint("merge"), ["uri", "ordinal"]).select("doc_id", "n_tokens")
