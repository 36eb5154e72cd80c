"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Layout of a data set, one pair of files per partition of ascending doc_id ranges:

``NAME.ids``  the ids of all its documents in order, little-endian, 16 bits wide if the
              vocabulary allows and 32 otherwise, nothing else;
``NAME.idx``  32 bytes of header (8 bytes of magic, id width, number of documents, number
              of ids, each 64-bit), then n + 1 offsets (uint64, in ids, from the file's
              first), n document ids (int64) and n null flags (uint8).

``manifest/`` (Parquet) lists the files in order with their counts and ``base``, the
number of ids in all files before, a running sum over partitions; base + offset is a
document's position in the whole data set.  Files are written under a new name for every
attempt of a task and renamed when whole; only those that the manifest names count, so a
lost executor or a repeated task leaves unread files at worst.

Edge cases: a null text is an empty document, which still gets its end id; a null doc_id
comes first and is read back as null; equal doc_ids are ordered by a hash of their text;
an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .storage import map_file, read_range, shared_dir, write_file
from .textvec import slices
from .workers import lean

MAGIC = b"FLATTOK1"
END_ID = 2
MANIFEST = "part int, lo long, ids_uri string, idx_uri string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_pair(uri: str, width: int, chunks: Iterator[bytes], lengths: list[np.ndarray], doc_ids: list[pa.Array]) -> tuple[str, str, int, int]:
    """Write one ids file from ``chunks`` and its index; ``lengths`` and ``doc_ids`` fill up as chunks are drawn."""
    name = f"{uri}-{uuid.uuid4().hex[:12]}"
    write_file(f"{name}.ids", chunks)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
    keys = pa.chunked_array(doc_ids)
    plain = pc.fill_null(keys, 0).to_numpy().astype("<i8")
    head = MAGIC + np.array([width, len(plain), ends[-1]], "<u8").tobytes()
    write_file(f"{name}.idx", [head, ends.tobytes(), plain.tobytes(), pc.is_null(keys).to_numpy().astype("u1").tobytes()])
    return f"{name}.ids", f"{name}.idx", len(plain), int(ends[-1])


def read_index(uri: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Id width, offsets, document ids and null flags of an index file, memory-mapped."""
    data = map_file(uri)
    if data[:8].to_pybytes() != MAGIC:
        raise ValueError(f"{uri} is not an index of a token file")
    width, n, total = map(int, np.frombuffer(data, "<u8", 3, 8))
    offsets = np.frombuffer(data, "<u8", n + 1, 32)
    doc_ids = np.frombuffer(data, "<i8", n, 32 + 8 * (n + 1))
    nulls = np.frombuffer(data, "u1", n, 32 + 8 * (2 * n + 1))
    if int(offsets[-1]) != total:
        raise ValueError(f"{uri} counts {total} ids but its offsets end at {int(offsets[-1])}")
    return width, offsets, doc_ids, nulls


def read_ids(uri: str, width: int) -> np.ndarray:
    """The ids of a file, memory-mapped where the file system is local."""
    data = map_file(uri)
    return np.frombuffer(data, f"<u{width}") if data.size else np.empty(0, f"<u{width}")


def write_tokens(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``documents`` and write the data set under ``path``; returns its manifest."""
    spark = documents.sparkSession
    vocabulary = vocabulary or byte_bpe.vocabulary_path()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, lengths, doc_ids = byte_bpe.encoder(vocabulary), [], []

        def ids() -> Iterator[bytes]:
            for batch in batches:
                for piece in slices(batch):
                    found, bounds = coder.flat(piece.column("text"), end_id)
                    lengths.append(np.diff(bounds))
                    doc_ids.append(piece.column("doc_id"))
                    yield found.tobytes()

        feed = ids()
        first = next(feed, None)
        if first is None:
            return
        chunks = (x for source in ([first], feed) for x in source)
        ids_uri, idx_uri, n_docs, n_ids = write_pair(f"{path}/part-{part:06d}", coder.dtype.itemsize, chunks, lengths, doc_ids)
        row = {"part": part, "lo": pc.min(pa.chunked_array(doc_ids)).as_py(), "ids_uri": ids_uri, "idx_uri": idx_uri, "n_docs": n_docs, "n_ids": n_ids}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("part", pa.int32()), ("lo", pa.int64()), ("ids_uri", pa.string()), ("idx_uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # Collected at once, a row a file: the writing task must not run again with another outcome,
    # and a table of them would be a file (for Spark, a process that sets its mode) a task.
    base, listed = 0, []
    for row in sorted(rows.mapInArrow(lean(write), MANIFEST).collect(), key=lambda row: row["part"]):
        listed.append((*row, base))
        base += row["n_ids"]
    spark.createDataFrame(listed, f"{MANIFEST}, base long").coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, offsets, doc_ids, nulls = read_index(row["idx_uri"])
                ids = read_ids(row["ids_uri"], width)
                if len(ids) != int(offsets[-1]):
                    raise ValueError(f"{row['ids_uri']} holds {len(ids)} ids, not {int(offsets[-1])}")
                at = offsets.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch({
                    "doc_id": pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), "start": pa.array(at[:-1] + row["base"]),
                    "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    # One file to a task.
    return manifest.repartition(max(1, n), "part").mapInArrow(lean(read), DOCUMENTS)


def tokens_on_disk(documents: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``documents`` as token files, then describe each document from them."""
    path = path or shared_dir(documents.sparkSession, "token-files")
    return read_documents(write_tokens(documents, path, **options))


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of all documents of that doc_id, by looking only into the files that may hold it."""
    out = []
    for row in spark.read.parquet(f"{path}/manifest").where(F.col("lo").isNull() | (F.col("lo") <= doc_id)).orderBy("part").toLocalIterator():
        width, offsets, doc_ids, nulls = read_index(row["idx_uri"])
        for k in np.flatnonzero((doc_ids == doc_id) & (nulls == 0)):
            first, end = int(offsets[k]), int(offsets[k + 1])
            out.append(np.frombuffer(read_range(row["ids_uri"], first * width, (end - first) * width), f"<u{width}").tolist())
    return out
