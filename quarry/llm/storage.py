"""Shared storage for operators that cut lineage or keep files of their own.

Everything lives under the folder that the cluster names in ``spark.checkpoint.dir``, or
that was given to ``setCheckpointDir``.  Where neither is set, a folder is made on this
machine if the session runs on it alone (unit tests), and any other session is refused,
as executors would write to disks of their own.  ``clean_up`` removes what a session's
operators left there, once their results are stored elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from .workers import release

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder URI under the shared checkpoint folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quarry/{label}-{uuid.uuid4().hex}"
    _made.setdefault(context.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete all folders that this application's operators made; DataFrames that they
    returned can't be read afterwards.  Returns how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> bool:
    """Return what the driver's JVM and Python have freed to the system, where the JVM has
    that command (17.0.9 or later on Linux): compiling many plans leaves hundreds of MB."""
    release()
    try:
        jvm = spark._jvm
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # Py4J finds no method for a null array, Java's own reflection does.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Py4JError:
        return False
    return True


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI or plain absolute path, and the path in it."""
    if uri.startswith(("s3a://", "s3n://")):  # what Spark calls it
        uri = "s3" + uri[3:]
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write byte chunks to a new file whole: a partial file never has the final name."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    fs.move(part, path)
    return n


def map_file(uri: str):
    """A read-only buffer over a file: memory-mapped where the file system is local."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if fs.get_file_info(path).size == 0:
            return pa.py_buffer(b"")
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def read_range(uri: str, start: int, size: int):
    """A buffer over ``size`` bytes of a file from ``start`` on, or as many as there are."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return map_file(uri)[start: start + size]
    with fs.open_input_file(path) as f:
        return pa.py_buffer(f.read_at(size, start))
