"""Publishing results without overwriting what differs."""

from __future__ import annotations

import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.decode import registry
from quarry.decode.cursor import Reject


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A new Parquet table; an existing one is refused."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def preflight(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, status`` of each wanted ``path, sha256``: missing, unchanged or collision."""
    have = existing.select("path", F.col("sha256").alias("have"))
    status = F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("sha256"), "unchanged").otherwise("collision")
    return wanted.join(have, "path", "left").select("path", status.alias("status"))


def residue_possible(before: str, result: str, after: str) -> bool:
    """Whether a failed publication may still have put the whole file there."""
    return (before, result, after) == ("missing", "io-error", "unchanged")


def preflight_file(path: str, data: bytes) -> str:
    try:
        with open(path, "rb") as f:
            return "unchanged" if f.read() == data else "collision"
    except FileNotFoundError:
        return "missing"
    except OSError:
        return "io-error"


def _staged(path: str, data: bytes) -> str:
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, prefix=".new-")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    return name


def write_new(path: str, data: bytes) -> str:
    """Put a whole file at a free name, or give already-exists; of two writers one wins."""
    name = _staged(path, data)
    try:
        os.link(name, path)
    except FileExistsError:
        return "already-exists"
    finally:
        os.unlink(name)
    return "ok"


def publish_exact(path: str, data: bytes) -> str:
    """emitted, unchanged, collision or io-error."""
    before = preflight_file(path, data)
    if before != "missing":
        return before
    try:
        if write_new(path, data) == "ok":
            return "emitted"
    except OSError:
        return "io-error"
    after = preflight_file(path, data)
    return after if after != "missing" else "io-error"


def ensure_directory(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def export_registry(entries: DataFrame, path: str) -> int:
    """Write a registry as its canonical file, replacing the old one whole.

    The format bounds a registry to 65,536 entries and 512 MiB, so it may pass the driver.
    """
    if entries.count() > registry.MAX_ENTRIES:
        raise Reject("limit-exceeded", "entries")
    rows = [r.asDict() for r in entries.collect()]
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    data = registry.serialize([{k: plain(v) for k, v in r.items()} for r in rows])
    name = _staged(path, data)
    os.replace(name, path)
    return len(rows)


def import_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file as a table with ``schema``."""
    if os.path.islink(path) or not os.path.isfile(path):
        raise Reject("not-a-regular-file", path)
    with open(path, "rb") as f:
        entries = registry.deserialize(f.read())
    ddl = (
        "file_version int, engine binary, class_id int, type_id int, script_index int, has_script_hash boolean, is_stripped boolean, is_ref boolean, "
        "script_hash binary, type_hash binary, nodes binary, strings binary, dependencies array<int>, class_name binary, name_space binary, assembly binary, schema binary")
    names = [x.strip().split()[0] for x in ddl.split(",")]
    return spark.createDataFrame([tuple((e | {"schema": registry.schema_bytes(e)})[n] for n in names) for e in entries], ddl)


def run_process(arguments: list[str], timeout: float) -> tuple[str, int | None]:
    """Run a helper without a shell on the driver: ok, failed, timed-out or not-started, and its code."""
    if not arguments or len(arguments) > 256 or sum(len(os.fsencode(a)) + 1 for a in arguments) > 65_536:
        return "invalid-argument", None
    try:
        with subprocess.Popen(arguments, start_new_session=True) as process:
            try:
                code = process.wait(timeout)
            except subprocess.TimeoutExpired:
                os.killpg(process.pid, 9)
                process.wait()
                return "timed-out", None
    except OSError:
        return "not-started", None
    return ("ok" if code == 0 else "failed"), code
