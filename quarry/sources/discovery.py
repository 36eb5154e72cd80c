"""Finding input files: explicit files and directory trees, here or on shared storage."""

from __future__ import annotations

import os
import stat
import sys
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.decode.cursor import Reject

PATHS = "path string, explicit_file boolean"


@dataclass(frozen=True)
class Options:
    """A limit of 0 is none."""

    recursive: bool = True
    reject_links: bool = False
    reject_special: bool = False
    max_files: int = 0
    max_directories: int = 0
    max_depth: int = 0
    max_path_bytes: int = 0


def _check_path(path: str, options: Options) -> None:
    if not path:
        raise Reject("invalid-argument", "path")
    if options.max_path_bytes and len(os.fsencode(path)) > options.max_path_bytes:
        raise Reject("path-limit-exceeded", path)


def discover(inputs: list[str], options: Options = Options()) -> list[tuple[str, bool]]:
    """Regular files, sorted by bytes and distinct by spelling, and whether each was named
    itself.  A link named as input is refused; links and special nodes further down are
    ignored unless the options refuse them, and never followed."""
    if not inputs:
        raise Reject("invalid-argument", "inputs")
    found: dict[str, bool] = {}
    queue: deque[tuple[str, int]] = deque()
    directories = files = 0

    def add(path: str, explicit: bool) -> None:
        nonlocal files
        files += 1
        if options.max_files and files > options.max_files:
            raise Reject("file-limit-exceeded", path)
        found[path] = found.get(path, False) or explicit

    def enqueue(path: str, depth: int) -> None:
        nonlocal directories
        if options.max_depth and depth > options.max_depth:
            raise Reject("depth-limit-exceeded", path)
        directories += 1
        if options.max_directories and directories > options.max_directories:
            raise Reject("directory-limit-exceeded", path)
        queue.append((path, depth))

    for path in inputs:
        _check_path(path, options)
        try:
            mode = os.lstat(path).st_mode
        except FileNotFoundError:
            raise Reject("not-found", path) from None
        if stat.S_ISLNK(mode):
            raise Reject("link-rejected", path)
        if stat.S_ISREG(mode):
            add(path, True)
        elif stat.S_ISDIR(mode):
            enqueue(path, 0)
        else:
            raise Reject("unsupported-node", path)
    while queue:
        directory, depth = queue.popleft()
        with os.scandir(directory) as entries:
            for entry in entries:
                child = directory.rstrip("/") + "/" + entry.name if directory != "/" else "/" + entry.name
                _check_path(child, options)
                if entry.is_symlink():
                    if options.reject_links:
                        raise Reject("link-rejected", child)
                elif entry.is_file(follow_symlinks=False):
                    add(child, False)
                elif entry.is_dir(follow_symlinks=False):
                    if options.recursive:
                        enqueue(child, depth + 1)
                elif options.reject_special:
                    raise Reject("unsupported-node", child)
    return sorted(found.items(), key=lambda item: os.fsencode(item[0]))


def is_local(path: str) -> bool:
    return "://" not in path and not path.startswith("file:")


def discover_shared(spark: SparkSession, inputs: list[str], options: Options = Options()) -> list[tuple[str, bool]]:
    """The same for URIs of any file system that Spark can list, which the driver walks through
    Hadoop's interface; links and special nodes exist there only as far as it shows them."""
    if not inputs:
        raise Reject("invalid-argument", "inputs")
    settings, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found: dict[str, bool] = {}
    queue: deque[tuple[str, int, bool]] = deque((path, 0, True) for path in inputs)
    directories = files = 0
    while queue:
        path, depth, named = queue.popleft()
        _check_path(path, options)
        where = path_of(path)
        system = where.getFileSystem(settings)
        if not system.exists(where):
            raise Reject("not-found", path)
        state = system.getFileStatus(where)
        if state.isSymlink():
            if named or options.reject_links:
                raise Reject("link-rejected", path)
        elif state.isDirectory():
            if not named and not options.recursive:
                continue
            directories += 1
            if options.max_depth and depth > options.max_depth:
                raise Reject("depth-limit-exceeded", path)
            if options.max_directories and directories > options.max_directories:
                raise Reject("directory-limit-exceeded", path)
            for child in system.listStatus(where):
                name = child.getPath().toString()
                if child.isFile():
                    _check_path(name, options)
                    files += 1
                    found.setdefault(name, False)
                else:
                    queue.append((name, depth + 1, False))
        else:
            files += 1
            found[state.getPath().toString()] = True
        if options.max_files and files > options.max_files:
            raise Reject("file-limit-exceeded", path)
    return sorted(found.items(), key=lambda item: item[0].encode())


def uris(spark: SparkSession, inputs: list[str], options: Options = Options()) -> list[str]:
    """What discovery finds as URIs: local paths by the driver's own walk, all others shared."""
    local, shared = [p for p in inputs if is_local(p)], [p for p in inputs if not is_local(p)]
    found = [f"file://{os.path.abspath(p)}" for p, _ in discover(local, options)] if local or not inputs else []
    return found + ([p for p, _ in discover_shared(spark, shared, options)] if shared else [])


def paths(spark: SparkSession, inputs: list[str], options: Options = Options()) -> DataFrame:
    local, shared = [p for p in inputs if is_local(p)], [p for p in inputs if not is_local(p)]
    found = discover(local, options) if local or not inputs else []
    return spark.createDataFrame(found + (discover_shared(spark, shared, options) if shared else []), PATHS)


def program_resource(name: str, program: str | None = None) -> str:
    """A regular file under ``share`` next to the running program."""
    home = os.path.dirname(os.path.realpath(program or sys.argv[0]))
    path = os.path.join(home, "share", name)
    if not name or os.path.isabs(name) or ".." in name.split("/"):
        raise Reject("invalid-argument", name)
    if os.path.islink(path) or not os.path.isfile(path):
        raise Reject("not-found", path)
    return path
