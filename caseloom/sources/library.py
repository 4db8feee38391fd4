"""Stored files of any size: hashed as streams, and kept by content in a library.

Paths are dealt to tasks, never contents: a task reads its files piece by piece, so memory
does not depend on their size and no file passes through a column. Nor does the driver see a
path: folders are listed by tasks, and lists are stored, so that joins know their true size.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import extension_of, filename_of_url
from ..session import settled
from .files import library_path

#: Bytes read at a time, files of one task about, and entries of a folder handed over together.
PIECE, FILES_PER_TASK, ENTRIES = 8 << 20, 256, 4096
#: Beyond this many, tasks get more files each: the driver remembers every task.
MOST_TASKS = 1024


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def first_bytes(uri: str, size: int) -> bytes:
    """The first ``size`` bytes of a file, or all if it is shorter."""
    system, place = _at(uri)
    with system.open_input_stream(place) as file:
        return file.read(size)


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path, size) of what a folder holds, without names that begin with a dot or an underscore; a folder's size is None.

    A local folder is read entry by entry. Of other file systems Arrow gives all entries of one folder at once.
    """
    if not isinstance(system, pafs.LocalFileSystem):
        for e in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if e.base_name[:1] not in "._" and e.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield e.path, e.size if e.type == pafs.FileType.File else None
        return
    try:
        found = os.scandir(folder)
    except FileNotFoundError:
        return
    with found:
        for e in found:
            if e.name[:1] not in "._":
                try:
                    state = e.stat()
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
                if stat.S_ISDIR(state.st_mode) or stat.S_ISREG(state.st_mode):
                    yield e.path, state.st_size if stat.S_ISREG(state.st_mode) else None


def _lister(system: pafs.FileSystem, scheme: str, glob: str, deep: bool):
    """From folders (path) to (path, byte_size) of their files; folders below are gone into, or, if not ``deep``, rows without a size."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        sizes: list[int | None] = []

        def lines() -> pa.RecordBatch:
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "byte_size"])

        for batch in batches:
            folders = [path[len(scheme) :] for path in batch.column(0).to_pylist()]
            while folders:
                for path, size in _entries(system, folders.pop()):
                    if size is None and deep:
                        folders.append(path)
                    elif size is None or fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], glob):
                        paths.append(scheme + path)
                        sizes.append(size)
                    if len(paths) == ENTRIES:
                        yield lines()
                        paths, sizes = [], []
        yield lines()

    return walk


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, byte_size) of the files of a folder tree whose name fits ``glob``, empty ones included; no content is read.

    The folder is listed when this is called, by one task, and each folder below it with its
    tree by a task of its own; what follows reads the stored list. Names that begin with a
    dot or an underscore are none of the data.
    """
    system, base = _at(path.rstrip("/"))
    scheme = path.split("://", 1)[0] + "://" if "://" in path else "file://"
    listed = "path string, byte_size long"
    top = spark.createDataFrame([(scheme + base,)], "path string").mapInArrow(_lister(system, scheme, glob, False), listed)
    level = settled(top, "level")
    folders = level.filter("byte_size is null").select("path")
    below = folders.repartition(max(1, min(folders.count(), MOST_TASKS))).mapInArrow(_lister(system, scheme, glob, True), listed)
    return settled(level.filter("byte_size is not null").unionByName(below), "listing")


def _digest(uri: str | None, piece: int) -> tuple[str | None, int | None]:
    """SHA-256 and size of a file; none where it cannot be read."""
    if uri is None:
        return None, None
    state, size = hashlib.sha256(), 0
    try:
        system, place = _at(uri)
        with system.open_input_stream(place) as file:
            while part := file.read(piece):
                state.update(part)
                size += len(part)
    except (OSError, pa.ArrowException):
        return None, None
    return state.hexdigest(), size


def _dealt(files: DataFrame) -> DataFrame:
    """Paths spread evenly over tasks: the longest file is one task's, but files are not bunched by folder."""
    tasks = max(1, min(-(-files.count() // FILES_PER_TASK), MOST_TASKS))
    return files.repartition(tasks, F.xxhash64("path"))


def _hashed(paths: DataFrame, piece: int) -> DataFrame:
    """(path, sha256, byte_size) of different paths."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a line a file, handed over together: a batch of one costs more than a small file
            seen = [_digest(path, piece) for path in batch.column(0).to_pylist()]
            digests, sizes = pa.array([d for d, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.int64())
            yield pa.record_batch([batch.column(0), digests, sizes], names=["path", "sha256", "byte_size"])

    return _dealt(paths).mapInArrow(read, "path string, sha256 string, byte_size long")


def hash_files(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """Add sha256 and byte_size, as read, to a table with ``path``; both are NULL where a file cannot be read.

    The files are read when this is called.
    """
    # stored before the join: Spark's estimate for rows from Python knows nothing of how many there are, and would broadcast all
    found = settled(_hashed(files.select("path").filter("path is not null").distinct(), piece), "hashes")
    return files.drop("sha256", "byte_size").join(found, "path", "left")


def store_files(files: DataFrame, library: str, piece: int = PIECE) -> DataFrame:
    """Keep the contents of files (path) in a library, one file per content at ``hh/hash.ext`` below it.

    Returns (path, sha256, byte_size, original_filename, extension, relative_path,
    is_new): ``is_new`` marks the one arrival (the first by path) that was written; contents
    that were there before are not written again. Files that cannot be read have NULLs
    and store nothing. A file is read twice, once for its name; a copy gets that name
    only when complete and found to have the same hash, so a lost task leaves no half
    file and a repeated run changes nothing.
    """
    spark = files.sparkSession
    named = _hashed(files.select("path").distinct(), piece).withColumn("original_filename", filename_of_url("path"))
    named = named.withColumn("extension", extension_of("original_filename"))
    named = settled(named.withColumn("relative_path", library_path(F.col("sha256"), F.col("extension"))), "arrivals")
    first = named.filter("sha256 is not null").groupBy("relative_path", "sha256").agg(F.min("path").alias("path"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _at(library.rstrip("/"))
        for batch in batches:
            fresh = []
            for place, digest, path in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                final = f"{base}/{place}"
                new = target.get_file_info(final).type == pafs.FileType.NotFound
                if new:
                    target.create_dir(final.rsplit("/", 1)[0], recursive=True)
                    passing, state = f"{base}/_{uuid.uuid4().hex}", hashlib.sha256()
                    source, at = _at(path)
                    with source.open_input_stream(at) as file, target.open_output_stream(passing) as out:
                        while part := file.read(piece):
                            state.update(part)
                            out.write(part)
                    if state.hexdigest() != digest:
                        target.delete_file(passing)
                        raise RuntimeError(f"file changed while it was stored: {path}")
                    target.move(passing, final)
                fresh.append(new)
            yield pa.record_batch([batch.column(2), batch.column(0), pa.array(fresh, pa.bool_())], names=["path", "relative_path", "is_new"])

    dealt = _dealt(first).select("relative_path", "sha256", "path")
    written = settled(dealt.mapInArrow(copy, "path string, relative_path string, is_new boolean"), "stored")
    return named.join(written, ["path", "relative_path"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def stored_hashes(spark: SparkSession, library: str, piece: int = PIECE) -> DataFrame:
    """(local_path below the library, file_hash) of all stored files, read anew; a NULL hash is an unreadable file."""
    files = _hashed(list_files(spark, library).select("path"), piece)
    # ``hh/name`` are the last two steps of a stored file's path
    steps = F.split("path", "/")
    return files.select(F.concat_ws("/", F.element_at(steps, -2), F.element_at(steps, -1)).alias("local_path"), F.col("sha256").alias("file_hash"), "byte_size")
