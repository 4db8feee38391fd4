"""Dossiers as files: one document per export, Markdown or HTML, at the path the manifest names.

The blocks of all documents are sorted by range over all tasks. A task writes the
documents that lie within its range straight to their names, one open file at a time. The
first and the last one may go on in another task: those are staged as parts, and a second
job, one task a document, joins them as streams. So a document of any size is one file, no
task holds more than a batch of blocks, and the driver sees two names a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.cases import BLOCK_ORDER, export_manifest, markdown_to_html
from ..operators.common import join_many_to_one
from ..session import scratch_path, settled

#: Bytes copied at a time when parts are joined.
_COPY = 8 << 20
_PARTS = "path string, task int, n int, file string"


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def _place(system: pafs.FileSystem, source: str, target: str) -> None:
    """Give a complete file its name; a repeated run replaces it by the same bytes."""
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    system.move(source, target)


@dataclass
class Staged(WriterCommitMessage):
    """Parts that one task left for joining."""

    parts: list[tuple[str, int, int, str]]


class DossierWriter(DataSourceArrowWriter):
    """Writes rows (path, block), sorted by path and place within the document."""

    def __init__(self, folder: str, staging: str):
        self.folder, self.staging = folder.rstrip("/"), staging.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        task, run = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, staging = _at(self.staging)
        _, folder = _at(self.folder)
        system.create_dir(staging, recursive=True)
        parts: list[tuple[str, int, int, str]] = []
        path, out, n = None, None, 0

        def finish(last: bool) -> None:
            out.close()
            name = f"{staging}/{task}-{run}-{n}"
            if last or n == 0:
                parts.append((path, task, n, name))
            else:
                _place(system, name, f"{folder}/{path}")

        for batch in iterator:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != path:
                    if out is not None:
                        finish(False)
                        n += 1
                    path, out = name, system.open_output_stream(f"{staging}/{task}-{run}-{n}")
                out.write((block or "").encode())
        if out is not None:
            finish(True)
        return Staged(parts)

    def commit(self, messages: list[Staged | None]) -> None:
        """Name the parts of all tasks, two a task at most; what a failed attempt left is not among them."""
        system, staging = _at(self.staging)
        system.create_dir(staging, recursive=True)
        with system.open_output_stream(f"{staging}/parts.json") as out:
            for part in sorted(p for m in messages if m is not None for p in m.parts):
                out.write((json.dumps(dict(zip(("path", "task", "n", "file"), part, strict=True))) + "\n").encode())

    def abort(self, messages: list[Staged | None]) -> None:
        system, staging = _at(self.staging)
        if system.get_file_info(staging).type != pafs.FileType.NotFound:
            system.delete_dir(staging)


class DossierFiles(DataSource):
    """``df.write.format("dossier_files").option("staging", ...).save(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "dossier_files"

    def schema(self) -> str:
        return "path string, block string"

    def writer(self, schema: StructType, overwrite: bool) -> DossierWriter:
        return DossierWriter(self.options["path"], self.options["staging"])


def _joiner(folder: str, staging: str):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _at(folder)
        _, waiting = _at(staging)
        path, out, held = None, None, None
        for batch in batches:
            for name, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != path:
                    if out is not None:
                        out.close()
                        _place(system, held, f"{base}/{path}")
                    held = f"{waiting}/whole-{uuid.uuid4().hex}"
                    path, out = name, system.open_output_stream(held)
                with system.open_input_stream(file) as part:
                    while piece := part.read(_COPY):
                        out.write(piece)
        if out is not None:
            out.close()
            _place(system, held, f"{base}/{path}")
        yield pa.record_batch([pa.array([], pa.string())], names=["path"])

    return join


def write_documents(blocks: DataFrame, folder: str, order: list[str]) -> None:
    """Write (path, ``order`` columns, block) as one file ``folder``/path per path: its blocks in order, without separators.

    A repeated run writes the same files. Executors need the folder and the shared one to
    be of a file system that Arrow knows.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(DossierFiles)
    staging = scratch_path(spark, "documents")
    rows = blocks.orderBy("path", *order).select("path", "block")
    rows.write.format("dossier_files").option("staging", staging).mode("append").save(folder)
    parts = spark.read.schema(_PARTS).json(f"{staging}/parts.json")
    dealt = parts.repartition("path").sortWithinPartitions("path", "task", "n").select("path", "file")
    dealt.mapInArrow(_joiner(folder, staging), "path string").write.format("noop").mode("overwrite").save()
    system, base = _at(staging)
    system.delete_dir(base)


def export_dossiers(requests: DataFrame, blocks: DataFrame, cases: DataFrame, folder: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Write the requested dossiers (case_id, format) below ``folder``; returns the manifest and the rejected requests.

    ``blocks`` are Markdown dossiers (:func:`dossier_blocks`). A Markdown export is their
    text, an HTML one the page made of their lines; both stand at the manifest's
    ``relative_path``. Requests of another format are rejected and write nothing;
    requests of a case that does not exist have no document and are left out of the
    manifest. A request that repeats is one export.
    """
    good, bad = export_manifest(requests.distinct(), ts)
    known = good.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_semi").dropDuplicates(["id"])
    manifest = settled(known, "manifest")
    order = [*BLOCK_ORDER, "line_no"]

    def of(kind: str, rows: DataFrame) -> DataFrame:
        wanted = manifest.filter(F.col("format") == kind).select("case_id", F.col("relative_path").alias("path"))
        return join_many_to_one(rows, wanted, ["case_id"]).select("path", *order, "block")

    plain = blocks.withColumn("line_no", F.lit(0))
    page = markdown_to_html(blocks, cases).withColumn("line_no", F.col("line_no").cast("int"))
    write_documents(of("markdown", plain).unionByName(of("html", page)), folder, order)
    return manifest, bad


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, bytes, content_hash) of every document; texts beyond 2 GB cannot be read this way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # the folder's own name is unique in the shared folder, so it splits each file's path
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    below = F.element_at(F.split("path", F.lit(f"/{name}/")), -1)
    return files.select(below.alias("relative_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"))
