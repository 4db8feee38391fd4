"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caseloom.session import scratch_path, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder: lineage ends here."""
    return settled(df, f"llm-{label}")


class Shelf:
    """Intermediate tables in the shared folder that go when nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """The rows written once and read back; see :func:`stored`."""
        path = scratch_path(df.sparkSession, f"llm-{label}")
        self.paths.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all of them. Where the file system is none that Arrow knows they stay, which costs disk only."""
        for path in self.paths:
            with contextlib.suppress(OSError, pa.ArrowException):
                system, base = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
                system.delete_dir(base)
        self.paths = []


def range_bounds(df: DataFrame, key: str, rows: int = 4096) -> list:
    """Ascending bounds that cut a column into ranges of about ``rows`` rows: one light job over that column.

    At most 10,000 ranges are made; beyond 10,000 x ``rows`` rows they hold more, in
    proportion. Compute the bounds once and use them for all that must agree.
    """
    n = df.select(F.count(F.lit(1))).first()[0]
    parts = int(min(10_000, max(1, n // rows)))
    if parts == 1:
        return []
    cuts = [i / parts for i in range(1, parts)]
    return sorted(set(df.select(F.percentile_approx(key, cuts, max(10_000, 4 * parts))).first()[0] or []))


def range_number(bounds: list, key: Column) -> Column:
    """The number of the range a key lies in: numbers ascend with the key, NULL comes first.

    A window within a range stays small whatever the size of the table.
    """
    if not bounds:
        return F.lit(0)
    return _bisect(F.array(*[F.lit(b) for b in bounds]), key, len(bounds))


def _bisect(spots: Column, key: Column, n: int) -> Column:
    """How many of the ``n`` ascending ``spots`` are at most ``key``; NULL gives 0."""
    low = F.lit(0)
    step = 1 << max(0, n.bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    jump = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        low,
        lambda at, s: F.when((at + s <= n) & (F.get(spots, at + s - 1) <= key), at + s).otherwise(at),
    )
    return F.when(key.isNull(), F.lit(0)).otherwise(jump)


def running_starts(totals: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over the rows before, in ``order``.

    For tables of one row per key range: :func:`range_bounds` bounds their number.
    """
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0)))


def unit_hash(seed: int, *cols: Column | str) -> Column:
    """Repeatable number in [0, 1) from the seed and the columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A model for all tasks, of bounded size; :func:`received` there.

    It travels by value, classes included, so executors need not have this package.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(held: Broadcast):
    return pickle.loads(held.value)


# ---- inside tasks: memory ---------------------------------------------------------


def worker_model(kind: str, key: object, make: Callable[[], object]) -> object:
    """A model that a worker process keeps from task to task: one of each kind, the last one asked for."""
    held = sys.modules.setdefault("_caseloom_models", SimpleNamespace(by_kind={})).by_kind
    if kind not in held or held[kind][0] != key:
        held.pop(kind, None)
        held[kind] = (key, make())
    return held[kind][1]


def tidy(work: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """The same function of batches in a worker that drops models of other kinds first and gives memory back at the end.

    Workers are reused by later stages; what an earlier one left would add up.
    """

    def run(batches: Iterator) -> Iterator:
        held = getattr(sys.modules.get("_caseloom_models"), "by_kind", {})
        for kind in [k for k in held if k != keeps]:
            del held[kind]
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    run.__annotations__ = dict(work.__annotations__)
    return run


# ---- inside tasks: texts as bytes -------------------------------------------------


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_size(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start = 0
    ends = np.cumsum(lengths)
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
