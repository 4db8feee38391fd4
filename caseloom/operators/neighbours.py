"""Exact nearest-neighbour join: cells around pivots, triangle bounds, vectors and queries paired as data.

Every vector belongs to the cell of its nearest pivot. A cell's number of vectors, radius
and smallest distances to its pivot say how near it must come to a query and how far its
best vectors can be; cells that cannot hold one of the k nearest are never asked. Cells
are cut into chunks of bounded size, so a crowd of equal vectors is many chunks. A task
keeps one chunk and lets the queries that ask it pass by in batches; every query leaves
its k best of the chunk, and those are ranked at the end.

The driver sees pivots and one line per cell, both bounded by a parameter; neither
queries nor vectors. What a call does does not depend on their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.vectors import DISTANCE_DIGITS
from ..session import settled
from .common import first_rows

#: Pivots at most, vectors for each of them at least, and vectors of a chunk about.
PIVOTS, PER_PIVOT, CHUNK = 256, 512, 16_384
#: Cells of a distance matrix held at a time by one task.
_CELLS = 2_000_000
#: Allowance for rounding in bounds, absolute and by the length of the vectors.
_SLACK, _SLACK_BY_LENGTH = 2e-6, 1e-7


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(length > 0, length, 1.0)[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(gap, 0.0))


@dataclass
class Cells:
    """What bounds need to know: pivots and, by cell, number, radius and the smallest distances to the pivot.

    For ``cosine`` all vectors have length 1, except zero vectors: they are as far as can
    be from everything (distance 1) and form a cell of their own, the last one.
    """

    metric: str
    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    near: list[np.ndarray]
    length: float
    chunk: int

    def chunks(self, cell: np.ndarray | int) -> np.ndarray:
        # a query is repeated for every chunk: chunks smaller than a usual one grow with the table,
        # so that there are no more of them than cells, about
        size = max(self.chunk, min(CHUNK, int(self.count.sum()) // PIVOTS))
        return np.maximum(1, -(-self.count[cell] // size))

    def _rank(self, distance: np.ndarray) -> np.ndarray:
        return distance * distance / 2 if self.metric == "cosine" else distance

    def candidates(self, queries: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
        """Which cells (columns) may hold one of the k nearest of each query, not farther than its ``bound``."""
        n_pivots = len(self.pivots)
        wanted = np.broadcast_to(self.count > 0, (len(queries), len(self.count))).copy()
        if not n_pivots:
            return wanted
        own = unit_rows(queries) if self.metric == "cosine" else queries
        zero = ~queries.any(axis=1) if self.metric == "cosine" else np.zeros(len(queries), bool)
        to_pivot = _distances(own, self.pivots)
        slack = _SLACK + _SLACK_BY_LENGTH * (self.length + np.sqrt((own * own).sum(axis=1)))[:, None]
        reach = np.concatenate([to_pivot[:, [p]] + d[None, :] for p, d in enumerate(self.near[:n_pivots]) if len(d)] or [np.zeros((len(queries), 0))], axis=1)
        limit = np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(queries), np.inf)
        limit = np.minimum(self._rank(limit), np.where(np.isnan(bound), np.inf, bound))
        first = np.array([d.min() if len(d) else 0.0 for d in self.near[:n_pivots]])
        least = np.maximum(0.0, np.maximum(to_pivot - self.radius[None, :n_pivots], first[None, :] - to_pivot) - slack)
        wanted[:, :n_pivots] &= (self._rank(least) <= limit[:, None] + slack) | zero[:, None]
        return wanted


@dataclass
class VectorIndex:
    """Stored vectors (item_id, embedding, cell) and what is known of their cells; built once, asked many times."""

    table: DataFrame
    cells: Cells


def build_index(vectors: DataFrame, k: int, metric: str = "cosine", pivots: int = PIVOTS, chunk: int = CHUNK) -> VectorIndex:
    """Index vectors (item_id, embedding) for up to ``k`` neighbours; NULL vectors are left out.

    The vectors are computed once and written to the shared folder. Pivots are those
    with the smallest hashes, ``pivots`` at most.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    rows = settled(vectors.select("item_id", "embedding").filter("embedding is not null"), "vectors")
    wanted = max(1, min(pivots, rows.count() // PER_PIVOT))
    seen = rows.select("embedding").orderBy(F.xxhash64("embedding"), "item_id").limit(wanted).collect()
    points = np.array([r["embedding"] for r in seen], dtype=np.float64) if seen else np.zeros((0, 1))
    points = np.unique(unit_rows(points) if metric == "cosine" else points, axis=0)
    if metric == "cosine":
        points = points[points.any(axis=1)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix_of(batch.column(1))
            length = np.sqrt((own * own).sum(axis=1))
            if metric == "cosine":
                own = unit_rows(own)
            cell, distance = np.full(len(own), len(points), np.int32), np.full(len(own), np.inf)
            some = length > 0 if metric == "cosine" else np.ones(len(own), bool)
            if len(points) and some.any():
                to_pivot = _distances(own[some], points)
                cell[some] = to_pivot.argmin(axis=1)
                distance[some] = to_pivot.min(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(distance), pa.array(length)], names=["item_id", "embedding", "cell", "d", "length"])

    out = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("d", "length")]])
    table = rows.mapInArrow(assign, out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One line a cell of what a task's vectors say; nothing is shuffled by vector."""
        seen: dict[int, list] = {}
        for batch in batches:
            cell, d, length = (batch.column(c).to_numpy() for c in range(3))
            for c in np.unique(cell).tolist():
                own = d[cell == c]
                n, radius, far, near = seen.get(c, (0, -np.inf, 0.0, np.zeros(0)))
                seen[c] = [n + len(own), max(radius, own.max()), max(far, length[cell == c].max()), np.sort(np.concatenate([near, own]))[:k]]
        rows = [(c, *v[:3], v[3].tolist()) for c, v in seen.items()]
        names = ["cell", "n", "radius", "length", "near"]
        types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    lines = table.select("cell", "d", "length").mapInArrow(summed, "cell int, n long, radius double, length double, near array<double>")
    least = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    stats = lines.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("length").alias("length"), least)
    known = {r["cell"]: r for r in stats.collect()}  # one line a cell
    every = range(len(points) + 1)
    cells = Cells(
        metric,
        points,
        np.array([known[c]["n"] if c in known else 0 for c in every]),
        np.array([known[c]["radius"] if c in known else 0.0 for c in every]),
        [np.array(known[c]["near"] if c in known else []) for c in every],
        1.0 if metric == "cosine" else max((r["length"] for r in known.values()), default=0.0),
        chunk,
    )
    return VectorIndex(table.drop("d", "length"), cells)


def _asking(cells: Cells, k: int):
    """Queries, repeated for every chunk that may hold one of their nearest."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bound = batch.column(2).to_numpy(zero_copy_only=False)
                row, cell = np.nonzero(cells.candidates(matrix_of(batch.column(1)), k, bound))
                n = cells.chunks(cell)
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.record_batch(
                    [*batch.take(pa.array(row)).columns, pa.array(cell.astype(np.int32)), pa.array(nth.astype(np.int32))],
                    names=["query_id", "embedding", "bound", "cell", "chunk"],
                )

    return ask


#: Raw distances that may be shown alike are no farther apart.
_ALIKE = 1.1 * 10.0**-DISTANCE_DIGITS


def _side(items: np.ndarray, metric: str) -> np.ndarray:
    """What a chunk's items are compared by, once for all queries: unit vectors, or squared lengths."""
    return unit_rows(items) if metric == "cosine" else (items * items).sum(axis=1)


def _best_of(queries: np.ndarray, bound: np.ndarray, items: np.ndarray, side: np.ndarray, k: int, metric: str):
    """Rows, columns, rank and cosine distances of the k best items of every query; items come in the order of their ids.

    Only what can be among the k best is rounded and ranked; of the rest one product is all that is computed.
    """
    own = unit_rows(queries)
    if metric == "cosine":
        raw = 1.0 - own @ side.T
    else:
        raw = (queries * queries).sum(axis=1)[:, None] + side[None, :]
        raw -= 2.0 * (queries @ items.T)

    def distance(part: np.ndarray) -> np.ndarray:
        return part if metric == "cosine" else np.sqrt(np.maximum(part, 0.0))

    limit = np.where(np.isnan(bound), np.inf, bound)
    if items.shape[0] > k:
        kth = distance(np.partition(raw, k - 1, axis=1)[:, k - 1])
        limit = np.minimum(limit, np.round(kth, DISTANCE_DIGITS) + 0.0)
    reach = limit + _ALIKE
    row, column = np.nonzero(raw <= (reach if metric == "cosine" else np.where(reach < 0, -np.inf, reach * reach))[:, None])
    rank = np.round(distance(raw[row, column]), DISTANCE_DIGITS) + 0.0
    near = rank <= limit[row]
    row, column, rank = row[near], column[near], rank[near]
    order = np.lexsort((column, rank, row))
    row, column, rank = row[order], column[order], rank[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, column, rank = row[kept], column[kept], rank[kept]
    if metric == "cosine":
        return row, column, rank, rank
    alike = np.einsum("ij,ij->i", own[row], unit_rows(items[column]))
    return row, column, rank, np.round(1.0 - alike, DISTANCE_DIGITS) + 0.0


def _meeting(k: int, metric: str, schema: pa.Schema):
    """For rows in the order (cell, chunk, kind): a chunk's vectors are kept, the queries after them pass by."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, items, ids, side = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, chunk, kind = (batch.column(c).to_numpy() for c in ("cell", "chunk", "kind"))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                rows = batch.slice(low, high - low)
                if at != (cell[low], chunk[low]):
                    at, parts, items, ids, side = (cell[low], chunk[low]), [], None, None, None
                if kind[low] == 0:
                    parts.append((rows.column("item_id"), matrix_of(rows.column("embedding")).astype(np.float32 if _is_float(rows) else np.float64)))
                    continue
                if items is None:
                    if not parts:
                        continue
                    ids = pa.concat_arrays([p[0] for p in parts])
                    order = pc.sort_indices(ids)
                    items, ids = np.concatenate([p[1] for p in parts])[order.to_numpy()].astype(np.float64), ids.take(order)
                    side = _side(items, metric)
                step = max(1, _CELLS // len(items))
                for first in range(0, rows.num_rows, step):
                    some = rows.slice(first, step)
                    bound = some.column("bound").to_numpy(zero_copy_only=False)
                    row, column, rank, shown = _best_of(matrix_of(some.column("embedding")), bound, items, side, k, metric)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("query_id").take(pa.array(row)), ids.take(pa.array(column)), pa.array(rank), pa.array(shown)], schema=schema
                    )

    return meet


def _is_float(rows: pa.RecordBatch) -> bool:
    return pa.types.is_float32(rows.schema.field("embedding").type.value_type)


def nearest_join(queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(query_id, item_id, rank_distance, distance): the k nearest items of every query, ties by item id.

    ``queries`` is (query_id, embedding) and may have ``bound``: items of a larger rank
    distance than that are left out. Of rows that repeat a ``query_id`` the smallest
    vector asks; NULL vectors ask nothing. ``distance`` is the cosine distance whatever
    the metric.
    """
    cells = index.cells
    bound = F.col("bound").cast("double") if "bound" in queries.columns else F.lit(None).cast("double")
    asked = queries.select("query_id", F.struct("embedding", bound.alias("bound")).alias("q")).filter("q.embedding is not null")
    asked = asked.groupBy("query_id").agg(F.min("q").alias("q")).select("query_id", "q.*")
    paired = T.StructType([*asked.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("cell", "chunk")]])
    asks = asked.mapInArrow(_asking(cells, k), paired)
    per_cell = F.array(*[F.lit(int(n)) for n in cells.chunks(np.arange(len(cells.count)))])
    held = index.table.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.element_at(per_cell, F.col("cell") + 1)).cast("int"))
    both = held.withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind")
    out = T.StructType(
        [queries.schema["query_id"], index.table.schema["item_id"], *[T.StructField(c, T.DoubleType()) for c in ("rank_distance", "distance")]]
    )
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out.fields])
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in out.fields])
    columns = ["cell", "chunk", "kind", "item_id", "query_id", "embedding", "bound"]
    found = both.select(*columns).mapInArrow(_meeting(k, cells.metric, arrow), out)
    return first_rows(found, ["query_id"], [F.col("rank_distance"), F.col("item_id")], k)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    known = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64()}
    return known[type(kind)]
