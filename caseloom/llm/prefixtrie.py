"""Prefix trie of conversations as padded matrices of turn ids, one sorted block at a time.

A conversation is its sequence of turn ids. In sorted order the conversations that begin
with the same turns are neighbours, so the trie never has to be built: a row of the sorted
table starts a node at every depth beyond what it shares with the row before it, and all
figures of a node are sums over its rows.

Ranges of the sorted table (shards) are dealt to tasks. A task takes its rows in blocks:
matrices of ids padded with -1 and put in order by numpy. Where a column changes from one
row to the next, all columns after it count as changed as well (an accumulated OR), which
marks the node starts of every depth at once; ``reduceat`` over them gives the nodes of the
block. Only nodes on the path of a block's first or last row can go on in the next block.
These come out as parts under a digest of their path and are added up afterwards. So that
sums stay exact, a block knows the rows just before and after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.operators.common import join_many_to_one

from .common import stored

#: Conversations share the beginning of the first one of their group: its size, and turns shared at most, plus one.
GROUP, HEADS = 5, 9
#: Cells of a block's matrices, one row at least.
CELLS = 1 << 20
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODE = "key string, parent_key string, conv_id long, depth long, parent_conv_id long, " + ", ".join(f"{c} long" for c in _SUMS)
#: ``ends`` holds the digest of all ids that end at a node, or ``piece`` some of them, joined, in the order of ``shard``, ``place``.
_SCHEMA = f"{_NODE}, ends string, piece string, shard int, place long"
_NONE = hashlib.sha256(b"").hexdigest()


# ---- conversations as rows of ids -------------------------------------------------


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, bytes): for every conversation its turns as pairs of 64-bit ids, and the UTF-8 bytes of their texts.

    Turns are in the order of ``turn`` (NULL first; equal ones by id). Texts stay where
    they are: what moves is 24 bytes a turn. The ids together hold 127 bits of two hashes
    of role and text, NULLs being empty.
    """
    what, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = F.struct(
        F.col(turn).alias("turn"),
        # never negative: -1 pads the matrices
        F.xxhash64(F.lit(11), what, said).bitwiseAND(F.lit((1 << 63) - 1)).alias("a"),
        F.xxhash64(F.lit(12), what, said).alias("b"),
        F.octet_length(said).cast("long").alias("n"),
    )
    narrow = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("t")).filter("conv_id is not null")
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def rebuilt(rows: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the first one of its group, h being crc32(id) % ``heads``.

    The group of c begins at c - c % ``group``. Where that conversation is absent no turn
    is put in front; where it is shorter than h all of it is. Every group's first rows
    are cut to ``heads`` - 1 turns before the join.
    """
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    base = rows.filter(F.col("conv_id") == first).select(F.col("conv_id").alias("_first"), F.slice("t", 1, heads - 1).alias("_head"))
    both = rows.withColumn("_first", first).join(base, "_first", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("t", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("t", h + 1, F.greatest(F.size("t"), F.lit(1)))).alias("t"))


def _flat(rows: DataFrame) -> DataFrame:
    ids = F.flatten(F.transform("t", lambda t: F.array(t["a"], t["b"])))
    return rows.select("conv_id", ids.alias("ids"), F.transform("t", lambda t: t["n"]).alias("bytes"))


# ---- one block --------------------------------------------------------------------


def _padded(rows: list[np.ndarray], width: int, pad: int) -> np.ndarray:
    out = np.full((len(rows), width), pad, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _shared(one: np.ndarray | None, other: np.ndarray | None) -> int:
    """How many turns two rows of ids begin with in common; -1 where one is missing."""
    if one is None or other is None:
        return -1
    n = min(len(one), len(other))
    apart = np.flatnonzero(one[:n] != other[:n])
    return (int(apart[0]) if len(apart) else n) // 2


def _path_keys(ids: np.ndarray, depth: int) -> list[str]:
    """Digests of the first 0, 1, ... ``depth`` turns."""
    path, keys = hashlib.sha256(), []
    body = np.ascontiguousarray(ids, "<i8").tobytes()
    for d in range(depth + 1):
        keys.append(path.copy().hexdigest())
        path.update(body[16 * d : 16 * d + 16])
    return keys


class Block:
    """Nodes of some neighbouring rows: ids, bytes and conversation of each, and the rows of ids before and after them."""

    def __init__(self, convs: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray], before: np.ndarray | None, after: np.ndarray | None):
        width = max(len(s) for s in sizes)
        matrix = _padded(ids, 2 * width, -1)
        order = np.lexsort((convs, *matrix.T[::-1]))
        self.convs, self.matrix = convs[order], matrix[order]
        self.ids = [ids[i] for i in order]
        self.length = np.array([len(ids[i]) // 2 for i in order])
        self.total = np.zeros((len(order), width + 1), np.int64)
        np.cumsum(_padded([sizes[i] for i in order], width, 0), axis=1, out=self.total[:, 1:])
        # turns shared with the row before: columns not yet changed
        changed = np.logical_or.accumulate((self.matrix[1:] != self.matrix[:-1]).reshape(len(order) - 1, width, 2).any(axis=2), axis=1)
        inner = np.minimum((~changed).sum(axis=1), np.minimum(self.length[1:], self.length[:-1]))
        self.lead = np.concatenate([[_shared(before, self.ids[0])], inner])
        self.trail = np.concatenate([inner, [_shared(self.ids[-1], after)]])
        self.first_keys = _path_keys(self.ids[0], int(self.length[0]))
        self.last_keys = _path_keys(self.ids[-1], int(self.length[-1]))

    def nodes(self, shard: int, place: int) -> Iterator[pa.RecordBatch]:
        """Nodes by depth; those that may go on outside have a key and are parts."""
        n, last = len(self.convs), len(self.convs) - 1
        parent_of = np.full(n, -1)  # for every row, its node of the depth above
        parent_conv, parent_key = np.zeros(0, np.int64), np.zeros(0, object)
        for depth in range(int(self.length.max()) + 1):
            rows = np.flatnonzero(self.length >= depth)
            lead, trail, length = self.lead[rows], self.trail[rows], self.length[rows]
            starts = lead < depth
            starts[0] = True  # the first row of all, or one after a shorter row
            at = np.flatnonzero(starts)
            own = np.cumsum(starts) - 1
            conv = np.minimum.reduceat(self.convs[rows], at)
            shared = np.maximum(lead, depth - 1)
            # what a row has in common with the one before it is saved, from this depth on
            below = self.total[rows, np.maximum(depth - 1, 0)] if depth else self.total[rows, 0]
            saved = np.where(shared >= depth, self.total[rows, np.maximum(shared, 0)] - below, 0)
            sums = [
                np.add.reduceat(x.astype(np.int64), at)
                for x in (np.ones(len(rows)), (lead <= depth) & (length > depth), trail < length, saved)
            ]
            key = np.full(len(at), None, object)
            if rows[0] == 0 and self.lead[0] >= depth:
                key[0] = self.first_keys[depth]
            if rows[-1] == last and self.trail[last] >= depth:
                key[-1] = self.last_keys[depth]
            if depth == 0:
                key[:] = self.first_keys[0]  # the root goes on everywhere
            above = parent_of[rows[at]]
            up = parent_conv[above] if depth else np.zeros(len(at), np.int64)
            up_key = parent_key[above] if depth else np.full(len(at), None, object)
            open_parent = np.array([k is not None for k in up_key], bool)
            ends, pieces = self._ends(rows, at, depth, key)
            yield pa.record_batch(
                [
                    pa.array(key, pa.string()), pa.array(up_key, pa.string()), pa.array(conv), pa.array(np.full(len(at), depth, np.int64)),
                    pa.array(up, pa.int64(), mask=open_parent | (depth == 0)), *map(pa.array, sums), pa.array(ends, pa.string()),
                    pa.array(pieces, pa.string()), pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), place, np.int64)),
                ],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )
            parent_of = np.full(n, -1)
            parent_of[rows] = own
            parent_conv, parent_key = conv, key

    def _ends(self, rows: np.ndarray, at: np.ndarray, depth: int, key: np.ndarray) -> tuple[list, list]:
        """Digest, or piece, of the conversations that end at each node: they are its first rows, by conversation."""
        stop = np.append(at[1:], len(rows))
        count = np.add.reduceat((self.length[rows] == depth).astype(np.int64), at)
        digests: list[str | None] = [_NONE] * len(at)
        pieces: list[str | None] = [None] * len(at)
        for i in np.flatnonzero(count):
            joined = ",".join(map(str, self.convs[rows[at[i] : stop[i]][: count[i]]].tolist()))
            if key[i] is None:
                digests[i] = hashlib.sha256(joined.encode()).hexdigest()
            else:
                digests[i], pieces[i] = None, joined
        for i in range(len(at)):
            if key[i] is not None:
                digests[i] = None
        return digests, pieces


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _block_nodes(cells: int):
    """A function for the rows of shards in order: blocks of at most ``cells`` cells, each with its neighbours."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, before, held, width = None, 0, None, [], 0

        def close(after: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            nonlocal before, held, width, place
            if held:
                convs, ids, sizes = zip(*held, strict=True)
                block = Block(np.array(convs), list(ids), list(sizes), before, after)
                yield from block.nodes(shard, place)
                before, held, width, place = block.ids[-1], [], 0, place + 1

        for batch in batches:
            found = zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _lists(batch.column(3)), _lists(batch.column(4)),
                strict=True,
            )
            for number, kind, conv, ids, sizes in found:
                if number != shard:
                    yield from close(None)
                    shard, place, before = number, 0, None
                if kind == 0:  # the last row of the shard before
                    before = ids
                elif kind == 2:  # the first row of the shard after
                    yield from close(ids)
                else:
                    if held and (len(held) + 1) * max(width, len(sizes) + 1) > cells:
                        yield from close(ids)
                    held.append((conv, ids, sizes))
                    width = max(width, len(sizes) + 1)
        yield from close(None)

    return nodes


# ---- the whole table --------------------------------------------------------------


def sorted_shards(rows: DataFrame) -> DataFrame:
    """(shard, kind, conv_id, ids, bytes): rows dealt to ranges of the sorted order, each with its neighbours as guests.

    Kind 1 are the rows; kind 0 is the last row before a shard, kind 2 the first one after
    it. Equal rows are told apart by conversation, so a crowd of them is dealt to many
    shards as well.
    """
    dealt = rows.repartitionByRange("ids", "conv_id").withColumn("shard", F.spark_partition_id())
    dealt = stored(dealt, "shards")
    edge = F.struct("ids", "conv_id", "bytes")
    edges = dealt.groupBy("shard").agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
    # one row a shard: their number is that of the tasks
    order = Window.orderBy("shard")
    edges = stored(edges.select("shard", F.lag("high").over(order).alias("g0"), F.lead("low").over(order).alias("g2")), "edges")
    guests = [edges.filter(f"g{k} is not null").select("shard", F.lit(k).alias("kind"), f"g{k}.conv_id", f"g{k}.ids", f"g{k}.bytes") for k in (0, 2)]
    own = dealt.select("shard", F.lit(1).alias("kind"), "conv_id", "ids", "bytes")
    return own.unionByName(guests[0]).unionByName(guests[1])


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of all pieces of a key, which come in order: only the running state is held."""
    key, state, parts = None, hashlib.sha256(), 0
    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != key:
                if key is not None:
                    yield pa.record_batch([[key], [state.hexdigest()]], names=["key", "ends"])
                key, state, parts = name, hashlib.sha256(), 0
            state.update((("," if parts else "") + piece).encode())
            parts += 1
    if key is not None:
        yield pa.record_batch([[key], [state.hexdigest()]], names=["key", "ends"])


def trie_nodes(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, ids, bytes), as :func:`prefix_trie` returns them."""
    dealt = sorted_shards(rows).repartition("shard").sortWithinPartitions("shard", "kind", "ids", "conv_id")
    found = stored(dealt.select("shard", "kind", "conv_id", "ids", "bytes").mapInArrow(_block_nodes(cells), _SCHEMA), "nodes")
    parts = found.filter("key is not null")
    whole = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in _SUMS],
    )
    pieces = parts.filter("piece is not null").repartition("key").sortWithinPartitions("key", "shard", "place")
    ends = pieces.select("key", "piece").mapInArrow(_joined_digests, "key string, ends string")
    whole = stored(whole.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_NONE))), "parts")
    names = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends"]
    # a whole node's parent may be one that was added up
    closed = found.filter("key is null").select("parent_key", *names).filter("parent_key is null").select(*names)
    below = found.filter("key is null and parent_key is not null").unionByName(whole.filter("parent_key is not null"), allowMissingColumns=True)
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    below = join_many_to_one(below, above, ["parent_key"]).withColumn("parent_conv_id", F.col("_up")).select(*names)
    root = whole.filter("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names)
    return closed.unionByName(below).unionByName(root).withColumnRenamed("ends", "ends_sha256")


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    group: int | None = GROUP, heads: int = HEADS, cells: int = CELLS,
) -> DataFrame:
    """Every distinct beginning of the (rebuilt) conversations: one row a node of their trie.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, bytes of a node's last text for every member but one)
    and ends_sha256 (of the ids that end there, ascending). With ``group`` None
    conversations are taken as they are.

    NULL roles and texts are empty, NULL turns come first, equal turns are ordered by
    their ids; repeated rows are turns of their own. Rows with a NULL ``conv_id`` belong
    to no conversation and are left out. Conversations without a turn left end at the
    root. An empty table has no nodes. Other columns are ignored. One conversation's ids
    (24 bytes a turn) are a row; texts of any length stay in the table.
    """
    rows = turn_rows(conversations, conv_id, turn, role, text)
    if group is not None:
        rows = rebuilt(stored(rows, "turns"), group, heads)
    return trie_nodes(_flat(rows), cells)
