"""Near-duplicate classes: weighted MinHash, banding, exact check of multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bagminhash import count_shingles, signatures
from .common import Shelf, by_size, tidy
from .words import mix, shingle_hashes, word_hashes

#: 25 bands of 5 registers: a pair at similarity 0.8 shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Share of equal registers below which a pair is not checked exactly: seven standard
#: deviations under the threshold (125 registers, 0.8: 0.036 each), so it loses no pair in practice.
LEAST_AGREE = 0.55
_BYTES = 2 << 20
_SPREAD = 64
_BLOCK = 512


def _multisets(batch: pa.RecordBatch):
    words, rows = word_hashes(batch.column("_text"))
    shingles, begins = shingle_hashes(words, rows)
    return count_shingles(shingles, begins), np.diff(begins)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, "_text", _BYTES):
            (doc, shingle, weight, _), sizes = _multisets(batch)
            n = batch.num_rows
            regs = signatures(doc, shingle, weight, n, BANDS * ROWS)
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(ROWS):
                bands = mix(bands + regs.reshape(n, BANDS, ROWS)[:, :, j])
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
            some = sizes > 0
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            small = (regs & np.uint64(0xFFFF)).astype("<u2")
            yield pa.record_batch(
                [
                    *batch.columns[:-1],
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel().view(np.int64))),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                ],
                names=["_digest", "_doc", "_size", "_bands", "_regs"],
            )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_size(whole, "_text", _BYTES):
            (_, _, _, each), sizes = _multisets(batch)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(each.view(np.int64)))],
                names=["_node", "_grams"],
            )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose registers agree often enough for the similarity to be possible."""
    for batch in batches:
        if batch.num_rows:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                for c in ("_ra", "_rb")
            )
            keep = (a == b).mean(axis=1) >= LEAST_AGREE
            yield batch.select(["_a", "_b"]).filter(pa.array(keep))


def components(edges: DataFrame, shelf: Shelf, a: str = "_a", b: str = "_b") -> DataFrame:
    """A common node (``_root``) for all nodes (``_node``) of a connected component; nodes without edges are left out.

    Every round each node joins the first of itself and its neighbours, and edges are
    redrawn between what they joined. First means smallest in the first round, where
    edges are stars around their smallest node, and first in a new random order in
    later ones, so that long chains shrink by a constant share a round. Minima are
    combined before the shuffle, so a node with very many edges is no hot spot; each
    round is written to the shared folder.
    """
    links = shelf.put(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a <> _b").distinct(), "links")
    steps = []
    while not links.isEmpty():
        rank = (lambda c: F.col(c)) if not steps else (lambda c, n=len(steps): F.xxhash64(F.lit(n), F.col(c)))
        both = links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy(F.col("_a").alias("_node")).agg(F.min(F.struct(rank("_b").alias("r"), F.col("_b").alias("n"))).alias("_m"))
        own = F.struct(rank("_node").alias("r"), F.col("_node").alias("n"))
        step = shelf.put(least.select("_node", F.least(own, F.col("_m"))["n"].alias("_up")), "joined")
        steps.append(step)
        ends = links
        for end in ("_a", "_b"):
            ends = ends.join(step.select(F.col("_node").alias(end), F.col("_up").alias(end + "u")), end)
        ends = ends.select(F.col("_au").alias("_a"), F.col("_bu").alias("_b")).filter("_a <> _b")
        links = shelf.put(ends.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links")
    if not steps:
        return edges.select(F.col(a).alias("_node"), F.col(a).alias("_root")).limit(0)
    roots = steps[0].select("_node", F.col("_up").alias("_root"))
    for step in steps[1:]:
        next_up = step.select(F.col("_node").alias("_root"), F.col("_up").alias("_next"))
        roots = roots.join(next_up, "_root", "left").select("_node", F.coalesce("_next", "_root").alias("_root"))
    return shelf.put(roots, "roots")


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Pairs (_a, _b) whose multisets overlap enough: sum of minima over sum of maxima.

    Several pairs may share their ``_b``; its shingles are repeated once per 64 of them
    and the pairs spread over the copies, so a text with very many near copies is split.
    """
    shares = pairs.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / _SPREAD).cast("int").alias("_n"))
    left = pairs.join(shares, "_b").withColumn("_salt", F.pmod(F.xxhash64("_a"), F.col("_n")).cast("int"))
    right = shares.join(grams.select(F.col("_node").alias("_b"), F.col("_grams").alias("_gb")), "_b")
    right = right.select("_b", "_gb", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"))
    full = left.join(right, ["_b", "_salt"]).join(
        grams.select(F.col("_node").alias("_a"), F.col("_grams").alias("_ga")), "_a"
    )
    shared = F.size(F.array_intersect("_ga", "_gb"))
    return full.filter(shared >= F.lit(similarity) * (F.size("_ga") + F.size("_gb") - shared)).select("_a", "_b")


def _cross(left_over: DataFrame, nodes: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Links between different components within buckets (_key, _node, _comp), enough of them to join all that are linked.

    A bucket is cut into blocks of about 512 nodes, and every two blocks meet in a task
    of their own; so the size of a bucket bounds neither memory nor the result, and
    only links leave the task. A pair is checked in the first bucket it shares: by
    registers, then exactly, unless the block has joined its components already.
    """
    sizes = left_over.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("_n"))
    rows = left_over.join(sizes, "_key").withColumn("_i", F.pmod(F.xxhash64("_node"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select("_key", "_node", "_comp", "_i", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"))
    rows = rows.join(nodes.select("_node", "_regs", "_bands"), "_node").join(grams, "_node")

    def compare(group: pa.Table) -> pa.Table:
        n = group.num_rows
        regs = np.frombuffer(b"".join(group.column("_regs").to_pylist()), "<u2").reshape(n, -1)
        node, comp, block = (group.column(c).to_numpy().copy() for c in ("_node", "_comp", "_i"))
        key, low, high = (group.column(c)[0].as_py() for c in ("_key", "_lo", "_hi"))
        bands = np.concatenate(group.column("_bands").combine_chunks().to_numpy(zero_copy_only=False)).reshape(n, -1)
        lists = group.column("_grams").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        ends = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        one, other = [], []
        for i in np.flatnonzero(block == low):
            others = np.arange(n) > i if low == high else block == high
            at = np.flatnonzero(others & (comp != comp[i]))
            at = at[(regs[at] == regs[i]).mean(axis=1) >= LEAST_AGREE]
            at = at[bands[i][(bands[at] == bands[i]).argmax(axis=1)] == key]
            if not len(at):
                continue
            own = np.sort(flat[ends[i] : ends[i + 1]])
            size = ends[at + 1] - ends[at]
            every = flat[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - ends[at], size)]
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
            for j in at[shared >= similarity * (len(own) + size - shared)]:
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    one.append(node[i])
                    other.append(node[j])
        return pa.table({"_a": pa.array(one, pa.int64()), "_b": pa.array(other, pa.int64())})

    return rows.groupBy("_key", "_lo", "_hi").applyInArrow(compare, "_a long, _b long")


def _labelled(rows: DataFrame, node: str, root: DataFrame) -> DataFrame:
    """Add the component of column ``node``, itself where it has no links, as ``<node>r``."""
    label = node + "r"
    named = root.select(F.col("_node").alias(node), F.col("_root").alias(label))
    return rows.join(named, node, "left").withColumn(label, F.coalesce(label, node))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shelf: Shelf | None = None
) -> DataFrame:
    """Class of every row: doc_id, class_id (smallest doc_id of the class), class_size, is_kept, text_digest.

    Two texts are linked if the multisets of their five-word shingles (lower case; words
    are runs of letters and digits) overlap in ``similarity`` or more, sum of minima
    over sum of maxima; classes are the connected components, so a class may hold texts
    that are linked over others only. Equal texts are one class. ``is_kept`` marks one
    row of every class: that with the smallest doc_id, then with the smallest digest;
    rows that repeat both its doc_id and its text bear the same mark.

    A text of one to four words has one shingle. A NULL text, and one without any
    word, is never a near copy; empty and NULL texts are not copies of each other
    either: each such row is a class of its own and kept. Other columns are ignored.
    A class whose rows have no doc_id has a NULL class_id.

    Links are never lost to a cap: a bucket first checks its members against its
    smallest one; members of buckets that then still hold several components are
    compared across components. A linked pair is missed only if no band agrees
    (probability 5e-5 at similarity 0.8) in every chain that would link it.

    Intermediate tables go to the shared folder. Those that the result does not read are
    deleted; the others are on ``shelf``, for a caller who is done with the result.
    """
    shelf, work = shelf or Shelf(), Shelf()
    body = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    low = F.lower(F.col("_text"))
    source = body.select(F.md5(low).alias("_digest"), "_doc", low.alias("_text"))
    sketched = source.filter("_text is not null").mapInArrow(
        tidy(_sketch), "_digest string, _doc long, _size long, _bands array<long>, _regs binary"
    )
    texts = sketched.filter("_size > 0").groupBy("_digest").agg(
        F.min("_doc").alias("_doc"), F.first("_bands").alias("_bands"), F.first("_regs").alias("_regs")
    )
    nodes = shelf.put(texts.withColumn("_node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("_node", F.explode("_bands").alias("_key"))
    buckets = spread.groupBy("_key").agg(F.min("_node").alias("_pivot"), F.max("_node").alias("_last"))
    members = work.put(
        spread.join(buckets.filter("_pivot < _last").select("_key", "_pivot"), "_key"), "members"
    )
    pairs = members.filter("_node <> _pivot").select(F.col("_node").alias("_a"), F.col("_pivot").alias("_b"))
    pairs = work.put(pairs.distinct(), "pairs")

    needed = nodes.join(members.select("_node").distinct(), "_node", "left_semi").select("_node", "_digest", "_doc")
    chosen = source.filter("_text is not null").join(
        needed.withColumnRenamed("_doc", "_at"), (source["_digest"] == needed["_digest"]) & source["_doc"].eqNullSafe(F.col("_at"))
    )
    grams = work.put(
        chosen.select("_node", "_text").mapInArrow(tidy(_grams), "_node long, _grams array<long>").dropDuplicates(["_node"]), "grams"
    )
    # first each node against the smallest node it met, then all that is not yet joined
    nearest = pairs.groupBy("_a").agg(F.min("_b").alias("_b"))
    edges = work.put(_verified(nearest, grams, similarity), "edges")
    root = components(edges, work)
    apart = _labelled(_labelled(pairs, "_a", root), "_b", root).filter("_ar <> _br").select("_a", "_b")
    regs = nodes.select("_node", "_regs")
    rest = (
        apart.join(regs.select(F.col("_node").alias("_a"), F.col("_regs").alias("_ra")), "_a")
        .join(regs.select(F.col("_node").alias("_b"), F.col("_regs").alias("_rb")), "_b")
        .mapInArrow(tidy(_agreeing), "_a long, _b long")
    )
    edges = work.put(edges.unionByName(_verified(work.put(rest, "rest"), grams, similarity)), "edges")
    whole = _labelled(members.select("_key", "_node"), "_node", components(edges, work)).withColumnRenamed("_noder", "_comp")
    mixed = whole.groupBy("_key").agg(F.min("_comp").alias("_l"), F.max("_comp").alias("_h")).filter("_l < _h")
    left_over = work.put(whole.join(mixed.select("_key"), "_key", "left_semi"), "left")
    edges = work.put(edges.unionByName(_cross(left_over, nodes, grams, similarity)), "edges")
    root = components(edges, shelf)
    work.clear()
    classed = nodes.select("_node", "_digest", "_doc").join(root, "_node", "left")
    classed = classed.select("_digest", F.coalesce("_root", "_node").alias("_root"), "_doc")
    return _with_classes(body, classed)


def _with_classes(body: DataFrame, classed: DataFrame) -> DataFrame:
    """One row per input row: copies counted per text first, then texts per class."""
    digest = F.md5(F.lower("_text"))
    rows = body.select("_doc", digest.alias("_digest"))
    copies = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies"))
    texts = classed.join(copies, "_digest")
    heads = texts.groupBy("_root").agg(
        F.sum("_copies").alias("class_size"), F.min("_doc").alias("class_id"), F.min(F.struct(F.col("_doc").isNull(), "_doc", "_digest")).alias("_head")
    )
    texts = texts.join(heads, "_root").select(
        "_digest", "class_id", "class_size", (F.col("_digest") == F.col("_head._digest")).alias("_has_head")
    )
    joined = rows.join(texts, "_digest", "left")
    lone = F.col("class_size").isNull()
    return joined.select(
        F.col("_doc").alias("doc_id"),
        F.when(lone, F.col("_doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (lone | (F.col("_has_head") & F.col("_doc").eqNullSafe(F.col("class_id")))).alias("is_kept"),
        F.col("_digest").alias("text_digest"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, all columns untouched.

    Rows that repeat both the doc_id and the text of a kept one count as one row: one of them stays.
    """
    shelf = Shelf()
    classes = near_duplicates(docs, doc_id, text, similarity, shelf).filter("text_digest is not null")
    key = [F.coalesce("doc_id", F.lit(0)).alias("_llm_id"), F.col("doc_id").isNull().alias("_llm_none"), F.col("text_digest").alias("_llm_digest")]
    rows = classes.groupBy(*key).agg(
        F.first("is_kept").alias("_kept"), F.max("class_size").alias("_size"), F.count(F.lit(1)).alias("_rows")
    )
    # a kept row of a class of one has nothing to be decided; most rows are of this kind
    names = ["_llm_id", "_llm_none", "_llm_digest"]
    odd = Shelf().put(rows.filter("not _kept or (_rows > 1 and _size > 1)").select(*names, F.col("_kept").alias("_llm_kept")), "odd")
    shelf.clear()
    ident = F.col(doc_id).cast("long")
    marked = docs.withColumns(dict(zip(names, [F.coalesce(ident, F.lit(0)), ident.isNull(), F.md5(F.lower(F.col(text)))], strict=True)))
    # rows that repeat a kept one stand side by side then; texts move once
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("_llm_id"))
    judged = marked.join(odd, names, "left").withColumn("_llm_nth", nth)
    return judged.filter("_llm_kept is null or (_llm_kept and _llm_nth = 1)").select(*docs.columns)
