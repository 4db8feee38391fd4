"""Benchmark items inside documents: size-partitioned MinHash containment search, exact check of shingles.

A short item has a tiny Jaccard similarity with a long document, so documents are cut
into windows of the items' own size class: items with up to 2**c shingles are sought
in windows of 2 x 2**c shingles that overlap by half, so every run of 2**c shingles
lies whole in some window, however long the document. In such a window the item's
similarity is at least about 0.2, and 64 bins of a one-permutation MinHash, each with
its smallest shingle hash, agree in some bin with near certainty; windows of a larger
class are unions of those of the next smaller one, so each shingle is hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_size, received, sent, tidy
from .words import mix, shingle_hashes, word_hashes

#: Share of an item's shingles that a document must hold.
CONTAINMENT = 0.8
BINS = 64
#: Items sought in one pass over the documents; more are sought in several passes.
ITEMS = 10_000
#: Characters of items in a pass, unless one item alone has more.
ITEM_CHARS = 20_000_000
_BYTES = 2 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SMALLEST = 3


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted, and where each text's begin."""
    shingles, begins = shingle_hashes(*word_hashes(texts))
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.argsort(shingles, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, shingles = doc[order], shingles[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(begins) - 1))])


def _sketch(shingles: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Smallest hash per bin of every group (groups x BINS)."""
    spread = mix(shingles)
    sketch = np.full(groups * BINS, _NONE)
    np.minimum.at(sketch, group * BINS + (spread >> np.uint64(58)).astype(np.int64), spread)
    return sketch.reshape(groups, BINS)


class Items:
    """The items of one pass: distinct shingles, size classes, and an index of sketch values by class."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.shingles, self.begins = _distinct(pa.array(texts, pa.string()))
        counts = np.diff(self.begins)
        owner = np.repeat(np.arange(len(ids)), counts)
        sketch = _sketch(self.shingles, owner, len(ids))
        # with repeats, for they take room in a document too
        length = np.diff(shingle_hashes(*word_hashes(pa.array(texts, pa.string())))[1])
        size_class = np.maximum(np.ceil(np.log2(np.maximum(length, 1))).astype(int), _SMALLEST)
        self.classes = {}
        for c in np.unique(size_class[counts > 0]):
            of = np.flatnonzero((size_class == c) & (counts > 0))
            value = sketch[of]
            some = value != _NONE
            flat, item = value[some], np.repeat(of, some.sum(axis=1))
            order = np.argsort(flat, kind="stable")
            self.classes[int(c)] = (flat[order], item[order])

    def candidates(self, shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Pairs (document, item) of which some window and the item agree in a bin, as an n x 2 array."""
        if not self.classes or not len(shingles):
            return np.zeros((0, 2), np.int64)
        counts = np.diff(begins)
        span = 1 << _SMALLEST
        blocks = -(-counts // span)
        first = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(shingles)) - np.repeat(begins[:-1], counts)
        block_doc = np.repeat(np.arange(len(counts)), blocks)
        sketch = _sketch(shingles, first[doc] + nth // span, int(first[-1]))
        found = []
        for c in range(_SMALLEST, max(self.classes) + 1):
            if c > _SMALLEST:
                # two neighbours of the smaller class make one block of this class
                place = np.arange(len(block_doc)) - np.repeat(first[:-1], np.diff(first))
                lead = np.flatnonzero(place % 2 == 0)
                follow = np.minimum(lead + 1, len(block_doc) - 1)
                same = (follow > lead) & (block_doc[follow] == block_doc[lead])
                sketch = np.where(same[:, None], np.minimum(sketch[lead], sketch[follow]), sketch[lead])
                block_doc = block_doc[lead]
                first = np.concatenate([[0], np.cumsum(np.bincount(block_doc, minlength=len(counts)))])
            if c == _SMALLEST and c in self.classes:
                found.append(self._lookup(mix(shingles)[:, None], doc, *self.classes[c]))
            elif c in self.classes:
                window = sketch.copy()
                joined = np.flatnonzero(block_doc[1:] == block_doc[:-1])
                window[joined] = np.minimum(sketch[joined], sketch[joined + 1])
                found.append(self._lookup(window, block_doc, *self.classes[c]))
        return np.unique(np.concatenate(found), axis=0)

    @staticmethod
    def _lookup(window: np.ndarray, block_doc: np.ndarray, values: np.ndarray, items: np.ndarray) -> np.ndarray:
        flat = window.ravel()
        # a first look at 20 bits of each value leaves few for the search
        seen = np.zeros(1 << 20, bool)
        seen[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(flat & np.uint64(0xFFFFF)).astype(np.int64)] & (flat != _NONE))
        low = np.searchsorted(values, flat[maybe], side="left")
        many = np.searchsorted(values, flat[maybe], side="right") - low
        maybe, low, many = maybe[many > 0], low[many > 0], many[many > 0]
        at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.stack([block_doc[np.repeat(maybe, many) // window.shape[1]], items[at]], axis=1)

    def verified(self, shingles: np.ndarray, begins: np.ndarray, pairs: np.ndarray):
        """Exact share of the item's distinct shingles that the whole document holds, for every pair."""
        share = np.zeros(len(pairs))
        at = 0
        while at < len(pairs):
            doc = pairs[at, 0]
            stop = int(np.searchsorted(pairs[:, 0], doc, side="right"))
            own = np.unique(shingles[begins[doc] : begins[doc + 1]])
            for k in range(at, stop):
                item = self.shingles[self.begins[pairs[k, 1]] : self.begins[pairs[k, 1] + 1]]
                place = np.minimum(np.searchsorted(own, item), len(own) - 1)
                share[k] = (own[place] == item).mean()
            at = stop
        return share


def _item_passes(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items, lower-cased, a bounded number of them at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.lower(F.col(text)).alias("t")).filter("i is not null and t is not null")
    ids, texts, chars = [], [], 0
    for row in rows.toLocalIterator():
        if ids and (len(ids) >= ITEMS or chars + len(row.t) > ITEM_CHARS):
            yield Items(ids, texts)
            ids, texts, chars = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        chars += len(row.t)
    if ids:
        yield Items(ids, texts)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Pairs doc_id, item_id, containment: items of which a document holds ``containment`` or more.

    Containment is the share of the item's distinct five-word shingles (lower case; words
    are runs of letters and digits) that the whole document has, counted exactly for
    every candidate of the MinHash search. An item of one to four words has one
    shingle, and is found only in documents that are just these words. Items and
    documents without words, NULL texts and NULL item ids match nothing; a repeated
    document row gives its pairs again, a repeated item row does not. Other columns
    are ignored.

    Documents are not shuffled. The items travel to every task, at most 10,000 and 20
    million characters at a time (about 0.5 GB in a worker at the limit, some MB
    for a thousand items); a larger set of items is sought in several passes.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.col(text)).alias("_text")).filter("_text is not null")
    found = []
    for block in _item_passes(items.dropDuplicates([item_id, item_text]), item_id, item_text):
        held = sent(spark, block)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = received(held)
            for whole in batches:
                for batch in by_size(whole, "_text", _BYTES):
                    shingles, begins = shingle_hashes(*word_hashes(batch.column("_text")))
                    pairs = index.candidates(shingles, begins)
                    share = index.verified(shingles, begins, pairs)
                    good = share >= containment
                    pairs, share = pairs[good], share[good]
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(pairs[:, 0])), pa.array(index.ids[pairs[:, 1]]), pa.array(share)],
                        names=["doc_id", "item_id", "containment"],
                    )

        found.append(narrow.mapInArrow(tidy(search), "doc_id long, item_id long, containment double"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, containment double")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns untouched; NULL texts stay.

    Each pass over the items flags the rows in place, so nothing is joined or shuffled.
    """
    kept = docs
    for block in _item_passes(items.dropDuplicates([item_id, item_text]), item_id, item_text):
        held = sent(docs.sparkSession, block)

        kept = kept.filter(F.arrow_udf(_cleaner(held, containment), "boolean")(F.lower(F.col(text))))
    return kept


def _cleaner(held, containment: float):
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = received(held)
        for texts in batches:
            flags = []
            for batch in by_size(pa.record_batch([texts], names=["_text"]), "_text", _BYTES):
                shingles, begins = shingle_hashes(*word_hashes(batch.column(0)))
                pairs = index.candidates(shingles, begins)
                dirty = np.zeros(batch.num_rows, bool)
                dirty[pairs[index.verified(shingles, begins, pairs) >= containment, 0]] = True
                flags.append(~dirty)
            yield pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))

    clean.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return tidy(clean)
