"""Two tokenizers held against each other: inverted bitmaps of linked id pairs.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; all pairs of
an A token and a B token within a group are links. For every id pair there is a posting
list over the documents, kept as compressed bitmaps: documents are numbered within chunks,
a chunk's bitmap is a sorted list of 16-bit numbers or, where that is smaller, one bit a
document. Plane 0 marks the documents that hold the pair; planes 1, 2, ... are the binary
digits of how many links beyond the first one each of them has. Chunks cover different
documents, so the OR of a pair's bitmaps is their concatenation, and its popcount, the
number of documents, the sum of theirs. A pair's count then goes back along its postings:
each chunk takes the counts of its own pairs and adds them up by document.

What is shuffled are chunks of bitmaps, once, and 24 bytes for every pair of a chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.operators.common import join_many_to_one

from .common import by_size, stored, tidy, worker_model

#: A chunk's documents and links (different pairs of a document) at most; one document is never split.
CHUNK_DOCS, CHUNK_LINKS = 65_536, 1_500_000
#: Known pieces a worker keeps at most between two batches, and bytes of text taken at a time.
_REMEMBER, _BYTES = 250_000, 1 << 20
#: Pieces encoded as one text.
_IN_A_ROW = 1000
#: Links of a group above this are counted by its different ids.
_SMALL = 4096
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_POSTINGS = (
    "chunk long, n int, doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, "
    "pair long, plane int, dense boolean, docs binary, n_docs long"
)
_RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"


# ---- tokens of one text -----------------------------------------------------------


def _byte_values() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairAligner:
    """Groups and links of texts under tokenizer A (a byte-level BPE) and B (SentencePiece with byte fallback).

    Both begin a new token at a space after a character that is no white space: A's
    pre-tokenizer does so, and B has no piece with a space after another character. So
    texts are cut there and every different piece is aligned once. Where a tokenizer is
    not of that kind, texts are aligned whole.
    """

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = _byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces
        ]
        before = json.loads(self.a.to_str())
        split = before.get("pre_tokenizer") or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and before.get("normalizer") is None
        self.cuts = bool(byte_level and not any("▁" in p.lstrip("▁") for p in pieces))
        self.border = re.compile(r"(?<=\S)(?= )")
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.array(names, "S").view(np.uint8).reshape(len(names), -1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[bytes] = []
        self.counts = np.zeros((0, 6), np.int64)  # n_a, n_b, groups, links, usable, no cut after it
        self.pairs, self.times, self.links = (np.zeros(n, np.int64) for n in (0, 0, 1))

    def _one_by_one(self, side: str, parts: list[str]) -> list[list[int]]:
        """Ids of pieces given without their first space, which B itself adds, but not to nothing."""
        if side == "a":
            return [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        found = self.b.encode(parts, num_threads=1)
        lone = self.b.encode("a ")[len(self.b.encode("a")) :]
        return [ids if part else lone for part, ids in zip(parts, found, strict=True)]

    def _tokens(self, side: str, parts: list[str], bodies: list[bytes], in_a_row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, the number of each, and which pieces their tokens give back byte by byte.

        The first ``in_a_row`` pieces may be cut from one another wherever they stand, so
        they are encoded as texts of many pieces.
        """
        table, length = (self.bytes_a, self.length_a) if side == "a" else (self.bytes_b, self.length_b)
        flat, counts, usable = [], [], []
        steps = [*range(0, in_a_row, _IN_A_ROW), in_a_row, len(parts)]
        for low, high in zip(steps[:-1], steps[1:], strict=True):
            some, own = parts[low:high], bodies[low:high]
            if not some:
                continue
            if low < in_a_row:
                text = " ".join(some)
                ids = self.a.encode(" " + text, add_special_tokens=False).ids if side == "a" else self.b.encode(text, num_threads=1)
                if b"".join(map(table.__getitem__, ids)) == b"".join(own):
                    ids = np.array(ids, np.int64)
                    ends = np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(b) for b in own]), side="right")
                    flat.append(ids)
                    counts.append(np.diff(ends, prepend=0))
                    usable.append(np.ones(len(own), bool))
                    continue
            found = self._one_by_one(side, some)
            flat.append(np.fromiter(chain.from_iterable(found), np.int64))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            usable.append(np.array([b"".join(map(table.__getitem__, ids)) == body for ids, body in zip(found, own, strict=True)], bool))
        return np.concatenate(flat), np.concatenate(counts), np.concatenate(usable)

    def learn(self, parts: list[str]) -> None:
        """Align pieces, given without their first space, all at once."""
        if not parts:
            return
        plain = [p for p in parts if p and not p[-1].isspace()] if self.cuts else []
        parts = plain + ([p for p in parts if not p or p[-1].isspace()] if self.cuts else parts)
        bodies = [(" " + p).encode() for p in parts]
        sizes = np.fromiter(map(len, bodies), np.int64, len(parts))
        a, n_a, good_a = self._tokens("a", parts, bodies, len(plain))
        b, n_b, good_b = self._tokens("b", parts, bodies, len(plain))
        usable = good_a & good_b
        a, of_a, end_a = _placed(a, n_a, self.length_a, sizes, usable)
        b, of_b, end_b = _placed(b, n_b, self.length_b, sizes, usable)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        group_a, group_b = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
        first_a, first_b = np.cumsum(group_a) - group_a, np.cumsum(group_b) - group_b
        of_group = of_a[first_a]
        n_groups = np.bincount(of_group, minlength=len(parts))
        n_links = np.zeros(len(parts), np.int64)
        np.add.at(n_links, of_group, group_a * group_b)
        # every A token with all B tokens of its group
        small = group_a * group_b <= _SMALL
        mine = np.flatnonzero(small[in_a])
        each = group_b[in_a[mine]]
        left = np.repeat(mine, each)
        right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first_b[in_a[left]]
        pairs, times, of_pair = [a[left] << 32 | b[right]], [np.ones(len(left), np.int64)], [of_a[left]]
        for g in np.flatnonzero(~small):
            (x, n), (y, m) = (
                np.unique(ids[at : at + k], return_counts=True) for ids, at, k in ((a, first_a[g], group_a[g]), (b, first_b[g], group_b[g]))
            )
            pairs.append(((x << 32)[:, None] | y[None, :]).ravel())
            times.append(np.outer(n, m).ravel())
            of_pair.append(np.full(len(pairs[-1]), of_group[g]))
        order = np.argsort(np.concatenate(of_pair), kind="stable")
        ends = self.links[-1] + np.cumsum(np.bincount(np.concatenate(of_pair), minlength=len(parts)))
        self.text += self._written(a, b, in_a, in_b, first_a, first_b, group_a, of_group, len(parts))
        no_cut = np.arange(len(parts)) >= len(plain)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links, usable, no_cut], axis=1).astype(np.int64)])
        self.pairs = np.concatenate([self.pairs, np.concatenate(pairs)[order]])
        self.times = np.concatenate([self.times, np.concatenate(times)[order]])
        self.links = np.concatenate([self.links, ends])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))

    def _written(self, a, b, in_a, in_b, first_a, first_b, group_a, of_group, n: int) -> list[bytes]:
        """Groups of every piece as ``a1,a2|b1;a3|b2,b3``: decimal digits in a matrix, a separator after each."""
        ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + first_b[in_a]] = a
        ids[np.arange(len(b)) + first_a[in_b] + group_a[in_b]] = b
        begins = first_a + first_b
        marks[begins + group_a - 1] = ord("|")
        marks[np.append(begins[1:], len(ids))[: len(begins)] - 1] = ord(";")
        digits = np.concatenate([self.digits[ids], marks[:, None]], axis=1)
        shown = digits != 0
        ends = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
        blob = digits[shown].tobytes()
        # where each piece's groups begin and end; unusable pieces have none
        low = np.searchsorted(of_group, np.arange(n + 1))
        at = ends[np.append(begins, len(ids))[low]].tolist()
        return [blob[x : y - 1] if y > x else b"" for x, y in zip(at[:-1], at[1:], strict=True)]

    def _numbers(self, parts: list[str]) -> np.ndarray:
        known = self.known
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def _learn_new(self, texts: list[list[str]]) -> None:
        self.learn(list(set().union(*texts).difference(self.known)))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts (text x 4) and group digests, then links: text, pair (A id << 32 | B id), how often."""
        if len(self.known) > _REMEMBER:
            self.forget()
        split = [(t.split(" ") if self.cuts else [t]) if t else [] for t in texts]
        self._learn_new(split)
        counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        docs, pieces, numbers = [], [], [self._numbers(parts) for parts in split]
        # white space before a space: no cut there
        odd = [i for i, of in enumerate(numbers) if self.cuts and self.counts[of[:-1], 5].any()]
        again = [[p[1:] for p in self.border.split(" " + texts[i])] for i in odd]
        self._learn_new(again)
        for i, parts in zip(odd, again, strict=True):
            numbers[i] = self._numbers(parts)
        table = self.counts
        for i, of in enumerate(numbers):
            if not len(of):
                continue
            if not table[of, 4].all():
                continue
            counts[i] = table[of, :4].sum(axis=0)
            digests[i] = hashlib.sha256(b";".join(map(self.text.__getitem__, of.tolist()))).hexdigest()
            own, n = np.unique(of, return_counts=True)
            docs.append(np.full(len(own), i))
            pieces.append((own, n))
        if not docs:
            return counts, digests, *(np.zeros(0, np.int64) for _ in range(3))
        doc = np.concatenate(docs)
        piece, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
        begin, size = self.links[piece], self.links[piece + 1] - self.links[piece]
        source = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        doc, pair, n = np.repeat(doc, size), self.pairs[source], self.times[source] * np.repeat(n, size)
        order = np.lexsort((pair, doc))
        doc, pair, n = doc[order], pair[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]))
        return counts, digests, doc[first], pair[first], np.add.reduceat(n, first)


def _placed(ids: np.ndarray, counts: np.ndarray, length: np.ndarray, sizes: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the usable pieces in a row, the piece of each, and where it ends if all pieces stand in a row."""
    of = np.repeat(np.arange(len(counts)), counts)
    total = np.concatenate([[0], np.cumsum(length[ids])])
    ends = total[1:] + (np.cumsum(sizes) - sizes - total[np.cumsum(counts) - counts])[of]
    keep = usable[of]
    return ids[keep], of[keep], ends[keep]


def _shared_aligner(path_a: str, path_b: str) -> PairAligner:
    """One aligner per worker process, for the last pair of tokenizers."""
    return worker_model("aligner", (path_a, path_b), lambda: PairAligner(path_a, path_b))


# ---- bitmaps ----------------------------------------------------------------------


def _binaries(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of neighbouring slices of bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(parts.tobytes())])


def planes(doc: np.ndarray, pair: np.ndarray, times: np.ndarray, n_docs: int) -> Iterator[tuple]:
    """Bitmaps (pair, plane, dense, docs, popcount), as arrays, of the links of a chunk in the order of document."""
    order = np.argsort(pair, kind="stable")
    doc, pair, rest = doc[order], pair[order], times[order] - 1
    wide = -(-n_docs // 8)
    for plane in range(1 + int(rest.max(initial=0)).bit_length() if len(rest) else 0):
        keep = (rest >> (plane - 1) & 1).astype(bool) if plane else np.ones(len(doc), bool)
        if not keep.any():
            continue
        d, p = doc[keep], pair[keep]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        count = np.diff(np.append(first, len(p)))
        dense = 2 * count > wide
        thin = np.repeat(~dense, count)
        yield p[first][~dense], plane, False, _binaries(d[thin].astype("<u2").view(np.uint8), 2 * count[~dense]), count[~dense]
        at, step = np.flatnonzero(dense), max(1, (1 << 22) // n_docs)
        for low in range(0, len(at), step):
            some = at[low : low + step]
            marks = np.zeros((len(some), 8 * wide), bool)
            for i, k in enumerate(some):
                marks[i, d[first[k] : first[k] + count[k]]] = True
            bits = np.packbits(marks, axis=1, bitorder="little")
            yield p[first[some]], plane, True, _binaries(bits.ravel(), np.full(len(some), wide)), np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def postings(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of documents, written once: a row for each document (``n`` is its number) and one for each bitmap (``pair``)."""
    narrow = docs.select(F.spark_partition_id().alias("_task"), F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    names = [c.split()[0] for c in _POSTINGS.split(", ")]
    schema = pa.schema(
        [("chunk", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()),
         ("pair", pa.int64()), ("plane", pa.int32()), ("dense", pa.bool_()), ("docs", pa.binary()), ("n_docs", pa.int64())]
    )

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([columns.get(c, pa.nulls(rows, schema.field(c).type)) for c in names], schema=schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, serial, n_docs, n_links, held = _shared_aligner(path_a, path_b), 0, 0, 0, []

        def close(chunk: int) -> Iterator[pa.RecordBatch]:
            nonlocal serial, n_docs, n_links, held
            doc, pair, times = (np.concatenate(x) for x in zip(*held, strict=True))
            for own, plane, dense, bits, count in planes(doc, pair, times, n_docs):
                n = len(own)
                yield batch_of(
                    n, chunk=pa.array(np.full(n, chunk)), pair=pa.array(own), plane=pa.array(np.full(n, plane, np.int32)),
                    dense=pa.array(np.full(n, dense)), docs=bits, n_docs=pa.array(count.astype(np.int64)),
                )
            serial, n_docs, n_links, held = serial + 1, 0, 0, []

        chunk = 0
        for whole in batches:
            for batch in by_size(whole, "_text", _BYTES):
                for low in range(0, batch.num_rows, 1024):
                    part = batch.slice(low, 1024)
                    if held and (n_docs + part.num_rows > CHUNK_DOCS or n_links > CHUNK_LINKS):
                        yield from close(chunk)
                    chunk = part.column(0)[0].as_py() << 32 | serial
                    counts, digests, doc, pair, times = aligner.align(part.column(2).to_pylist())
                    n = part.num_rows
                    yield batch_of(
                        n, chunk=pa.array(np.full(n, chunk)), n=pa.array(np.arange(n_docs, n_docs + n, dtype=np.int32)), doc_id=part.column(1),
                        groups_sha256=pa.array(digests), **{c: pa.array(np.ascontiguousarray(counts[:, i])) for i, c in enumerate(_COUNTS)},
                    )
                    held.append(((doc + n_docs).astype(np.uint16), pair, times.astype(np.int64)))
                    n_docs, n_links = n_docs + n, n_links + len(doc)
        if held:
            yield from close(chunk)

    return stored(narrow.mapInArrow(tidy(encode, "aligner"), _POSTINGS), "postings")


def pair_counts(posted: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, is_best): every linked id pair, its documents and links, whether no pair of its A id has more documents."""
    weight = F.when(F.col("plane") == 0, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("plane") - 1))
    sums = posted.filter("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n_docs"))).alias("n_docs"), F.sum(F.col("n_docs") * weight).alias("n_links")
    )
    ids = sums.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n_docs", "n_links")
    # an A id has at most as many partners as B has ids
    return ids.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with the counts of their pairs added up along the bitmaps."""
    is_doc = left.column("n").is_valid()
    documents = left.filter(is_doc).sort_by("n")
    bitmaps = left.filter(left.column("pair").is_valid()).combine_chunks()
    n = documents.num_rows
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    right = right.sort_by("_pair")
    keys = right.column("_pair").to_numpy()
    counts, is_best = right.column("_docs").to_numpy(), right.column("_best").to_numpy().astype(np.int64)
    for dense in (False, True):
        some = bitmaps.filter(pa.compute.equal(bitmaps.column("dense"), dense)).combine_chunks()
        if not some.num_rows:
            continue
        plane = some.column("plane").to_numpy().astype(np.int64)
        weight = np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0))
        at = np.searchsorted(keys, some.column("pair").to_numpy())
        shown, sums = weight * is_best[at], weight * counts[at]
        for bits in some.column("docs").chunks:
            ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
            data = np.frombuffer(bits.buffers()[2], np.uint8)
            if not dense:
                marks = data[ends[0] : ends[-1]].view("<u2")
                each = np.diff(ends) // 2
                np.add.at(best, marks, np.repeat(shown[: len(bits)], each))
                np.add.at(total, marks, np.repeat(sums[: len(bits)], each))
            else:
                for i in range(len(bits)):
                    found = np.flatnonzero(np.unpackbits(data[ends[i] : ends[i + 1]], count=n, bitorder="little"))
                    best[found] += shown[i]
                    total[found] += sums[i]
            shown, sums = shown[len(bits) :], sums[len(bits) :]
    columns = {c: documents.column(c) for c in ("doc_id", *_COUNTS, "groups_sha256")} | {"n_best": pa.array(best), "count_sum": pa.array(total)}
    return pa.table({c: columns[c] for c in ("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256")})


def document_scores(posted: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents of :func:`postings` with n_best and count_sum from the counts of their pairs."""
    pairs = posted.filter("plane = 0").select(F.col("chunk").alias("_chunk"), F.col("pair").alias("_pair"))
    found = counts.select(F.col("pair").alias("_pair"), F.col("n_docs").alias("_docs"), F.col("is_best").alias("_best"))
    scores = join_many_to_one(pairs, found, ["_pair"]).select("_chunk", "_pair", "_docs", "_best")
    return posted.groupBy("chunk").cogroup(scores.groupBy("_chunk")).applyInArrow(_scored, _RESULT)


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How the tokens of two tokenizers align in every document, one row each.

    doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that share a group),
    n_best (links whose pair is held by as many documents as any pair of its A id),
    count_sum (documents that hold the pair, over all links) and groups_sha256 of the
    groups written as ``a1,a2|b1;a3|b2,b3``.

    A text is read as a space and the text; special tokens' strings in it are plain text.
    A NULL or empty text, and one that either tokenizer does not give back byte by byte,
    has no tokens: zeros and an empty ``groups_sha256``. Repeated rows are documents of
    their own. An empty table gives an empty one; other columns are ignored. One document
    and its different pairs must fit a task.
    """
    posted = postings(docs, path_a, path_b, doc_id, text)
    return document_scores(posted, stored(pair_counts(posted), "pairs"))
