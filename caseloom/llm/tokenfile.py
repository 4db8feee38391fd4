"""Token ids as directly addressable codes: write, read back, and look up single tokens.

Format of a file (all numbers little-endian; one file holds consecutive documents):

    magic "DAC1", then uint32 header length, then a JSON header
    levels: for each level k, its chunks (8 bits each), its continuation bitmap
            (bit i of byte i // 8: entry i has a chunk on level k + 1), and its rank
            directory (uint32 per 512 entries: set bits before them)
    documents: uint64 per document plus one: where its tokens begin in the file

An id is split into 8-bit chunks, lowest first; its chunk on level k + 1 stands at
position rank(bitmap k, i). So token i is found with one rank per level, without
decoding anything around it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.session import scratch_path

from .common import by_size, byte_view, range_bounds, range_number, running_starts, stored, tidy, worker_model
from .words import piece_hashes

MAGIC = b"DAC1"
BITS = 8
#: Entries per number of the rank directory.
SPAN = 512
#: Id that ends every document, documents in a range on average, and tokens from which on a file is closed.
END, SHARD, FILE_TOKENS = 2, 2048, 2_000_000
_BYTES = 2 << 20
#: Distinct pieces whose ids a worker remembers, about 40 bytes each; beyond it it starts anew.
_REMEMBER = 400_000


# ---- the code ---------------------------------------------------------------------


def encode_ids(ids: np.ndarray, begins: np.ndarray) -> bytes:
    """One file: the ids, and where each document begins (one entry more than documents)."""
    parts, counts = [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        more = rest >> np.uint32(BITS)
        flag = more > 0
        counts.append(len(rest))
        marks = np.packbits(flag, bitorder="little")
        spans = np.add.reduceat(flag.astype(np.uint32), np.arange(0, len(flag), SPAN)) if len(flag) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(spans)]).astype("<u4")
        parts += [(rest & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes(), marks.tobytes(), ranks.tobytes()]
        rest = more[flag]
        if not len(rest):
            break
    head = json.dumps({"levels": counts, "documents": len(begins) - 1, "span": SPAN, "bits": BITS}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts, np.asarray(begins).astype("<u8").tobytes()])


@dataclass
class TokenFile:
    """A file in memory; ``token`` addresses single ids, ``all_ids`` decodes everything at once."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    begins: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> TokenFile:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[4:8], "little")
        head = json.loads(data[8 : 8 + size])
        at, levels = 8 + size, []
        for n in head["levels"]:
            fields = []
            for kind, count in ((np.uint8, n), (np.uint8, -(-n // 8)), ("<u4", -(-n // head["span"]) + 1)):
                fields.append(np.frombuffer(data, kind, count, at))
                at += fields[-1].nbytes
            levels.append(tuple(fields))
        return cls(levels, np.frombuffer(data, "<u8", head["documents"] + 1, at).astype(np.int64))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k, (chunks, marks, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * k)
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            from_byte = (i // SPAN) * (SPAN // 8)
            inside = marks[from_byte : (i >> 3) + 1].copy()
            inside[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[i // SPAN]) + int(np.bitwise_count(inside).sum())
        return value

    def all_ids(self) -> np.ndarray:
        values = None
        for chunks, marks, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            if values is not None:
                ids[np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)] |= values << np.uint32(BITS)
            values = ids
        return values


# ---- tokenizing -------------------------------------------------------------------


class PieceTokenizer:
    """Ids of whole texts from a byte-level BPE of the tokenizers library.

    Its pre-tokenizer never joins over the start of a run of white space, nor over a
    letter and a punctuation mark after it, so a text is cut there and every different
    piece is encoded once: the ids of the pieces in a row are those of the text. Pieces
    are told apart by 64-bit hashes. Texts that hold a special token's string are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces; those that start with a space and end in none are encoded as one text."""
        simple = np.array([p[0] == " " and p[-1] > " " and not p[-1].isspace() for p in pieces])
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        plain, odd = [pieces[i] for i in np.flatnonzero(simple)], [pieces[i] for i in np.flatnonzero(~simple)]
        ids, counts = [], []
        for at in range(0, len(plain), 10_000):
            some = plain[at : at + 10_000]
            found = self.tokenizer.encode("".join(some), add_special_tokens=False)
            ends = np.cumsum([len(p) for p in some])
            begin = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.offsets))
            ids.append(np.asarray(found.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(ends, begin, side="right"), minlength=len(some)))
        for at in range(0, len(odd), 256):
            for found in self.tokenizer.encode_batch(odd[at : at + 256], add_special_tokens=False):
                ids.append(np.asarray(found.ids, np.uint32))
                counts.append(np.array([len(found.ids)]))
        new = len(self.ends) - 1 + np.arange(len(pieces))
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        known, place = np.concatenate([self.known, hashes[order]]), np.concatenate([self.place, new])
        sort = np.argsort(known, kind="stable")
        self.known, self.place = known[sort], place[sort]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end`` after each, and the number of ids of each."""
        data, offsets = byte_view(texts)
        n = len(offsets) - 1
        bounds = _piece_bounds(data, offsets)
        owner = np.searchsorted(offsets, bounds[:-1], side="right") - 1
        hashes, first, which = np.unique(piece_hashes(data, bounds), return_index=True, return_inverse=True)
        if len(self.known) > _REMEMBER:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.any():
            body = data.tobytes()
            spans = zip(bounds[first[new]].tolist(), bounds[first[new] + 1].tolist(), strict=True)
            self._learn(hashes[new], [body[a:b].decode() for a, b in spans])
            at = np.searchsorted(self.known, hashes)
        place = self.place[at][which] if len(hashes) else np.zeros(0, np.int64)
        begin = self.ends[place]
        size = self.ends[place + 1] - begin
        each = np.bincount(owner, size, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
        source = np.arange(size.sum())
        source -= np.repeat(np.cumsum(size) - size - begin, size)
        ids = self.ids[source]
        for i in self._with_special(texts):
            whole = np.asarray(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            low = int(each[:i].sum())
            ids = np.concatenate([ids[:low], whole, ids[low + int(each[i]) :]])
            each[i] = len(whole)
        if end is not None:
            ids = np.insert(ids, np.cumsum(each), end)
            each = each + 1
        return ids, each

    def _with_special(self, texts: pa.Array) -> list[int]:
        found: set[int] = set()
        for token in self.special:
            hit = pc.fill_null(pc.match_substring(texts, token), False)
            found.update(np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist())
        return sorted(found)


def _shared_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per worker process, so that pieces seen in earlier tasks are known."""
    return worker_model("tokenizer", path, lambda: PieceTokenizer(path))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def _piece_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin, and the end of the data; empty texts have none."""
    space = np.flatnonzero(data == 32)
    before = data[np.maximum(space - 1, 0)]
    two, three = data[np.maximum(space - 2, 0)], data[np.maximum(space - 3, 0)]
    # after other white space there is no cut; C2, E1, E2 and E3 begin that beyond ASCII
    maybe = (before >= 128) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    cut = np.zeros(len(data) + 1, bool)
    cut[space[(before > 32) & (before != 127) & ~maybe]] = True
    if len(data):
        cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)


# ---- files ------------------------------------------------------------------------


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then move: a repeated task writes the same bytes again."""
    system, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(base, recursive=True)
    passing = f"{base}/_{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write(data)
    system.move(passing, f"{base}/{name}")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, bounds: list | None = None
) -> DataFrame:
    """Encode all texts and write them to ``folder`` in ascending doc_id order; returns (shard, part, documents, tokens).

    Rows are dealt by ranges of doc_id (NULL first, repeated ids together, then by text;
    a NULL text is empty), files ``shard-<range>-<part>.dac`` for every range (cut at
    ``bounds``, ascending doc_ids; by default about 2,048 documents each), a new part
    after about 2 million tokens, which bounds what a worker holds; an
    empty table writes none. Each worker sorts its range, so only texts move, once.
    Other columns are ignored.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bounds = range_bounds(narrow, "_id", SHARD) if bounds is None else bounds
    ranged = narrow.withColumn("_shard", range_number(bounds, F.col("_id")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, part, ids, counts = _shared_tokenizer(tokenizer), None, 0, [], []

        def close() -> pa.RecordBatch:
            begins = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            _put(folder, f"shard-{shard:09d}-{part:09d}.dac", encode_ids(np.concatenate(ids), begins))
            return pa.record_batch([[shard], [part], [len(begins) - 1], [int(begins[-1])]], names=["shard", "part", "documents", "tokens"])

        for whole in batches:
            for batch in by_size(whole, "_text", _BYTES):
                numbers = batch.column("_shard").to_numpy()
                edges = np.flatnonzero(np.diff(numbers)) + 1
                for low, high in zip([0, *edges], [*edges, len(numbers)], strict=True):
                    if shard is not None and (numbers[low] != shard or sum(map(len, ids)) >= FILE_TOKENS):
                        yield close()
                        part = part + 1 if numbers[low] == shard else 0
                        ids, counts = [], []
                    shard = int(numbers[low])
                    found, each = pieces.encode(batch.column("_text").slice(low, high - low), end)
                    ids.append(found.astype(np.uint16) if len(found) and found.max() < 65536 else found)
                    counts.append(each)
        if shard is not None:
            yield close()

    dealt = ranged.repartition("_shard").sortWithinPartitions("_shard", F.col("_id").asc_nulls_first(), "_text")
    return dealt.select("_shard", "_text").mapInArrow(tidy(encode, "tokenizer"), "shard long, part long, documents long, tokens long")


def read_tokens(spark, folder: str) -> DataFrame:
    """(shard, part, n, begin, n_tokens, ids_crc32) of every document in the files, n counting within the file."""
    files = spark.read.format("binaryFile").load(folder).filter(F.col("path").endswith(".dac")).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                file = TokenFile.parse(memoryview(content.as_buffer()).tobytes())
                ids = file.all_ids().astype("<u4")
                begins = file.begins
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
                shard, part = map(int, path.as_py().rpartition("shard-")[2].split(".")[0].split("-"))
                n = len(sums)
                yield pa.record_batch(
                    [pa.array([shard] * n), pa.array([part] * n), pa.array(range(n)), pa.array(begins[:-1]), pa.array(np.diff(begins)), pa.array(sums, pa.int64())],
                    names=["shard", "part", "n", "begin", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(tidy(decode, "tokenizer"), "shard long, part long, n long, begin long, n_tokens long, ids_crc32 long")


def token_table(
    docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32, shard for every row.

    ``folder`` defaults to a fresh one below the shared folder. Ids are matched to
    documents by their order within each range of doc_id.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "llm-tokens")
    ids = docs.select(F.col(doc_id).cast("long").alias("_id"))
    bounds = range_bounds(ids, "_id", SHARD)
    shards = stored(write_tokens(docs, folder, tokenizer, doc_id, text, bounds=bounds), "shards")
    schema = "shard long, part long, n long, begin long, n_tokens long, ids_crc32 long"
    found = read_tokens(spark, folder) if not shards.isEmpty() else spark.createDataFrame([], schema)
    # tokens before each range, and tokens and documents before each part of a range
    sums = shards.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    starts = running_starts(sums, "shard", "tokens", "_before").select("shard", "_before")
    parts = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(parts), F.lit(0))
    offsets = shards.select("shard", "part", earlier("tokens").alias("_inside"), earlier("documents").alias("_rows"))
    found = found.join(offsets, ["shard", "part"]).withColumn("n", F.col("n") + F.col("_rows"))
    order = Window.partitionBy("shard").orderBy(F.col("_id").asc_nulls_first())
    names = ids.withColumn("shard", range_number(bounds, F.col("_id")).cast("long"))
    names = names.withColumn("n", F.row_number().over(order).cast("long") - 1)
    joined = found.join(starts, "shard").join(names, ["shard", "n"])
    return joined.select(
        F.col("_id").alias("doc_id"), (F.col("_before") + F.col("_inside") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "shard"
    )
