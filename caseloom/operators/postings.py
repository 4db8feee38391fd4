"""Trigram postings of chunks, so that a keyword search reads no text that cannot match.

Two Parquet tables below one folder:

* ``entries``: (shelf, place, record_id, chunk_index, text). Chunks are dealt to shelves, which are
  partition folders, by a hash of their key, and numbered there; texts are looked up by partition pruning.
* ``postings``: (gram, shelf, words, bits), each file sorted by gram. Bit i of ``bits[j]`` says that the
  chunk at place 64 * words[j] + i holds the gram. A row tells of the neighbouring texts of one batch, so a
  frequent gram is many rows in all files, never one long list; a word cut by a batch is two that are joined
  when read. Lists are joined by bitwise aggregates, and a rare gram is read by the pages that hold it.

Texts are folded like :func:`~caseloom.functions.text.contains_pattern` does and closed by two
NUL characters, so every character begins a gram and one or two characters are a prefix of
grams. Whatever the postings let through is tested with the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import contains_pattern
from ..session import settled
from .common import join_many_to_one

#: Chunks aimed at per shelf, and shelves at most (beyond, shelves grow).
SHELF_ROWS, SHELVES = 1 << 16, 1 << 16
GRAM = 3
#: Characters whose grams are listed at a time.
_PIECE = 1 << 20

#: Read with these, so that an index of no rows is one too.
ENTRIES = "record_id string, chunk_index long, text string, place int, shelf int"
POSTINGS = "gram string, shelf int, words array<int>, bits array<long>"


@dataclass(frozen=True)
class KeywordIndex:
    entries: DataFrame
    postings: DataFrame


def write_postings(chunks: DataFrame, folder: str, shelves: int | None = None) -> KeywordIndex:
    """Index of (record_id, chunk_index, text), written below a fresh ``folder``.

    ``shelves`` follows from the number of chunks where it is not given; counting is cheap for
    stored chunks, and computes others once more. The index describes the chunks of this moment;
    after an index pass it is written anew. Other columns are left out. A NULL text is kept and
    found by no query; repeated rows stay repeated.
    """
    shelves = shelves or min(SHELVES, 1 + chunks.count() // SHELF_ROWS)
    dealt = chunks.select(
        F.col("record_id").cast("string"),
        F.col("chunk_index").cast("long"),
        "text",
        F.pmod(F.xxhash64("record_id", "chunk_index"), F.lit(shelves)).cast("int").alias("shelf"),
    )
    # texts move once: numbers and folders need the same partitioning
    place = F.row_number().over(Window.partitionBy("shelf").orderBy("record_id", "chunk_index")) - 1
    numbered = dealt.repartition("shelf").withColumn("place", place)
    numbered.write.partitionBy("shelf").parquet(f"{folder}/entries")

    entries = chunks.sparkSession.read.schema(ENTRIES).parquet(f"{folder}/entries")
    texts = entries.filter("text is not null").select("shelf", "place", F.col("text").cast("binary"))
    # a file holds whole neighbourhoods already: nothing is shuffled
    lists = texts.mapInArrow(_listed, POSTINGS)
    lists.sortWithinPartitions("gram", "shelf").write.parquet(f"{folder}/postings")
    return read_postings(chunks.sparkSession, folder)


def read_postings(spark: SparkSession, folder: str) -> KeywordIndex:
    """The index below ``folder``."""
    entries = spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
    return KeywordIndex(entries, spark.read.schema(POSTINGS).parquet(f"{folder}/postings"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the grams of (shelf, place, text), piece by piece."""
    for batch in batches:
        shelf, place = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        words, word = np.unique(shelf << 32 | place >> 6, return_inverse=True)
        # bytes fold A-Z only
        texts = [t.lower().decode("utf-8", "replace") + "\0" * (GRAM - 1) for t in batch.column(2).to_pylist()]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        for at in range(0, len(chars), _PIECE):
            yield from _lists(chars, at, min(at + _PIECE, len(chars)), ends, words, word << 6 | place & 63)


def _lists(
    chars: np.ndarray, at: int, end: int, ends: np.ndarray, words: np.ndarray, spots: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """One row per shelf and gram that begins in [at, end); no gram begins with what closes a text.

    The text that stops at ``ends[i]`` is bit ``spots[i] % 64`` of word ``spots[i] // 64`` of ``words``.
    """
    low = np.searchsorted(ends, at, "right")
    high = np.searchsorted(ends, end, "left") + 1
    stops = ends[low:high]
    held = np.diff(np.minimum(stops, end), prepend=at)
    begin = np.ones(end - at, bool)
    for i in range(1, GRAM):
        closing = stops - i
        begin[closing[(closing >= at) & (closing < end)] - at] = False
    spot = np.repeat(spots[low:high], held)[begin]
    if not len(spot):
        return
    # characters by their rank, so that a gram and its text fit one number
    piece = chars[at : end + GRAM - 1]
    rank = np.zeros(0x110000, np.int64)
    rank[piece] = 1
    alphabet = np.flatnonzero(rank)
    rank[alphabet] = np.arange(len(alphabet))
    shift = max(6, int(spot.max()).bit_length())
    if len(alphabet) ** GRAM << shift >= 1 << 63:
        middle = (at + end) // 2
        yield from _lists(chars, at, middle, ends, words, spots)
        yield from _lists(chars, middle, end, ends, words, spots)
        return
    # what lies beyond the last character begins no gram
    ranks = np.append(rank[piece], np.zeros(end - at + GRAM - 1 - len(piece), np.int64))
    code = ranks[: end - at].copy()
    for i in range(1, GRAM):
        code *= len(alphabet)
        code += ranks[i : i + end - at]
    hits = code[begin]
    hits <<= shift
    hits |= spot
    hits.sort()
    pair = hits >> 6
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), hits & 63), first)
    gram, word = hits[first] >> shift, words[(hits[first] & (1 << shift) - 1) >> 6]
    shelf = word >> 32
    start = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (shelf[1:] != shelf[:-1])))
    parts = [alphabet[gram[start] // len(alphabet) ** i % len(alphabet)] for i in reversed(range(GRAM))]
    text = np.stack(parts, 1).astype("<u4").tobytes().decode("utf-32-le")
    offsets = pa.array(np.append(start, len(bits)), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string()),
            pa.array(shelf[start], pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(word & 0xFFFFFFFF, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(bits, pa.int64())),
        ],
        ["gram", "shelf", "words", "bits"],
    )


def needles(query: str) -> list[str]:
    """What a text must hold to match: grams, or, where no run of literals has three characters, its runs."""
    folded = re.sub("[A-Z]+", lambda m: m[0].lower(), query)
    runs = {run for run in re.split("[%_]+", folded) if run}
    grams = {run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)}
    return sorted(grams or runs)


def candidates(index: KeywordIndex, query: str) -> DataFrame:
    """(shelf, word, bits): the places that hold all needles of ``query``, which needs at least one."""
    wanted, gram = needles(query), F.col("gram")
    if len(wanted[0]) == GRAM:
        listed = index.postings.filter(gram.isin(wanted))
    else:
        # a prefix may stand for many grams, and a gram begin with several prefixes
        matched = F.array(*[F.when(gram.startswith(n), F.lit(n)) for n in wanted])
        condition = gram.startswith(wanted[0])
        for needle in wanted[1:]:
            condition = condition | gram.startswith(needle)
        listed = index.postings.filter(condition).select(
            "shelf", F.explode(F.array_compact(matched)).alias("gram"), "words", "bits"
        )
    hits = (
        listed.select("shelf", "gram", F.inline(F.arrays_zip("words", "bits")).alias("word", "bits"))
        .groupBy("shelf", "word", "gram")
        .agg(F.bit_or("bits").alias("bits"))
    )
    return (
        hits.groupBy("shelf", "word")
        .agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("lists"))
        .filter((F.col("lists") == len(wanted)) & (F.col("bits") != 0))
        .select("shelf", "word", "bits")
    )


def on_shelves(index: KeywordIndex, rows: DataFrame) -> DataFrame:
    """Entries of the shelves that ``rows`` (shelf) name; the folder numbers, ``SHELVES`` at most, pass the driver."""
    named = [r["shelf"] for r in rows.select("shelf").distinct().collect()]
    return index.entries.filter(F.col("shelf").isin(named))


def keyword_matches(index: KeywordIndex, query: str) -> DataFrame:
    """Entries whose text contains ``query``, with ``%`` and ``_`` live, ASCII case folded; no cap.

    A query of wildcards only names no literal to look up: its texts are all tested.
    """
    if not needles(query):
        return index.entries.filter(contains_pattern("text", query))
    found = settled(candidates(index, query), "candidates")
    # bitmaps are small beside the texts, which stay where they are as long as Spark can broadcast them
    texts = on_shelves(index, found).withColumn("word", F.expr("place div 64").cast("int"))
    held = join_many_to_one(texts, found, ["shelf", "word"], "inner").filter(
        F.call_function("shiftright", F.col("bits"), F.col("place") % 64).bitwiseAND(F.lit(1)) == 1
    )
    return held.select(*index.entries.columns).filter(contains_pattern("text", query))
