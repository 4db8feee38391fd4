"""Quality of texts without labels: heuristic labelers vote, their posterior trains a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_size, byte_view, received, sent, unit_hash
from .weak import any_objection, estimate
from .words import MARKS, shingle_hashes, word_hashes

LABELERS = ("symbols", "capitals", "distinct words", "repeated runs", "length", "sentences", "word length", "letters")
#: Documents that the scorer is trained on, at most, and hashed features (a power of two).
SAMPLE, FEATURES = 4_000, 1 << 16
#: A labeler objects to at most this share of good documents.
FALSE_OBJECTIONS = 0.002
#: Score from which on a document counts as good.
THRESHOLD = 0.5
_BYTES = 2 << 20


def _share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return counts / np.maximum(of, 1)


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Different hashes of every text."""
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(rows) <= 65536 else np.int64), kind="stable")]
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(doc[first], minlength=len(rows) - 1)


def measures(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Eight numbers for every whole text (columns as LABELERS, each a share or a count), and its words and marks."""
    data, ends = byte_view(texts)

    def count(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[ends])

    chars = count((data & 0xC0) != 0x80)
    small = (data >= 97) & (data <= 122)
    big = (data >= 65) & (data <= 90)
    spaces = (data == 32) | ((data >= 9) & (data <= 13))
    plain = np.isin(data, np.frombuffer(b".,;:?!'\"()-", np.uint8))
    digits = (data >= 48) & (data <= 57)
    odd = (data < 128) & ~(small | big | spaces | plain | digits)
    stops = np.isin(data, np.frombuffer(b".?!", np.uint8))
    letters = count(small | big | (data >= 0xC0))
    words, marks = word_hashes(texts), word_hashes(texts, MARKS)
    n = np.diff(words[1])
    runs, begins = shingle_hashes(*words)
    table = np.stack(
        [
            _share(count(odd), chars),
            _share(count(big), letters),
            _share(_distinct(*words), np.sqrt(np.maximum(n, 1))),
            1 - _share(_distinct(runs, begins), np.diff(begins)),
            n.astype(float),
            _share(count(stops), n),
            _share(letters, n),
            _share(letters, chars),
        ],
        axis=1,
    )
    return table, words, marks


def vote(table: np.ndarray) -> np.ndarray:
    """Votes of the eight labelers: 1 good, -1 bad, 0 none."""
    odd, big, distinct, repeated, n, stops, length, letters = table.T
    some = n >= 20

    def judge(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    return np.stack(
        [
            judge(odd <= 0.02, odd > 0.06),
            judge((big < 0.12) & (n > 0), big > 0.4),
            judge(some & (distinct >= 4), some & (distinct < 2)),
            judge(some & (repeated < 0.1), some & (repeated > 0.4)),
            judge(n >= 30, n == 0),
            judge(some & (stops >= 0.03) & (stops <= 0.3), some & (stops > 0.6)),
            judge(some & (length >= 3) & (length <= 9), some & ((length < 2) | (length > 15))),
            judge(some & (letters > 0.7), some & (letters < 0.55)),
        ],
        axis=1,
    ).astype(np.int8)


@dataclass
class Scorer:
    """Linear scorer: mean weight of a text's words and marks, and weights of its measures."""

    weights: np.ndarray
    dense: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    bias: float
    posteriors: dict[tuple[int, ...], float] = field(default_factory=dict)

    def score(self, table: np.ndarray, tokens: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """``tokens`` are words and marks: (feature numbers, borders of the texts), and how often each stands if not once."""
        odds = self.bias + ((_squeezed(table) - self.center) / self.scale) @ self.dense
        n = np.maximum(_many(*tokens[0]), 1)
        for index, rows, *times in tokens:
            weights = self.weights[index] * times[0] if times else self.weights[index]
            total = np.concatenate([[0.0], np.cumsum(weights)])[rows]
            odds = odds + np.diff(total) / n
        # sums depend on the batch in their last digits
        return np.round(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 6)


def _many(index: np.ndarray, rows: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Words of every text."""
    return np.diff(rows) if times is None else np.diff(np.concatenate([[0], np.cumsum(times)])[rows])


def _counted(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different features of a text, and how often each stands."""
    return np.unique(index, return_counts=True)


def _squeezed(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[:, 4] = np.log1p(table[:, 4])
    table[:, 6] = np.minimum(table[:, 6], 30)
    return np.clip(table, 0, 30)


def _index(words, marks, features: int) -> list[tuple[np.ndarray, np.ndarray]]:
    fold = np.uint64(features - 1)
    return [((h & fold).astype(np.int64), rows) for h, rows in (words, marks)]


def train(table: np.ndarray, tokens: list[tuple[np.ndarray, ...]], labels: np.ndarray, features: int, rounds: int = 80) -> Scorer:
    """Logistic regression on soft labels, full gradient steps with per-weight rates."""
    shaped = _squeezed(table)
    center, scale = shaped.mean(axis=0), shaped.std(axis=0) + 1e-6
    dense_in = (shaped - center) / scale
    scorer = Scorer(np.zeros(features), np.zeros(table.shape[1]), center, scale, 0.0)
    n = np.maximum(_many(*tokens[0]), 1)
    where = np.concatenate([index for index, *_ in tokens])
    owner = np.concatenate([np.repeat(np.arange(len(n)), np.diff(rows)) for _, rows, *_ in tokens])
    share = np.concatenate([times[0] if times else np.ones(len(index)) for index, _, *times in tokens]) / n[owner]
    past = [np.full(features, 1e-8), np.full(table.shape[1], 1e-8), 1e-8]
    for _ in range(rounds):
        gap = scorer.score(table, tokens) - labels
        steps = [np.bincount(where, gap[owner] * share, features), gap @ dense_in, gap.sum()]
        for k, step in enumerate(steps):
            past[k] = past[k] + np.square(step)
        scorer.weights -= 0.3 * steps[0] / np.sqrt(past[0]) + 0.001 * scorer.weights
        scorer.dense -= 0.3 * steps[1] / np.sqrt(past[1])
        scorer.bias -= 0.3 * steps[2] / np.sqrt(past[2])
    return scorer


def fit_quality(docs: DataFrame, text: str = "text", sample: int = SAMPLE, features: int = FEATURES, seed: int = 6) -> Scorer:
    """Fit a scorer without labels.

    The labelers vote on every document; expectation-maximisation over how often each of
    the at most 3**8 combinations of votes occurs estimates how reliable they are. Their
    posterior labels then train the scorer on the ``sample`` different texts of the smallest hashes,
    or on all if there are fewer; words and marks of these whole texts come to the driver as
    counts of features, so that no text sends more than ``features`` of each. NULL and empty texts vote like any text without words.
    Without documents the scorer says 0.5 to everything.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "_text", _BYTES):
                kinds, counts = np.unique(vote(measures(batch.column(0))[0]), axis=0, return_counts=True)
                yield pa.record_batch([pa.array(kinds.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(counts)], names=["votes", "n"])

    found = rows.mapInArrow(votes, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    after = estimate({tuple(r["votes"]): r["n"] for r in found}, any_objection, FALSE_OBJECTIONS)
    if not found:
        return Scorer(np.zeros(features), np.zeros(len(LABELERS)), np.zeros(len(LABELERS)), np.ones(len(LABELERS)), 0.0)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "_text", _BYTES):
                table, *tokens = measures(part.column(0))
                out: list[list] = [[], []]
                for held, (index, ends) in zip(out, _index(*tokens, features), strict=True):
                    for low, high in zip(ends[:-1], ends[1:], strict=True):
                        held.append(np.stack(_counted(index[low:high])).astype("<u4").tobytes())
                yield pa.record_batch(
                    [pa.array(table.tolist(), pa.list_(pa.float64())), pa.array(vote(table).astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())],
                    names=["table", "votes", "words", "marks"],
                )

    # the texts of the smallest hashes: copies share one, so however often a text repeats it counts once
    mark = unit_hash(seed, "_text")
    picked = rows
    if sum(r["n"] for r in found) > sample:
        # about twice as many hashes as needed are compared, however many texts there are
        texts = rows.agg(F.approx_count_distinct(mark, 0.02)).first()[0]
        few = rows.filter(mark < 2 * sample / max(1, texts)).select(mark.alias("_mark")).distinct()
        least = few.orderBy("_mark").limit(sample).agg(F.max("_mark")).first()[0]
        picked = rows.filter(mark <= least) if least is not None else rows.limit(0)
    picked = picked.dropDuplicates(["_text"])
    got = picked.mapInArrow(described, "table array<double>, votes array<int>, words binary, marks binary").collect()
    if not got:
        return Scorer(np.zeros(features), np.zeros(len(LABELERS)), np.zeros(len(LABELERS)), np.ones(len(LABELERS)), 0.0, after)
    got.sort(key=lambda r: (bytes(r["words"]), bytes(r["marks"])))  # so that sums, and with them reruns, agree
    tokens = []
    for name in ("words", "marks"):
        each = [np.frombuffer(r[name], "<u4").reshape(2, -1) for r in got]
        index, times = np.concatenate(each, axis=1).astype(np.int32)
        tokens.append((index, np.concatenate([[0], np.cumsum([e.shape[1] for e in each])]), times))
    labels = np.array([after[tuple(r["votes"])] for r in got])
    scorer = train(np.array([r["table"] for r in got]), tokens, labels, features)
    scorer.posteriors = after
    return scorer


def score_quality(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add quality_score (0 to 1), quality_pred (1 from ``threshold`` on) and quality_weak to every row.

    ``quality_weak`` is the posterior of the labelers' votes on this very text. Whole
    texts are scored where they are; nothing is shuffled. NULL and empty texts score as
    texts without words. Columns of the input that bear one of the names are replaced.
    """
    held = sent(docs.sparkSession, scorer)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = received(held)
        for texts in batches:
            score, weak = [], []
            for part in by_size(pa.record_batch([texts], names=["_text"]), "_text", _BYTES):
                table, *tokens = measures(part.column(0))
                score.append(model.score(table, _index(*tokens, len(model.weights))))
                weak += [model.posteriors.get(tuple(v), 0.5) for v in vote(table).tolist()]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(score) if score else np.zeros(0)), pa.array(weak, pa.float64())], names=["s", "w"])

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = [c for c in docs.columns if c not in ("quality_score", "quality_pred", "quality_weak")]
    found = docs.select(*kept, F.arrow_udf(work, "s double, w double")(F.col(text)).alias("_llm_quality"))
    return found.select(
        *kept,
        F.col("_llm_quality.s").alias("quality_score"),
        (F.col("_llm_quality.s") >= threshold).cast("int").alias("quality_pred"),
        F.col("_llm_quality.w").alias("quality_weak"),
    )
