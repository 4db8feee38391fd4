"""Language of a text by compression: the dictionary that makes it smallest names the language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.operators.common import first_rows

from .common import byte_view, received, sent, tidy, unit_hash

UNKNOWN = "und"
#: Bounds of the sample that a model is fitted on: texts per language, and characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 512, 1024
#: Languages up to which each gets the full sample; of more, each gets a smaller one, so that the model stays bounded.
FULL_LANGUAGES = 64
_SALTS = 64
#: Bytes compressed at a time, so that a long text meets the dictionary again and again.
CHUNK = 4096
#: Share of the size by which the best language must beat the next one to be accepted.
MARGIN = 0.005
_SETTINGS = {"window_log": 20, "hash_log": 18, "chain_log": 18, "search_log": 1, "min_match": 4, "target_length": 0}


def letters_of(text: Column) -> Column:
    """Lower case, every run of other characters than letters and their marks one space; empty without a letter."""
    return F.when(text.rlike(r"\p{L}"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")).otherwise("")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, most frequent first (ties of size go to the first)."""

    dictionaries: dict[str, bytes]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False, **_SETTINGS
        )
        made = []
        for content in self.dictionaries.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings))
        return made


def fit_languages(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    texts: int = SAMPLE_TEXTS,
    chars: int = SAMPLE_CHARS,
    seed: int = 3,
) -> LanguageModel:
    """Dictionaries from a bounded sample: of each language ``texts`` texts picked at random, ``chars`` characters of each.

    Any number of label values is learned; beyond 64 the texts of each are fewer in
    proportion, one at least.

    The sample is repeatable and independent of the order of rows. Rows without text or
    language are left out; without any row the model is empty and knows no language.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).filter(
        "_lang is not null and _text is not null"
    )
    counts = rows.groupBy("_lang").count().collect()
    texts = max(1, texts * FULL_LANGUAGES // max(FULL_LANGUAGES, len(counts)))
    pieces = rows.select("_lang", F.substring(letters_of(F.substring("_text", 1, 2 * chars)), 1, chars).alias("_piece"))
    pieces = pieces.withColumn("_place", unit_hash(seed, "_piece")).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    # in two steps, so that a language with a third of all rows is no single task's work
    first = [F.col("_place"), F.col("_piece")]
    sample = first_rows(first_rows(pieces, ["_lang", "_salt"], first, texts), ["_lang"], first, texts).collect()
    order = sorted(counts, key=lambda r: (-r["count"], r["_lang"]))
    by_lang: dict[str, list] = {r["_lang"]: [] for r in order}
    for row in sorted(sample, key=lambda r: (r["_place"], r["_piece"])):
        by_lang[row["_lang"]].append(row["_piece"])
    return LanguageModel({k: " ".join(v).encode() for k, v in by_lang.items()})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add lang_pred, score and accepted to every row; nothing is shuffled.

    The whole text (letters only, lower case) is compressed in pieces of 4,096 bytes with
    the dictionary of every language; ``lang_pred`` has the smallest total, ``score`` is
    the share of its size by which the next language is larger (1 if there is no other),
    ``accepted`` whether that reaches ``margin``. A NULL text, one without a letter, and
    any text under an empty model is ``und`` with score 0 and not accepted. Columns of
    the input that bear one of the three names are replaced.
    """
    names = list(model.dictionaries)
    held = sent(docs.sparkSession, model)

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = received(held).compressors()
        for texts in batches:
            data, ends = byte_view(texts)
            body = memoryview(np.ascontiguousarray(data))
            best, share = [], []
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                pieces = [body[at : min(at + CHUNK, high)] for at in range(low, high, CHUNK)]
                sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
                if high - low <= 1 and not bytes(body[low:high]).strip() or not sizes:
                    best.append(UNKNOWN)
                    share.append(0.0)
                    continue
                first = min(range(len(sizes)), key=sizes.__getitem__)
                others = [s for i, s in enumerate(sizes) if i != first]
                best.append(names[first])
                share.append(min(1.0, (min(others) - sizes[first]) / min(others)) if others else 1.0)
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(share, pa.float64())], names=["lang", "score"])

    classify.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    named = F.arrow_udf(tidy(classify), "lang string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    found = docs.select(*kept, named(letters_of(F.col(text))).alias("_llm_found"))
    return found.select(*kept, *_results(margin))


def _results(margin: float) -> list[Column]:
    lang, score = F.col("_llm_found.lang"), F.col("_llm_found.score")
    return [lang.alias("lang_pred"), score.alias("score"), ((lang != UNKNOWN) & (score >= margin)).alias("accepted")]


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns untouched."""
    whole = docs.select(F.struct(*docs.columns).alias("_llm_row"), F.col(text).alias("_llm_text"))
    return identify(whole, model, "_llm_text", margin).filter("accepted").select("_llm_row.*")
