"""Documents to training tokens, stage by stage: language, near copies, benchmark, mix, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet to the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.llm import decontaminate, langid, mixing, neardup, tokenfile
from caseloom.llm.common import stored, table
from caseloom.llm.queries import TOKENIZER
from caseloom.session import apply_settings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others (no letters, no margin) go. Learns from the labelled ones."""
    apply_settings(spark)
    model = langid.fit_languages(docs.filter(langid.fold_of(F.col("doc_id")) != 0))
    return langid.keep_known(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    apply_settings(spark)
    return neardup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    apply_settings(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, so some rows repeat and some are gone."""
    apply_settings(spark)
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from the token files."""
    apply_settings(spark)
    return tokenfile.token_table(docs, TOKENIZER).drop("shard")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: The stages cannot be expressed in SQL; tests hold each against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
