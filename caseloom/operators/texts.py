"""Text to chunks, vectors and entities, and the tables that hold them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.embedding import hash_vector
from ..functions.text import is_blank, let, trim_ws
from .common import derived_id, first_row, first_rows, join_many_to_one

#: Chunk size aimed at, in UTF-8 bytes.
CHUNK_BYTES = 1200
DIMS = 384
#: Token vectors averaged per sequence.
POOL_LIMIT = 512
ENGINE, ENGINE_VERSION = "bge-small", "v1.5"


# --- chunks -----------------------------------------------------------------


def chunks_of_text(text: Column, target: int = CHUNK_BYTES) -> Column:
    """Array of chunks: whole lines packed greedily up to ``target`` bytes.

    A line longer than the target stays whole, blank chunks are left out.
    """

    def step(acc: Column, line: Column) -> Column:
        cur = acc["cur"]
        full = (F.octet_length(cur) + F.octet_length(line) > target) & ~is_blank(cur)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(trim_ws(cur)))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(cur), line, F.lit("\n")).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        rest = F.array(trim_ws(acc["cur"]))
        return F.when(is_blank(acc["cur"]), acc["done"]).otherwise(F.concat(acc["done"], rest))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("cur"))
    packed = F.aggregate(F.split(text, "\n"), start, step, finish)
    # text that cannot overflow needs no packing
    return F.when(
        F.octet_length(text) < target,
        F.when(is_blank(text), F.expr("cast(array() as array<string>)")).otherwise(F.array(trim_ws(text))),
    ).otherwise(packed)


def chunk_text(df: DataFrame, text: str = "text", target: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk (chunk_index from 0, chunk), keeping the other columns. No shuffle."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(chunks_of_text(F.col(text), target)).alias("chunk_index", "chunk"))


# --- vectors ----------------------------------------------------------------


def hash_embed(df: DataFrame, keys: list[str], text: str = "text", dims: int = DIMS) -> DataFrame:
    """Deterministic unit vector of every text: (keys, embedding). Map-side only."""
    return df.select(*keys, hash_vector(F.col(text), dims).alias("embedding"))


def mean_pool(vectors: DataFrame, group: str, order: str, embedding: str = "embedding", limit: int = POOL_LIMIT) -> DataFrame:
    """Component-wise mean of the first ``limit`` vectors of each group, not normalised."""
    first = first_rows(vectors.select(group, order, embedding), [group], [F.col(order)], limit)
    means = (
        first.select(group, F.posexplode(embedding).alias("pos", "x"))
        .groupBy(group, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(group).agg(F.transform(ordered, lambda p: p["m"]).alias(embedding))


# --- entities ---------------------------------------------------------------

# fixed values: dictionary terms by entity type
DICTIONARY: dict[str, list[str]] = {
    "agency": ["AARO", "NASA", "DOJ", "FBI", "CIA", "DHS", "FAA", "NORAD"],
    "shape": ["orb", "sphere", "tic-tac", "cylinder", "disc", "triangle"],
    "sensor": ["radar", "ir", "flir", "sonar", "visual", "satellite"],
    "pattern": ["hypersonic", "transmedium", "instantaneous acceleration"],
}
TERM_CONFIDENCE, DATE_CONFIDENCE = 0.85, 0.8
ENTITY_SOURCE = "deterministic"


def entity_array(text: Column, dictionary: dict[str, list[str]] | None = None) -> Column:
    """Sorted array of (key, entity_type, name, confidence), one per lower-cased name and type.

    The first surface form in the text is the name. Everything happens inside the
    row, so extraction needs no shuffle.
    """
    rules = [
        (kind, r"(?iU)\b(%s)\b" % "|".join(re.escape(t) for t in terms), TERM_CONFIDENCE)
        for kind, terms in (DICTIONARY if dictionary is None else dictionary).items()
    ]
    rules.append(("date", r"(?U)\b(\d{4}-\d{2}-\d{2})\b", DATE_CONFIDENCE))

    def hits(kind: str, pattern: str, confidence: float) -> Column:
        def firsts(names: Column, lows: Column) -> Column:
            return F.transform(
                F.array_distinct(lows),
                lambda low: F.struct(
                    low.alias("key"),
                    F.lit(kind).alias("entity_type"),
                    F.get(names, (F.array_position(lows, low) - 1).cast("int")).alias("name"),
                    F.lit(confidence).alias("confidence"),
                ),
            )

        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return let(found, lambda names: let(F.transform(names, F.lower), lambda lows: firsts(names, lows)))

    return F.sort_array(F.concat(*[hits(*rule) for rule in rules]))


def extract_entities(
    df: DataFrame, key: str = "record_id", text: str = "text", dictionary: dict[str, list[str]] | None = None
) -> DataFrame:
    """(record_id, name, entity_type, confidence, source) of every distinct hit."""
    found = df.select(key, F.explode(entity_array(F.col(text), dictionary)).alias("e"))
    return found.select(key, "e.name", "e.entity_type", "e.confidence", F.lit(ENTITY_SOURCE).alias("source"))


def entity_names(text: Column, dictionary: dict[str, list[str]] | None = None) -> Column:
    """The names found in a text, joined by blanks in entity order."""
    return F.array_join(F.transform(entity_array(text, dictionary), lambda e: e["name"]), " ")


def upsert_entities(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """Entity dimension after a pass: unique on (name, entity_type), case matters.

    A known entity keeps its id and takes the new description.
    """
    keys = ["name", "entity_type"]
    new = hits.groupBy(*keys).agg(F.max("source").alias("_source"))
    known = entities.select(*keys, F.col("id").alias("_id"), F.col("description").alias("_old"))
    return known.join(new, keys, "full_outer").select(
        F.coalesce("_id", derived_id("entity", "entity_type", "name")).alias("id"),
        *keys,
        F.coalesce("_source", "_old").alias("description"),
    )


def link_entities(links: DataFrame, hits: DataFrame, entities: DataFrame, processed: DataFrame) -> DataFrame:
    """Record-entity links with those of the ``processed`` records (record_id) replaced."""
    done = processed.select("record_id").distinct()
    kept = join_many_to_one(links, done, ["record_id"], "left_anti")
    ids = entities.select("name", "entity_type", F.col("id").alias("entity_id"))
    # names such as a frequent agency occur in a large share of all records
    fresh = join_many_to_one(
        hits.select("record_id", "name", "entity_type", "confidence"), ids, ["name", "entity_type"]
    )
    columns = ["record_id", "entity_id", "confidence"]
    return kept.select(*columns).unionByName(fresh.select(*columns))


# --- chunk tables -----------------------------------------------------------


def chunk_rows(docs: DataFrame, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Chunks of (record_id, title, text) with everything the chunk tables need.

    Entity names are attached before the split, row by row; no join is needed.
    """
    named = docs.select("record_id", "title", entity_names(F.col("text"), dictionary).alias("entities"), "text")
    return chunk_text(named).select(
        derived_id("chunk", "record_id", F.col("chunk_index")).alias("chunk_id"),
        "record_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("chunk").alias("text"),
        "title",
        "entities",
    )


def index_chunks(
    docs: DataFrame, ts: str, dictionary: dict[str, list[str]] | None = None, dims: int = DIMS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows for analysis_chunks, chunk_vectors and search_documents."""
    rows = chunk_rows(docs, dictionary)
    chunks = rows.select(
        F.col("chunk_id").alias("id"),
        "record_id",
        "chunk_index",
        "text",
        F.lit(ENGINE).alias("engine_name"),
        F.lit(ENGINE_VERSION).alias("model_version"),
        F.lit(ts).alias("created_at"),
    )
    vectors = hash_embed(rows, ["chunk_id"], "text", dims).select(
        "chunk_id", F.col("embedding").cast("array<float>").alias("embedding")
    )
    return chunks, vectors, rows.select("chunk_id", "record_id", "title", "text", "entities")


def replace_rows(existing: DataFrame, new: DataFrame, processed: DataFrame) -> DataFrame:
    """``existing`` without the processed records (record_id), plus ``new``."""
    done = processed.select("record_id").distinct()
    kept = join_many_to_one(existing, done, ["record_id"], "left_anti")
    return kept.select(*new.columns).unionByName(new)


def save_text(results: DataFrame, texts: DataFrame) -> DataFrame:
    """One text per record; of several writes (record_id, text, processed_at) the last one counts."""
    last = first_row(texts, ["record_id"], [F.col("processed_at").desc()]).select(
        "record_id", F.col("text").alias("_text"), F.col("processed_at").alias("_at"), F.lit(True).alias("_new")
    )
    new = F.col("_new").isNotNull()
    return results.join(last, "record_id", "full_outer").select(
        "record_id",
        F.when(new, F.col("_text")).otherwise(F.col("ocr_text")).alias("ocr_text"),
        F.when(new, "indexed").otherwise(F.col("status")).alias("status"),
        F.when(new, F.col("_at")).otherwise(F.col("processed_at")).alias("processed_at"),
    )


# --- targets ----------------------------------------------------------------

_FINISHED = ["indexed", "completed"]


def _target(stage: str) -> Column:
    local = F.col("local_path").isNotNull()
    status = F.col("analysis_status")
    if stage in ("index", "analyse"):
        return local & (status.isNull() | ~status.isin(_FINISHED))
    if stage == "synthesise":
        return local & status.eqNullSafe("indexed")
    if stage == "reprocess":
        return local
    raise ValueError(f"unknown stage: {stage}")


def select_targets(records: DataFrame, stage: str) -> DataFrame:
    """Records a stage (index, analyse, synthesise, reprocess) has to work on."""
    return records.filter(_target(stage))


def target_counts(records: DataFrame, stage: str) -> DataFrame:
    """One row: pending and skipped_remote."""
    return records.agg(
        F.count_if(_target(stage)).alias("pending"), F.count_if(F.col("local_path").isNull()).alias("skipped_remote")
    )
