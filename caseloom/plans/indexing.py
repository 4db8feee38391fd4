"""One index pass over all pending records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import texts as tx
from ..session import scratch_path


@dataclass(frozen=True)
class IndexTables:
    """The tables an index pass reads and rewrites."""

    records: DataFrame
    entities: DataFrame
    links: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    search_documents: DataFrame
    results: DataFrame


def run_index(
    tables: IndexTables,
    texts: DataFrame,
    ts: str,
    dictionary: dict[str, list[str]] | None = None,
    scores: DataFrame | None = None,
    stage: str = "index",
    dims: int = tx.DIMS,
    staging: str | None = None,
) -> IndexTables:
    """Text of every target record to entities, chunks, vectors and status.

    ``texts`` is (record_id, text, error), one row per record at most, ``scores``
    an optional (record_id, score) of image redaction. A record without text, or
    with an error, becomes ``failed`` with the message; the others go on. Every result
    starts from the same joined texts and hits: they are written once to ``staging``, a
    path in the shared folder (a fresh one by default), and read by all results.
    """
    spark = texts.sparkSession
    staging = staging or scratch_path(spark, "index")

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staging}/{name}")

    targets = tx.select_targets(tables.records, stage).select(F.col("id").alias("record_id"), "title")
    got = targets.join(texts.select("record_id", "text", "error"), "record_id", "left")
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("text").isNull(), "no text extracted")
    judged = staged(got.withColumn("problem", problem), "texts")
    docs = judged.filter(F.col("problem").isNull()).select("record_id", "title", "text")
    processed = docs.select("record_id")

    hits = staged(tx.extract_entities(docs, dictionary=dictionary), "hits")
    entities = tx.upsert_entities(tables.entities, hits)
    links = tx.link_entities(tables.links, hits, entities, processed)
    chunks, vectors, search_documents = tx.index_chunks(docs, ts, dictionary, dims)
    stale = tables.chunks.join(processed, "record_id", "left_semi").select(F.col("id").alias("chunk_id"))

    outcome = judged.select(F.col("record_id").alias("id"), "problem", F.lit(True).alias("_tried"))
    marked = tables.records.join(outcome, "id", "left")
    if scores is None:
        marked = marked.withColumn("_score", F.lit(0.0))
    else:
        marked = marked.join(scores.select(F.col("record_id").alias("id"), F.col("score").alias("_score")), "id", "left")
    tried = F.col("_tried").isNotNull()
    ok = tried & F.col("problem").isNull()
    records = (
        marked.withColumn(
            "analysis_status",
            F.when(ok, "indexed").when(tried, "failed").otherwise(F.col("analysis_status")),
        )
        .withColumn("analysis_error", F.when(tried, F.col("problem")).otherwise(F.col("analysis_error")))
        .withColumn(
            "redaction_score",
            F.when(ok, F.coalesce("_score", F.lit(0.0))).otherwise(F.col("redaction_score")),
        )
        .select(*tables.records.columns)
    )
    return IndexTables(
        records=records,
        entities=entities,
        links=links,
        chunks=tx.replace_rows(tables.chunks, chunks, processed),
        vectors=tables.vectors.join(stale, "chunk_id", "left_anti").unionByName(vectors),
        search_documents=tx.replace_rows(tables.search_documents, search_documents, processed),
        results=tx.save_text(
            tables.results, docs.select("record_id", "text", F.lit(ts).alias("processed_at"))
        ),
    )
