"""Counters, dashboards, geography and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import geo_point
from ..functions.text import media_kind
from .common import first_rows

#: Tokens a synthesis may produce.
TOKEN_LIMIT = 2048

_COUNTERS = [
    "total_records",
    "official_records",
    "manual_records",
    "downloadable_records",
    "local_records",
    "artifact_count",
    "artifact_bytes",
    "analyzed_records",
    "failed_analysis_records",
    "unanalyzed_count",
    "completed_count",
    "pending_count",
    "analysis_chunks",
    "vector_chunks",
    "entity_count",
    "case_count",
    "source_snapshots",
    "active_download_jobs",
]
_LATEST = ["latest_snapshot_at", "latest_snapshot_url", "latest_snapshot_records"]


def status_rollup(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with all counters; a table that is not passed counts as empty.

    Each table is scanned once. The single rows are stacked and summed, so nothing
    is joined.
    """
    status, zero = F.col("analysis_status"), F.lit(0).cast("long")
    done = F.coalesce(status.isin("completed", "indexed"), F.lit(False))
    every = F.count(F.lit(1))
    latest = F.max_by(
        F.struct("fetched_at", "upstream_url", "record_count"),
        # of several sources synced at the same time the last by address counts
        F.when(F.col("status") == "completed", F.struct("fetched_at", "upstream_url", "record_count")),
    )
    plans: dict[str, dict[str, Column]] = {
        "records": {
            "total_records": every,
            "official_records": F.count_if(F.col("source_type") == "official"),
            "manual_records": F.count_if(F.col("source_type") == "manual"),
            "downloadable_records": F.count_if(
                (F.col("source_type") == "official") & (F.coalesce("document_url", F.lit("")) != "")
            ),
            "local_records": F.count("local_path"),
            "analyzed_records": F.count_if(done),
            "failed_analysis_records": F.count_if(status == "failed"),
            "unanalyzed_count": F.count_if(~done),
            "completed_count": F.count_if(status == "completed"),
            "pending_count": F.count_if(status.isNull() | (status == "pending")),
        },
        "artifacts": {"artifact_count": every, "artifact_bytes": F.coalesce(F.sum("byte_size"), zero)},
        "chunks": {"analysis_chunks": every},
        "vectors": {"vector_chunks": every},
        "entities": {"entity_count": every},
        "cases": {"case_count": every},
        "snapshots": {"source_snapshots": every, "_latest": latest},
        "jobs": {"active_download_jobs": F.count_if(F.col("status").isin("queued", "running"))},
    }
    stacked = []
    for name, counters in plans.items():
        if name not in tables:
            continue
        row = tables[name].agg(*[c.alias(n) for n, c in counters.items()])
        newest = [
            (F.col(f"_latest.{field}") if "_latest" in counters else F.lit(None)).cast(kind).alias(out)
            for out, field, kind in zip(
                _LATEST, ["fetched_at", "upstream_url", "record_count"], ["string", "string", "long"]
            )
        ]
        stacked.append(row.select(*[(F.col(c) if c in counters else zero).alias(c) for c in _COUNTERS], *newest))
    rows = reduce(DataFrame.unionByName, stacked)
    return rows.agg(*[F.sum(c).alias(c) for c in _COUNTERS], *[F.max(c).alias(c) for c in _LATEST])


def pipeline_metrics(rollup: DataFrame) -> DataFrame:
    """Derived figures of the dashboard."""
    total = F.when(F.col("total_records") == 0, 1).otherwise(F.col("total_records"))
    return rollup.select(
        (F.col("local_records") / total * 100).alias("local_percent"),
        (F.col("analyzed_records") - F.col("completed_count")).alias("indexed"),
        (F.col("total_records") - F.col("local_records")).alias("remote"),
        F.col("pending_count").alias("pending"),
        F.col("completed_count").alias("completed"),
    )


def agency_matrix(records: DataFrame, n: int = 10) -> DataFrame:
    """Agencies by size with the first ``n`` records of each, and how many more there are.

    Sizes come from an aggregate, the records from a limited ranking; no agency, however
    large, is gathered.
    """
    agency = F.coalesce(F.nullif(F.col("agency"), F.lit("")), F.lit("Unknown Origin"))
    named = records.select(
        agency.alias("agency"), "id", "title", "analysis_status", F.coalesce("release_date", "created_at").alias("_at")
    )
    sizes = named.groupBy("agency").agg(F.count(F.lit(1)).alias("size"))
    order = [F.col("_at").desc(), F.col("title"), F.col("id")]
    top = first_rows(named, ["agency"], order, n)
    return (
        top.join(sizes, "agency")
        .withColumn("more", F.greatest(F.col("size") - n, F.lit(0)))
        .orderBy(F.col("size").desc(), "agency", *order)
        .select("agency", "size", "more", "id", "title", "analysis_status")
    )


def geo_resolve(records: DataFrame, rules: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Records with the coordinates of their place, NULL where no rule matches."""
    placed = records.withColumn("_point", geo_point(F.col("incident_location"), rules))
    return placed.select("*", F.col("_point.lat").alias("lat"), F.col("_point.lon").alias("lon")).drop("_point")


def geo_bounds(points: DataFrame) -> DataFrame:
    """Bounding box of the resolved points."""
    return points.agg(
        F.min("lat").alias("south"),
        F.min("lon").alias("west"),
        F.max("lat").alias("north"),
        F.max("lon").alias("east"),
        F.count("lat").alias("points"),
    )


def forensic_report(forensics: DataFrame, overlay: bool = False) -> DataFrame:
    """Findings by confidence with their box as array; ``overlay`` leaves metadata out."""
    shown = forensics.filter(F.col("layer_type") != "metadata_leak") if overlay else forensics
    return shown.withColumn("bbox", F.from_json("bounding_box_json", "array<double>")).orderBy(
        "record_id", F.col("confidence").desc(), "id"
    )


def chunks_of(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the given records (id) in order."""
    wanted = records.select(F.col("id").alias("record_id")).distinct()
    return chunks.join(wanted, "record_id", "left_semi").orderBy("record_id", "chunk_index")


def analysis_view(records: DataFrame, results: DataFrame) -> DataFrame:
    """Status, text and answer of every record; no text reads as empty."""
    texts = results.select(F.col("record_id").alias("id"), "ocr_text")
    return records.join(texts, "id", "left").select(
        F.col("id").alias("record_id"),
        F.col("analysis_status").alias("status"),
        F.coalesce("ocr_text", F.lit("")).alias("ocr_text"),
        "intelligence_json",
        F.lit("stored").alias("engine"),
    )


def record_images(assets: DataFrame, n: int | None = 4) -> DataFrame:
    """Image assets per record, the first ``n`` by id unless all are wanted."""
    images = assets.filter(F.col("asset_type") == "image")
    return images if n is None else first_rows(images, ["record_id"], [F.col("id")], n)


def with_media_kind(records: DataFrame) -> DataFrame:
    return records.withColumn("media_kind", media_kind("file_type"))


# fixed values: progress event -> record status
EVENT_STATUS: dict[str, str] = {
    "extracting-foundation": "indexing",
    "processing": "indexing",
    "indexing": "indexing",
    "foundation-indexed": "indexed",
    "analyzing": "synthesizing",
    "synthesizing": "synthesizing",
    "completed": "completed",
    "record-completed": "completed",
    "record-failed": "failed",
}


def mapped_status(status: Column) -> Column:
    """Record status a progress event stands for, NULL for events that change nothing."""
    mapped = F.when(F.lit(False), F.lit(None).cast("string"))
    for event, result in EVENT_STATUS.items():
        mapped = mapped.when(status == event, result)
    return mapped


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per record from (record_id, ts, event_id, status) events; batch and stream alike."""
    mapped = events.withColumn("_status", mapped_status(F.col("status"))).filter(F.col("_status").isNotNull())
    return (
        mapped.groupBy("record_id")
        .agg(F.max(F.struct("ts", "event_id", F.col("_status").alias("status"))).alias("_last"))
        .select("record_id", F.col("_last.status").alias("analysis_status"), F.col("_last.ts").alias("ts"))
    )


def batch_progress(events: DataFrame, key: str = "batch_id") -> DataFrame:
    """Progress of every batch from its events.

    ``events`` has ts, event_id, status, current, total, token_index, token_limit and
    progress. Counters keep their last known value; a synthesis reports its tokens, a
    model load its own progress, and final events leave the progress as it was.
    """
    at = F.struct("ts", "event_id")
    final = F.col("status").isin("completed", "batch-complete")
    sets = ~final
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    seen = events.groupBy(key).agg(
        last("current").alias("current"),
        last("total").alias("total"),
        F.max_by("status", at).alias("_newest"),
        F.max_by(F.struct("status", "token_index", "token_limit", "progress"), F.when(sets, at)).alias("_e"),
    )
    token_share = (
        F.coalesce("_e.token_index", F.lit(0)) / F.coalesce("_e.token_limit", F.lit(TOKEN_LIMIT)) * 100
    )
    share = F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("current", F.lit(0)) / F.col("total") * 100)
    percent = (
        F.when(F.col("_e.status") == "loading-model", F.coalesce(F.col("_e.progress").cast("double"), F.lit(0.0)))
        .when(F.col("_e.status").isin("synthesizing", "synthesizing-start"), token_share)
        .otherwise(F.coalesce(share, F.lit(0.0)))
    )
    return seen.select(
        key,
        F.coalesce("current", F.lit(0)).cast("long").alias("current"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        percent.alias("progress"),
        (~F.col("_newest").isin("completed", "batch-complete")).alias("active"),
    )
