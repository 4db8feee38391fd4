"""Data quality and bulk maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import first_rows, join_many_to_one

#: Official files smaller than this are taken for error pages.
POISON_BYTES = 1024


def drop_duplicate_records(records: DataFrame) -> DataFrame:
    """Keep one row of every (title, document_url) that several official rows share.

    All rows of such a pair compete, manual ones too: ``completed`` counts 10, a
    ``|title:`` key 1, the lowest id decides ties. The contest is a plain
    aggregate, so a pair repeated billions of times is combined map-side.
    """
    pair = ["title", "document_url"]
    score = F.when(F.col("analysis_status") == "completed", 10).otherwise(0) + F.when(
        F.col("stable_key").contains("|title:"), 1
    ).otherwise(0)
    contest = (
        records.filter(F.col("document_url").isNotNull())
        .groupBy(*pair)
        .agg(
            F.count_if(F.col("source_type") == "official").alias("officials"),
            F.min(F.struct((-score).alias("s"), F.col("id").alias("winner"))).alias("w"),
        )
        .filter(F.col("officials") > 1)
        .select(*pair, F.col("w.winner").alias("winner"))
    )
    columns = records.columns
    judged = join_many_to_one(records, contest, pair, "left")
    return judged.filter(F.col("winner").isNull() | (F.col("winner") == F.col("id"))).select(*columns)


def _renewed(records: DataFrame, changed: Column, ts: str | None) -> DataFrame:
    """``updated_at`` set to ``ts`` where a record changed; tables without the column stay without."""
    if ts is None or "updated_at" not in records.columns:
        return records
    return records.withColumn("updated_at", F.when(changed, F.lit(ts)).otherwise(F.col("updated_at")))


def drop_poisoned_artifacts(artifacts: DataFrame, records: DataFrame, ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove too small official files and forget them on the records that point there, renewing these at ``ts``."""
    poisoned = (
        artifacts.filter((F.col("byte_size") < POISON_BYTES) & (F.col("source_type") == "official"))
        .select("relative_path")
        .distinct()
    )
    kept = join_many_to_one(artifacts, poisoned, ["relative_path"], "left_anti")
    marked = poisoned.select(F.col("relative_path").alias("local_path"), F.lit(True).alias("_poisoned"))
    reset = join_many_to_one(records, marked, ["local_path"], "left")
    reset = _renewed(reset, F.col("_poisoned").isNotNull(), ts)
    return (
        kept.select(*artifacts.columns),
        reset.withColumn("local_path", F.when(F.col("_poisoned").isNull(), F.col("local_path"))).select(
            *records.columns
        ),
    )


def integrity_rows(records: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict per local record and artifact; ``files`` is (local_path, file_hash), NULL hash = unreadable."""
    local = records.filter(F.col("local_path").isNotNull()).select("id", "local_path")
    expected = artifacts.filter(F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("id"), F.col("sha256").alias("expected")
    )
    seen = files.select("local_path", "file_hash", F.lit(True).alias("present"))
    found = join_many_to_one(local, seen, ["local_path"], "left")
    # a record may own many artifacts; each of them is judged
    owned = join_many_to_one(expected, found, ["id"], "inner")
    bare = found.join(expected.select("id").distinct(), "id", "left_anti")
    verdict = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("expected").isNull(), "verified")
        .when(F.col("file_hash").eqNullSafe(F.col("expected")), "verified")
        .otherwise("corrupted")
    )
    return owned.unionByName(bare, allowMissingColumns=True).select(
        "id", "local_path", "expected", verdict.alias("verdict")
    )


def verify_integrity(records: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total, verified, corrupted, missing."""
    tally = lambda kind: F.count_if(F.col("verdict") == kind).alias(kind)
    return integrity_rows(records, artifacts, files).agg(
        F.count(F.lit(1)).alias("total"), tally("verified"), tally("corrupted"), tally("missing")
    )


#: Tables emptied by :func:`clear_analysis` and the column that names the record.
DEPENDENT = {
    "analysis_results": "record_id",
    "analysis_chunks": "record_id",
    "search_documents": "record_id",
    "record_forensics": "record_id",
    "record_entities": "record_id",
    "intelligence_logs": "record_id",
}


def clear_analysis(tables: dict[str, DataFrame], ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Forget the analysis of the given records (a one-column ``id`` table), or of all.

    Fragments stay, as do assets of type ``source``. Only tables that are passed in
    come back.
    """
    out = dict(tables)
    chosen = None if ids is None else ids.select("id").distinct()

    def survivors(df: DataFrame, column: str) -> DataFrame:
        if chosen is None:
            return df.limit(0)
        keys = chosen.select(F.col("id").alias(column))
        return join_many_to_one(df, keys, [column], "left_anti").select(*df.columns)

    if "chunk_vectors" in tables:
        vectors = tables["chunk_vectors"]
        if chosen is None:
            out["chunk_vectors"] = vectors.limit(0)
        else:
            kept = survivors(tables["analysis_chunks"], "record_id").select(F.col("id").alias("chunk_id"))
            out["chunk_vectors"] = vectors.join(kept, "chunk_id", "left_semi")
    for name, column in DEPENDENT.items():
        if name in tables:
            out[name] = survivors(tables[name], column)
    if "record_assets" in tables:
        assets = tables["record_assets"]
        sources = assets.filter(F.col("asset_type") == "source")
        derived = assets.filter(~F.col("asset_type").eqNullSafe("source"))
        out["record_assets"] = sources.unionByName(survivors(derived, "record_id"))
    records = tables["records"]
    if chosen is None:
        hit: Column = F.lit(True)
        marked = records
    else:
        marked = records.join(chosen.withColumn("_hit", F.lit(True)), "id", "left")
        hit = F.col("_hit").isNotNull()
    out["records"] = (
        marked.withColumn("analysis_status", F.when(hit, "pending").otherwise(F.col("analysis_status")))
        .withColumn("intelligence_json", F.when(~hit, F.col("intelligence_json")))
        .withColumn("redaction_score", F.when(~hit, F.col("redaction_score")))
        .select(*records.columns)
    )
    return out


def reset_local_copies(
    records: DataFrame, artifacts: DataFrame, assets: DataFrame, ts: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Report (files_removed, bytes_removed), then records (renewed at ``ts``), artifacts and assets without local copies."""
    report = artifacts.agg(
        F.count(F.lit(1)).alias("files_removed"),
        F.coalesce(F.sum("byte_size"), F.lit(0).cast("long")).alias("bytes_removed"),
    )
    nothing = F.lit(None).cast("string")
    bare = _renewed(records, F.lit(True), ts).withColumn("local_path", nothing).withColumn("thumbnail_path", nothing).select(*records.columns)
    return report, bare, artifacts.limit(0), assets.limit(0)


def repair_stalled(
    jobs: DataFrame, items: DataFrame, reason: str = "Application interrupted"
) -> tuple[DataFrame, DataFrame]:
    """Jobs and items left running by a crash become failed, with the reason noted."""
    stuck_job = F.coalesce(F.col("status").isin("running", "queued"), F.lit(False))
    stuck_item = F.coalesce(F.col("status").isin("downloading", "queued"), F.lit(False))
    note = F.to_json(F.struct(F.lit(reason).alias("error")))

    def known(df: DataFrame, column: str) -> Column:
        return F.col(column) if column in df.columns else F.lit(None).cast("string")

    failed_jobs = jobs.withColumn(
        "summary_json", F.when(stuck_job, note).otherwise(known(jobs, "summary_json"))
    ).withColumn("status", F.when(stuck_job, "failed").otherwise(F.col("status")))
    failed_items = items.withColumn(
        "error", F.when(stuck_item, reason).otherwise(known(items, "error"))
    ).withColumn("status", F.when(stuck_item, "failed").otherwise(F.col("status")))
    return failed_jobs, failed_items


def _wanted() -> Column:
    has_url = F.coalesce(F.col("document_url"), F.lit("")) != ""
    return F.col("local_path").isNull() & has_url


def download_worklist(records: DataFrame) -> DataFrame:
    """Official rows still to fetch, newest release first, then by title."""
    todo = records.filter((F.col("source_type") == "official") & _wanted())
    newest = F.coalesce("release_date", "created_at")
    return todo.orderBy(newest.desc(), F.col("title"), F.col("id")).select(
        F.col("id").alias("record_id"), "title", F.col("document_url").alias("url"), F.lit("queued").alias("status")
    )


def download_counts(records: DataFrame) -> DataFrame:
    """One row: total, queued, skipped."""
    return records.filter(F.col("source_type") == "official").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_wanted()).alias("queued"),
        F.count_if(~_wanted()).alias("skipped"),
    )


def job_rollup(items: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Counters, final status and progress of every job.

    Total and skipped come from ``jobs`` where given (skipped records have no item
    there), else they are counted from the items.
    """
    status = F.col("status")
    counts = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status.isin("queued", "downloading")).alias("remaining"),
        F.count_if(status == "skipped").alias("skipped_items"),
    )
    if jobs is None:
        full = counts.withColumn("total", F.col("items")).withColumn("skipped", F.col("skipped_items"))
        running: Column = F.lit("running")
    else:
        known = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("was"), "total", "skipped")
        full = known.join(counts, "job_id", "left").fillna(0, ["completed", "failed", "remaining"])
        running = F.col("was")
    done = F.when(F.col("failed") == 0, "completed").otherwise("completed_with_errors")
    return full.select(
        "job_id",
        "total",
        "skipped",
        "completed",
        "failed",
        "remaining",
        F.when(F.col("remaining") == 0, done).otherwise(running).alias("status"),
        job_progress(F.col("completed"), F.col("failed"), F.col("total"), F.col("skipped")).alias("progress"),
    )


def job_progress(completed: Column, failed: Column, total: Column, skipped: Column) -> Column:
    """Percentage done; 0 for a job without work, NULL when everything was skipped."""
    return F.when(total == 0, 0.0).otherwise(
        (completed + failed).cast("double") / F.nullif(total - skipped, F.lit(0)) * 100
    )


def job_report(jobs: DataFrame, items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of the jobs by last update, newest first, then title.

    With ``limit`` only the newest items per job come back, pruned before the shuffle.
    """
    order = [F.col("updated_at").desc(), F.col("title"), F.col("id")]
    picked = items if limit is None else first_rows(items, ["job_id"], order, limit)
    heads = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    return join_many_to_one(picked, heads, ["job_id"], "inner").orderBy("job_id", *order)


def active_job(jobs: DataFrame) -> DataFrame:
    """The latest queued or running job."""
    busy = jobs.filter(F.col("status").isin("queued", "running"))
    return busy.orderBy(F.col("updated_at").desc(), "id").limit(1)
