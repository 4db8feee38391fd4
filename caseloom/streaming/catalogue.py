"""Releases processed as they arrive in a landing folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import sync_report
from ..operators.quality import download_worklist
from ..operators.texts import select_targets
from ..plans.sync import apply_release, maintain
from ..schemas import ARTIFACTS, RECORDS, SNAPSHOT_ROWS
from ..sources.catalogue import begins_like_page, read_catalogue_csv
from ..sources.library import first_bytes
from ..sources.sinks import read_version, versions, write_version

#: What the ``binaryFile`` source delivers.
_FILE = "path string, modificationTime timestamp, length long, content binary"

#: Tables kept below the store folder.
TABLES = ["release", "diffs", "reports", "merged", "artifacts", "records", "worklist", "targets"]


def _previous(spark: SparkSession, table_dir: str, batch_id: int, schema) -> DataFrame:
    """State before a batch: the newest version not written by it."""
    older = [v for v in versions(spark, table_dir) if v <= batch_id]
    return read_version(spark, table_dir, older[-1]) if older else spark.createDataFrame([], schema)


def _apply_release(spark: SparkSession, path: str, store: str, batch_id: int) -> None:
    ts = f"batch-{batch_id:010d}"
    version = batch_id + 1

    def save(df: DataFrame, name: str) -> DataFrame:
        """Write a table of this batch; what follows reads the stored rows."""
        write_version(df, f"{store}/{name}", version=version)
        return read_version(spark, f"{store}/{name}", version, df.schema)

    records = _previous(spark, f"{store}/records", batch_id, RECORDS)
    artifacts = _previous(spark, f"{store}/artifacts", batch_id, ARTIFACTS)
    previous = _previous(spark, f"{store}/release", batch_id, SNAPSHOT_ROWS)
    current = save(read_catalogue_csv(spark, path, check=False).drop("file"), "release")
    result = apply_release(current, previous, records, ts, ts)
    diff = save(result.diff.withColumn("snapshot_id", F.lit(ts)), "diffs")
    save(sync_report(diff, current).withColumn("snapshot_id", F.lit(ts)), "reports")
    clean, good, _ = maintain(save(result.records, "merged"), artifacts)
    save(good, "artifacts")
    stored = save(clean, "records")
    save(download_worklist(stored), "worklist")
    save(select_targets(stored, "index").select("id", "title"), "targets")


def stream_catalogue(
    spark: SparkSession, landing: str, store: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Sync, clean up, plan downloads and pick index targets for every file that lands.

    One file is one release and one batch, in order of arrival. All tables of a batch
    are written under its own version, so a batch that is repeated after a failure
    overwrites what it had written and starts from the same state. Error pages are
    skipped and leave the state as it was.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        for row in batch.collect():
            # the source writes ``file:/`` where others expect ``file:///``
            if not begins_like_page(first_bytes(re.sub("^file:/+", "file:///", row["path"]), 16)):
                _apply_release(session, row["path"], store, batch_id)

    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "*.csv")
        .load(landing)
        # names only: a content would be read whole, by one task
        .select("path")
    )
    writer = arrivals.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
