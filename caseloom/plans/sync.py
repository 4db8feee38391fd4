"""From a catalogue file to history, changes and record table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.changes import snapshot_diff, sync_report, upsert_records
from ..operators.quality import download_worklist, drop_duplicate_records, drop_poisoned_artifacts
from ..sources.catalogue import snapshot_rows


@dataclass(frozen=True)
class SyncResult:
    """What one release leaves behind."""

    rows: DataFrame
    diff: DataFrame
    report: DataFrame
    records: DataFrame


def apply_release(
    current: DataFrame, previous: DataFrame, records: DataFrame, snapshot_id: str, ts: str
) -> SyncResult:
    """Compare the keyed rows of a release with the ``previous`` ones and carry them into ``records``."""
    diff = snapshot_diff(previous, current, records)
    return SyncResult(
        rows=snapshot_rows(current, snapshot_id),
        diff=diff,
        report=sync_report(diff, current),
        records=upsert_records(records, current, snapshot_id, ts),
    )


def maintain(records: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean-up after a sync: records, artifacts, and what is left to download."""
    unique = drop_duplicate_records(records)
    good, clean = drop_poisoned_artifacts(artifacts, unique)
    return clean, good, download_worklist(clean)
