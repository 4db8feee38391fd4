"""What changed between releases, and how the record table follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import derived_id

#: Columns a release overwrites on an existing record.
OVERWRITTEN = [
    "title",
    "agency",
    "release_date",
    "incident_date",
    "incident_location",
    "document_url",
    "file_type",
    "summary",
    "source_snapshot_id",
    "content_hash",
]


def _change_type(previous: Column, current: Column) -> Column:
    return (
        F.when(previous.isNull(), "added").when(current.isNull(), "removed").when(previous != current, "changed")
    )


def snapshot_diff(prev: DataFrame, cur: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Added, changed and removed keys; both sides are unique on ``stable_key``.

    ``cur`` carries title and document_url. A removed key takes its title from the
    official row in ``records``, else from the key itself.
    """
    before = prev.select("stable_key", F.col("content_hash").alias("previous_hash"))
    if records is None:
        before = before.withColumn("known_title", F.lit(None).cast("string"))
    else:
        # joined before the outer join, which then reuses this partitioning by key
        known = records.filter(F.col("source_type") == "official").select(
            "stable_key", F.col("title").alias("known_title")
        )
        before = before.join(known, "stable_key", "left")
    after = cur.select(
        "stable_key", F.col("content_hash").alias("current_hash"), F.col("title").alias("new_title"), "document_url"
    )
    change = _change_type(F.col("previous_hash"), F.col("current_hash"))
    return (
        before.join(after, "stable_key", "full_outer")
        .withColumn("change_type", change)
        .filter(F.col("change_type").isNotNull())
        .select(
            "stable_key",
            "change_type",
            F.when(
                F.col("change_type") == "removed", F.coalesce("known_title", F.col("stable_key").cast("string"))
            )
            .otherwise(F.coalesce("new_title", F.lit("Untitled")))
            .alias("title"),
            "document_url",
            "previous_hash",
            "current_hash",
        )
    )


def sync_report(diff: DataFrame, cur: DataFrame) -> DataFrame:
    """One row: record_count, added, changed, removed."""
    tally = lambda kind: F.count_if(F.col("change_type") == kind)
    zero = F.lit(0).cast("long")
    changes = diff.agg(
        zero.alias("record_count"),
        tally("added").alias("added"),
        tally("changed").alias("changed"),
        tally("removed").alias("removed"),
    )
    size = cur.agg(
        F.count(F.lit(1)).alias("record_count"), zero.alias("added"), zero.alias("changed"), zero.alias("removed")
    )
    return changes.unionByName(size).agg(
        *[F.sum(c).alias(c) for c in ("record_count", "added", "changed", "removed")]
    )


def upsert_records(records: DataFrame, cur: DataFrame, snapshot_id: str | Column, ts: str) -> DataFrame:
    """Record table after a release.

    Official rows are matched on ``stable_key``: identity, local copy and analysis
    survive, catalogue columns are overwritten, a returning key loses its tombstone
    and a missing one gets ``ts``. Rows from elsewhere pass through.
    """
    columns = records.columns
    types = {f.name: f.dataType for f in records.schema.fields}
    snapshot = snapshot_id if isinstance(snapshot_id, Column) else F.lit(snapshot_id)
    official = records.filter(F.col("source_type") == "official")
    others = records.filter(~F.col("source_type").eqNullSafe("official"))
    incoming = cur.withColumn("source_snapshot_id", snapshot)
    fresh = [c for c in OVERWRITTEN if c in incoming.columns and c in columns]
    new = incoming.select(
        F.col("stable_key"), F.lit(True).alias("_in"), *[F.col(c).alias(f"_new_{c}") for c in fresh]
    )
    joined = official.withColumn("_was", F.lit(True)).join(new, "stable_key", "full_outer")
    arrived, existed = F.col("_in").isNotNull(), F.col("_was").isNotNull()
    gone = existed & ~arrived
    rules: dict[str, Column] = {
        "id": F.when(existed, F.col("id")).otherwise(derived_id("official", "stable_key")),
        "source_type": F.lit("official"),
        "removed_from_source_at": F.when(gone, F.coalesce("removed_from_source_at", F.lit(ts))),
        "updated_at": F.when(gone & F.col("removed_from_source_at").isNotNull(), F.col("updated_at")).otherwise(
            F.lit(ts)
        ),
        "created_at": F.when(existed, F.col("created_at")).otherwise(F.lit(ts)),
        "analysis_status": F.when(existed, F.col("analysis_status")).otherwise("pending"),
    }
    for name in fresh:
        rules[name] = F.when(arrived, F.col(f"_new_{name}")).otherwise(F.col(name))
    merged = joined.select(*[rules.get(c, F.col(c)).cast(types[c]).alias(c) for c in columns])
    return merged.unionByName(others)


def number_snapshots(manifest: DataFrame) -> DataFrame:
    """Number the completed releases of every source 1, 2, 3 ... by fetch time.

    One row per release, so the window is as small as the list of releases.
    """
    window = Window.partitionBy("source_name").orderBy("fetched_at", "id")
    done = manifest.filter(F.col("status") == "completed")
    return done.withColumn("snapshot_no", F.row_number().over(window).cast("long"))


def change_feed(rows: DataFrame) -> DataFrame:
    """:func:`snapshot_diff` over the whole history in one pass.

    ``rows`` holds (snapshot_no, stable_key, content_hash), unique on the first two,
    with releases numbered without gaps (:func:`number_snapshots`); each is compared
    with its predecessor. The comparison joins on key *and* release, so a key that
    is present in every release spreads over all tasks, and no window is needed.
    """
    newest = rows.agg(F.max("snapshot_no")).scalar()
    before = rows.filter(F.col("snapshot_no") < newest).select(
        (F.col("snapshot_no") + 1).alias("snapshot_no"), "stable_key", F.col("content_hash").alias("previous_hash")
    )
    after = rows.select("snapshot_no", "stable_key", F.col("content_hash").alias("current_hash"))
    return (
        before.join(after, ["stable_key", "snapshot_no"], "full_outer")
        .withColumn("change_type", _change_type(F.col("previous_hash"), F.col("current_hash")))
        .filter(F.col("change_type").isNotNull())
        .select("snapshot_no", "stable_key", "change_type", "previous_hash", "current_hash")
    )


def latest_snapshot(snapshots: DataFrame, source: str | None = None) -> DataFrame:
    """The newest completed snapshot, of one source if given."""
    done = snapshots.filter(F.col("status") == "completed")
    if source is not None:
        done = done.filter(F.col("source_name") == source)
    return done.orderBy(F.col("fetched_at").desc(), F.col("id")).limit(1)
