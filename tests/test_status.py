
from pyspark.sql import functions as F

from caseloom.operators import status as st
from caseloom.streaming.events import stream_status, streamed_status


def records(spark):
    rows = [
        ("1", "official", "u", "p", None, "A", "2024-01", "One"),
        ("2", "official", "", None, "pending", "", "2024-02", "Two"),
        ("3", "manual", "u", "p", "completed", None, None, "Three"),
        ("4", "official", None, None, "indexed", "A", "2024-03", "Four"),
        ("5", "manual", None, "p", "failed", "A", "2024-03", "Five"),
    ]
    return spark.createDataFrame(
        rows, "id string, source_type string, document_url string, local_path string, analysis_status string, agency string, release_date string, title string"
    ).withColumn("created_at", F.lit("2020"))


def test_rollup_counts_missing_status_twice(spark):
    snapshots = spark.createDataFrame([("completed", "1", "u1", 10), ("completed", "2", "u2", 20), ("failed", "3", "u3", 30)], "status string, fetched_at string, upstream_url string, record_count long")
    artifacts = spark.createDataFrame([], "byte_size long")
    row = st.status_rollup({"records": records(spark), "snapshots": snapshots, "artifacts": artifacts}).head()
    assert (row.total_records, row.official_records, row.manual_records, row.downloadable_records, row.local_records) == (5, 3, 2, 1, 3)
    assert (row.analyzed_records, row.failed_analysis_records, row.unanalyzed_count, row.completed_count, row.pending_count) == (2, 1, 3, 1, 2)
    assert (row.artifact_bytes, row.source_snapshots, row.case_count) == (0, 3, 0)
    assert (row.latest_snapshot_at, row.latest_snapshot_url, row.latest_snapshot_records) == ("2", "u2", 20)
    metrics = st.pipeline_metrics(st.status_rollup({"records": records(spark)})).head()
    assert tuple(metrics) == (60.0, 1, 2, 2, 1)
    assert st.pipeline_metrics(st.status_rollup({"records": records(spark).limit(0)})).head().local_percent == 0.0


def test_agencies_with_blank_names_and_rest(spark):
    rows = st.agency_matrix(records(spark), 2).collect()
    assert [(r.agency, r["size"], r.more, r.id) for r in rows] == [
        ("A", 3, 1, "5"),
        ("A", 3, 1, "4"),
        ("Unknown Origin", 2, 0, "2"),
        ("Unknown Origin", 2, 0, "3"),
    ]


def test_geography(spark):
    df = spark.createDataFrame([("1", "Tokyo"), ("2", "Brazil"), ("3", None)], "id string, incident_location string")
    assert tuple(st.geo_bounds(st.geo_resolve(df)).head()) == (-14.235, -51.9253, 35.6762, 139.6503, 2)


def test_forensic_report(spark):
    df = spark.createDataFrame(
        [("1", "r", "box", 0.5, "[1, 2.5]"), ("2", "r", "metadata_leak", 1.0, None), ("3", "r", "box", 0.9, "[1,")],
        "id string, record_id string, layer_type string, confidence double, bounding_box_json string",
    )
    assert [(r.id, r.bbox) for r in st.forensic_report(df).collect()] == [("2", None), ("3", None), ("1", [1.0, 2.5])]
    assert [r.id for r in st.forensic_report(df, overlay=True).collect()] == ["3", "1"]


def test_views_of_a_record(spark):
    results = spark.createDataFrame([("1", "text")], "record_id string, ocr_text string")
    got = {r.record_id: (r.status, r.ocr_text, r.engine) for r in st.analysis_view(records(spark).withColumn("intelligence_json", F.lit("{}")), results).collect()}
    assert got["1"] == (None, "text", "stored") and got["2"] == ("pending", "", "stored")
    assets = spark.createDataFrame([(str(i), "r", "image" if i else "source") for i in range(7)], "id string, record_id string, asset_type string")
    assert sorted(r.id for r in st.record_images(assets).collect()) == ["1", "2", "3", "4"]
    assert st.record_images(assets, None).count() == 6
    chunks = spark.createDataFrame([("1", 1), ("1", 0), ("9", 0)], "record_id string, chunk_index long")
    assert [(r.record_id, r.chunk_index) for r in st.chunks_of(records(spark), chunks).collect()] == [("1", 0), ("1", 1)]




def events(spark, rows):
    return spark.createDataFrame([(r, n, n, s) for n, (r, s) in enumerate(rows)], "record_id string, ts long, event_id long, status string").withColumn("ts", F.timestamp_seconds("ts"))


ROWS = [("a", "processing"), ("a", "foundation-indexed"), ("a", "loading-model"), ("b", "record-failed"), ("c", "other"), ("b", "analyzing"), ("a", "completed")]


def test_latest_mapped_event_counts(spark):
    got = {r.record_id: r.analysis_status for r in st.current_status(events(spark, ROWS[:6])).collect()}
    assert got == {"a": "indexed", "b": "synthesizing"}


def test_stream_of_events_ends_like_the_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    df = events(spark, ROWS)
    for low, high in ((0, 3), (3, 7)):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_status(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {tuple(r) for r in streamed_status(spark, str(tmp_path / "store")).collect()}
    assert got == {tuple(r) for r in st.current_status(df).collect()}


def test_batch_progress(spark):
    rows = [
        ("a", 1, "extracting-foundation", 1, 4, None, None),
        ("a", 2, "record-completed", 2, None, None, None),
        ("b", 1, "synthesizing", None, None, 512, None),
        ("c", 1, "loading-model", None, None, None, 33.0),
        ("d", 1, "record-completed", 1, 2, None, None),
        ("d", 2, "completed", 2, 2, None, None),
    ]
    df = spark.createDataFrame(rows, "batch_id string, event_id long, status string, current long, total long, token_index long, progress double")
    df = df.withColumn("ts", F.timestamp_seconds("event_id")).withColumn("token_limit", F.lit(None).cast("long"))
    got = {r.batch_id: (r.current, r.total, r.progress, r.active) for r in st.batch_progress(df).collect()}
    assert got["a"] == (2, 4, 50.0, True) and got["b"] == (0, 0, 25.0, True) and got["c"] == (0, 0, 33.0, True)
    assert got["d"] == (2, 2, 100.0, False)


