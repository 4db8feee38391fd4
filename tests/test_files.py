import hashlib

from pyspark.sql import functions as F

from caseloom.operators import quality as q
from caseloom.sources import files as fs
from conftest import SF


def test_artifacts_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.TXT").write_bytes(b"one")
    (tmp_path / "sub" / "b").write_bytes(b"two")
    rows = {r.original_filename: r for r in fs.artifact_catalogue(fs.read_files(spark, str(tmp_path))).collect()}
    digest = hashlib.sha256(b"one").hexdigest()
    assert rows["A.TXT"].relative_path == f"{digest[:2]}/{digest}.txt" and rows["A.TXT"].byte_size == 3
    assert "." not in rows["b"].relative_path


ARTIFACT = "id string, record_id string, sha256 string, source_url string, relative_path string, byte_size long"
INCOMING = "record_id string, sha256 string, source_url string, relative_path string, byte_size long, ordinal long"


def test_artifacts_merge_by_hash(spark):
    known = spark.createDataFrame([("a1", "r1", "h1", "u1", "p1", 1), ("a2", None, "h2", "u2", "p2", 2)], ARTIFACT)
    incoming = spark.createDataFrame(
        [
            (None, "h1", None, "p1x", 9, 1),
            ("r2", "h2", "n2", "p2", 9, 2),
            ("r3", "h3", None, "p3", 3, 3),
            ("r4", "h3", "n3", "p3.pdf", 3, 4),
            (None, "h3", None, "p3", 3, 5),
        ],
        INCOMING,
    )
    merged, paths = fs.merge_artifacts(known, incoming)
    got = {r.sha256: (r.record_id, r.source_url, r.relative_path, r.byte_size) for r in merged.collect()}
    assert got == {"h1": ("r1", "u1", "p1", 1), "h2": ("r2", "n2", "p2", 2), "h3": ("r4", "n3", "p3", 3)}
    assert {r.record_id: r.local_path for r in paths.collect()} == {"r2": "p2", "r3": "p3", "r4": "p3.pdf"}
    skipped = {r.ordinal: r.skipped_existing for r in fs.arrivals(known, incoming).collect()}
    assert skipped == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_manual_and_web_records(spark):
    files = spark.createDataFrame([("/x/Report.final.PDF", " ", "n"), ("/x/plain", "Given ", None)], "path string, title string, notes string")
    rows = {r.title: r for r in fs.records_from_files(files, "t").collect()}
    assert set(rows) == {"Report.final", "Given"}
    assert rows["Report.final"].file_type == "pdf" and rows["Report.final"].summary == "n" and rows["Given"].file_type is None
    assert rows["Given"].stable_key == rows["Given"].content_hash == "manual:" + rows["Given"].id
    page = fs.records_from_pages(spark.createDataFrame([("http://x",)], "url string"), "t").head()
    assert page.title == page.document_url == "http://x" and page.file_type == "txt" and page.stable_key == "web:" + page.id


def test_text_by_extension(spark):
    rows = [("a.txt", b"ok"), ("b.MD", b"\xff\xfe"), ("c.pdf", b"%"), ("d.exe", b"x"), ("e", b"x")]
    got = {r.path: (r.text, r.engine, r.error) for r in fs.read_text_assets(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"] == ("ok", "text-file", None)
    assert got["b.MD"][0] is None and "UTF-8" in got["b.MD"][2]
    assert got["c.pdf"][2] == "needs external text: pdf" and got["d.exe"][2] == "unsupported type `exe`" and got["e"][2]
    outside = spark.createDataFrame([("c.pdf", "read elsewhere", "vision")], "path string, text string, engine string")
    base = fs.read_text_assets(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path: r.text for r in fs.attach_texts(base, outside).collect()}["c.pdf"] == "read elsewhere"


def test_pages_keep_scripts_and_drop_blank_nodes(spark):
    html = '<html><head><title> A&amp;B </title><script>var t="</p>";</script></head><body> <p>x<b>y</b>\n</p><!-- c -->z</body></html>'
    df = spark.createDataFrame([(1, "http://u", html), (2, "http://v", None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in fs.pages_to_text(df).collect()}
    assert got[1] == 'Source URL: http://u\n\nA&B\nvar t="</p>";\nx\ny\nz\n'
    assert got[2] == "Source URL: http://v\n\n"


def test_every_page_gives_one_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = fs.pages_to_text(pages)
    assert texts.count() == pages.count()
    # all fixture pages carry a script, whose text stays
    assert texts.filter(~F.col("text").contains("track(")).count() == 0


def test_duplicates_keep_the_best_and_count_officials_only(spark):
    rows = [
        ("1", "T", "u", "official", None, "k"),
        ("2", "T", "u", "official", "completed", "k"),
        ("3", "T", "u", "manual", "completed", "url:x|title:t"),
        ("4", "S", "u", "official", None, "k"),
        ("5", "S", "u", "manual", None, "k"),
        ("6", "N", None, "official", None, "k"),
        ("7", "N", None, "official", None, "k"),
        ("8", "E", "", "official", None, "k|title:x"),
        ("9", "E", "", "official", None, "k"),
    ]
    df = spark.createDataFrame(rows, "id string, title string, document_url string, source_type string, analysis_status string, stable_key string")
    assert sorted(r.id for r in q.drop_duplicate_records(df).collect()) == ["3", "4", "5", "6", "7", "8"]


def test_integrity_counts_rows_of_the_join(spark):
    records = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("3", "p3"), ("4", None), ("5", "p5")], "id string, local_path string")
    artifacts = spark.createDataFrame([("1", "h1"), ("1", "hx"), ("2", "h2"), ("5", "h5")], "record_id string, sha256 string")
    files = spark.createDataFrame([("p1", "h1"), ("p3", "h3"), ("p5", None)], "local_path string, file_hash string")
    assert tuple(q.verify_integrity(records, artifacts, files).head()) == (5, 2, 2, 1)


def test_clear_analysis_of_all_and_of_some(spark):
    tables = {
        "records": spark.createDataFrame([("1", "completed", "{}", 0.5), ("2", None, "{}", 0.5)], "id string, analysis_status string, intelligence_json string, redaction_score double"),
        "analysis_chunks": spark.createDataFrame([("c1", "1"), ("c2", "2")], "id string, record_id string"),
        "chunk_vectors": spark.createDataFrame([("c1", [1.0]), ("c2", [1.0])], "chunk_id string, embedding array<float>"),
        "record_assets": spark.createDataFrame([("a", "1", "source"), ("b", "1", "image"), ("c", "2", "image")], "id string, record_id string, asset_type string"),
        "fragments": spark.createDataFrame([("f", "1")], "id string, record_id string"),
    }
    some = q.clear_analysis(tables, spark.createDataFrame([("1",)], "id string"))
    assert {r.id: (r.analysis_status, r.intelligence_json) for r in some["records"].collect()} == {"1": ("pending", None), "2": (None, "{}")}
    assert [r.id for r in some["analysis_chunks"].collect()] == ["c2"]
    assert [r.chunk_id for r in some["chunk_vectors"].collect()] == ["c2"]
    assert sorted(r.id for r in some["record_assets"].collect()) == ["a", "c"]
    assert some["fragments"].count() == 1
    everything = q.clear_analysis(tables)
    assert everything["chunk_vectors"].count() == 0 and everything["fragments"].count() == 1
    assert [r.id for r in everything["record_assets"].collect()] == ["a"]
    assert {r.analysis_status for r in everything["records"].collect()} == {"pending"}


def test_job_progress_edges(spark):
    jobs = spark.createDataFrame([("a", "running", 0, 0), ("b", "running", 4, 2), ("c", "running", 2, 2)], "id string, status string, total long, skipped long")
    items = spark.createDataFrame([("b", "completed"), ("b", "failed")], "job_id string, status string")
    got = {r.job_id: (r.progress, r.status) for r in q.job_rollup(items, jobs).collect()}
    assert got == {"a": (0.0, "completed"), "b": (100.0, "completed_with_errors"), "c": (None, "completed")}
