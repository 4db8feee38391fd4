import pytest
from pyspark.sql import functions as F

from caseloom.operators import cases as ca
from caseloom.sources import exports


def world(spark):
    cases = spark.createDataFrame([("c1", "One & <two>", "About", "2024-01-01"), ("c2", "Empty", None, "2024-01-02")], "id string, title string, description string, created_at string")
    members = spark.createDataFrame([("c1", "r1", " mine "), ("c1", "r2", None), ("gone", "r1", None)], "case_id string, record_id string, notes string")
    notes = spark.createDataFrame([("n1", "c1", "first", "2024-02-01"), ("n2", "c1", "second", "2024-01-15")], "id string, case_id string, body string, created_at string")
    records = spark.createDataFrame(
        [("r1", "Later", None, "2024-05", " Agency ", " sum\nmary "), ("r2", "Early", "2023", None, " ", None)],
        "id string, title string, incident_date string, release_date string, agency string, summary string",
    ).withColumn("created_at", F.lit("2020"))
    links = spark.createDataFrame([("r1", "Orb", "shape", 0.85), ("r1", "NASA", "agency", 0.8)], "record_id string, name string, entity_type string, confidence double")
    results = spark.createDataFrame([("r1", "line\n" + "é" * 2000), ("r2", " ")], "record_id string, ocr_text string")
    return cases, members, notes, records, links, results


def expected_one():
    excerpt = ("line\n> " + "é" * 2000)[:1600]
    return (
        "# One & <two>\n\nAbout\n\n## Case Summary\n\n- Case ID: `c1`\n- Created: `2024-01-01`\n- Evidence records: `2`\n"
        "- Notes: `2`\n\n## Evidence\n\n"
        "### Early\n\n- Record ID: `r2`\n- Incident Date: `2023`\n\n"
        "### Later\n\n- Record ID: `r1`\n- Agency: `Agency`\n- Release Date: `2024-05`\n- Case Notes: `mine`\n\nsum\nmary\n"
        "\nEntities:\n- agency `NASA` (0.80)\n- shape `Orb` (0.85)\n"
        f"\nAnalysis Excerpt:\n\n> {excerpt}\n\n"
        "## Investigator Notes\n\n- `2024-01-15`: second\n- `2024-02-01`: first\n"
    )


EMPTY = (
    "# Empty\n\n## Case Summary\n\n- Case ID: `c2`\n- Created: `2024-01-02`\n- Evidence records: `0`\n- Notes: `0`\n\n"
    "## Evidence\n\n## Investigator Notes\n\nNo investigator notes have been added.\n"
)


def documents(blocks, order):
    out = {}
    for r in blocks.orderBy(*order).collect():
        out[r.case_id] = out.get(r.case_id, "") + r.block
    return out


def test_dossier_text(spark):
    assert documents(ca.dossier_blocks(*world(spark)), ca.BLOCK_ORDER) == {"c1": expected_one(), "c2": EMPTY}


def test_html_is_line_wise_and_escaped(spark):
    html = documents(ca.markdown_to_html(ca.dossier_blocks(*world(spark)), world(spark)[0]), [*ca.BLOCK_ORDER, "line_no"])["c1"]
    assert html.startswith("<!doctype html>") and "<title>One &amp; &lt;two&gt;</title>" in html and html.endswith("</html>\n")
    body = html[html.index("<body>\n") + 7 : html.index("</body>")]

    def escape(text):
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    expected = ""
    for line in expected_one().splitlines():
        tags = [("# ", "h1", ""), ("## ", "h2", ""), ("### ", "h3", ""), ("- ", "p", ' class="bullet"'), ("> ", "blockquote", "")]
        for prefix, tag, more in tags:
            if line.startswith(prefix):
                expected += f"<{tag}{more}>{escape(line[len(prefix):])}</{tag}>\n"
                break
        else:
            expected += "\n" if not line.strip() else f"<p>{escape(line)}</p>\n"
    assert body == expected


TS = "2024-06-01T00:00:00+00:00"


@pytest.mark.parametrize("spread", [True, False])
def test_dossiers_are_one_file_per_export(spark, tmp_path, spread):
    """Documents that cross tasks, and documents within one, are whole; a repeated run changes nothing."""
    folder = tmp_path / "exports"
    cases = world(spark)[0]
    requests = spark.createDataFrame(
        [("c1", "Markdown"), ("c1", "html"), ("c2", "MARKDOWN"), ("c2", "markdown"), ("c2", "docx"), ("c2", None), ("gone", "html")],
        "case_id string, format string",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not spread).lower())
    try:
        for _ in range(2):
            manifest, bad = exports.export_dossiers(requests, ca.dossier_blocks(*world(spark)), cases, str(folder), TS)
            paths = {(r.case_id, r.format): r.relative_path for r in manifest.collect()}
            assert set(paths) == {("c1", "markdown"), ("c1", "html"), ("c2", "markdown")}
            assert {str(f.relative_to(folder)) for f in folder.rglob("*") if f.is_file()} == set(paths.values())
            assert (folder / paths["c1", "markdown"]).read_text(encoding="utf-8") == expected_one()
            assert (folder / paths["c2", "markdown"]).read_text(encoding="utf-8") == EMPTY
            page = documents(ca.markdown_to_html(ca.dossier_blocks(*world(spark)), cases), [*ca.BLOCK_ORDER, "line_no"])["c1"]
            assert (folder / paths["c1", "html"]).read_text(encoding="utf-8") == page
            assert sorted((r.case_id, r.format) for r in bad.filter("format is not null").collect()) == [("c2", "docx")]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert not list((tmp_path).rglob("parts.json"))


def test_a_document_larger_than_a_task(spark, tmp_path):
    """Blocks of few documents over many tasks: the parts are joined in order."""
    rows = spark.range(0, 4000, 1, 8).selectExpr("concat('d', id % 3, '/x.md') as path", "cast(id as int) as line_no", "concat('line ', id, '\\n') as block")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exports.write_documents(rows, str(tmp_path), ["line_no"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for d in range(3):
        assert (tmp_path / f"d{d}" / "x.md").read_text() == "".join(f"line {i}\n" for i in range(d, 4000, 3))
    exports.write_documents(rows.limit(0), str(tmp_path / "none"), ["line_no"])
    assert not list((tmp_path / "none").rglob("*.md"))


def test_summary_counts_do_not_multiply(spark):
    cases, members, notes, *_ = world(spark)
    got = [(r.id, r.record_count, r.note_count) for r in ca.case_summary(cases, members.union(members), notes).collect()]
    assert got == [("c2", 0, 0), ("c1", 2, 2)]


def test_timeline_order(spark):
    _, members, _, records, *_ = world(spark)
    rows = [(r.case_id, r.id, r.occurred) for r in ca.case_timeline(members, records).collect()]
    assert rows == [("c1", "r2", "2023"), ("c1", "r1", "2024-05"), ("gone", "r1", "2024-05")]


def test_members_last_note_wins_even_null(spark):
    cases, members, _, records, *_ = world(spark)
    requests = spark.createDataFrame(
        [("c1", "r1", "new", 1), ("c1", "r1", None, 2), ("c2", "r2", "x", 1), ("zz", "r1", "x", 1), ("c1", "zz", "x", 1)],
        "case_id string, record_id string, notes string, ordinal int",
    )
    merged, rejects = ca.add_members(members.filter("case_id <> 'gone'"), requests, cases, records)
    assert {(r.case_id, r.record_id): r.notes for r in merged.collect()} == {("c1", "r1"): None, ("c1", "r2"): None, ("c2", "r2"): "x"}
    assert {r.reason for r in rejects.collect()} == {"case not found: zz", "record not found: zz"}


def test_cases_and_notes_reject_blanks(spark):
    requests = spark.createDataFrame([("1", " A　", " "), ("2", " \t", "x"), ("3", "B", " d "), ("4", None, None)], "request_id string, title string, description string")
    cases, rejects = ca.create_cases(requests, "t")
    assert {(r.title, r.description) for r in cases.collect()} == {("A", None), ("B", " d ")}
    assert sorted(r.request_id for r in rejects.collect()) == ["2", "4"]
    base = world(spark)
    asked = spark.createDataFrame([("1", "c1", None, " hi "), ("2", "c1", None, " "), ("3", "no", None, "x")], "request_id string, case_id string, record_id string, body string")
    notes, rejected = ca.append_notes(base[2], asked, base[0], "2025")
    assert [r.body for r in ca.list_notes(notes).collect()] == ["second", "first", "hi"]
    assert {r.request_id: r.reason for r in rejected.collect()} == {"2": "note body is required", "3": "case not found: no"}


def test_export_manifest(spark):
    good, bad = ca.export_manifest(spark.createDataFrame([("c", "HTML"), ("c", "markdown"), ("c", "pdf")], "case_id string, format string"), "t")
    rows = {r.format: r for r in good.collect()}
    assert rows["html"].relative_path == f"c/{rows['html'].id}.html" and rows["markdown"].relative_path.endswith(".md")
    assert [r.format for r in bad.collect()] == ["pdf"]
