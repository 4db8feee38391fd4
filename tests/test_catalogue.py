import os
from itertools import count

import pytest
from pyspark.sql import functions as F

from caseloom.operators import catalogue as cat, changes as chg
from caseloom.schemas import CATALOGUE, RECORDS, SNAPSHOT_ROWS
from caseloom.sources import catalogue as src, files as fs, sinks
from caseloom.streaming.catalogue import stream_catalogue

HEADER = " title ,Agency,RELEASE DATE,PDF | Image Link,Description Blurb"


def write(folder, name, text, mode="w"):
    path = os.path.join(folder, name)
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as out:
        out.write(text)
    return path


def read(spark, path):
    return {r.title: r for r in src.read_catalogue_csv(spark, path).collect()}


def test_csv_rows_of_every_kind(spark, tmp_path):
    text = "﻿" + HEADER + "\n"
    text += '"Two\nlines",  A ,2024,http://ex.org/a b,"say ""hi"", ok"\n'
    text += "Short,B\n"
    text += "Long,C,2024,,x,extra,more\n"
    text += "   ,nobody,,,\n"
    text += "Cable 001,D,2024,https://ex.org/1,first\n"
    text += "Cable 1,D,2024,https://ex.org/1,second\n"
    rows = read(spark, write(tmp_path, "c.csv", text))
    assert set(rows) == {"Two\nlines", "Short", "Long", "Cable 001"}
    assert rows["Two\nlines"].document_url == "http://ex.org/a%20b"
    assert rows["Two\nlines"].summary == 'say "hi", ok' and rows["Two\nlines"].agency == "A"
    assert rows["Short"].release_date is None and rows["Long"].summary == "x"
    assert rows["Cable 001"].summary == "first"
    assert rows["Cable 001"].stable_key == "url:https://ex.org/1|title:cable 1"
    assert rows["Short"].stable_key.startswith("meta:") and rows["Short"].redaction is None


def test_files_of_a_release_have_their_own_headers(spark, tmp_path):
    write(tmp_path, "b.csv", "Title,Agency,PDF | Image Link\n" + "Two,FBI,https://ex.org/2\n" + "Same,late,https://ex.org/s\n" + '"x\ny",B,\n' * 400)
    write(tmp_path, "a.csv", "\ufeff agency ,unknown,TITLE,Title,pdf | image link\n" + "NASA,u,old,One,https://ex.org/1\n" + "first,u,,Same,https://ex.org/s\n")
    rows = read(spark, str(tmp_path))
    assert set(rows) == {"One", "Two", "Same", "x\ny"}
    assert (rows["One"].agency, rows["Two"].agency, rows["x\ny"].agency) == ("NASA", "FBI", "B")
    # the larger file comes first in a scan, the first one by path still wins
    assert rows["Same"].agency == "first" and rows["Same"].file.endswith("a.csv")


def test_a_header_may_have_any_number_of_columns(spark, tmp_path):
    text = ",".join([*[f'"c,{i}"' for i in range(300)], "Title"]) + "\n" + "," * 300 + "Wide,more\n"
    assert set(read(spark, write(tmp_path, "w.csv", text))) == {"Wide"}


def test_derived_ids_tell_keys_apart(spark):
    from caseloom.operators.common import derived_id

    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), (None, "a"), ("a\\", "b"), ("a", "\\N"), ("a\\|b", "c")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert len({r[0] for r in df.select(derived_id("k", "x", "y")).collect()}) == len(rows)


def test_release_without_usable_rows_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        src.read_catalogue_csv(spark, write(tmp_path, "c.csv", HEADER + "\n ,a,b,,\n"))


def test_error_pages_are_split_off(spark):
    rows = [(b"<!DOCTYPE html>" + b"x" * 300,), (b"<html>",), (b"<Html>",), (b"Title\n",), ("<HTML>" + "é" * 200,)]
    df = spark.createDataFrame([(bytes(r[0], "utf-8") if isinstance(r[0], str) else r[0],) for r in rows], "content binary")
    good, bad = src.split_html_payloads(df)
    assert sorted(bytes(r.content) for r in good.collect()) == [b"<Html>", b"Title\n"]
    samples = sorted(len(r["sample"]) for r in bad.collect())
    assert samples == [6, 6 + 97, 200]


def test_content_hash_sees_every_field_and_null(spark):
    one = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert len({r[0] for r in one.select(cat.content_hash(["x", "y"])).collect()}) == 3
    swapped = one.select("y", "x").select(cat.content_hash(["y", "x"]))
    assert {r[0] for r in swapped.collect()} == {r[0] for r in one.select(cat.content_hash(["x", "y"])).collect()}


def test_later_equal_header_counts(spark):
    df = spark.createDataFrame([("1", "2")], ["Agency", " AGENCY "])
    row = cat.conform_columns(df).head()
    assert row.agency == "2" and len(row) == 16


def rows(spark, pairs):
    return spark.createDataFrame(
        [(k, h, f"T{k}", f"u{k}") for k, h in pairs], "stable_key string, content_hash string, title string, document_url string"
    )


def test_diff_kinds_and_titles(spark):
    prev, cur = rows(spark, [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]), rows(spark, [("b", "2"), ("c", "1"), ("e", "1")])
    records = spark.createDataFrame(
        [("a", "official", "Known"), ("a", "manual", "No"), ("d", "manual", "No")], "stable_key string, source_type string, title string"
    )
    diff = chg.snapshot_diff(prev, cur, records)
    got = {r.stable_key: (r.change_type, r.title, r.document_url, r.previous_hash, r.current_hash) for r in diff.collect()}
    assert got == {
        "a": ("removed", "Known", None, "1", None),
        "b": ("changed", "Tb", "ub", "1", "2"),
        "d": ("removed", "d", None, "1", None),
        "e": ("added", "Te", "ue", None, "1"),
    }
    assert tuple(chg.sync_report(diff, cur).head()) == (3, 1, 1, 2)


def test_diff_applied_to_the_old_rows_gives_the_new(spark):
    prev, cur = rows(spark, [(str(i), str(i % 3)) for i in range(50)]), rows(spark, [(str(i), str(i % 4)) for i in range(25, 90)])
    state = {r.stable_key: r.content_hash for r in prev.collect()}
    for r in chg.snapshot_diff(prev, cur).collect():
        if r.change_type == "removed":
            del state[r.stable_key]
        else:
            state[r.stable_key] = r.current_hash
    assert state == {r.stable_key: r.content_hash for r in cur.collect()}


def record(**values):
    return tuple(values.get(f.name) for f in RECORDS.fields)


def test_upsert_keeps_identity_and_marks_the_missing(spark):
    records = spark.createDataFrame(
        [
            record(id="1", stable_key="a", source_type="official", title="old", local_path="p", analysis_status="completed", removed_from_source_at="t0", created_at="t0", updated_at="t0"),
            record(id="2", stable_key="b", source_type="official", title="b", created_at="t0", updated_at="t0"),
            record(id="3", stable_key="c", source_type="official", title="c", removed_from_source_at="t0", updated_at="t0"),
            record(id="4", stable_key="a", source_type="manual", title="m"),
        ],
        RECORDS,
    )
    cur = rows(spark, [("a", "9"), ("n", "9")])
    out = chg.upsert_records(records, cur, "s9", "t9")
    got = {(r.stable_key, r.source_type): r for r in out.collect()}
    assert len(got) == 5
    a = got["a", "official"]
    assert (a.id, a.title, a.local_path, a.analysis_status, a.removed_from_source_at) == ("1", "Ta", "p", "completed", None)
    assert (a.updated_at, a.created_at, a.source_snapshot_id, a.content_hash) == ("t9", "t0", "s9", "9")
    assert got["b", "official"].removed_from_source_at == "t9" and got["b", "official"].updated_at == "t9"
    assert got["c", "official"].removed_from_source_at == "t0" and got["c", "official"].updated_at == "t0"
    assert got["n", "official"].analysis_status == "pending" and got["n", "official"].created_at == "t9"
    assert got["a", "manual"].title == "m"
    twice = {tuple(r) for r in chg.upsert_records(out, cur, "s9", "t9").collect()}
    assert twice == {tuple(r) for r in out.collect()}


def test_change_feed_equals_diffs_one_by_one(spark):
    history = [(n, str(k), str((n * k) % 3)) for n in range(1, 6) for k in range(20) if (n + k) % 4]
    df = spark.createDataFrame(history, "snapshot_no long, stable_key string, content_hash string")
    feed = {(r.snapshot_no, r.stable_key): (r.change_type, r.previous_hash, r.current_hash) for r in chg.change_feed(df).collect()}
    expected, before = {}, {}
    for n in range(1, 6):
        now = {k: h for m, k, h in history if m == n}
        for k in before.keys() | now.keys():
            old, new = before.get(k), now.get(k)
            if old != new:
                kind = "added" if old is None else "removed" if new is None else "changed"
                expected[n, k] = (kind, old, new)
        before = now
    assert feed == expected


def test_snapshots_are_numbered_per_source(spark):
    manifest = spark.createDataFrame(
        [("x", "s", "2", "completed"), ("y", "s", "1", "completed"), ("z", "s", "0", "failed"), ("w", "t", "5", "completed")],
        "id string, source_name string, fetched_at string, status string",
    )
    assert {r.id: r.snapshot_no for r in chg.number_snapshots(manifest).collect()} == {"y": 1, "x": 2, "w": 1}
    assert chg.latest_snapshot(manifest, "s").head().id == "x"


def test_manifest_of_files(spark, tmp_path):
    write(tmp_path, "a.csv", HEADER + "\nOne,A,,,\nTwo,A,,,\n")
    rows_read = src.read_catalogue_csv(spark, str(tmp_path))
    manifest = src.snapshot_manifest(fs.read_files(spark, str(tmp_path), "*.csv"), rows_read, "s", "u", "2024-05-01T00").collect()
    assert [(r.record_count, r.status, r.release_label) for r in manifest] == [(2, "completed", "Catalogue sync 2024-05-01")]
    assert len(src.snapshot_rows(rows_read, "s1").select(*SNAPSHOT_ROWS.fieldNames()).collect()) == 2


def test_versions_and_pointer(spark, tmp_path):
    table = str(tmp_path / "t")
    assert sinks.current_version(spark, table) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, table)
    for n in count(1):
        assert sinks.write_version(spark.range(n), table, ["id"]) == n
        assert sinks.read_version(spark, table).count() == n
        if n == 3:
            break
    assert sinks.versions(spark, table) == [1, 2, 3] and sinks.read_version(spark, table, 2).count() == 2


def test_stream_follows_the_releases(spark, tmp_path):
    landing, store, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "checkpoint"))
    os.mkdir(landing)
    releases = [
        HEADER + "\nOne,A,,https://ex.org/1,x\nTwo,A,,https://ex.org/2,x\n",
        "<html>denied</html>",
        HEADER + "\nTwo,A,,https://ex.org/2,changed\nThree,A,,https://ex.org/3,x\n",
    ]
    for n, text in enumerate(releases):
        write(landing, f"r{n}.csv", text)
        os.utime(os.path.join(landing, f"r{n}.csv"), (1_700_000_000 + n, 1_700_000_000 + n))
    stream_catalogue(spark, landing, store, checkpoint).awaitTermination()
    records = {r.title: r.removed_from_source_at for r in sinks.read_version(spark, f"{store}/records").collect()}
    assert set(records) == {"One", "Two", "Three"}
    assert records["One"] is not None and records["Two"] is None and records["Three"] is None
    diffs = {(r.title, r.change_type) for r in sinks.read_version(spark, f"{store}/diffs").collect()}
    assert diffs == {("One", "removed"), ("Two", "changed"), ("Three", "added")}
    assert sorted(r.title for r in sinks.read_version(spark, f"{store}/worklist").collect()) == ["One", "Three", "Two"]
    # nothing new: nothing changes
    stream_catalogue(spark, landing, store, checkpoint).awaitTermination()
    assert sinks.versions(spark, f"{store}/records") == [1, 3]


def test_catalogue_schema_has_sixteen_text_columns():
    assert len(CATALOGUE) == 16 and {f.dataType.simpleString() for f in CATALOGUE} == {"string"}


def test_conformed_values_are_trimmed(spark):
    df = spark.createDataFrame([("　x ",)], "Title string")
    assert cat.conform_columns(df).select(F.col("title")).head()[0] == "x"
