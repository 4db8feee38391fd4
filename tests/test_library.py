"""Streamed hashes and the content library."""

import hashlib
import tracemalloc

from caseloom.sources import library as lib


def world(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    bodies = {"a.PDF": b"same", "sub/b.pdf": b"same", "c": b"", "big.bin": bytes(range(256)) * 4000}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    return folder, bodies


def test_hashes_are_read_in_pieces(spark, tmp_path):
    folder, bodies = world(tmp_path)
    found = lib.hash_files(lib.list_files(spark, str(folder)), piece=1000).collect()
    assert {(r.path.split("/in/")[1], r.sha256, r.byte_size) for r in found} == {(n, hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items()}
    assert {r.path.split("/in/")[1]: r.byte_size for r in lib.list_files(spark, str(folder)).collect()} == {n: len(b) for n, b in bodies.items()}
    (folder / "_SUCCESS").write_bytes(b"x")
    assert {r.path.split("/in/")[1] for r in lib.list_files(spark, str(folder), "*.pdf").collect()} == {"sub/b.pdf"}
    assert lib.list_files(spark, str(folder)).count() == 4 and lib.list_files(spark, str(tmp_path / "no")).count() == 0
    gone = spark.createDataFrame([(str(tmp_path / "none.txt"), "kept"), (None, "too")], "path string, note string")
    assert sorted((r.note, r.sha256, r.byte_size) for r in lib.hash_files(gone).collect()) == [("kept", None, None), ("too", None, None)]


def test_library_keeps_each_content_once(spark, tmp_path):
    folder, bodies = world(tmp_path)
    library = tmp_path / "library"
    files = lib.list_files(spark, str(folder))
    more = files.select("path").unionByName(spark.createDataFrame([(str(tmp_path / "gone.txt"),)], "path string"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in lib.store_files(more, str(library), piece=1000).collect()}
    assert {n: r.is_new for n, r in rows.items()} == {"a.PDF": True, "b.pdf": False, "c": True, "big.bin": True, "gone.txt": False}
    assert rows["a.PDF"].relative_path == rows["b.pdf"].relative_path and rows["gone.txt"].relative_path is None
    held = {str(p.relative_to(library)): p.read_bytes() for p in library.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ends = {"a.PDF": ".pdf", "c": "", "big.bin": ".bin"}
    assert held == {f"{digest(bodies[n])[:2]}/{digest(bodies[n])}{e}": bodies[n] for n, e in ends.items()}
    times = {p: p.stat().st_mtime_ns for p in library.rglob("*") if p.is_file()}
    assert not any(r.is_new for r in lib.store_files(more, str(library)).collect())
    assert times == {p: p.stat().st_mtime_ns for p in library.rglob("*") if p.is_file()}
    seen = {r.local_path: r.file_hash for r in lib.stored_hashes(spark, str(library)).collect()}
    assert seen == {path: digest(body) for path, body in held.items()}


def test_no_files(spark, tmp_path):
    nothing = spark.createDataFrame([], "path string")
    assert lib.store_files(nothing, str(tmp_path)).count() == 0


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    folder = tmp_path / "flat"
    (folder / "below" / "deep").mkdir(parents=True)
    (folder / "_gone").mkdir()
    names = [*(f"d{i}.txt" for i in range(20_000)), "below/x.txt", "below/deep/y.txt"]
    for name in [*names, "_gone/z.txt", "below/.hidden", "below/other.csv"]:
        (folder / name).touch()
    lib.list_files(spark, str(folder / "below")).count()
    tracemalloc.start()
    try:
        found = lib.list_files(spark, str(folder), "*.txt")
        assert found.count() == len(names) and tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()
    assert {r.path for r in found.collect()} == {f"file://{folder}/{n}" for n in names}


def test_lists_of_files_are_broadcast_by_measured_size_only(spark, tmp_path):
    for i in range(500):
        (tmp_path / f"{i}.txt").write_bytes(b"x")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        seen = lib.hash_files(lib.list_files(spark, str(tmp_path)).select("path"))
        assert [r.byte_size for r in seen.collect()] == [1] * 500
        # the plan as it ran in the end, sizes known
        assert "BroadcastHashJoin" not in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_tasks_do_not_grow_without_end(spark, monkeypatch):
    monkeypatch.setattr(lib, "FILES_PER_TASK", 2)
    monkeypatch.setattr(lib, "MOST_TASKS", 4, raising=False)
    paths = lambda n: lib._dealt(spark.range(n).selectExpr("string(id) as path")).rdd.getNumPartitions()
    assert [paths(n) for n in (0, 3, 100)] == [1, 2, 4]
