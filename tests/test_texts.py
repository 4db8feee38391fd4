import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions.embedding import hash_vector
from caseloom.operators import texts as tx
from caseloom.plans.indexing import IndexTables, run_index
from conftest import SF


def model_chunks(text, target=1200):
    chunks, current = [], ""
    for line in text.split("\n"):
        if len(current.encode()) + len(line.encode()) > target and current.strip():
            chunks.append(current.strip())
            current = ""
        current += line + "\n"
    if current.strip():
        chunks.append(current.strip())
    return chunks


def model_vector(text, dims=384):
    vector, tokens = np.zeros(dims), [t for t in re.split(r"[^\w]|_", text) if t]
    if not tokens:
        vector[0] = 1.0
        return vector
    for token in tokens:
        raw = "".join(c.lower() if c.isascii() else c for c in token).encode()
        digest = hashlib.sha256(raw).digest()
        for i in range(0, 32, 4):
            sign = 1.0 if digest[i + 2] % 2 == 0 else -1.0
            vector[int.from_bytes(digest[i : i + 2], "little") % dims] += sign * (1.0 + math.log(len(raw)))
    return vector / np.linalg.norm(vector)


def test_chunks_equal_the_model_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {}
    for row in tx.chunk_text(docs).collect():
        got.setdefault(row.doc_id, {})[row.chunk_index] = row.chunk
    for doc in docs.collect():
        mine = got.get(doc.doc_id, {})
        assert [mine[i] for i in range(len(mine))] == model_chunks(doc.text)


@pytest.mark.parametrize(
    "text", ["", " \n\t\n", "a\n\nb", "x" * 3000, "é" * 599 + "\n" + "b" * 10, "a" * 1199 + "\nb", "a\n" * 900, " q "]
)
def test_chunk_edges(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = [r.chunk for r in tx.chunk_text(df).orderBy("chunk_index").collect()]
    assert got == model_chunks(text)


def test_vectors_equal_the_model(spark):
    texts = ["AARO sensor", "", "!!! --", "Étage Étage über 42 x²", "the The THE", "a" * 5000, "one two\nthree_four"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", hash_vector(F.col("t"), 384).alias("v")).collect()
    for row in rows:
        assert len(row.v) == 384
        assert np.allclose(row.v, model_vector(texts[row.i]), atol=1e-12)
        assert abs(np.linalg.norm(row.v) - 1.0) < 1e-9


def test_vectors_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {r.doc_id: r.embedding for r in tx.hash_embed(docs, ["doc_id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r.doc_id: r.embedding for r in tx.hash_embed(docs, ["doc_id"]).collect()}
    assert small.keys() == whole.keys()
    assert all(np.allclose(small[k], whole[k], atol=1e-12) for k in whole)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(np.allclose(whole[k], model_vector(texts[k]), atol=1e-9) for k in whole)


def test_mean_pool_takes_the_first_and_divides_by_their_number(spark):
    rows = [(g, i, [float(i), 1.0]) for g in ("a", "b") for i in range(5 if g == "a" else 2)]
    df = spark.createDataFrame(rows, "g string, i int, embedding array<float>")
    got = {r.g: r.embedding for r in tx.mean_pool(df, "g", "i", limit=3).collect()}
    assert got == {"a": [1.0, 1.0], "b": [0.5, 1.0]}


def hits(spark, text, dictionary=None):
    df = spark.createDataFrame([("r", text)], "record_id string, text string")
    return [(r.name, r.entity_type) for r in tx.extract_entities(df, dictionary=dictionary).collect()]


def test_entities_of_the_default_dictionary(spark):
    assert {n for n, _ in hits(spark, "The AARO and NASA are investigating. The FBI is not.")} == {"AARO", "NASA", "FBI"}
    shapes = hits(spark, "Observed a tic-tac shaped object and a sphere.")
    assert [t for _, t in shapes] == ["shape", "shape"]
    assert hits(spark, "Incident occurred on 2024-05-12.") == [("2024-05-12", "date")]


def test_entities_keep_the_first_form_and_respect_unicode_words(spark):
    assert hits(spark, "Orb orb ORB") == [("Orb", "shape")]
    assert hits(spark, "éir irë ir_ x") == []
    assert hits(spark, "IR,flir radar") == [("flir", "sensor"), ("IR", "sensor"), ("radar", "sensor")]
    assert hits(spark, "a+b a", {"k": ["a+b"]}) == [("a+b", "k")]


def test_entity_dimension_is_case_sensitive_and_keeps_ids(spark):
    known = spark.createDataFrame([("e1", "Orb", "shape", "old")], "id string, name string, entity_type string, description string")
    found = spark.createDataFrame(
        [("r1", "Orb", "shape", 0.85, "new"), ("r2", "orb", "shape", 0.85, "new")],
        "record_id string, name string, entity_type string, confidence double, source string",
    )
    first = tx.upsert_entities(known, found)
    rows = {r.name: r for r in first.collect()}
    assert rows["Orb"].id == "e1" and rows["Orb"].description == "new" and set(rows) == {"Orb", "orb"}
    again = {(r.id, r.name) for r in tx.upsert_entities(first, found).collect()}
    assert again == {(r.id, r.name) for r in rows.values()}


def index_tables(spark):
    records = spark.createDataFrame(
        [
            ("1", "One", "p1", None, None, None),
            ("2", "Two", "p2", "pending", None, None),
            ("3", "Three", "p3", "completed", None, 0.5),
            ("4", "Four", None, "pending", None, None),
            ("5", "Five", "p5", "failed", "old", None),
        ],
        "id string, title string, local_path string, analysis_status string, analysis_error string, redaction_score double",
    )
    empty = lambda ddl: spark.createDataFrame([], ddl)
    chunk = "id string, record_id string, chunk_index long, text string, engine_name string, model_version string, created_at string"
    return IndexTables(
        records=records,
        entities=empty("id string, name string, entity_type string, description string"),
        links=spark.createDataFrame([("1", "gone", 1.0), ("3", "kept", 1.0)], "record_id string, entity_id string, confidence double"),
        chunks=spark.createDataFrame([("c-old", "1", 0, "old", "e", "v", "t")], chunk),
        vectors=spark.createDataFrame([("c-old", [1.0]), ("c-other", [2.0])], "chunk_id string, embedding array<float>"),
        search_documents=empty("chunk_id string, record_id string, title string, text string, entities string"),
        results=empty("record_id string, ocr_text string, status string, processed_at string"),
    )


@pytest.mark.parametrize("staged", [False, True])
def test_index_pass_replaces_and_survives_bad_records(spark, tmp_path, staged):
    texts = spark.createDataFrame(
        [("1", "NASA saw an orb", None), ("2", None, None), ("5", None, "cannot read")],
        "record_id string, text string, error string",
    )
    out = run_index(index_tables(spark), texts, "now", staging=str(tmp_path / "stage") if staged else None)
    status = {r.id: (r.analysis_status, r.analysis_error) for r in out.records.collect()}
    assert status == {
        "1": ("indexed", None),
        "2": ("failed", "no text extracted"),
        "3": ("completed", None),
        "4": ("pending", None),
        "5": ("failed", "cannot read"),
    }
    assert [(r.record_id, r.text, r.engine_name) for r in out.chunks.collect()] == [("1", "NASA saw an orb", "bge-small")]
    assert [r.entities for r in out.search_documents.collect()] == ["NASA orb"]
    ids = {r.chunk_id for r in out.vectors.collect()}
    assert "c-old" not in ids and "c-other" in ids and len(ids) == 2
    links = {(r.record_id, r.confidence) for r in out.links.collect()}
    assert links == {("1", 0.85), ("3", 1.0)}
    assert {r.record_id: r.status for r in out.results.collect()} == {"1": "indexed"}


def test_targets_count_missing_status(spark):
    records = index_tables(spark).records
    pick = lambda stage: sorted(r.id for r in tx.select_targets(records, stage).collect())
    assert pick("index") == ["1", "2", "5"]
    assert pick("reprocess") == ["1", "2", "3", "5"]
    assert pick("synthesise") == []
    assert tuple(tx.target_counts(records, "index").head()) == (3, 1)
    with pytest.raises(ValueError):
        tx.select_targets(records, "other")
