import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import neighbours, search as se, texts as tx
from conftest import SF


def brute(queries, items, k, metric):
    out = set()
    for qid, q in queries:
        scored = []
        for iid, v in items:
            cosine = round(1 - np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v)), 6) + 0.0
            rank = cosine if metric == "cosine" else round(float(np.linalg.norm(q - v)), 6)
            scored.append((rank, iid, cosine))
        out |= {(qid, iid, cosine) for _, iid, cosine in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("chunk, per_pivot", [(16384, 512), (7, 512), (7, 10)])
def test_nearest_equals_brute_force(spark, monkeypatch, metric, chunk, per_pivot):
    monkeypatch.setattr(neighbours, "PER_PIVOT", per_pivot)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 5)) + np.repeat(8 * rng.normal(size=(6, 5)), 10, axis=0)
    items = [(f"i{n % 90:03d}-{n}", base[n % 60]) for n in range(150)]  # many exact ties
    queries = [(n, rng.normal(size=5)) for n in range(20)]
    frame = lambda rows, ddl: spark.createDataFrame([(i, v.tolist()) for i, v in rows], ddl)
    got = se.nearest(
        frame(queries, "query_id long, embedding array<double>"),
        frame(items, "item_id string, embedding array<double>").repartition(5),
        4,
        metric,
        chunk,
    )
    assert {(r.query_id, r.item_id, r.distance) for r in got.collect()} == brute(queries, items, 4, metric)


def test_nearest_with_nothing_to_find(spark):
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    items = spark.createDataFrame([], "item_id string, embedding array<float>")
    assert se.nearest(queries, items).count() == 0
    assert se.nearest(queries.limit(0), items).count() == 0


def test_bounds_leave_cells_out_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_PIVOT", 20)
    rng = np.random.default_rng(4)
    spots = 20 * rng.normal(size=(12, 6))
    rows = [(n, (spots[n % 12] + rng.normal(size=6)).tolist()) for n in range(600)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:40], "query_id long, embedding array<double>")
    for metric in ("cosine", "l2"):
        index = neighbours.build_index(items, 3, metric, chunk=16)
        asked = index.cells.candidates(np.array([r[1] for r in rows[:40]]), 3, np.full(40, np.nan))
        assert asked.any(axis=1).all() and asked.mean() < 0.6  # most cells are not asked
        got = {(r.query_id, r.item_id, r.distance) for r in se.nearest(queries, index, 3, metric).collect()}
        assert got == brute([(i, np.array(v)) for i, v in rows[:40]], [(i, np.array(v)) for i, v in rows], 3, metric)


def test_zero_vectors_repeated_queries_and_bounds(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [2.0, 0.0])], "item_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])] * 30 + [(2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.item_id, r.distance) for r in se.nearest(queries, items, 3).collect())
    assert got == [(1, 1, 1.0), (1, 2, 0.0), (1, 5, 0.0), (2, 1, 1.0), (2, 2, 1.0), (2, 3, 1.0)]
    near = se.nearest(queries.withColumn("bound", F.lit(0.5)), items, 3, "l2").collect()
    assert sorted((r.query_id, r.item_id) for r in near) == [(1, 2), (2, 1)]


def corpus(spark):
    records = spark.createDataFrame(
        [("1", "Alpha", "official", "p"), ("2", "Beta", "manual", None), ("3", "Gamma", "official", None)],
        "id string, title string, source_type string, local_path string",
    )
    for c in ("agency", "release_date", "document_url", "intelligence_json"):
        records = records.withColumn(c, F.lit(None).cast("string"))
    texts = [("1", 0, "red orb over water"), ("1", 1, "nothing here"), ("2", 0, "red orb"), ("3", 0, "blue disc 100%")]
    chunks = spark.createDataFrame([(f"{r}-{i}", r, i, t) for r, i, t in texts], "id string, record_id string, chunk_index long, text string")
    vectors = tx.hash_embed(chunks.withColumnRenamed("id", "chunk_id"), ["chunk_id"])
    artifacts = spark.createDataFrame([("1", "h1"), ("1", "h2")], "record_id string, sha256 string")
    members = spark.createDataFrame([("c", "2"), ("c", "2x")], "case_id string, record_id string")
    return chunks, vectors, records, artifacts, members


def ask(spark, text):
    return tx.hash_embed(spark.createDataFrame([(0, text)], "query_id long, text string"), ["query_id"])


def test_search_fans_out_artifacts_and_orders_by_distance(spark):
    chunks, vectors, records, artifacts, members = corpus(spark)
    rows = se.vector_search(ask(spark, "red orb"), chunks, vectors, records, artifacts, members, k=2).collect()
    best = sorted((r.distance, r.id, r.artifact_sha256) for r in rows)
    assert best[0] == (0.0, "2", None) and {b[1:] for b in best[1:]} == {("1", "h1"), ("1", "h2")}


def test_filters_after_the_k_nearest_may_leave_fewer(spark):
    chunks, vectors, records, artifacts, members = corpus(spark)
    find = lambda **o: {r.chunk_id for r in se.vector_search(ask(spark, "red orb"), chunks, vectors, records, artifacts, members, **o).collect()}
    assert find(k=1, filters=se.Filters(source_type="official")) == set()
    assert find(k=1, filters=se.Filters(source_type="official"), filter_mode="pre") == {"1-0"}
    assert find(k=2, filters=se.Filters(local_only=True)) == {"1-0"}
    assert find(k=4, filters=se.Filters(case_id="c")) == {"2-0"}
    assert find(k=1, filters=se.Filters(case_id="c"), filter_mode="pre") == {"2-0"}
    with pytest.raises(ValueError):
        find(filter_mode="other")


def test_keyword_search(spark):
    chunks, vectors, records, artifacts, members = corpus(spark)
    find = lambda q, **o: [(r.id, r.chunk_index, r.artifact_sha256) for r in se.keyword_search(q, chunks, records, artifacts, members, **o).collect()]
    assert find("ALPHA") == [("1", 0, "h1"), ("1", 0, "h2"), ("1", 1, "h1"), ("1", 1, "h2")]
    assert find("red_orb", k=1) == [("1", 0, "h1")]
    assert find("ORB", filters=se.Filters(case_id="c")) == [("2", 0, None)]
    assert find("100%") == [("3", 0, None)] and find("zzz") == []


def test_search_falls_back_only_without_vectors(spark):
    chunks, vectors, records, artifacts, members = corpus(spark)
    embed = lambda df: tx.hash_embed(df, ["query_id"])
    results, total = se.search("Alpha", embed, chunks, None, records, artifacts)
    assert total.head()[0] == results.count() == 4
    results, total = se.search("Alpha", embed, chunks, vectors.limit(0), records, artifacts)
    assert total.head()[0] == 0


def test_fragments_by_record_within_and_after(spark):
    fragments = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("c", "2", "z")], "id string, record_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.1])], "fragment_id string, embedding array<float>")
    queries = spark.createDataFrame([("1", [0.9, 0.3]), ("2", [0.0, 1.0])], "record_id string, embedding array<double>")
    find = lambda **o: {(r.record_id, r.fragment_id) for r in se.fragment_search_by_record(queries, fragments, vectors, **o).collect()}
    assert find(k=1) == {("1", "a"), ("2", "c")}
    assert find(k=1, filter_mode="post") == set()
    assert find(k=2, filter_mode="post") == {("1", "a"), ("2", "c")}


def test_stored_vectors_are_not_shuffled(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    plan = se.nearest(queries, vectors.select(F.col("vec_id").alias("item_id"), "embedding"), 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in physical and "NestedLoop" not in physical
    assert "WindowGroupLimit" in physical
    # the only exchange is above the per-task results
    assert physical.index("Exchange") < physical.index("MapInArrow")


def test_listing_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    ddl = "id string, title string, agency string, source_type string, local_path string, release_date string, created_at string"
    spark.createDataFrame([("1", "a", "x", "official", "p", None, "t")], ddl).write.parquet(path)
    empty = lambda ddl: spark.createDataFrame([], ddl)
    listed = se.list_records(
        spark.read.parquet(path),
        empty("record_id string, sha256 string, byte_size long"),
        empty("record_id string"),
        empty("id string, record_id string, asset_type string, local_path string"),
        source_type="official",
        local_only=True,
    )
    assert listed.count() == 1 and listed.head().artifact_size == 0
    plan = listed._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :][:200]
    assert "IsNotNull(local_path)" in pushed and "EqualTo(source_type,official)" in pushed
