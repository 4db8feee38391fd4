"""Findings of the third round: each test failed before its fix."""

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry
from caseloom.llm import quality
from caseloom.operators import terms as te
from caseloom.operators.neighbours import Cells
from caseloom.sources import sinks
from caseloom.streaming.catalogue import stream_catalogue
from caseloom.workload import q_cases


def test_words_alone_need_no_window(spark):
    """Every occurrence was once sorted, windowed and gathered by text; now each form of a text counts once."""
    docs = spark.createDataFrame([("k", "Orb orb disc ORB"), ("k", "Orb orb disc ORB"), ("n", None), ("e", "")], "record_id string, text string")
    terms = spark.createDataFrame([("w", "orb"), ("v", "disc")], "entity_type string, term string")
    found = te.extract_terms(docs, terms)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    assert sorted((r.record_id, r.name, r.entity_type) for r in found.collect()) == [("k", "Orb", "w"), ("k", "disc", "v")]


def test_kinds_with_and_without_longer_terms(spark):
    docs = spark.createDataFrame([("k", "the orb, the disc; Orb")], "record_id string, text string")
    terms = spark.createDataFrame([("w", "the orb"), ("w", "orb"), ("v", "orb"), ("v", "the")], "entity_type string, term string")
    got = sorted((r.name, r.entity_type) for r in te.extract_terms(docs, terms).collect())
    assert got == [("Orb", "w"), ("orb", "v"), ("the", "v"), ("the orb", "w")]


def test_streams_read_a_table_of_one_file_or_of_many(spark, tmp_path):
    """A folder of part files was once passed over, and reading the empty result back failed."""
    rows = [(c, t, "system" if t == 0 else "user", f"t{c}.{t} ") for c in range(5) for t in range(6)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    given.toPandas().to_parquet(tmp_path / "conversations.parquet")
    texts = [sorted(map(tuple, q_cases.l08_stream(spark, str(folder)).collect())) for folder in (tmp_path / "many", tmp_path)]
    assert texts[0] == texts[1] == [(c, 0, f"t{c}.5 ") for c in range(5)]


def same_as_sql(spark, folder, name, frame, table):
    frame.to_parquet(folder / f"{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = duck.sql(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect())) == sorted(want)
    return dict(want)


def test_titles_with_long_numbers_and_final_letters(spark, tmp_path):
    """The SQL knew neither numbers beyond 64 bits nor letters whose lower case depends on their place."""
    texts = ["9" * 21, "a18446744073709551616 18446744073709551615b", "0" * 30 + "7 007", "ΟΔΟΣ. ΣΟΣ'Α ΑΣ'", "İ", "GROẞ", ""]
    got = same_as_sql(spark, tmp_path, "s05_normalise_title", pd.DataFrame({"doc_id": range(7), "text": texts}), "documents")
    assert [got[i].split(" ", 2)[2] for i in range(7)] == ["0", "a0 18446744073709551615b", "7 7", "οδος. σοσ'α ας'", "i̇", "groß", ""]


def test_percentages_at_ties(spark, tmp_path):
    """The SQL multiplied before it rounded, which carries 127.64999999999999 over the tie."""
    vectors = [[(1 - n / 1e4) / 2] for n in range(-2765, 10_000, 10)] + [[float("inf")], [1e30], []]
    got = same_as_sql(spark, tmp_path, "v06_match_percent", pd.DataFrame({"vec_id": range(len(vectors)), "embedding": vectors}), "embeddings")
    assert got[0] == 127.6


def test_scorer_learns_from_whole_texts(spark):
    """Words after the 20,000th were once left out of the training."""
    words = ["tree", "river", "stone", "cloud", "field", "house", "garden", "window", "morning", "letter"]
    good = " ".join(f"The {words[i % 10]} {words[i * 7 % 10]}." for i in range(30))
    head = "stone " * 20_001
    rows = [(f"{good} {i}",) for i in range(10)] + [(head + "zebra " * (10 + i),) for i in range(10)]
    scorer = quality.fit_quality(spark.createDataFrame(rows, "text string"))
    hashes, _ = quality.word_hashes(quality.pa.array(["zebra"]))
    assert scorer.weights[int(hashes[0]) & (len(scorer.weights) - 1)] != 0


def test_a_landed_release_is_never_one_value(spark, tmp_path):
    """Each file was once read whole by one task, only to see how it begins."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("<html>gone</html>")
    (tmp_path / "in" / "b.csv").write_text("title\none\ntwo\n")
    run = stream_catalogue(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "mark"))
    run.awaitTermination()
    plan = run._jsq.explainInternal(True)
    assert "content" not in plan.split("Physical Plan")[-1]
    assert sorted(r.title for r in sinks.read_version(spark, str(tmp_path / "store" / "records")).collect()) == ["one", "two"]


def test_queries_are_not_repeated_for_ever_more_chunks():
    """A small chunk size once made as many copies of every query as the table had chunks."""
    few, many = (Cells("l2", np.zeros((256, 2)), np.full(257, n), np.zeros(257), [], 0.0, 128) for n in (40, 2400))
    assert few.chunks(np.arange(257)).sum() == 257
    assert many.chunks(np.arange(257)).sum() <= 2 * 257
