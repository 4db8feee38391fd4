"""One key holding a third of all rows: same results, spread over tasks, nothing gathered."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import cases as ca, common as cm, quality as q, search as se, texts as tx

#: Partitions count as large from a few bytes on, so that adaptive execution splits the hot ones.
SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.shuffle.partitions": "16",
}


class split:  # noqa: N801
    """Within: joins whose hot partitions are split."""

    def __init__(self, spark):
        self.conf, self.old = spark.conf, {}

    def __enter__(self):
        for key, value in SPLIT.items():
            self.old[key] = self.conf.get(key, None)
            self.conf.set(key, value)

    def __exit__(self, *_):
        for key, value in self.old.items():
            self.conf.unset(key) if value is None else self.conf.set(key, value)


@pytest.fixture(scope="module")
def tables(spark):
    many = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v")
    )
    one = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    return many, one


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_split_at_run_time(spark, tables, how):
    many, one = tables
    plain = sorted(map(tuple, many.join(one, "k", how).fillna(-1).collect()))
    with split(spark):
        joined = cm.join_many_to_one(many.repartition(6), one.repartition(6), ["k"], how)
        assert sorted(tuple(-1 if v is None else v for v in r) for r in joined.collect()) == plain
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_one_to_many_keeps_unmatched_rows(spark, tables):
    many, one = tables
    plain = sorted(map(str, one.join(many, "k", "left").select("k", "w", "v").collect()))
    with split(spark):
        assert sorted(map(str, cm.join_one_to_many(one, many, ["k"]).select("k", "w", "v").collect())) == plain


def test_joined_text_parts_are_bounded_and_whole(spark):
    rows = [("hot", i, f"{i};") for i in range(500)] + [("b", 3, "x"), ("b", 1, "y")]
    df = spark.createDataFrame(rows, "k string, seq int, t string").repartition(7)
    parts = cm.joined_text(df, ["k"], "seq", "t", "text", span=64).orderBy("k", "part").collect()
    assert "".join(r.text for r in parts if r.k == "hot") == "".join(f"{i};" for i in range(500))
    assert max(r.text.count(";") for r in parts) == 64
    assert [r.text for r in parts if r.k == "b"] == ["yx"]


def test_first_rows_are_limited_before_the_shuffle(tables):
    many, _ = tables
    plan = cm.first_rows(many, ["k"], [F.col("v")], 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("WindowGroupLimit") == 2


def hot_records(spark):
    """A third of all rows share title and URL."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(0, 900, 1, 6).select(
        n.cast("string").alias("id"),
        F.when(hot, "same").otherwise(F.concat(F.lit("t"), (n % 200).cast("string"))).alias("title"),
        F.when(n % 11 == 0, F.lit(None)).otherwise("u").alias("document_url"),
        F.when(n % 5 == 0, "manual").otherwise("official").alias("source_type"),
        F.when(n % 7 == 0, "completed").alias("analysis_status"),
        F.concat(F.lit("k|title:"), n.cast("string")).alias("stable_key"),
        F.when(hot, "same/path").otherwise(F.concat(F.lit("p"), n.cast("string"))).alias("local_path"),
    )


def same(spark, make):
    """``make()`` gives one or several tables: alike with and without splitting."""

    def rows():
        made = make()
        frames = made if isinstance(made, tuple) else tuple(made.values()) if isinstance(made, dict) else (made,)
        return [sorted(map(str, f.select(sorted(f.columns)).collect())) for f in frames]

    plain = rows()
    with split(spark):
        assert rows() == plain


def test_operators_give_the_same_with_hot_keys(spark):
    records = hot_records(spark)
    same(spark, lambda: q.drop_duplicate_records(records))
    artifacts = records.select(
        F.when(F.col("title") == "same", "3").otherwise(F.col("id")).alias("record_id"),
        F.sha2("id", 256).alias("sha256"),
        F.col("local_path").alias("relative_path"),
        (F.col("id").cast("long") * 3).alias("byte_size"),
        F.lit("official").alias("source_type"),
    )
    same(spark, lambda: q.drop_poisoned_artifacts(artifacts, records))
    files = artifacts.groupBy(F.col("relative_path").alias("local_path")).agg(F.min("sha256").alias("file_hash"))
    same(spark, lambda: q.verify_integrity(records, artifacts, files))
    links = artifacts.select("record_id", F.lit("e").alias("name"))
    assets = artifacts.select(F.col("sha256").alias("id"), "record_id", F.lit("image").alias("asset_type"), F.col("relative_path").alias("local_path"))
    listed = records.withColumn("release_date", F.lit("x")).withColumn("created_at", F.lit("x")).withColumn("agency", F.lit("a"))
    same(spark, lambda: se.list_records(listed, artifacts, links, assets))
    tables = {"records": records.withColumn("intelligence_json", F.lit("x")).withColumn("redaction_score", F.lit(1.0)), "record_entities": links}
    ids = spark.createDataFrame([("3",), ("4",)], "id string")
    same(spark, lambda: q.clear_analysis(tables, ids))


def test_entities_and_cases_with_hot_keys(spark):
    records = hot_records(spark).withColumn("created_at", F.col("id"))
    hits = records.select(F.col("id").alias("record_id"), F.col("title").alias("name"), F.lit("w").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit("s").alias("source"))
    known = spark.createDataFrame([("e", "same", "w", "d")], "id string, name string, entity_type string, description string")
    entities = tx.upsert_entities(known, hits)
    none = spark.createDataFrame([("zz", "x", 1.0), ("3", "x", 1.0)], "record_id string, entity_id string, confidence double")
    done = hits.select("record_id")
    same(spark, lambda: tx.link_entities(none, hits, entities, done))
    members = records.select(
        F.when(F.col("title") == "same", "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("long") % 5)).alias("case_id"),
        F.col("id").alias("record_id"),
        F.lit("n").alias("notes"),
    )
    cases = members.select(F.col("case_id").alias("id"), F.col("case_id").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("t").alias("created_at")).distinct().filter("id <> 'c4'")
    notes = members.select("case_id", F.col("record_id").alias("id"), F.lit("b").alias("body"), F.lit("t").alias("created_at"))
    requests = members.withColumn("ordinal", F.lit(1)).withColumn("request_id", F.col("record_id")).withColumn("body", F.lit("b"))
    same(spark, lambda: ca.add_members(members.limit(0), requests, cases, records))
    asked = requests.select("request_id", "case_id", "record_id", "body")
    same(spark, lambda: ca.append_notes(notes, asked, cases, "t"))
    links = hits.select("record_id", "name", "entity_type", "confidence")
    results = records.select(F.col("id").alias("record_id"), F.col("title").alias("ocr_text"))
    arguments = (cases, members, notes, records, links, results)
    same(spark, lambda: ca.dossier_blocks(*arguments))


def test_fragments_of_a_hot_record(spark):
    n = F.col("id")
    fragments = spark.range(0, 300, 1, 6).select(
        n.cast("string").alias("id"), F.when(n % 3 == 0, "hot").otherwise(n.cast("string")).alias("record_id"), F.lit("t").alias("text")
    )
    vectors = fragments.select(F.col("id").alias("fragment_id"), F.array(F.col("id").cast("double"), F.lit(50.0)).alias("embedding"))
    queries = fragments.select("record_id").distinct().withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0)))
    same(spark, lambda: se.fragment_search_by_record(queries, fragments, vectors))
