"""Renewed dates, bounded prompts, streams of a page, chunk sizes at the edge."""

from pyspark.sql import functions as F

from caseloom.operators import layers as ly, quality as q, responses as rs, texts as tx


def test_maintenance_renews_changed_records(spark):
    records = spark.createDataFrame(
        [("1", "small", "t0", "thumb"), ("2", "big", "t0", None), ("3", None, None, None)],
        "id string, local_path string, updated_at string, thumbnail_path string",
    )
    artifacts = spark.createDataFrame(
        [("small", 10, "official"), ("big", 10_000, "official")], "relative_path string, byte_size long, source_type string"
    )
    _, after = q.drop_poisoned_artifacts(artifacts, records, "t1")
    got = {r.id: (r.local_path, r.updated_at) for r in after.collect()}
    assert got == {"1": (None, "t1"), "2": ("big", "t0"), "3": (None, None)}
    _, after = q.drop_poisoned_artifacts(artifacts, records.drop("updated_at"), "t1")
    assert after.columns == ["id", "local_path", "thumbnail_path"]
    _, bare, _, _ = q.reset_local_copies(records, artifacts, artifacts, "t2")
    assert {r.updated_at for r in bare.collect()} == {"t2"}


def test_prompts_show_the_first_fragments(spark):
    texts = spark.createDataFrame([("r", "x" * 6000)], "record_id string, text string")
    manifest = spark.createDataFrame([("r", 0, "m")], "record_id string, part long, manifest string")
    fragments = spark.createDataFrame([("r", i, f"<{i}>") for i in range(40)], "record_id string, rank int, text string")
    assets = spark.createDataFrame([], "record_id string, asset_type string")

    def prompt(**options):
        parts = rs.build_prompts(texts, manifest, fragments, assets, **options).orderBy("part").collect()
        return "".join(p.prompt for p in parts)

    assert "<14>" in prompt() and "<15>" not in prompt() and prompt().count("x" * 2000) == 1
    assert "<2>" in prompt(k=3) and "<3>" not in prompt(k=3)
    assert "x" * 6000 in prompt(long_bytes=None) and "x" * 11 not in prompt(excerpt_chars=10)


def test_every_stream_of_a_page_is_a_layer(spark):
    rows = [("r", 1, s, n, "Tj", t) for s, texts in enumerate([["abc", "def"], ["abc", "def"], ["tiny"]]) for n, t in enumerate(texts)]
    ops = spark.createDataFrame(rows, "record_id string, page int, stream int, seq int, op string, text string")
    found = ly.text_layers(ops)
    assert sorted((r.stream, r.content) for r in found.collect()) == [(0, "abcdef"), (1, "abcdef")]
    none = spark.createDataFrame(
        [], "id string, record_id string, layer_type string, content string, confidence double, bounding_box_json string, metadata_json string, created_at string"
    )
    saved = ly.save_forensics(none, ly.text_layers(ops, span=1), "t").collect()
    assert len(saved) == 4 and len({r.id for r in saved}) == 4


def test_chunks_at_the_target_size(spark):
    for size in (1199, 1200, 1201):
        text = "a" * (size - 10) + "\n" + "b" * 9
        df = spark.createDataFrame([("r", text), ("s", "a\n" * (size // 2))], "record_id string, text string")
        # packing line by line, without the short cut for texts that cannot overflow
        for row in df.collect():
            chunks, cur = [], ""
            for line in row.text.split("\n"):
                if len((cur + line).encode()) > 1200 and cur.strip():
                    chunks.append(cur.strip())
                    cur = ""
                cur += line + "\n"
            chunks += [cur.strip()] if cur.strip() else []
            got = tx.chunk_text(df.filter(F.col("record_id") == row.record_id)).orderBy("chunk_index").collect()
            assert [r.chunk for r in got] == chunks
