import json

from pyspark.sql import functions as F

from caseloom.operators import responses as rs
from caseloom.streaming.events import stream_tokens, streamed_text


def model_parse(text):
    start = max(text.find("{"), 0)
    thought, end = text[:start].strip(), text.rfind("}")
    answer = text[start : end + 1 if end >= 0 else len(text)]
    try:
        return thought, json.loads(answer), True
    except ValueError:
        return thought, {"object_description": "Extraction failed", "raw_response": text}, False


def test_parsing_equals_the_model(spark):
    texts = [
        'hm {"b": 1, "a": [true, null]} bye',
        "no json",
        "{bad",
        "x } y { z",
        'a {"k": 1} and } more',
        '{"a": 1}, {"b": 2}',
        '{"a": 1}] , [{"b": 2}',
        '{"a": 1}} , {"v": {"b": 2}',
        "",
        "123",
        '"quoted"',
        ' é {"t": "ü\\n\\u00e9"}',
        '{"a": 1, "a": 2}',
        "}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id int, generated string")
    for row in rs.parse_responses(df).collect():
        thought, value, ok = model_parse(texts[row.record_id])
        assert (row.thought, json.loads(row.response_json), row.parsed) == (thought, value, ok), texts[row.record_id]


def test_only_text_observations_become_fragments(spark):
    df = spark.createDataFrame([("r", '{"observations": ["a", 1, null, {"x": 1}, "b"]}'), ("s", '{"observations": "no"}'), ("t", "broken")], "record_id string, response_json string")
    got = [(r.record_id, r.position, r.text, r.confidence) for r in rs.explode_observations(df, "t").orderBy("position").collect()]
    assert got == [("r", 0, "a", 0.9), ("r", 4, "b", 0.9)]
    vectors = rs.fragment_vectors(rs.explode_observations(df, "t")).collect()
    assert len(vectors) == 2 and all(len(v.embedding) == 384 for v in vectors)


def test_projection_falls_through_what_scripts_call_false(spark):
    rows = [
        ("1", '{"object_description": "", "incident_date": 0, "location": false, "intelligence_score": 0}', "2024", ""),
        ("2", '{"object_description": "0", "incident_date": 7, "location": "L", "intelligence_score": 0.125, "agencies": ["A"], "pilot_observations": "p"}', None, None),
        ("3", "", None, None),
        ("4", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, intelligence_json string, incident_date string, incident_location string")
    got = {r.record_id: tuple(r)[1:] for r in rs.intel_projection(df).collect()}
    assert got == {
        "1": ("No summary available.", "2024", "GLOBAL", [], "No observational data resolved.", 60),
        "2": ("0", "7", "L", ["A"], "p", 13),
    }


def test_prompt_parts_join_to_the_prompt(spark):
    texts = spark.createDataFrame([("1", "short"), ("2", "é" * 2501)], "record_id string, text string")
    records = texts.select(F.col("record_id").alias("id"))
    findings = spark.createDataFrame([("1", i, "box", f"c{i}", 0.5) for i in range(5)], "record_id string, seq int, layer_type string, content string, confidence double")
    manifest = rs.forensic_manifest(findings, records, span=2)
    fragments = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a")], "record_id string, rank int, text string")
    assets = spark.createDataFrame([("1", "image"), ("1", "source"), ("1", "image")], "record_id string, asset_type string")
    prompts = {}
    for r in rs.build_prompts(texts, manifest, fragments, assets, "SYS.", "GO.").orderBy("record_id", "part").collect():
        prompts[r.record_id] = prompts.get(r.record_id, "") + r.prompt
    lines = "".join(f"- [BOX] c{i} (Confidence: 0.50)\n" for i in range(5))
    frame = "<|im_start|>system\nSYS. \nDirectives:\n1. STRUCTURE: Return valid JSON only.\n2. AUDIT: "
    end = "<|im_end|>\n<|im_start|>user\nGO.<|im_end|>\n<|im_start|>thought\n"
    assert prompts["1"] == (
        frame + "AUDIT NOTICE: 2 visual assets are attached. Perform a forensic comparison.\n\nFORENSIC VISUAL MANIFEST:\n"
        + lines + "\n\nCRITICAL CONTEXT FROM SEMANTIC INDEX:\na\n---\nb\n\n\nInput Document:\nshort" + end
    )
    assert prompts["2"] == (
        frame + "No visual assets attached.\n\nFORENSIC VISUAL MANIFEST:\n- No visual anomalies detected by foundation OCR.\n"
        "\n\nCRITICAL CONTEXT FROM SEMANTIC INDEX:\n\n\n\nInput Document:\n"
        "SOURCE DATA EXCERPT (Refer to Semantic Index below for full context):\n" + "é" * 2000 + "\n" + end
    )


def test_staleness_needs_more_than_five_seconds(spark):
    records = spark.createDataFrame(
        [("1", "{}", "2024-01-01T00:00:06+00:00"), ("2", "{}", "2024-01-01 00:00:05"), ("3", None, "2025-01-01"), ("4", "{}", "2025-01-01"), ("5", "{}", "2025-01-01")],
        "id string, intelligence_json string, updated_at string",
    )
    logs = spark.createDataFrame([(r, "2024-01-01T00:00:00+00:00") for r in "1235"] + [("1", "2023-01-01T00:00:00+00:00")], "record_id string, created_at string")
    texts = spark.createDataFrame([(r, "t") for r in "1234"] + [("5", "")], "record_id string, ocr_text string")
    got = {r.record_id: r.stale for r in rs.stale_synthesis(records, texts, logs).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": False, "5": False}


EVENTS = [
    ("a", 1, "synthesizing", "x"),
    ("a", 2, "synthesizing-start", "ignored"),
    ("a", 3, "synthesizing", "one "),
    ("a", 4, "loading-model", "no"),
    ("a", 5, "synthesizing", None),
    ("a", 6, "synthesizing", "two"),
    ("b", 1, "synthesizing", "kept"),
    ("c", 1, "synthesizing", "gone"),
    ("c", 2, "synthesizing-start", None),
]
EVENT = "record_id string, seq long, status string, token_text string"


def test_last_run_wins(spark):
    got = {r.record_id: r.text for r in rs.assemble_token_stream(spark.createDataFrame(EVENTS, EVENT)).collect()}
    assert got == {"a": "one two", "b": "kept"}


def test_streamed_runs_equal_the_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    for part in (EVENTS[:3], EVENTS[3:7], EVENTS[7:]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    stream_tokens(events, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.record_id: r.text for r in streamed_text(spark, str(tmp_path / "store")).collect()} == {"a": "one two", "b": "kept"}


def test_log_history(spark):
    logs = spark.createDataFrame([("1", "r", "2"), ("2", "r", "3"), ("3", "r", "1"), ("4", "q", "9")], "id string, record_id string, created_at string")
    assert [r.id for r in rs.log_history(logs).collect()] == ["4", "2", "1", "3"]
    assert [r.id for r in rs.log_history(logs, 2).collect()] == ["4", "2", "1"]
