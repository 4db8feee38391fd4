import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import layers as ly


def png(path, pixels):
    """A grey image as PNG."""
    height, width = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def model_score(pixels):
    height, width = pixels.shape
    sums = []
    for row in pixels:
        total = run = 0
        for value in [*row, 255]:
            if value < 15:
                run += 1
            else:
                total += run if run > width // 8 else 0
                run = 0
        sums.append(total)
    kept = sum(sums[y] for y in range(1, height - 1) if sums[y] and (sums[y - 1] or sums[y + 1]))
    return kept / (height * width)


def images():
    block, line, streak = (np.full((20, 64), 255) for _ in range(3))
    block[5:10, 10:40] = 0
    line[7, :] = 0
    streak[3:6, 0:8] = 14
    longer = streak.copy()
    longer[3:6, 0:9] = 14
    edge = np.full((20, 64), 15)
    edge[0:2, 30:64] = 0
    return {"block": block, "line": line, "streak": streak, "longer": longer, "edge": edge, "noise": np.random.default_rng(3).choice([0, 255], (33, 70), p=[0.9, 0.1])}


def test_expected_scores():
    made = images()
    assert model_score(made["block"]) == 150 / 1280 and model_score(made["line"]) == model_score(made["streak"]) == 0
    assert model_score(made["longer"]) == 27 / 1280


def test_scores_of_image_files(spark, tmp_path):
    made = images()
    for name, pixels in made.items():
        png(tmp_path / f"{name}.png", pixels)
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = ly.redaction_score(spark.read.format("image").load(str(tmp_path))).collect()
    got = {r.path.rsplit("/", 1)[1].removesuffix(".png"): r.redaction_score for r in rows}
    assert got == {"broken": 0.0, **{n: pytest.approx(model_score(p)) for n, p in made.items()}}


def test_scores_of_pixel_tables(spark):
    made = images()
    rows = [(n, int(y), int(x), bool(p[y, x] < 15)) for n, p in made.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    df = spark.createDataFrame(rows, "image_id string, y long, x long, dark boolean")
    got = {r.image_id: r.redaction_score for r in ly.redaction_score_of_pixels(df).collect()}
    assert got == {n: pytest.approx(model_score(p)) for n, p in made.items()}


def test_boxes_are_scaled_to_the_page(spark):
    ops = spark.createDataFrame(
        [("r", 1, 1, "re", 50.0, 100.0, 100.0, 20.0), ("r", 1, 2, "re", 0.0, 0.0, 10.0, 20.0), ("r", 1, 3, "Tj", 0.0, 0.0, 100.0, 20.0), ("r", 2, 4, "re", 0.0, 0.0, 11.0, 6.0)],
        "record_id string, page int, seq int, op string, x double, y double, w double, h double",
    )
    pages = spark.createDataFrame([("r", 1, 500.0, 707.0)], "record_id string, page int, page_width double, page_height double")
    rows = ly.save_forensics(
        spark.createDataFrame([("old", "r", "x", "", 0.1, None, "{}", "t"), ("o2", "q", "x", "", 0.1, None, "{}", "t")],
            "id string, record_id string, layer_type string, content string, confidence double, bounding_box_json string, metadata_json string, created_at string"),
        ly.box_layers(ops, pages), "now").collect()
    boxes = {r.content: r.bounding_box_json for r in rows if r.record_id == "r"}
    assert boxes == {"Graphic Overlay @ Page 1": "[100.0,1174.0,200.0,40.0]", "Graphic Overlay @ Page 2": "[0.0,1408.0,11.0,6.0]"}
    assert [r.id for r in rows if r.record_id == "q"] == ["o2"]


def test_hidden_text_is_trimmed_across_parts(spark):
    pieces = ["  ", " \n", " a", "", "b ", " ", "c  ", "\t"]
    rows = [("r", 1, n, "Tj", t) for n, t in enumerate(pieces)] + [("r", 2, 0, "TJ", "12345"), ("r", 3, 0, "TJ", "      "), ("r", 4, 0, "Tj", "ééé"), ("r", 5, 0, "re", "123456")]
    df = spark.createDataFrame(rows, "record_id string, page int, seq int, op string, text string")
    for span in (2, 3, 1024):
        parts = ly.text_layers(df, span=span).orderBy("page", "part").collect()
        assert "".join(r.content for r in parts if r.page == 1) == "".join(pieces).strip()
        assert {r.page for r in parts} == {1, 4}


def test_all_layers_together(spark):
    ops = spark.createDataFrame([("r", 1, 1, "re", 0.0, 0.0, 11.0, 6.0, None), ("r", 1, 2, "Tj", None, None, None, None, "hidden words")],
        "record_id string, page int, seq int, op string, x double, y double, w double, h double, text string")
    info = spark.createDataFrame([("r", "Author", "me"), ("r", "None", None)], "record_id string, key string, value string")
    rows = {r.layer_type: (r.content, r.confidence) for r in ly.forensic_layers(ops, info=info).collect()}
    assert rows == {"improper_redaction": ("Graphic Overlay @ Page 1", 0.9), "hidden_text": ("hidden words", 0.7), "metadata_leak": ("Author: me", 1.0)}


def test_sealed_values(spark):
    key = F.lit("0123456789abcdef0123456789abcdef")
    df = spark.createDataFrame([(b"secret",), (b"",)], "c binary").select("c", ly.seal(F.col("c"), key).alias("s")).cache()
    for row in df.select("c", "s", ly.unseal(F.col("s"), key).alias("o")).collect():
        assert row.o == row.c and bytes(row.s[:8]) == b"PVAULT01" and len(row.s) == 8 + 12 + len(row.c) + 16
    tampered = df.select(F.concat(F.lit("PVAULT02").cast("binary"), F.substring("s", 9, 1000)).alias("s"))
    assert [r[0] for r in tampered.select(ly.try_unseal(F.col("s"), key)).collect()] == [None, None]
    with pytest.raises(Exception, match="no valid header"):
        tampered.select(ly.unseal(F.col("s"), key)).collect()
    broken = df.select(F.concat("s", F.lit("x").cast("binary")).alias("s"))
    assert [r[0] for r in broken.select(ly.try_unseal(F.col("s"), key)).collect()] == [None, None]
