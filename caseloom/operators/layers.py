"""Layers hidden in documents and images, and sealing of stored bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank, ltrim_ws, rtrim_ws
from .common import derived_id, join_many_to_one, joined_text, union_all
from .texts import replace_rows

#: Page size assumed where none is known; boxes are scaled to it.
PAGE_WIDTH, PAGE_HEIGHT = 1000.0, 1414.0
LAYER_CONFIDENCE = {"improper_redaction": 0.9, "hidden_text": 0.7, "metadata_leak": 1.0}


def box_layers(ops: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Filled rectangles that may cover text.

    ``ops`` is (record_id, page, seq, op, x, y, w, h); ``pages`` optionally gives
    (record_id, page, page_width, page_height). Only boxes wider than 10 and higher
    than 5 count; y is flipped to run from the top.
    """
    boxes = ops.filter((F.col("op") == "re") & (F.col("w") > 10) & (F.col("h") > 5)).select(
        "record_id", "page", "seq", "x", "y", "w", "h"
    )
    if pages is None:
        sized = boxes.withColumn("page_width", F.lit(PAGE_WIDTH)).withColumn("page_height", F.lit(PAGE_HEIGHT))
    else:
        sized = join_many_to_one(boxes, pages, ["record_id", "page"], "left").fillna(
            {"page_width": PAGE_WIDTH, "page_height": PAGE_HEIGHT}
        )
    pw, ph = F.col("page_width"), F.col("page_height")
    bbox = F.array(
        F.col("x") / pw * PAGE_WIDTH,
        F.lit(PAGE_HEIGHT) - (F.col("y") + F.col("h")) / ph * PAGE_HEIGHT,
        F.col("w") / pw * PAGE_WIDTH,
        F.col("h") / ph * PAGE_HEIGHT,
    )
    return sized.select(
        "record_id",
        "page",
        "seq",
        F.lit("improper_redaction").alias("layer_type"),
        F.concat(F.lit("Graphic Overlay @ Page "), F.col("page").cast("string")).alias("content"),
        F.lit(LAYER_CONFIDENCE["improper_redaction"]).alias("confidence"),
        bbox.alias("bbox"),
        F.to_json(F.struct(bbox.alias("bbox"), F.col("page").alias("page"))).alias("metadata_json"),
    )


def text_layers(ops: DataFrame, span: int = 1024) -> DataFrame:
    """Text drawn on a page, in order, as numbered parts; 5 bytes or less do not count.

    ``ops`` is (record_id, page, seq, op, text) and, where a page has several content
    streams, their ``stream``: each is a layer of its own. The outer white space of a
    text is cut at its first and last non-blank piece, which a plain aggregate finds,
    so that even a page with very many pieces is assembled by many tasks.
    """
    keys = ["record_id", "page", *(["stream"] if "stream" in ops.columns else [])]
    drawn = ops.filter(F.col("op").isin("Tj", "TJ")).select(*keys, "seq", F.coalesce("text", F.lit("")).alias("text"))
    solid = ~is_blank("text")
    extent = (
        drawn.groupBy(*keys)
        .agg(
            F.sum(F.octet_length("text")).alias("bytes"),
            F.min(F.when(solid, F.col("seq"))).alias("first"),
            F.max(F.when(solid, F.col("seq"))).alias("last"),
        )
        .filter((F.col("bytes") > 5) & F.col("first").isNotNull())
    )
    inside = join_many_to_one(drawn, extent, keys, "inner").filter(
        F.col("seq").between(F.col("first"), F.col("last"))
    )
    head = F.when(F.col("seq") == F.col("first"), ltrim_ws("text")).otherwise(F.col("text"))
    tail = F.when(F.col("seq") == F.col("last"), rtrim_ws("text")).otherwise(F.col("text"))
    cut = inside.withColumn("text", head).withColumn("text", tail)
    return joined_text(cut, keys, "seq", "text", "content", span=span).select(
        *keys,
        "part",
        F.lit("hidden_text").alias("layer_type"),
        "content",
        F.lit(LAYER_CONFIDENCE["hidden_text"]).alias("confidence"),
        F.to_json(F.struct(*keys[1:])).alias("metadata_json"),
    )


def metadata_layers(info: DataFrame) -> DataFrame:
    """Entries (record_id, key, value) of a document's information table."""
    return info.filter(F.col("value").isNotNull()).select(
        "record_id",
        F.lit("metadata_leak").alias("layer_type"),
        F.concat_ws(": ", "key", "value").alias("content"),
        F.lit(LAYER_CONFIDENCE["metadata_leak"]).alias("confidence"),
        F.to_json(F.struct("key")).alias("metadata_json"),
    )


def forensic_layers(ops: DataFrame, pages: DataFrame | None = None, info: DataFrame | None = None) -> DataFrame:
    """All three kinds of layers: (record_id, page, seq, part, layer_type, content, confidence, bbox, metadata_json)."""
    frames = [box_layers(ops, pages)]
    if "text" in ops.columns:
        frames.append(text_layers(ops))
    if info is not None:
        frames.append(metadata_layers(info))
    return union_all(frames)


def save_forensics(existing: DataFrame, layers: DataFrame, ts: str) -> DataFrame:
    """Forensic table with the rows of the records in ``layers`` replaced; the box gets its own column."""
    # the box as a column spares parsing it out of the metadata
    # two layers of one record may be alike in all but their place
    place = [c for c in ("page", "stream", "seq", "part") if c in layers.columns]
    box = F.to_json("bbox") if "bbox" in layers.columns else F.get_json_object("metadata_json", "$.bbox")
    new = layers.select(
        derived_id("layer", "record_id", "layer_type", "metadata_json", "content", *place).alias("id"),
        "record_id",
        "layer_type",
        "content",
        "confidence",
        box.alias("bounding_box_json"),
        "metadata_json",
        F.lit(ts).alias("created_at"),
    )
    return replace_rows(existing, new, layers.select("record_id"))


# --- image redaction --------------------------------------------------------

#: Luma below this counts as dark.
DARK = 15


def redaction_score_of_pixels(pixels: DataFrame) -> DataFrame:
    """Share of an image covered by dark blocks, from a pixel table (image_id, y, x, dark).

    Runs longer than an eighth of the width count; a line whose neighbours have no
    such run is a thin line and is dropped, as are the first and the last line.
    Runs are found per line; lines meet their neighbours by sending their sum to
    both, so an image of any height is still aggregated map-side.
    """
    line = Window.partitionBy("image_id", "y").orderBy("x")
    # dark pixels of one run share the difference of position and rank
    ranked = pixels.filter("dark").withColumn("run", F.col("x") - F.row_number().over(line))
    size = pixels.groupBy("image_id").agg(
        (F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height")
    )
    runs = ranked.groupBy("image_id", "y", "run").agg(F.count(F.lit(1)).alias("n"))
    long_runs = join_many_to_one(runs, size, ["image_id"]).filter(F.col("n") > F.floor(F.col("width") / 8))
    sums = long_runs.groupBy("image_id", "y").agg(F.sum("n").alias("own"))
    sent = F.explode(
        F.array(
            F.struct(F.col("y").alias("to"), F.col("own").alias("own"), F.lit(0).cast("long").alias("near")),
            F.struct((F.col("y") - 1).alias("to"), F.lit(0).cast("long").alias("own"), F.col("own").alias("near")),
            F.struct((F.col("y") + 1).alias("to"), F.lit(0).cast("long").alias("own"), F.col("own").alias("near")),
        )
    )
    met = (
        sums.select("image_id", sent.alias("m"))
        .groupBy("image_id", F.col("m.to").alias("y"))
        .agg(F.sum("m.own").alias("own"), F.sum("m.near").alias("near"))
        .filter((F.col("own") > 0) & (F.col("near") > 0))
    )
    inner = join_many_to_one(met, size, ["image_id"]).filter((F.col("y") >= 1) & (F.col("y") <= F.col("height") - 2))
    kept = inner.groupBy("image_id").agg(F.sum("own").alias("covered"))
    return size.join(kept, "image_id", "left").select(
        "image_id",
        (F.coalesce("covered", F.lit(0)) / (F.col("width") * F.col("height"))).alias("redaction_score"),
    )


def _score_image(height: int, width: int, channels: int, data: bytes) -> float:
    if height < 1 or width < 1:
        return 0.0
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    # channels come as B, G, R(, A)
    luma = pixels[:, :, 0] if channels == 1 else (
        2126 * pixels[:, :, 2] + 7152 * pixels[:, :, 1] + 722 * pixels[:, :, 0]
    ) // 10000
    edge = np.zeros((height, 1), np.int8)
    step = np.diff(np.concatenate([edge, (luma < DARK).astype(np.int8), edge], axis=1), axis=1)
    row, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    length = stop - start
    wide = length > width // 8
    sums = np.bincount(row[wide], length[wide], height)
    near = np.zeros(height, bool)
    near[1:] |= sums[:-1] > 0
    near[:-1] |= sums[1:] > 0
    keep = near & (sums > 0)
    keep[0] = keep[-1] = False
    return float(sums[keep].sum() / (height * width))


def redaction_score(images: DataFrame) -> DataFrame:
    """(path, redaction_score) of files read with the ``image`` source; undecodable files score 0."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [
                _score_image(h, w, c, d) if d is not None else 0.0
                for h, w, c, d in zip(batch["height"], batch["width"], batch["channels"], batch["data"])
            ]
            yield pd.DataFrame({"path": batch["path"], "redaction_score": values})

    flat = images.select(
        F.col("image.origin").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )
    return flat.mapInPandas(score, "path string, redaction_score double")


# --- sealing ----------------------------------------------------------------

# fixed value: first bytes of a sealed file, also its additional authenticated data
MAGIC = "PVAULT01"


def seal(content: Column, key: Column) -> Column:
    """Magic, 12-byte nonce, AES-256-GCM ciphertext and tag. Spark draws a fresh nonce per value."""
    sealed = F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(MAGIC))
    return F.concat(F.lit(MAGIC).cast("binary"), sealed)


def unseal(sealed: Column, key: Column) -> Column:
    """Content of a sealed value; a wrong header or tag fails the job."""
    opened = F.aes_decrypt(F.substring(sealed, 9, 2**31 - 1), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(MAGIC))
    return F.when(F.substring(sealed, 1, 8) == F.lit(MAGIC).cast("binary"), opened).otherwise(
        F.raise_error(F.lit("sealed value has no valid header")).cast("binary")
    )


def try_unseal(sealed: Column, key: Column) -> Column:
    """Like :func:`unseal`, with NULL in place of a failure."""
    opened = F.try_aes_decrypt(F.substring(sealed, 9, 2**31 - 1), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(MAGIC))
    return F.when(F.substring(sealed, 1, 8) == F.lit(MAGIC).cast("binary"), opened)
