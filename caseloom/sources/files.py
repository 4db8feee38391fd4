"""Stored files: content-addressed catalogue, manual imports, text routing, web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank_to_null, extension_of, filename_of_url, is_blank
from ..operators.common import derived_id, join_many_to_one


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of a folder tree with their bytes (path, modificationTime, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def library_path(sha256: Column, extension: Column) -> Column:
    """``hh/hash.ext``, without the dot where there is no extension."""
    return F.concat(
        F.substring(sha256, 1, 2),
        F.lit("/"),
        sha256,
        F.when(F.coalesce(extension, F.lit("")) != "", F.concat(F.lit("."), extension)).otherwise(""),
    )


def artifact_catalogue(files: DataFrame, url: str = "path") -> DataFrame:
    """Identity of every file: hash, size, original name, extension and place in the library."""
    named = files.select(
        F.col(url).alias("source_url"),
        F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").cast("long").alias("byte_size"),
        filename_of_url(url).alias("original_filename"),
    ).withColumn("extension", extension_of("original_filename"))
    return named.withColumn("relative_path", library_path(F.col("sha256"), F.col("extension")))


def merge_artifacts(catalogue: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifact table after (record_id, sha256, byte_size, source_url, relative_path, ..., ordinal) arrivals.

    Unique by hash: the first arrival gives a new artifact its identity; the last
    known record and URL of all arrivals replace those stored. Also returns
    (record_id, local_path): every record points to the path it arrived with last.
    Everything is an aggregate by hash, so any number of copies is combined map-side.
    """
    kept = [c for c in catalogue.columns if c not in ("id", "record_id", "sha256", "source_url", "created_at")]
    present = [c for c in kept if c in incoming.columns]
    order = F.col("ordinal")
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order))
    merged = incoming.groupBy("sha256").agg(
        F.min_by(F.struct(*present), order).alias("_first"),
        latest("record_id").alias("_record"),
        latest("source_url").alias("_url"),
    )
    old = catalogue.withColumn("_old", F.lit(True))
    joined = old.join(merged, "sha256", "full_outer")
    known = F.col("_old").isNotNull()
    out = joined.select(
        F.when(known, F.col("id")).otherwise(derived_id("artifact", "sha256")).alias("id"),
        F.coalesce("_record", "record_id").alias("record_id"),
        "sha256",
        F.coalesce("_url", "source_url").alias("source_url"),
        F.col("created_at") if "created_at" in catalogue.columns else F.lit(None).cast("string").alias("created_at"),
        *[
            (F.when(known, F.col(c)).otherwise(F.col(f"_first.{c}")) if c in present else F.col(c)).alias(c)
            for c in kept
        ],
    )
    paths = (
        incoming.filter(F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.max_by("relative_path", order).alias("local_path"))
    )
    return out, paths


def arrivals(catalogue: DataFrame, incoming: DataFrame) -> DataFrame:
    """Arrivals with ``skipped_existing``: was the path there before, or earlier in this batch?"""
    first = incoming.groupBy("relative_path").agg(F.min("ordinal").alias("_first"))
    known = catalogue.select("relative_path", F.lit(True).alias("_known")).distinct()
    by_path = first.join(known, "relative_path", "left")
    return join_many_to_one(incoming, by_path, ["relative_path"], "left").select(
        *incoming.columns,
        (F.col("_known").isNotNull() | (F.col("ordinal") > F.col("_first"))).alias("skipped_existing"),
    )


def records_from_files(files: DataFrame, ts: str) -> DataFrame:
    """Manual imports: (path, optional title, notes) to record rows."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.coalesce(F.nullif(F.regexp_extract(base, r"^(.+)\.[^.]*$", 1), F.lit("")), base)
    title = F.coalesce(blank_to_null("title"), stem) if "title" in files.columns else stem
    notes = F.col("notes") if "notes" in files.columns else F.lit(None).cast("string")
    ident = derived_id("manual", "path")
    key = F.concat(F.lit("manual:"), ident)
    return files.select(
        ident.alias("id"),
        key.alias("stable_key"),
        key.alias("content_hash"),
        title.alias("title"),
        extension_of("path").alias("file_type"),
        F.lit("manual").alias("source_type"),
        notes.alias("summary"),
        F.lit(None).cast("string").alias("document_url"),
        F.lit("pending").alias("analysis_status"),
        F.lit(ts).alias("created_at"),
        F.lit(ts).alias("updated_at"),
    )


def records_from_pages(pages: DataFrame, ts: str) -> DataFrame:
    """Web pages (url) as record rows: the URL is the title, the type is text."""
    ident = derived_id("web", "url")
    key = F.concat(F.lit("web:"), ident)
    return pages.select(
        ident.alias("id"),
        key.alias("stable_key"),
        key.alias("content_hash"),
        F.col("url").alias("title"),
        F.lit("txt").alias("file_type"),
        F.lit("manual").alias("source_type"),
        F.lit(None).cast("string").alias("summary"),
        F.col("url").alias("document_url"),
        F.lit("pending").alias("analysis_status"),
        F.lit(ts).alias("created_at"),
        F.lit(ts).alias("updated_at"),
    )


#: Unicode white space (control separators 1C-1F are not part of it).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


class _TextNodes(HTMLParser):
    """Collects trimmed text nodes; scripts and styles count as text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self._open: list[str] = []

    def _close(self) -> None:
        text = "".join(self._open).strip(_SPACE)
        self._open.clear()
        if text:
            self.nodes.append(text)

    def handle_data(self, data: str) -> None:
        self._open.append(data)

    def handle_starttag(self, tag, attrs) -> None:
        self._close()

    def handle_endtag(self, tag) -> None:
        self._close()

    def handle_comment(self, data) -> None:
        self._close()

    def of(self, html: str) -> list[str]:
        self.feed(html)
        self.close()
        self._close()
        return self.nodes


def pages_to_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text): the source line, then every non-blank text node on its own line."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                f"Source URL: {url}\n\n" + "".join(node + "\n" for node in _TextNodes().of(html or ""))
                for url, html in zip(batch["url"], batch["html"])
            ]
            yield pd.DataFrame({key: batch[key], "url": batch["url"], "text": texts})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url", "html").mapInPandas(convert, f"{key} {kind}, url string, text string")


# fixed values: extensions read as they are
_PLAIN_TEXT = ["txt", "md", "csv", "json"]
_NEEDS_READER = ["pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"]


def read_text_assets(files: DataFrame) -> DataFrame:
    """(path, text, engine, error) by extension.

    Plain text is read whole; documents and images need text from outside; any other
    type is an error. Text that is not UTF-8 is one as well.
    """
    kind = F.coalesce(extension_of("path"), F.lit(""))
    plain = kind.isin(_PLAIN_TEXT)
    text = F.when(plain, F.try_validate_utf8(F.col("content").cast("string")))
    error = (
        F.when(plain & text.isNull(), "stream did not contain valid UTF-8")
        .when(kind.isin(_NEEDS_READER), F.concat(F.lit("needs external text: "), kind))
        .when(~plain, F.concat(F.lit("unsupported type `"), kind, F.lit("`")))
    )
    return files.select(
        "path", text.alias("text"), F.when(plain, "text-file").alias("engine"), error.alias("error")
    )


def attach_texts(needing: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts from outside, (path, text, engine), put where :func:`read_text_assets` found none."""
    given = texts.filter(~is_blank("text")).select(
        "path", F.col("text").alias("_text"), F.col("engine").alias("_engine")
    )
    joined = needing.join(given, "path", "left")
    return joined.select(
        "path",
        F.coalesce("text", "_text").alias("text"),
        F.coalesce("engine", "_engine").alias("engine"),
        F.when(F.col("_text").isNull(), F.col("error")).alias("error"),
    )
