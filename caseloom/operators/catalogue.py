"""Catalogue rows: conforming, keys, hashes, first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, normalise_title, normalise_url, trim_ws
from ..schemas import CATALOGUE, CATALOGUE_HEADERS
from .common import first_row


def conform_columns(df: DataFrame, spec: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Match headers ignoring case and outer blanks; blank or missing values become NULL.

    The result always has the columns of ``spec`` (header -> name), after ``keep``.
    """
    spec = spec or CATALOGUE_HEADERS
    # of two equal headers the later one counts
    found = {name.lstrip("\ufeff").strip().lower(): name for name in df.columns}
    picked = []
    for header, name in spec.items():
        actual = found.get(header.strip().lower())
        value = F.lit(None).cast("string") if actual is None else blank_to_null(F.col(f"`{actual}`").cast("string"))
        picked.append(value.alias(name))
    return df.select(*keep, *picked)


def with_normal_url(df: DataFrame, column: str = "document_url") -> DataFrame:
    return df.withColumn(column, normalise_url(column))


def stable_key(
    title: Column | str = "title",
    release_date: Column | str = "release_date",
    agency: Column | str = "agency",
    url: Column | str = "document_url",
) -> Column:
    """Identity of a row across releases: its web address and title, else a hash of its facts."""
    text = lambda c: F.coalesce(trim_ws(c), F.lit(""))
    address, norm = text(url), normalise_title(text(title))
    facts = F.sha2(F.concat_ws("|", norm, text(release_date), text(agency), address), 256)
    return F.when(
        address.startswith("http://") | address.startswith("https://"),
        F.concat(F.lit("url:"), address, F.lit("|title:"), norm),
    ).otherwise(F.concat(F.lit("meta:"), facts))


def content_hash(columns: list[str] | None = None) -> Column:
    """SHA-256 of the row as JSON, keys in alphabetical order, NULLs included."""
    names = sorted(columns or CATALOGUE.fieldNames())
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def dedup_first(df: DataFrame, key: str = "stable_key", ordinal: str = "ordinal") -> DataFrame:
    """Keep the first row of every key in ``ordinal`` order."""
    return first_row(df, [key], [F.col(ordinal)])


def keyed_rows(conformed: DataFrame) -> DataFrame:
    """Usable rows of a release with key and hash; rows without a title are no records."""
    rows = with_normal_url(conformed.filter(F.col("title").isNotNull()))
    return rows.withColumn("stable_key", stable_key()).withColumn("content_hash", content_hash())
