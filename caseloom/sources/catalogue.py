"""Catalogue releases as CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import blank_to_null, trim_ws
from ..operators.catalogue import keyed_rows
from ..operators.common import derived_id, first_row, join_many_to_one
from ..schemas import CATALOGUE_HEADERS
from ..session import settled
from .records import first_records, read_pieces, records_of

_CSV = {
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "mode": "PERMISSIVE",
}
#: Fields a record may have whatever its header says; the rest of the reader's limits are its defaults.
_MOST_FIELDS = 20_480


def read_raw_csv(spark: SparkSession, path: str, spec: dict[str, str] | None = None) -> DataFrame:
    """Rows of the catalogue files: ``file``, ``ordinal`` (grows with the line) and the columns of ``spec``.

    Every file has a header of its own, in any order: its first row says which value
    belongs to which column (case and outer blanks do not count, of two equal headers
    the later one does, unknown ones are left out). Blank and missing values are NULL.
    A header may have any number of columns. Files are scanned once, each by many tasks,
    also where fields span lines (see :func:`.records.csv_records`).
    """
    spec = spec or CATALOGUE_HEADERS
    pieces = read_pieces(spark, path)
    records, heads = records_of(pieces), settled(first_records(pieces), "release-heads")
    # at least as many as fields, since quoted commas count too
    width = heads.agg(F.max(F.size(F.split("record", ",", -1)))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {**_CSV, "maxColumns": str(max(_MOST_FIELDS, width + 1))}
    fields = F.array(*[F.col("_f")[f"c{i}"] for i in range(width)])
    title = lambda h: F.coalesce(F.lower(trim_ws(h)), F.lit(""))
    heads = heads.select("file", F.col("ordinal").alias("_top"), F.from_csv("record", schema, options).alias("_f"))
    # reversed, so that the last of equal headers is found
    heads = heads.select("file", "_top", F.reverse(F.transform(fields, title)).alias("_names"))
    rows = records.select("file", "ordinal", F.from_csv("record", schema, options).alias("_f"))
    rows = rows.select("file", "ordinal", fields.alias("_values"))
    place = lambda h: F.lit(width) - F.array_position("_names", h.strip().lower()).cast("int")
    values = [
        F.when(F.array_contains("_names", h.strip().lower()), blank_to_null(F.get("_values", place(h)))).alias(name)
        for h, name in spec.items()
    ]
    return join_many_to_one(rows, heads, ["file"]).filter("ordinal > _top").select("file", "ordinal", *values)


def read_catalogue_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Usable rows of a release with ``stable_key`` and ``content_hash``, first of each key.

    First means the first line of the first file, by path. With ``check`` a release
    without any usable row is an error, found by looking for a single row.
    """
    usable = read_raw_csv(spark, path).filter(F.col("title").isNotNull())
    if check and not usable.take(1):
        raise ValueError(f"catalogue without usable records: {path}")
    return first_row(keyed_rows(usable), ["stable_key"], [F.col("file"), F.col("ordinal")]).drop("ordinal")


# fixed values: starts of an error page delivered in place of data (case matters)
_PAGE_STARTS = ["<!DOCTYPE", "<HTML", "<html"]
_EVIDENCE_BYTES = 200


def looks_like_page(content: Column) -> Column:
    head = F.substring(content, 1, 16)
    found = F.lit(False)
    for start in _PAGE_STARTS:
        found = found | (F.substring(head, 1, len(start)) == F.lit(start).cast("binary"))
    return found


def begins_like_page(head: bytes) -> bool:
    """:func:`looks_like_page` for the first bytes of a file."""
    return head.startswith(tuple(start.encode() for start in _PAGE_STARTS))


def split_html_payloads(payloads: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Payloads that are data, and those that are pages, reduced to their first bytes as evidence."""
    is_page = looks_like_page(F.col(content))
    rest = [c for c in payloads.columns if c != content]
    # the cut may split a character, which is then shown as a replacement
    sample = F.make_valid_utf8(F.substring(content, 1, _EVIDENCE_BYTES).cast("string")).alias("sample")
    return payloads.filter(~is_page), payloads.filter(is_page).select(*rest, sample)


def _plain_path(col: str) -> Column:
    """The sources spell ``scheme:///`` and ``scheme:/`` differently."""
    return F.regexp_replace(col, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def snapshot_manifest(
    files: DataFrame,
    rows: DataFrame,
    source_name: str,
    upstream_url: str,
    fetched_at: str,
    label: str = "Catalogue sync",
) -> DataFrame:
    """One row per raw file of a release.

    ``files`` comes from the ``binaryFile`` source, ``rows`` are the deduplicated
    rows with their ``file``. A file without usable rows is kept as failed.
    """
    counted = rows.groupBy(_plain_path("file").alias("path")).agg(F.count(F.lit(1)).alias("record_count"))
    hashed = files.select(_plain_path("path").alias("path"), F.sha2("content", 256).alias("content_hash"))
    joined = hashed.join(counted, "path", "left")
    usable = F.col("record_count").isNotNull()
    return joined.select(
        derived_id("snapshot", F.lit(source_name), F.lit(fetched_at), "content_hash").alias("id"),
        F.lit(source_name).alias("source_name"),
        F.lit(upstream_url).alias("upstream_url"),
        F.lit(f"{label} {fetched_at[:10]}").alias("release_label"),
        F.lit(fetched_at).alias("fetched_at"),
        "content_hash",
        F.col("path").alias("snapshot_path"),
        F.coalesce("record_count", F.lit(0).cast("long")).alias("record_count"),
        F.when(usable, "completed").otherwise("failed").alias("status"),
        F.when(~usable, "no usable records").alias("error"),
    )


def snapshot_rows(rows: DataFrame, snapshot_id: str) -> DataFrame:
    """Rows of a release as kept in the history."""
    catalogue = [c for c in rows.columns if c not in ("file", "stable_key", "content_hash")]
    return rows.select(
        F.lit(snapshot_id).alias("snapshot_id"),
        "stable_key",
        "content_hash",
        "title",
        "document_url",
        F.to_json(F.struct(*sorted(catalogue)), {"ignoreNullFields": "false"}).alias("record_json"),
    )

