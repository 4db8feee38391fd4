"""Sources, cleaning, change tracking and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalise_title, normalise_url
from ..operators import catalogue as cat, changes as chg, quality as q
from ..schemas import CATALOGUE_HEADERS
from ..session import scratch_path, settled
from ..sources import catalogue as src, exports, files as fs, library as lib, sinks
from ..streaming.catalogue import stream_catalogue
from .registry import query
from .sql import norm_title, trim
from .views import spread, table, view

_HEADER_OF = {name: header for header, name in CATALOGUE_HEADERS.items()}


def _release(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a catalogue release: padded headers, quoted and multi-line fields."""
    docs = table(spark, sf, "documents")
    ident = F.col("doc_id").cast("string")
    columns = {
        "title": F.concat(F.lit('Doc "00'), ident, F.lit('" ')),
        "agency": F.concat(F.lit("  "), F.col("source")),
        "release_date": F.lit(""),
        "summary": F.concat(F.lit("first, "), F.col("text")),
        "document_url": F.concat(F.lit("https://EX.org/a file/"), ident),
    }
    return docs.select(*[value.alias(f" {_HEADER_OF[name]}") for name, value in columns.items()])


def _write_release(spark: SparkSession, sf: str, parts: int | None = None) -> str:
    path = scratch_path(spark, "release")
    rows = _release(spark, sf)
    if parts:
        rows = rows.repartition(parts, F.col(" Title"))
    writer = rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return path


_RELEASE_SQL = f"""
select 'Doc "00' || doc_id || '"' as title, source as agency, cast(null as varchar) as release_date,
  'https://ex.org/a%20file/' || doc_id as document_url, sha256({trim("'first, ' || text")}) as summary_hash,
  'url:https://ex.org/a%20file/' || doc_id || '|title:doc "' || doc_id || '"' as stable_key
from documents"""


@query("s01_read_catalogue_csv", _RELEASE_SQL)
def s01(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read_catalogue_csv(spark, _write_release(spark, sf))
    return rows.select(
        "title", "agency", "release_date", "document_url", F.sha2("summary", 256).alias("summary_hash"), "stable_key"
    )


@query(
    "s01_read_catalogue_files",
    f"""
select 'Doc "00' || doc_id || '"' as title, source as agency, 'https://ex.org/a%20file/' || doc_id as document_url,
  sha256({trim("case when doc_id % 2 = 0 then 'first, ' else 'later, ' end || text")}) as summary_hash,
  case when doc_id % 2 = 0 then 'a' else 'b' end as folder
from documents""",
)
def s01_files(spark: SparkSession, sf: str) -> DataFrame:
    """A release in files whose headers differ in order; keys that stand in several files come from the first one."""
    path = scratch_path(spark, "files")
    rows = _release(spark, sf).withColumn("n", F.regexp_extract(" Title", "00([0-9]+)", 1).cast("long"))
    columns = [c for c in rows.columns if c != "n"]
    summary = f" {_HEADER_OF['summary']}"
    later = rows.withColumn(summary, F.concat(F.lit("later"), F.expr(f"substring(`{summary}`, 6)")))
    for folder, frame in (("a", rows.filter("n % 2 = 0").select(*columns)), ("b", later.select(*reversed(columns)))):
        writer = frame.write.option("header", "true").option("quoteAll", "true").option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{path}/{folder}")
    found = src.read_catalogue_csv(spark, f"{path}/*")
    folder = F.regexp_extract("file", "/([ab])/[^/]*$", 1).alias("folder")
    return found.select("title", "agency", "document_url", F.sha2("summary", 256).alias("summary_hash"), folder)


@query(
    "s02_split_html_payloads",
    """
select 'page' as kind, page_id as id, true as rejected, html[1:15] as sample from pages where html[1:9] = '<!DOCTYPE'
  or html[1:5] in ('<HTML', '<html')
union all
select 'page', page_id, false, null from pages where not (html[1:9] = '<!DOCTYPE' or html[1:5] in ('<HTML', '<html'))
union all
select 'document', doc_id, false, null from documents where not (text[1:9] = '<!DOCTYPE'
  or text[1:5] in ('<HTML', '<html'))
union all
select 'document', doc_id, true, text[1:15] from documents where text[1:9] = '<!DOCTYPE'
  or text[1:5] in ('<HTML', '<html')""",
)
def s02(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content")
    )
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content")
    )
    good, bad = src.split_html_payloads(pages.unionByName(docs))
    return good.select("kind", "id", F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("sample")).unionByName(
        bad.select("kind", "id", F.lit(True).alias("rejected"), F.substring("sample", 1, 15).alias("sample"))
    )


@query(
    "s03_conform_columns",
    f"""
select page_id, nullif({trim("url")}, '') as title, nullif({trim("case when page_id % 5 = 0 then ' ' else html end")}, '')
  as summary, cast(null as varchar) as agency
from pages""",
)
def s03(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("  "), F.col("url"), F.lit("\t ")).alias(" TITLE "),
        F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.col("html")).alias("description blurb"),
    )
    return cat.conform_columns(pages, keep=("page_id",)).select("page_id", "title", "summary", "agency")


@query(
    "s04_normalise_url",
    """
with base as (
  select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) as origin,
    regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '') as rest from pages
)
select page_id, origin || case when rest = '' or rest[1:1] in ('?', '#') then '/' else '' end || rest || '%20x' as url,
  'no url ' || page_id as kept_words, 'no%20url%20' || page_id as words
from base""",
)
def s04(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(
        F.upper(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*", 0)),
        F.regexp_replace("url", r"^[a-zA-Z]+://[^/?#]*", ""),
        F.lit(" x"),
    )
    words = F.concat(F.lit("no url "), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select(
        "page_id", normalise_url(raw).alias("url"), words.alias("kept_words"), normalise_url(words).alias("words")
    )


# ``lower`` of the check engine maps letter by letter and knows fewer letters: the rest of Unicode's rule is spelt out.
# A run of digits is an unsigned 64-bit integer, or 0 where it does not fit.
_LETTERS_SQL = "\\p{Lu}\\p{Ll}\\p{Lt}\\x{2160}-\\x{217F}\\x{24B6}-\\x{24E9}\\x{1F130}-\\x{1F149}\\x{1F150}-\\x{1F169}\\x{1F170}-\\x{1F189}\\x{AA}\\x{BA}" + "".join(
    f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x10D50, 0x10D65), (0x10D70, 0x10D85)]
)
_BETWEEN_SQL = (
    "\\p{Mn}\\p{Me}\\p{Cf}\\p{Lm}\\p{Sk}.:\\x{27}\\x{B7}\\x{387}\\x{55F}\\x{5F4}\\x{2018}\\x{2019}\\x{2024}\\x{2027}"
    "\\x{FE13}\\x{FE52}\\x{FE55}\\x{FF07}\\x{FF0E}\\x{FF1A}"
    # and marks the check engine does not know yet
    "\\x{897}\\x{10D4E}\\x{10D69}-\\x{10D6D}\\x{10D6F}\\x{10EFC}\\x{113BB}-\\x{113C0}\\x{113CE}\\x{113D0}\\x{113D2}"
    "\\x{113E1}-\\x{113E2}\\x{11F5A}\\x{1611E}-\\x{16129}\\x{1612D}-\\x{1612F}\\x{16D40}-\\x{16D42}\\x{16D6B}-\\x{16D6C}\\x{1E5EE}-\\x{1E5EF}"
)
_NEW_UPPER = "".join(map(chr, [0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66)]))
_NEW_LOWER = "".join(map(chr, [0x1C8A, 0x264, 0xA7CD, 0xA7DB, 0x19B, *range(0x10D70, 0x10D86)]))
_TITLE_SQL = f"""
with given as (select doc_id, 'Doc 00' || doc_id || ' ' || text as t from documents),
numbered as (
  select doc_id, array_to_string([case when p[1] between '0' and '9' then coalesce(cast(try_cast(p as ubigint) as varchar), '0')
    else p end for p in regexp_extract_all(t, '[0-9]+|[^0-9]+')], '') as t
  from given
),
sigma as (
  select doc_id, regexp_replace(t, '([{_LETTERS_SQL}][{_BETWEEN_SQL}]*)Σ([{_BETWEEN_SQL}]*)([^{_LETTERS_SQL}{_BETWEEN_SQL}]|$)',
    '\\1ς\\2\\3', 'g') as t
  from numbered
)
select doc_id, lower(translate(replace(t, 'İ', 'i' || chr(775)), '{_NEW_UPPER}', '{_NEW_LOWER}')) as title from sigma"""


@query("s05_normalise_title", _TITLE_SQL)
def s05(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("Doc 00"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    return spread(table(spark, sf, "documents"), "doc_id").select("doc_id", normalise_title(title).alias("title"))


_KEY_SQL = f"""case when document_url like 'http://%' or document_url like 'https://%'
    then 'url:' || document_url || '|title:' || {norm_title("title")}
    else 'meta:' || sha256({norm_title("title")} || '|' || coalesce(release_date, '') || '|' || coalesce(agency, '')
      || '|' || coalesce(document_url, '')) end"""


@query("s06_stable_key", f"select id, {_KEY_SQL} as stable_key from fx_records")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "fx_records").select("id", cat.stable_key().alias("stable_key"))


@query(
    "s07_content_hash",
    """
select id, sha256(cast(to_json({agency: agency, document_url: document_url, incident_date: incident_date,
  incident_location: incident_location, release_date: release_date, title: title}) as varchar)) as content_hash
from fx_records""",
)
def s07(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["title", "agency", "release_date", "incident_date", "incident_location", "document_url"]
    return view(spark, sf, "fx_records").select("id", cat.content_hash(columns).alias("content_hash"))


@query(
    "s08_dedup_first",
    f"""
with doubled as (
  select id, {_KEY_SQL} as stable_key, agency, cast(id as bigint) as ordinal from fx_records
  union all
  select id, {_KEY_SQL}, 'copy', cast(id as bigint) - 5 from fx_records
)
select stable_key, id, agency from (
  select *, row_number() over (partition by stable_key order by ordinal, agency) as rn from doubled) where rn = 1""",
)
def s08(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_records").withColumn("stable_key", cat.stable_key())
    number = F.col("id").cast("long")
    first = rows.select("id", "stable_key", "agency", number.alias("ordinal"))
    copies = rows.select("id", "stable_key", F.lit("copy").alias("agency"), (number - 5).alias("ordinal"))
    return cat.dedup_first(first.unionByName(copies)).select("stable_key", "id", "agency")


@query(
    "s09_snapshot_manifest",
    "select count(*) as record_count, 'completed' as status, 'Catalogue sync 2024-05-01' as release_label from documents",
)
def s09(spark: SparkSession, sf: str) -> DataFrame:
    path = _write_release(spark, sf)
    rows = src.read_catalogue_csv(spark, path)
    files = fs.read_files(spark, path, "*.csv")
    manifest = src.snapshot_manifest(files, rows, "catalogue", "https://ex.org/c.csv", "2024-05-01T10:00:00+00:00")
    return manifest.groupBy("status", "release_label").agg(F.sum("record_count").alias("record_count")).select(
        "record_count", "status", "release_label"
    )


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as stored files."""
    name = F.concat(F.lit("https://ex.org/f/the%20doc+"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return table(spark, sf, "documents").select(
        "doc_id", name.alias("path"), F.col("text").cast("binary").alias("content")
    )


@query(
    "s10_artifact_catalogue",
    """
select 'https://ex.org/f/the%20doc+' || doc_id || '.TXT' as source_url, sha256(text) as sha256,
  cast(strlen(text) as bigint) as byte_size, 'the doc+' || doc_id || '.TXT' as original_filename, 'txt' as extension,
  sha256(text)[1:2] || '/' || sha256(text) || '.txt' as relative_path
from documents""",
)
def s10(spark: SparkSession, sf: str) -> DataFrame:
    return fs.artifact_catalogue(_files(spark, sf))


def _written_files(spark: SparkSession, sf: str, keep: str = "true") -> str:
    """The documents as one text file each, in a fresh folder of the shared one."""
    folder = scratch_path(spark, "arrived")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = table(spark, sf, "documents").filter(keep).select(name.alias("path"), F.lit(0).alias("line_no"), F.col("text").alias("block"))
    exports.write_documents(rows, folder, ["line_no"])
    return folder


@query(
    "s10_library_files",
    """
select sha256[1:2] || '/' || sha256 || '.txt' as relative_path, sha256, any_value(byte_size) as byte_size, count(*) as arrivals, 1::bigint as written,
  cast(count(*) - 1 as bigint) as skipped
from (select sha256(coalesce(text, '')) as sha256, cast(strlen(coalesce(text, '')) as bigint) as byte_size from documents) group by sha256""",
)
def s10_library(spark: SparkSession, sf: str) -> DataFrame:
    """Files stored by content, and what the library then holds, read back."""
    arrived, library = _written_files(spark, sf), scratch_path(spark, "library")
    stored = lib.store_files(lib.list_files(spark, arrived), library)
    counts = stored.groupBy("relative_path").agg(
        F.count(F.lit(1)).alias("arrivals"), F.count_if("is_new").alias("written"), F.count_if(~F.col("is_new")).alias("skipped")
    )
    held = settled(lib.stored_hashes(spark, library), "held").withColumnRenamed("local_path", "relative_path")
    return settled(held.withColumnRenamed("file_hash", "sha256").join(counts, "relative_path", "full"), "library")


@query(
    "s11_merge_artifacts",
    """
with known as (
  select sha256, min(id) as id, min(record_id) as record_id, min(source_url) as source_url, min(byte_size) as byte_size,
    min(relative_path) as relative_path
  from fx_artifacts where source_type = 'official' group by sha256 having count(*) > 1
),
incoming as (
  select sha256, case when byte_size % 2 = 0 then record_id end as record_id, source_url, byte_size,
    sha256[1:2] || '/' || sha256 as relative_path, cast(id[2:] as bigint) as ordinal
  from fx_artifacts
),
merged as (
  select sha256, arg_min(byte_size, ordinal) as byte_size, arg_min(relative_path, ordinal) as relative_path,
    arg_max(record_id, ordinal) filter (where record_id is not null) as record_id,
    arg_max(source_url, ordinal) as source_url
  from incoming group by sha256
)
select sha256, coalesce(k.id, sha256('artifact|' || sha256)) as id, coalesce(m.record_id, k.record_id) as record_id,
  coalesce(m.source_url, k.source_url) as source_url, coalesce(k.byte_size, m.byte_size) as byte_size,
  coalesce(k.relative_path, m.relative_path) as relative_path
from merged m full join known k using (sha256)""",
)
def s11(spark: SparkSession, sf: str) -> DataFrame:
    stored = view(spark, sf, "fx_artifacts")
    known = (
        stored.filter(F.col("source_type") == "official")
        .groupBy("sha256")
        .agg(
            F.min("id").alias("id"),
            F.min("record_id").alias("record_id"),
            F.min("source_url").alias("source_url"),
            F.min("byte_size").alias("byte_size"),
            F.min("relative_path").alias("relative_path"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .drop("n")
    )
    incoming = stored.select(
        "sha256",
        F.when(F.col("byte_size") % 2 == 0, F.col("record_id")).alias("record_id"),
        "source_url",
        "byte_size",
        fs.library_path(F.col("sha256"), F.lit(None)).alias("relative_path"),
        F.substring("id", 2, 20).cast("long").alias("ordinal"),
    )
    merged, _ = fs.merge_artifacts(known, incoming)
    return merged.select("sha256", "id", "record_id", "source_url", "byte_size", "relative_path")


@query(
    "s12_records_from_files",
    """
select sha256('manual|https://ex.org/f/the%20doc+' || doc_id || '.TXT') as id,
  case when doc_id % 3 = 0 then lang else 'the%20doc+' || doc_id end as title, 'txt' as file_type,
  'manual' as source_type, 'pending' as analysis_status
from documents
union all
select sha256('web|' || url), url, 'txt', 'manual', 'pending' from pages""",
)
def s12(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("lang"))).otherwise(" ")
    path = F.concat(F.lit("https://ex.org/f/the%20doc+"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    files = table(spark, sf, "documents").select(path.alias("path"), named.alias("title"))
    ts = "2024-05-01T00:00:00+00:00"
    records = fs.records_from_files(files, ts).unionByName(fs.records_from_pages(table(spark, sf, "pages"), ts))
    return records.select("id", "title", "file_type", "source_type", "analysis_status")


@query(
    "s13_pages_to_text",
    """
with node as (
  select page_id, url, unnest(nodes) as n, generate_subscripts(nodes, 1) as i from (
    select page_id, url, string_split_regex(replace(html, 'var t="</p>";', 'var t="' || chr(1) || '";'), '<[^>]*>') as nodes
    from pages)
),
plain as (
  select page_id, url, i, regexp_replace(replace(replace(replace(replace(replace(replace(n, chr(1), '</p>'),
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'), '^\\s+|\\s+$', '', 'g') as n
  from node
)
select page_id, url, 'Source URL: ' || url || chr(10) || chr(10)
  || coalesce(string_agg(n || chr(10), '' order by i) filter (n <> ''), '') as text
from plain group by page_id, url""",
)
def s13(spark: SparkSession, sf: str) -> DataFrame:
    return fs.pages_to_text(table(spark, sf, "pages"))


@query(
    "s14_read_text_assets",
    """
select 'f/' || doc_id || '.' || case doc_id % 4 when 0 then 'MD' when 1 then 'json' when 2 then 'pdf' else 'exe' end
    as path,
  case when doc_id % 4 < 2 then text end as text, case when doc_id % 4 < 2 then 'text-file' end as engine,
  case doc_id % 4 when 2 then 'needs external text: pdf' when 3 then 'unsupported type `exe`' end as error
from documents""",
)
def s14(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("case doc_id % 4 when 0 then 'MD' when 1 then 'json' when 2 then 'pdf' else 'exe' end")
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )
    return fs.read_text_assets(files)


@query(
    "s15_stream_catalogue",
    "select count(*) as records, count(*) as added, count(distinct doc_id) as distinct_keys from documents",
)
def s15(spark: SparkSession, sf: str) -> DataFrame:
    landing = _write_release(spark, sf, parts=2)
    store, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "checkpoint")
    stream_catalogue(spark, landing, store, checkpoint).awaitTermination()
    records = sinks.read_version(spark, f"{store}/records").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("stable_key").alias("distinct_keys"), F.lit(0).alias("added")
    )
    reports = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{store}/reports").agg(
        F.lit(0).alias("records"), F.lit(0).alias("distinct_keys"), F.sum("added").alias("added")
    )
    return records.unionByName(reports).agg(*[F.sum(c).alias(c) for c in ("records", "added", "distinct_keys")])


@query(
    "s17_write_version",
    "select doc_id, sha256(text || '!') as text_hash, 2 as version from documents",
)
def s17(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    store = scratch_path(spark, "table")
    sinks.write_version(docs, store, ["doc_id"])
    version = sinks.write_version(docs.withColumn("text", F.concat("text", F.lit("!"))), store, ["doc_id"])
    return sinks.read_version(spark, store).select(
        "doc_id", F.sha2("text", 256).alias("text_hash"), F.lit(version).alias("version")
    )


# --- change tracking --------------------------------------------------------

_DIFF_SQL = """
select coalesce(c.stable_key, p.stable_key) as stable_key,
  case when p.stable_key is null then 'added' when c.stable_key is null then 'removed' else 'changed' end as change_type,
  case when c.stable_key is null then coalesce(r.title, p.stable_key) else c.title end as title,
  c.document_url as document_url, p.content_hash as previous_hash, c.content_hash as current_hash
from fx_prev p full join fx_cur c on p.stable_key = c.stable_key
left join fx_records r on r.id = p.stable_key and r.source_type = 'official'
where p.content_hash is distinct from c.content_hash"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    records = view(spark, sf, "fx_records").withColumn("stable_key", F.col("id"))
    return chg.snapshot_diff(view(spark, sf, "fx_prev"), view(spark, sf, "fx_cur"), records)


@query("c01_snapshot_diff", _DIFF_SQL)
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@query(
    "c02_sync_report",
    f"""
with diff as ({_DIFF_SQL})
select (select count(*) from fx_cur) as record_count, count(*) filter (change_type = 'added') as added,
  count(*) filter (change_type = 'changed') as changed, count(*) filter (change_type = 'removed') as removed
from diff""",
)
def c02(spark: SparkSession, sf: str) -> DataFrame:
    report = chg.sync_report(_diff(spark, sf), view(spark, sf, "fx_cur"))
    return report.select(*[F.col(c).cast("long").alias(c) for c in report.columns])


@query(
    "c03_upsert_records",
    """
with old as (
  select id, case when source_type = 'official' then id else stable_key end as stable_key, source_type, title, document_url,
    content_hash, local_path, analysis_status,
    case when cast(id as bigint) % 4 = 0 then '2023-01-01' end as removed_from_source_at
  from fx_records
),
official as (select * from old where source_type = 'official')
select coalesce(o.id, sha256('official|' || c.stable_key)) as id, coalesce(c.stable_key, o.stable_key) as stable_key,
  'official' as source_type, case when c.stable_key is null then o.title else c.title end as title,
  case when c.stable_key is null then o.document_url else c.document_url end as document_url,
  case when c.stable_key is null then o.content_hash else c.content_hash end as content_hash, o.local_path as local_path,
  case when o.id is null then 'pending' else o.analysis_status end as analysis_status,
  case when c.stable_key is null then coalesce(o.removed_from_source_at, '2024-06-01') end as removed_from_source_at
from official o full join fx_cur c on o.stable_key = c.stable_key
union all
select id, stable_key, source_type, title, document_url, content_hash, local_path, analysis_status,
  removed_from_source_at from old where source_type <> 'official'""",
)
def c03(spark: SparkSession, sf: str) -> DataFrame:
    records = (
        view(spark, sf, "fx_records")
        .withColumn(
            "stable_key",
            F.when(F.col("source_type") == "official", F.col("id")).otherwise(F.col("stable_key")),
        )
        .withColumn("removed_from_source_at", F.when(F.col("id").cast("long") % 4 == 0, "2023-01-01"))
        .withColumn("source_snapshot_id", F.lit("s1"))
    )
    merged = chg.upsert_records(records, view(spark, sf, "fx_cur"), "s2", "2024-06-01")
    return merged.select(
        "id",
        "stable_key",
        "source_type",
        "title",
        "document_url",
        "content_hash",
        "local_path",
        "analysis_status",
        "removed_from_source_at",
    )


@query(
    "c04_change_feed",
    """
with numbered as (select distinct snapshot_no from fx_snapshots),
following as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) as next_no from numbered),
before as (
  select f.next_no as snapshot_no, s.stable_key, s.content_hash from fx_snapshots s join following f using (snapshot_no)
  where f.next_no is not null
)
select snapshot_no, stable_key,
  case when b.content_hash is null then 'added' when c.content_hash is null then 'removed' else 'changed' end
    as change_type,
  b.content_hash as previous_hash, c.content_hash as current_hash
from before b full join fx_snapshots c using (snapshot_no, stable_key)
where b.content_hash is distinct from c.content_hash""",
)
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return chg.change_feed(view(spark, sf, "fx_snapshots"))


@query(
    "c05_latest_snapshot",
    """
select id, source_name, fetched_at, record_count from fx_manifest
where status = 'completed' and source_name = 'click' order by fetched_at desc, id limit 1""",
)
def c05(spark: SparkSession, sf: str) -> DataFrame:
    latest = chg.latest_snapshot(view(spark, sf, "fx_manifest"), "click")
    return latest.select("id", "source_name", "fetched_at", "record_count")


# --- data quality -----------------------------------------------------------


@query(
    "q01_drop_duplicate_records",
    """
with r as (select * replace ('T' || cast(cast(id as bigint) % 400 as varchar) as title) from fx_records),
scored as (
  select *, count(*) filter (source_type = 'official') over w as officials,
    row_number() over (w order by case when analysis_status = 'completed' then 10 else 0 end
      + case when contains(stable_key, '|title:') then 1 else 0 end desc, id) as rn
  from r window w as (partition by title, document_url)
)
select id, title, document_url, source_type, analysis_status from scored
where document_url is null or officials <= 1 or rn = 1""",
)
def q01(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat(F.lit("T"), (F.col("id").cast("long") % 400).cast("string"))
    records = view(spark, sf, "fx_records").withColumn("title", title)
    return q.drop_duplicate_records(records).select("id", "title", "document_url", "source_type", "analysis_status")


@query(
    "q02_drop_poisoned_artifacts",
    """
with bad as (select distinct relative_path from fx_artifacts where byte_size < 1024 and source_type = 'official')
select 'artifact' as kind, id, relative_path as path from fx_artifacts where relative_path not in (from bad)
union all
select 'record', r.id, case when b.relative_path is null then r.local_path end
from fx_records r left join bad b on b.relative_path = r.local_path""",
)
def q02(spark: SparkSession, sf: str) -> DataFrame:
    artifacts, records = q.drop_poisoned_artifacts(view(spark, sf, "fx_artifacts"), view(spark, sf, "fx_records"))
    return artifacts.select(F.lit("artifact").alias("kind"), "id", F.col("relative_path").alias("path")).unionByName(
        records.select(F.lit("record").alias("kind"), "id", F.col("local_path").alias("path"))
    )


@query(
    "q03_verify_stored_files",
    """
select count(*) as total, count(*) filter (doc_id % 7 <> 0 and doc_id % 5 <> 0) as verified,
  count(*) filter (doc_id % 7 <> 0 and doc_id % 5 = 0) as corrupted, count(*) filter (doc_id % 7 = 0) as missing
from documents""",
)
def q03_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Files read where they lie: some were never written, of some another content is expected."""
    docs = table(spark, sf, "documents")
    folder = _written_files(spark, sf, "doc_id % 7 <> 0")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    records = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), name.alias("local_path"))
    other = F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    artifacts = docs.select(F.col("doc_id").cast("string").alias("record_id"), F.sha2(F.concat(F.coalesce("text", F.lit("")), other), 256).alias("sha256"))
    hashed = lib.hash_files(lib.list_files(spark, folder).select("path"))
    files = settled(hashed.select(F.element_at(F.split("path", "/"), -1).alias("local_path"), F.col("sha256").alias("file_hash")), "seen")
    return q.verify_integrity(records, artifacts, files)


@query(
    "q03_verify_integrity",
    """
with files as (
  select relative_path as local_path, case when byte_size % 17 = 0 then null when byte_size % 5 = 0 then sha256 || 'x'
    else sha256 end as file_hash
  from fx_artifacts
),
present as (select * from files where coalesce(file_hash[1:1], 'a') <> '0'),
verdicts as (
  select case when p.local_path is null then 'missing' when a.sha256 is null then 'verified'
    when p.file_hash is not distinct from a.sha256 then 'verified' else 'corrupted' end as verdict
  from fx_records r left join fx_artifacts a on a.record_id = r.id left join present p on p.local_path = r.local_path
  where r.local_path is not null
)
select count(*) as total, count(*) filter (verdict = 'verified') as verified,
  count(*) filter (verdict = 'corrupted') as corrupted, count(*) filter (verdict = 'missing') as missing
from verdicts""",
)
def q03(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = view(spark, sf, "fx_artifacts")
    damaged = (
        F.when(F.col("byte_size") % 17 == 0, F.lit(None).cast("string"))
        .when(F.col("byte_size") % 5 == 0, F.concat("sha256", F.lit("x")))
        .otherwise(F.col("sha256"))
    )
    files = artifacts.select(F.col("relative_path").alias("local_path"), damaged.alias("file_hash"))
    present = files.filter(F.coalesce(F.substring("file_hash", 1, 1), F.lit("a")) != "0")
    return q.verify_integrity(view(spark, sf, "fx_records"), artifacts, present)


@query(
    "q04_clear_analysis",
    """
with chosen as (select distinct record_id as id from fx_links where name = 'quality 1')
select 'record' as kind, r.id as id, case when c.id is null then analysis_status else 'pending' end as state,
  case when c.id is null then intelligence_json end as json
from fx_records r left join chosen c using (id)
union all
select 'result', record_id, status, null from fx_results where record_id not in (from chosen)
union all
select 'link', record_id, name, null from fx_links where record_id not in (from chosen)
union all
select 'asset', id, asset_type, null from fx_assets where asset_type = 'source' or record_id not in (from chosen)""",
)
def q04(spark: SparkSession, sf: str) -> DataFrame:
    links = view(spark, sf, "fx_links")
    chosen = links.filter(F.col("name") == "quality 1").select(F.col("record_id").alias("id"))
    out = q.clear_analysis(
        {
            "records": view(spark, sf, "fx_records").withColumn("redaction_score", F.lit(0.5)),
            "analysis_results": view(spark, sf, "fx_results"),
            "record_entities": links,
            "record_assets": view(spark, sf, "fx_assets"),
        },
        chosen,
    )
    none = F.lit(None).cast("string").alias("json")
    kind = lambda name: F.lit(name).alias("kind")
    return (
        out["records"]
        .select(kind("record"), "id", F.col("analysis_status").alias("state"), F.col("intelligence_json").alias("json"))
        .unionByName(
            out["analysis_results"].select(
                kind("result"), F.col("record_id").alias("id"), F.col("status").alias("state"), none
            )
        )
        .unionByName(
            out["record_entities"].select(kind("link"), F.col("record_id").alias("id"), F.col("name").alias("state"), none)
        )
        .unionByName(out["record_assets"].select(kind("asset"), "id", F.col("asset_type").alias("state"), none))
    )


@query(
    "q05_reset_local_copies",
    """
select (select count(*) from fx_artifacts) as files_removed, (select cast(sum(byte_size) as bigint) from fx_artifacts)
  as bytes_removed, count(*) as records, count(*) filter (false) as still_local
from fx_records""",
)
def q05(spark: SparkSession, sf: str) -> DataFrame:
    report, records, _, _ = q.reset_local_copies(
        view(spark, sf, "fx_records").withColumn("thumbnail_path", F.lit("t.png")),
        view(spark, sf, "fx_artifacts"),
        view(spark, sf, "fx_assets"),
    )
    after = records.agg(F.count(F.lit(1)).alias("records"), F.count("local_path").alias("still_local"))
    stacked = report.unionByName(after, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("files_removed", "bytes_removed", "records", "still_local")])


@query(
    "q06_repair_stalled",
    """
select 'job' as kind, id, case when status in ('running', 'queued') then 'failed' else status end as status,
  case when status in ('running', 'queued') then '{"error":"Application interrupted"}' end as note
from fx_jobs
union all
select 'item', cast(id as varchar), case when status in ('downloading', 'queued') then 'failed' else status end,
  case when status in ('downloading', 'queued') then 'Application interrupted' end
from fx_items""",
)
def q06(spark: SparkSession, sf: str) -> DataFrame:
    jobs, items = q.repair_stalled(view(spark, sf, "fx_jobs"), view(spark, sf, "fx_items"))
    return jobs.select(F.lit("job").alias("kind"), "id", "status", F.col("summary_json").alias("note")).unionByName(
        items.select(F.lit("item").alias("kind"), F.col("id").cast("string").alias("id"), "status", F.col("error").alias("note"))
    )


@query(
    "q07_download_worklist",
    """
select id as record_id, title, document_url as url, 'queued' as status from fx_records
where source_type = 'official' and local_path is null and coalesce(document_url, '') <> ''""",
)
def q07(spark: SparkSession, sf: str) -> DataFrame:
    return q.download_worklist(view(spark, sf, "fx_records"))


@query(
    "q07_download_counts",
    """
select count(*) as total, count(*) filter (local_path is null and coalesce(document_url, '') <> '') as queued,
  count(*) filter (not (local_path is null and coalesce(document_url, '') <> '')) as skipped
from fx_records where source_type = 'official'""",
)
def q07_counts(spark: SparkSession, sf: str) -> DataFrame:
    return q.download_counts(view(spark, sf, "fx_records"))


@query(
    "q08_job_rollup",
    """
with c as (
  select job_id, count(*) as total, count(*) filter (status = 'skipped') as skipped,
    count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
    count(*) filter (status in ('queued', 'downloading')) as remaining
  from fx_items group by job_id
)
select *, case when remaining > 0 then 'running' when failed = 0 then 'completed' else 'completed_with_errors' end
    as status,
  round(case when total = 0 then 0.0 else (completed + failed)::double / nullif(total - skipped, 0) * 100 end, 6)
    as progress
from c""",
)
def q08(spark: SparkSession, sf: str) -> DataFrame:
    return q.job_rollup(view(spark, sf, "fx_items")).withColumn("progress", F.round("progress", 6))


@query(
    "q09_job_report",
    """
select job_id, i.id as id, i.title as title, i.status as status, j.status as job_status
from fx_items i join fx_jobs j on j.id = i.job_id""",
)
def q09(spark: SparkSession, sf: str) -> DataFrame:
    report = q.job_report(view(spark, sf, "fx_jobs"), view(spark, sf, "fx_items"))
    return report.select("job_id", "id", "title", "status", "job_status")


@query(
    "q09_active_job_items",
    """
with active as (select id from fx_jobs where status in ('queued', 'running') order by updated_at desc, id limit 1)
select job_id, i.id as id, i.status as status from fx_items i where job_id in (from active)
order by i.updated_at desc, i.title, i.id limit 50""",
)
def q09_active(spark: SparkSession, sf: str) -> DataFrame:
    job = q.active_job(view(spark, sf, "fx_jobs"))
    items = view(spark, sf, "fx_items")
    mine = items.join(job.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return q.job_report(job, mine, 50).select("job_id", "id", "status")
