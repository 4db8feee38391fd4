"""Cases and dossiers, model responses, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import PLACE_RULES
from ..functions.text import format_bytes
from ..operators import cases as ca, responses as rs, status as st, texts as tx
from ..session import scratch_path, settled
from ..sources import exports
from ..streaming.events import stream_status, stream_tokens, streamed_status, streamed_text
from .q_text import TS
from .registry import query
from .sql import chunk_ctes, embed_ctes, trim
from .views import arriving, spread, table, view


@query(
    "k01_case_summary",
    """
select c.id as id, c.title as title, c.description as description, c.created_at as created_at,
  (select count(distinct record_id) from fx_case_records m where m.case_id = c.id) as record_count,
  (select count(distinct n.id) from fx_case_notes n where n.case_id = c.id) as note_count
from fx_cases c""",
)
def k01(spark: SparkSession, sf: str) -> DataFrame:
    return ca.case_summary(view(spark, sf, "fx_cases"), view(spark, sf, "fx_case_records"), view(spark, sf, "fx_case_notes"))


@query(
    "k02_case_timeline",
    """
select m.case_id as case_id, r.id as id, r.title as title, m.notes as case_record_notes,
  coalesce(r.incident_date, r.release_date, r.created_at) as occurred
from fx_case_records m join fx_records r on r.id = m.record_id""",
)
def k02(spark: SparkSession, sf: str) -> DataFrame:
    rows = ca.case_timeline(view(spark, sf, "fx_case_records"), view(spark, sf, "fx_records"))
    return rows.select("case_id", "id", "title", "case_record_notes", "occurred")


@query(
    "k03_add_members",
    """
with request as (
  select case_id, record_id, notes, 1 as ordinal from fx_case_records
  union all
  select case_id, record_id || case when cast(record_id as bigint) % 10 = 0 then 'x' else '' end, 'later', 2
  from fx_case_records
),
judged as (
  select q.*, case when c.id is null then 'case not found: ' || case_id
    when r.id is null then 'record not found: ' || record_id end as reason
  from request q left join fx_cases c on c.id = q.case_id left join fx_records r on r.id = q.record_id
),
last as (select case_id, record_id, arg_max(coalesce(notes, chr(1)), ordinal) as note from judged where reason is null group by all),
merged as (
  select case_id, record_id, case when l.note is not null then nullif(l.note, chr(1)) else m.notes end as notes
  from (select case_id, record_id, 'old' as notes from fx_case_records where notes is not null) m
  full join last l using (case_id, record_id)
)
select 'member' as kind, case_id, record_id, notes as note from merged
union all
select 'reject', case_id, record_id, reason from judged where reason is not null""",
)
def k03(spark: SparkSession, sf: str) -> DataFrame:
    first = view(spark, sf, "fx_case_records")
    members = first.filter(F.col("notes").isNotNull()).withColumn("notes", F.lit("old"))
    odd = F.when(F.col("record_id").cast("long") % 10 == 0, "x").otherwise("")
    later = first.select("case_id", F.concat("record_id", odd).alias("record_id"), F.lit("later").alias("notes"))
    requests = first.withColumn("ordinal", F.lit(1)).unionByName(later.withColumn("ordinal", F.lit(2)))
    merged, rejects = ca.add_members(members, requests, view(spark, sf, "fx_cases"), view(spark, sf, "fx_records"))
    return merged.select(F.lit("member").alias("kind"), "case_id", "record_id", F.col("notes").alias("note")).unionByName(
        rejects.select(F.lit("reject").alias("kind"), "case_id", "record_id", F.col("reason").alias("note"))
    )


@query(
    "k04_create_cases",
    f"""
with request as (
  select conv_id || '-' || turn as request_id,
    case when turn % 5 = 0 then '  ' else '  ' || split_part(text, ' ', 1) || chr(10) end as title,
    case when turn % 3 = 0 then ' ' else text end as description
  from conversations
)
select 'case' as kind, sha256('case|' || request_id) as id, {trim("title")} as title,
  case when {trim("description")} <> '' then description end as description
from request where {trim("title")} <> ''
union all
select 'reject', request_id, null, 'case title is required' from request where {trim("title")} = ''""",
)
def k04(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    requests = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("request_id"),
        F.when(turn % 5 == 0, "  ")
        .otherwise(F.concat(F.lit("  "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("\n")))
        .alias("title"),
        F.when(turn % 3 == 0, " ").otherwise(F.col("text")).alias("description"),
    )
    cases, rejects = ca.create_cases(requests, TS)
    return cases.select(F.lit("case").alias("kind"), "id", "title", "description").unionByName(
        rejects.select(
            F.lit("reject").alias("kind"),
            F.col("request_id").alias("id"),
            F.lit(None).cast("string").alias("title"),
            F.col("reason").alias("description"),
        )
    )


@query(
    "k05_append_notes",
    f"""
with request as (
  select 'case' || conv_id % 50 as case_id, conv_id || '-' || turn as request_id,
    case when turn % 4 = 0 then chr(9) else ' ' || text end as body from conversations
)
select 'note' as kind, case_id, sha256('note|' || request_id) as id, {trim("body")} as body from request
where case_id in (select id from fx_cases) and {trim("body")} <> ''
union all
select 'reject', case_id, request_id, case when case_id not in (select id from fx_cases)
  then 'case not found: ' || case_id else 'note body is required' end
from request where case_id not in (select id from fx_cases) or {trim("body")} = ''
union all
select 'note', case_id, id, body from fx_case_notes""",
)
def k05(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    requests = table(spark, sf, "conversations").select(
        F.concat(F.lit("case"), (F.col("conv_id") % 50).cast("string")).alias("case_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("request_id"),
        F.lit(None).cast("string").alias("record_id"),
        F.when(turn % 4 == 0, "\t").otherwise(F.concat(F.lit(" "), F.col("text"))).alias("body"),
    )
    notes, rejects = ca.append_notes(view(spark, sf, "fx_case_notes"), requests, view(spark, sf, "fx_cases"), TS)
    return ca.list_notes(notes).select(F.lit("note").alias("kind"), "case_id", "id", "body").unionByName(
        rejects.select(F.lit("reject").alias("kind"), "case_id", F.col("request_id").alias("id"), F.col("reason").alias("body"))
    )


def _bullet(label: str, column: str) -> str:
    return f"case when coalesce({trim(column)}, '') = '' then '' else '- {label}: `' || {trim(column)} || '`' || chr(10) end"


_BULLETS = " || ".join(
    _bullet(label, column)
    for label, column in [
        ("Agency", "r.agency"),
        ("Release Date", "r.release_date"),
        ("Incident Date", "r.incident_date"),
        ("Incident Location", "r.incident_location"),
        ("Source URL", "r.document_url"),
        ("Local Path", "r.local_path"),
        ("Case Notes", "m.notes"),
    ]
)

_BLOCKS_SQL = f"""
place as (
  select m.case_id, r.id, coalesce(r.incident_date, r.release_date, r.created_at) as occurred,
    '### ' || r.title || chr(10) || chr(10) || '- Record ID: `' || r.id || '`' || chr(10) || {_BULLETS}
      || coalesce(chr(10) || {trim("r.file_type")} || chr(10), '') as entry
  from fx_case_records m join fx_records r on r.id = m.record_id
  where m.case_id in (select id from fx_cases)
),
head as (
  select id, title, description, created_at, (select count(*) from place p where p.case_id = c.id) as n_records,
    (select count(*) from fx_case_notes n where n.case_id = c.id) as n_notes
  from fx_cases c
),
block as (
  select id as case_id, 0 as section, cast(null as varchar) as occurred, cast(null as varchar) as item_id, 0 as part,
    cast(null as varchar) as kind, cast(null as varchar) as name,
    '# ' || title || chr(10) || chr(10) || coalesce(description || chr(10) || chr(10), '') || '## Case Summary'
      || chr(10) || chr(10) || '- Case ID: `' || id || '`' || chr(10) || '- Created: `' || created_at || '`' || chr(10)
      || '- Evidence records: `' || n_records || '`' || chr(10) || '- Notes: `' || n_notes || '`' || chr(10) || chr(10)
      || '## Evidence' || chr(10) || chr(10) as block
  from head
  union all
  select case_id, 1, occurred, id, 0, null, null, entry from place
  union all
  select case_id, 1, occurred, id, 1, null, null, chr(10) || 'Entities:' || chr(10) from place
  where id in (select record_id from fx_links)
  union all
  select case_id, 1, occurred, id, 2, entity_type, name,
    '- ' || entity_type || ' `' || name || '` (' || printf('%.2f', confidence) || ')' || chr(10)
  from place join fx_links on record_id = id
  union all
  select case_id, 1, occurred, id, 3, null, null, case when coalesce({trim("ocr_text")}, '') <> ''
    then chr(10) || 'Analysis Excerpt:' || chr(10) || chr(10) || '> '
      || replace(ocr_text, chr(10), chr(10) || '> ')[1:1600] || chr(10) || chr(10) else chr(10) end
  from place left join fx_results on record_id = id
  union all
  select id, 2, null, null, 0, null, null, '## Investigator Notes' || chr(10) || chr(10)
    || case when n_notes = 0 then 'No investigator notes have been added.' || chr(10) else '' end from head
  union all
  select case_id, 2, created_at, id, 1, null, null, '- `' || created_at || '`: ' || body || chr(10) from fx_case_notes
  where case_id in (select id from fx_cases)
)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return ca.dossier_blocks(
        view(spark, sf, "fx_cases"),
        view(spark, sf, "fx_case_records"),
        view(spark, sf, "fx_case_notes"),
        view(spark, sf, "fx_records").withColumn("summary", F.col("file_type")),
        view(spark, sf, "fx_links"),
        view(spark, sf, "fx_results"),
    )


@query("k06_dossier_markdown", f"with {_BLOCKS_SQL} select * from block")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf)


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_LINES_SQL = f"""{_BLOCKS_SQL},
lines as (
  select * exclude (block), unnest(string_split(regexp_replace(block, '\\n$', ''), chr(10))) as line,
    generate_subscripts(string_split(regexp_replace(block, '\\n$', ''), chr(10)), 1) - 1 as line_no
  from block
)"""


_HTML_OF_LINES = f"""
select case_id, section, occurred, item_id, part, kind, name, line_no,
  case when line[1:2] = '# ' then '<h1>' || {_esc("line[3:]")} || '</h1>'
    when line[1:3] = '## ' then '<h2>' || {_esc("line[4:]")} || '</h2>'
    when line[1:4] = '### ' then '<h3>' || {_esc("line[5:]")} || '</h3>'
    when line[1:2] = '- ' then '<p class="bullet">' || {_esc("line[3:]")} || '</p>'
    when line[1:2] = '> ' then '<blockquote>' || {_esc("line[3:]")} || '</blockquote>'
    when {trim("line")} = '' then '' else '<p>' || {_esc("line")} || '</p>' end || chr(10) as block
from lines"""


@query("k07_markdown_to_html", f"with {_LINES_SQL} {_HTML_OF_LINES}")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    html = ca.markdown_to_html(_blocks(spark, sf), view(spark, sf, "fx_cases"))
    # the fixed page around the lines is not compared
    body = html.filter(F.col("section").between(0, 2))
    return body.withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "k08_export_manifest",
    """
with request as (
  select id as case_id, 'Markdown' as format from fx_cases union all select id, 'HTML' from fx_cases
  union all select id, 'pdf' from fx_cases
),
judged as (select case_id, lower(format) as format from request)
select case_id, format, case_id || '/' || sha256('export|' || case_id || '|' || format || '|2024-06-01T00:00:00+00:00')
  || case format when 'markdown' then '.md' else '.html' end as relative_path, cast(null as varchar) as reason
from judged where format <> 'pdf'
union all
select case_id, format, null, 'export format must be `markdown` or `html`' from judged where format = 'pdf'""",
)
def k08(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "fx_cases").select(F.col("id").alias("case_id"))
    formats = F.explode(F.array(*[F.lit(f) for f in ("Markdown", "HTML", "pdf")]))
    good, bad = ca.export_manifest(ids.select("case_id", formats.alias("format")), TS)
    nothing = F.lit(None).cast("string")
    return good.select("case_id", "format", "relative_path", nothing.alias("reason")).unionByName(
        bad.select("case_id", "format", nothing.alias("relative_path"), "reason")
    )


_DOC_ORDER = "section, occurred nulls first, item_id nulls first, part, kind nulls first, name nulls first"
_PAGE_HEAD = (
    "'<!doctype html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head>' || chr(10) || '<meta charset=\"utf-8\">' || chr(10) || '<title>' || "
    + _esc("any_value(c.title)")
    + f" || '</title>' || chr(10) || '<style>{ca._PAGE_STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)"
)


@query(
    "s16_write_dossiers",
    f"""
with {_LINES_SQL},
html_line as ({_HTML_OF_LINES}),
document as (
  select case_id, 'markdown' as format, '.md' as suffix, string_agg(block, '' order by {_DOC_ORDER}) as body from block group by case_id
  union all
  select case_id, 'html', '.html', {_PAGE_HEAD} || string_agg(block, '' order by {_DOC_ORDER}, line_no)
    || '</body>' || chr(10) || '</html>' || chr(10)
  from html_line join fx_cases c on c.id = case_id group by case_id
)
select case_id, format, case_id || '/' || sha256('export|' || case_id || '|' || format || '|2024-06-01T00:00:00+00:00') || suffix as relative_path,
  cast(strlen(body) as bigint) as bytes, sha256(body) as content_hash, cast(null as varchar) as reason
from document
union all
select id, 'pdf', null, null, null, 'export format must be `markdown` or `html`' from fx_cases""",
)
def s16(spark: SparkSession, sf: str) -> DataFrame:
    """Both formats of every case as files, read back; a third format is rejected."""
    cases = view(spark, sf, "fx_cases")
    formats = F.explode(F.array(*[F.lit(f) for f in ("Markdown", "HTML", "pdf")]))
    requests = cases.select(F.col("id").alias("case_id"), formats.alias("format"))
    folder = scratch_path(spark, "exports")
    manifest, rejected = exports.export_dossiers(requests, settled(_blocks(spark, sf), "blocks"), cases, folder, TS)
    written = manifest.select("case_id", "format", "relative_path").join(exports.read_documents(spark, folder), "relative_path", "full")
    return written.unionByName(rejected, allowMissingColumns=True)


# --- model responses --------------------------------------------------------

_NONE = "- No visual anomalies detected by foundation OCR."
_FINDING = (
    "'- [' || upper(layer_type) || '] ' || content || ' (Confidence: ' || "
    "printf('%.2f', round(confidence, 2)) || ')' || chr(10)"
)
_MANIFEST_SQL = f"""
manifest as (
  select o_orderkey::varchar as record_id, cast(-1 as bigint) as part, 'FORENSIC VISUAL MANIFEST:' || chr(10)
    || case when exists (select 1 from fx_forensics f where f.record_id = o_orderkey::varchar) then ''
      else '{_NONE}' || chr(10) end as manifest
  from orders
  union all
  select record_id, seq // 1024, string_agg({_FINDING}, '' order by seq, {_FINDING}) from fx_forensics group by 1, 2
)"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return rs.forensic_manifest(view(spark, sf, "fx_forensics"), records)


@query("l01_forensic_manifest", f"with {_MANIFEST_SQL} select * from manifest")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf)


def _prompt_sql(per_record: int) -> str:
    """Prompts whose context comes from ``per_record`` conversations each."""
    return f"""
with {_MANIFEST_SQL},
turns as (
  select cast(conv_id // {per_record} as varchar) as record_id, conv_id * 1000 + turn as rank, text from conversations
),
first as (
  select * from (select *, row_number() over (partition by record_id order by rank, text) as rn from turns) where rn <= 15
),
frag as (
  select record_id, string_agg(text, chr(10) || '---' || chr(10) order by rank, text) as context from first group by 1
),
img as (select record_id, count(*) as images from fx_assets where asset_type = 'image' group by 1),
framed as (
  select d.record_id,
    '<|im_start|>system' || chr(10) || 'You audit documents for an evidence archive. ' || chr(10) || 'Directives:' || chr(10)
      || '1. STRUCTURE: Return valid JSON only.' || chr(10) || '2. AUDIT: ' || case when images > 0
      then 'AUDIT NOTICE: ' || images || ' visual assets are attached. Perform a forensic comparison.'
      else 'No visual assets attached.' end || chr(10) || chr(10) as head,
    chr(10) || chr(10) || 'CRITICAL CONTEXT FROM SEMANTIC INDEX:' || chr(10) || coalesce(context, '') || chr(10) || chr(10)
      || chr(10) || 'Input Document:' || chr(10) || case when strlen(text) > 5000
      then 'SOURCE DATA EXCERPT (Refer to Semantic Index below for full context):' || chr(10) || text[1:2000] || chr(10)
      else text end || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Perform the audit.<|im_end|>' || chr(10)
      || '<|im_start|>thought' || chr(10) as tail
  from fx_docs d left join frag using (record_id) left join img using (record_id)
)
select record_id, -2 as part, sha256(head) as prompt_hash from framed
union all select record_id, part, sha256(manifest) from manifest
union all select record_id, 4611686018427387904, sha256(tail) from framed"""


def _prompts(spark: SparkSession, sf: str, per_record: int) -> DataFrame:
    fragments = table(spark, sf, "conversations").select(
        F.floor(F.col("conv_id") / per_record).cast("string").alias("record_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rank"),
        "text",
    )
    prompts = rs.build_prompts(view(spark, sf, "fx_docs"), _manifest(spark, sf), fragments, view(spark, sf, "fx_assets"))
    return prompts.select("record_id", "part", F.sha2("prompt", 256).alias("prompt_hash"))


@query("l02_build_prompts", _prompt_sql(1))
def l02(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf, 1)


@query("l02_build_prompts_top", _prompt_sql(20))
def l02_top(spark: SparkSession, sf: str) -> DataFrame:
    """Records with far more fragments than a prompt shows."""
    return _prompts(spark, sf, 20)


_PARSED_SQL = """
split as (
  select record_id, generated,
    case when strpos(generated, '{') > 0 then generated[1:strpos(generated, '{') - 1] else '' end as before,
    case when strpos(generated, '}') > 0
      then generated[greatest(strpos(generated, '{'), 1):length(generated) - strpos(reverse(generated), '}') + 1]
      else generated[greatest(strpos(generated, '{'), 1):] end as answer
  from fx_responses
),
parsed as (
  select record_id, trim(before) as thought, json_valid(answer) as parsed,
    case when json_valid(answer) then cast(json(answer) as varchar)
      else cast(json_object('object_description', 'Extraction failed', 'raw_response', generated) as varchar) end
      as response_json
  from split
)"""


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return rs.parse_responses(view(spark, sf, "fx_responses"))


@query("l03_parse_responses", f"with {_PARSED_SQL} select record_id, thought, response_json, parsed from parsed")
def l03(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf)


@query(
    "l04_explode_observations",
    f"""
with {_PARSED_SQL},
item as (
  select record_id, unnest(json_extract(response_json, '$.observations[*]')) as v,
    generate_subscripts(json_extract(response_json, '$.observations[*]'), 1) - 1 as position
  from parsed
)
select record_id, position, 'observation' as fragment_type, v ->> '$' as text, cast(0.9 as double) as confidence
from item where json_type(v) = 'VARCHAR'""",
)
def l04(spark: SparkSession, sf: str) -> DataFrame:
    fragments = rs.explode_observations(_parsed(spark, sf), TS)
    return fragments.select(
        "record_id", F.col("position").cast("long").alias("position"), "fragment_type", "text", "confidence"
    )


@query(
    "l04_fragment_vectors",
    f"""
with {_PARSED_SQL},
item as (
  select record_id, unnest(json_extract(response_json, '$.observations[*]')) as v,
    generate_subscripts(json_extract(response_json, '$.observations[*]'), 1) - 1 as position
  from parsed
),
texts as (
  select sha256('observation|' || record_id || '|2024-06-01T00:00:00+00:00|' || position) as fragment_id, v ->> '$' as text
  from item where json_type(v) = 'VARCHAR'
),
{embed_ctes("texts", "fragment_id")}
select fragment_id, slot, round(v, 6) + 0.0 as v from vec where round(v, 6) <> 0""",
)
def l04_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = rs.fragment_vectors(rs.explode_observations(spread(_parsed(spark, sf), "record_id"), TS))
    cells = vectors.select("fragment_id", F.posexplode("embedding").alias("slot", "x"))
    return cells.filter(F.abs("x") >= 5e-7).select("fragment_id", "slot", (F.round("x", 6) + 0.0).alias("v"))


@query(
    "l05_intel_projection",
    """
with r as (
  select id, incident_date, incident_location, case cast(id as bigint) % 5 when 0 then ''
    when 1 then '{"object_description": "", "location": 0, "incident_date": false, "intelligence_score": 0.125, "agencies": ["A", "B"]}'
    when 2 then '{"object_description": 7, "location": "Here", "incident_date": "0", "pilot_observations": null}'
    when 3 then intelligence_json else 'broken {' end as j
  from fx_records
),
v as (select *, case when json_valid(j) then j else '{}' end as k from r where coalesce(j, '') <> ''),
f as (
  select *, nullif(nullif(nullif(k ->> '$.object_description', ''), '0'), 'false') as d,
    nullif(nullif(nullif(k ->> '$.location', ''), '0'), 'false') as l,
    nullif(nullif(k ->> '$.incident_date', ''), 'false') as i from v
)
select id as record_id, coalesce(d, 'No summary available.') as description,
  coalesce(i, incident_date, 'UNDISCLOSED') as target_date, coalesce(l, incident_location, 'GLOBAL') as location,
  coalesce(array_to_string(from_json(k -> '$.agencies', '["varchar"]'), ','), '') as agencies,
  coalesce(nullif(k ->> '$.pilot_observations', ''), 'No observational data resolved.') as observations,
  cast(floor(coalesce(nullif(cast(k ->> '$.intelligence_score' as double), 0), 0.6) * 100 + 0.5) as bigint) as fidelity
from f""",
)
def l05(spark: SparkSession, sf: str) -> DataFrame:
    records = view(spark, sf, "fx_records")
    number = F.col("id").cast("long") % 5
    text = (
        F.when(number == 0, "")
        .when(
            number == 1,
            '{"object_description": "", "location": 0, "incident_date": false, "intelligence_score": 0.125, '
            '"agencies": ["A", "B"]}',
        )
        .when(
            number == 2,
            '{"object_description": 7, "location": "Here", "incident_date": "0", "pilot_observations": null}',
        )
        .when(number == 3, F.col("intelligence_json"))
        .otherwise("broken {")
    )
    shown = rs.intel_projection(records.withColumn("intelligence_json", text))
    return shown.withColumn("agencies", F.array_join("agencies", ","))


@query("l06_log_history", "select id, record_id, created_at from fx_logs")
def l06(spark: SparkSession, sf: str) -> DataFrame:
    return rs.log_history(view(spark, sf, "fx_logs")).select("id", "record_id", "created_at")


@query(
    "l06_log_history_newest",
    """
select id, record_id, created_at from (
  select *, row_number() over (partition by record_id order by created_at desc, id) as rn from fx_logs) where rn <= 3""",
)
def l06_newest(spark: SparkSession, sf: str) -> DataFrame:
    return rs.log_history(view(spark, sf, "fx_logs"), 3).select("id", "record_id", "created_at")


@query(
    "l07_stale_synthesis",
    """
with log as (select record_id, max(cast(created_at as timestamptz)) as stamp from fx_logs
  group by record_id)
select r.id as record_id, coalesce(r.intelligence_json, '') <> '' and coalesce(x.ocr_text, '') <> ''
  and coalesce(cast(r.updated_at as timestamptz) > l.stamp - interval 30 seconds + interval 5 seconds, false) as stale
from fx_records r left join log l on l.record_id = r.id left join fx_results x on x.record_id = r.id""",
)
def l07(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "fx_logs").withColumn(
        "created_at", (F.to_timestamp("created_at") - F.expr("interval 30 seconds")).cast("string")
    )
    return rs.stale_synthesis(view(spark, sf, "fx_records"), view(spark, sf, "fx_results"), logs)


_TOKENS_SQL = """
with start as (select record_id, max(seq) as s from fx_tokens where status = 'synthesizing-start' group by record_id)
select record_id, seq // 4 as part, string_agg(token_text, '' order by seq) as text
from fx_tokens t left join start using (record_id)
where t.status = 'synthesizing' and coalesce(token_text, '') <> '' and (s is null or seq > s)
group by record_id, seq // 4"""


@query("l08_assemble_token_stream", _TOKENS_SQL)
def l08(spark: SparkSession, sf: str) -> DataFrame:
    return rs.assemble_token_stream(view(spark, sf, "fx_tokens"), span=4)


@query("l08_stream_tokens", _TOKENS_SQL.replace("seq // 4", "seq // 1024"))
def l08_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = arriving(spark, sf, "conversations")
    restart = (F.col("role") == "system") | (F.col("turn") % 4 == 0)
    events = rows.select(
        F.col("conv_id").alias("record_id"),
        F.col("turn").alias("seq"),
        F.when(restart, rs.RESET).otherwise(rs.TOKEN).alias("status"),
        F.col("text").alias("token_text"),
    )
    store = scratch_path(spark, "tokens")
    stream_tokens(events, store, scratch_path(spark, "checkpoint")).awaitTermination()
    return streamed_text(spark, store)


# --- dashboards -------------------------------------------------------------

_ROLLUP_SQL = """
rollup_row as (
  select count(*) as total_records, count(*) filter (source_type = 'official') as official_records,
    count(*) filter (source_type = 'manual') as manual_records,
    count(*) filter (source_type = 'official' and coalesce(document_url, '') <> '') as downloadable_records,
    count(local_path) as local_records, (select count(*) from fx_artifacts) as artifact_count,
    (select cast(coalesce(sum(byte_size), 0) as bigint) from fx_artifacts) as artifact_bytes,
    count(*) filter (analysis_status in ('completed', 'indexed')) as analyzed_records,
    count(*) filter (analysis_status = 'failed') as failed_analysis_records,
    count(*) filter (analysis_status is null or analysis_status not in ('completed', 'indexed')) as unanalyzed_count,
    count(*) filter (analysis_status = 'completed') as completed_count,
    count(*) filter (analysis_status is null or analysis_status = 'pending') as pending_count,
    (select count(*) from fx_docs) as analysis_chunks, (select count(*) from fx_fragments) as vector_chunks,
    (select count(*) from fx_links) as entity_count, (select count(*) from fx_cases) as case_count,
    (select count(*) from fx_manifest) as source_snapshots,
    (select count(*) from fx_jobs where status in ('queued', 'running')) as active_download_jobs,
    (select max(fetched_at) from fx_manifest where status = 'completed') as latest_snapshot_at,
    (select upstream_url from fx_manifest where status = 'completed'
      order by fetched_at desc, upstream_url desc, record_count desc limit 1) as latest_snapshot_url,
    (select record_count from fx_manifest where status = 'completed'
      order by fetched_at desc, upstream_url desc, record_count desc limit 1) as latest_snapshot_records
  from fx_records
)"""


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    names = {
        "records": "fx_records",
        "artifacts": "fx_artifacts",
        "chunks": "fx_docs",
        "vectors": "fx_fragments",
        "entities": "fx_links",
        "cases": "fx_cases",
        "snapshots": "fx_manifest",
        "jobs": "fx_jobs",
    }
    return st.status_rollup({key: view(spark, sf, name) for key, name in names.items()})


@query("d01_status_rollup", f"with {_ROLLUP_SQL} select * from rollup_row")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf)


@query(
    "d02_agency_matrix",
    """
with named as (
  select coalesce(nullif(agency, ''), 'Unknown Origin') as agency, id, title, analysis_status,
    coalesce(release_date, created_at) as stamp from fx_records
),
ranked as (
  select *, count(*) over (partition by agency) as size,
    row_number() over (partition by agency order by stamp desc, title, id) as rn from named
)
select agency, size, greatest(size - 10, 0) as more, id, title, analysis_status from ranked where rn <= 10""",
)
def d02(spark: SparkSession, sf: str) -> DataFrame:
    return st.agency_matrix(view(spark, sf, "fx_records"))


def _geo(i: int) -> str:
    cases = " ".join(
        f"when regexp_matches(lower(incident_location), '{rule[0]}') then {rule[i]}"
        for rule in PLACE_RULES
        if "(?<!" not in rule[0]
    )
    return f"case {cases} end"


@query("d03_geo_resolve", f"select id, {_geo(1)}::double as lat, {_geo(2)}::double as lon from fx_records")
def d03(spark: SparkSession, sf: str) -> DataFrame:
    return st.geo_resolve(view(spark, sf, "fx_records")).select("id", "lat", "lon")


@query(
    "d04_geo_bounds",
    f"""
with p as (select {_geo(1)}::double as lat, {_geo(2)}::double as lon from fx_records)
select min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east, count(lat) as points from p""",
)
def d04(spark: SparkSession, sf: str) -> DataFrame:
    return st.geo_bounds(st.geo_resolve(view(spark, sf, "fx_records")))


@query(
    "d05_format_bytes",
    """
with b as (select doc_id, case doc_id % 4 when 0 then n_chars when 1 then n_chars * 1024 when 2 then n_chars * 3000000
  else n_chars * 5000000000000 end * case when doc_id % 50 = 0 then 0 else 1 end as n from documents),
s as (
  select doc_id, n, case when n < 1024 then 0 when n < 1024^2 then 1 when n < 1024^3 then 2 when n < 1024^4 then 3
    else 4 end as u from b
)
select doc_id, case when n = 0 then '0 B' when u = 0 or n / 1024^u >= 10
  then printf('%.0f', round(n / 1024^u, 0)) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1]
  else printf('%.1f', round(n / 1024^u, 1)) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] end as label
from s""",
)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    scale = F.expr("case doc_id % 4 when 0 then 1L when 1 then 1024L when 2 then 3000000L else 5000000000000L end")
    zero = F.when(F.col("doc_id") % 50 == 0, 0).otherwise(1)
    return table(spark, sf, "documents").select("doc_id", format_bytes(F.col("n_chars") * scale * zero).alias("label"))


@query(
    "d06_pipeline_metrics",
    f"""
with {_ROLLUP_SQL}
select round(local_records / total_records * 100, 6) as local_percent, analyzed_records - completed_count as indexed,
  total_records - local_records as remote, pending_count as pending, completed_count as completed
from rollup_row""",
)
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return st.pipeline_metrics(_rollup(spark, sf)).withColumn("local_percent", F.round("local_percent", 6))


@query(
    "d07_forensic_report",
    """
select id, record_id, layer_type, confidence,
  case when bounding_box_json like '%]' then from_json(bounding_box_json, '["double"]')[3] end as box_width
from fx_forensics where layer_type <> 'metadata_leak'""",
)
def d07(spark: SparkSession, sf: str) -> DataFrame:
    report = st.forensic_report(view(spark, sf, "fx_forensics"), overlay=True)
    return report.select("id", "record_id", "layer_type", "confidence", F.get("bbox", 2).alias("box_width"))


@query(
    "d08_chunks_of",
    f"""
with recursive {chunk_ctes("fx_docs")}
select record_id, chunk_index, chunk as text from chunk
where record_id in (select id from fx_records where source_type = 'official')""",
)
def d08(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(view(spark, sf, "fx_docs"), "record_id").select("record_id", "text")
    chunks = tx.chunk_text(docs).select("record_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk").alias("text"))
    official = view(spark, sf, "fx_records").filter(F.col("source_type") == "official")
    return st.chunks_of(official, chunks)


@query(
    "d09_analysis_view",
    """
select r.id as record_id, analysis_status as status, coalesce(ocr_text, '') as ocr_text, intelligence_json,
  'stored' as engine
from fx_records r left join fx_results x on x.record_id = r.id""",
)
def d09(spark: SparkSession, sf: str) -> DataFrame:
    return st.analysis_view(view(spark, sf, "fx_records"), view(spark, sf, "fx_results"))


@query(
    "d10_record_images",
    """
select id, record_id, local_path from (
  select *, row_number() over (partition by record_id order by id) as rn from fx_assets where asset_type = 'image')
where rn <= 4""",
)
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return st.record_images(view(spark, sf, "fx_assets")).select("id", "record_id", "local_path")


@query(
    "d11_media_kind",
    """
select id, case when lower(file_type) in ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp', 'tif', 'tiff') then 'image'
  when lower(file_type) in ('mp4', 'webm', 'ogg', 'mov') then 'video' when lower(file_type) = 'pdf' then 'pdf'
  else 'other' end as media_kind
from fx_records""",
)
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return st.with_media_kind(view(spark, sf, "fx_records")).select("id", "media_kind")


_STATUS_SQL = """
with mapped as (
  select *, case status when 'extracting-foundation' then 'indexing' when 'foundation-indexed' then 'indexed'
    when 'synthesizing' then 'synthesizing' when 'record-completed' then 'completed' end as s from fx_progress
)
select record_id, arg_max(s, event_id) as analysis_status from mapped where s is not null group by record_id"""


@query("d12_current_status", _STATUS_SQL)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return st.current_status(view(spark, sf, "fx_progress")).select("record_id", "analysis_status")


@query("d12_stream_status", _STATUS_SQL)
def d12_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = arriving(spark, sf, "events")
    status = F.expr(
        "case event_type when 'signup' then 'extracting-foundation' when 'view' then 'foundation-indexed' "
        "when 'click' then 'synthesizing' when 'purchase' then 'record-completed' else 'loading-model' end"
    )
    events = rows.select(F.col("user_id").alias("record_id"), "ts", "event_id", status.alias("status"))
    store = scratch_path(spark, "status")
    stream_status(events, store, scratch_path(spark, "checkpoint")).awaitTermination()
    return streamed_status(spark, store).select("record_id", "analysis_status")


@query(
    "d13_batch_progress",
    """
with seen as (
  select batch_id, arg_max("current", event_id) filter ("current" is not null) as cur,
    arg_max(total, event_id) filter (total is not null) as tot, arg_max(status, event_id) as newest,
    arg_max(status, event_id) filter (status <> 'completed') as s,
    max(event_id) filter (status <> 'completed') as last_event
  from fx_batches group by batch_id
)
select s.batch_id as batch_id, coalesce(cur, 0) as "current", coalesce(tot, 0) as total,
  round(case when s.s = 'loading-model' then coalesce(b.progress, 0)
    when s.s = 'synthesizing' then coalesce(b.token_index, 0) / 2048 * 100
    when coalesce(tot, 0) > 0 then coalesce(cur, 0) / tot * 100 else 0 end, 6) as progress,
  newest <> 'completed' as active
from seen s left join fx_batches b on b.event_id = s.last_event""",
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return st.batch_progress(view(spark, sf, "fx_batches")).withColumn("progress", F.round("progress", 6))
