"""Adapter views: the given tables in the shape of the evidence corpus, in SQL both engines accept.

Every view keeps all rows of its table. ``SHA[x]`` stands for the SHA-256 hex digest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    "fx_records": """
select cast(d.doc_id as varchar(20)) as id, 'Doc 00' || cast(d.doc_id as varchar(20)) as title,
  case when d.doc_id % 13 = 0 then null else d.source end as agency,
  case when d.lang = 'en' then 'official' else 'manual' end as source_type,
  case when d.doc_id % 9 = 0 then null
       else '2024-' || lpad(cast(d.doc_id % 12 + 1 as varchar(2)), 2, '0') || '-01' end as release_date,
  case when d.doc_id % 4 = 0
       then '2023-' || lpad(cast(d.doc_id % 12 + 1 as varchar(2)), 2, '0') || '-15' end as incident_date,
  case d.doc_id % 6 when 0 then 'Nevada, USA' when 1 then 'New Mexico' when 2 then 'Jerusalem'
       when 3 then 'Tokyo' when 4 then 'Unknown' end as incident_location,
  case when d.doc_id % 11 = 0 then '' when d.doc_id % 10 = 0 then null
       else 'https://ex.org/f/' || cast(d.doc_id % 400 as varchar(20)) || '.pdf' end as document_url,
  case when d.doc_id % 3 = 0 then null else 'ab/' || cast(d.doc_id as varchar(20)) || '.txt' end as local_path,
  case d.doc_id % 5 when 0 then null when 1 then 'pending' when 2 then 'indexed' when 3 then 'completed'
       else 'failed' end as analysis_status,
  case when d.doc_id % 5 = 3 then '{"object_description": "' || d.lang || '", "intelligence_score": 0}' end
    as intelligence_json,
  case when d.doc_id % 2 = 0 then 'url:x|title:' || cast(d.doc_id as varchar(20))
       else 'meta:' || cast(d.doc_id as varchar(20)) end as stable_key,
  case d.doc_id % 4 when 0 then 'PDF' when 1 then 'png' when 2 then 'mp4' else 'txt' end as file_type,
  SHA[d.text] as content_hash, d.n_chars as byte_size, '2024-12-31 00:00:00' as created_at,
  '2024-12-31T00:00:' || lpad(cast(d.doc_id % 60 as varchar(2)), 2, '0') || '+00:00' as updated_at
from documents d""",
    "fx_prev": """
select cast(doc_id as varchar(20)) as stable_key, 'Doc ' || cast(doc_id as varchar(20)) as title,
  'https://ex.org/' || cast(doc_id as varchar(20)) as document_url, SHA[text] as content_hash
from documents""",
    "fx_cur": """
select case when doc_id % 7 = 0 then 'new-' else '' end || cast(doc_id as varchar(20)) as stable_key,
  'Doc ' || cast(doc_id as varchar(20)) as title, 'https://ex.org/' || cast(doc_id as varchar(20)) as document_url,
  case when doc_id % 11 = 0 then SHA[lang || text] else SHA[text] end as content_hash
from documents""",
    "fx_snapshots": """
select cast(extract(day from ts) as bigint) as snapshot_no, user_id as stable_key,
  cast(max(value) as varchar(40)) as content_hash
from events group by 1, 2""",
    "fx_manifest": """
select 's' || cast(extract(day from ts) as varchar(4)) as id, event_type as source_name,
  'https://ex.org/' || event_type as upstream_url,
  case when count(*) % 7 = 0 then 'failed' else 'completed' end as status,
  '2024-01-' || lpad(cast(extract(day from ts) as varchar(4)), 2, '0') as fetched_at, count(*) as record_count
from events group by extract(day from ts), event_type""",
    "fx_artifacts": """
select 'f' || cast(doc_id as varchar(20)) as id, cast(doc_id - doc_id % 3 as varchar(20)) as record_id,
  SHA[text] as sha256, n_chars as byte_size, 'official' as source_type,
  'ab/' || cast(doc_id as varchar(20)) || '.txt' as relative_path,
  'https://ex.org/f/' || cast(doc_id as varchar(20)) || '.TXT' as source_url
from documents""",
    "fx_docs": """
select cast(doc_id as varchar(20)) as record_id, 'Doc 00' || cast(doc_id as varchar(20)) as title, text
from documents""",
    "fx_links": """
select cast(doc_id as varchar(20)) as record_id, 'quality ' || cast(quality as varchar(4)) as name,
  'label' as entity_type, cast(0.85 as double) as confidence from labels
union all
select cast(doc_id as varchar(20)), 'toxic ' || cast(toxic as varchar(4)), 'flag', cast(0.5 as double) from labels""",
    "fx_assets": """
select 'a' || cast(doc_id as varchar(20)) as id, cast(doc_id - doc_id % 6 as varchar(20)) as record_id,
  case doc_id % 6 when 5 then 'source' else 'image' end as asset_type,
  'assets/' || cast(doc_id as varchar(20)) || '.png' as local_path
from documents""",
    "fx_results": """
select cast(doc_id as varchar(20)) as record_id, case when lang = 'es' then null else text end as ocr_text,
  'indexed' as status, '2024-12-31' as processed_at
from documents""",
    "fx_cases": """
select 'case' || cast(conv_id % 40 as varchar(20)) as id, 'Case ' || cast(conv_id % 40 as varchar(20)) as title,
  case when conv_id % 40 < 20 then 'About ' || cast(conv_id % 40 as varchar(20)) end as description,
  '2024-02-' || lpad(cast(conv_id % 40 % 28 + 1 as varchar(4)), 2, '0') as created_at
from conversations group by conv_id % 40""",
    "fx_case_records": """
select 'case' || cast(doc_id % 50 as varchar(20)) as case_id, cast(doc_id as varchar(20)) as record_id,
  case when doc_id % 3 = 0 then ' note ' || lang end as notes
from documents""",
    "fx_case_notes": """
select 'case' || cast(conv_id % 40 as varchar(20)) as case_id,
  cast(conv_id as varchar(20)) || '-' || cast(turn as varchar(20)) as id, text as body,
  '2024-03-' || lpad(cast(turn + 1 as varchar(4)), 2, '0') as created_at
from conversations where role = 'user'""",
    "fx_items": """
select cast(user_id as varchar(20)) as job_id, event_id as id, 'Item ' || cast(event_id % 97 as varchar(20)) as title,
  case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'queued'
       when 'view' then 'downloading' else 'skipped' end as status, event_id as updated_at
from events""",
    "fx_jobs": """
select cast(user_id as varchar(20)) as id, case when user_id % 3 = 0 then 'completed' when user_id % 3 = 1
  then 'running' else 'queued' end as status, max(event_id) as updated_at
from events group by user_id""",
    "fx_progress": """
select user_id as record_id, ts, event_id, case event_type when 'signup' then 'extracting-foundation'
  when 'view' then 'foundation-indexed' when 'click' then 'synthesizing' when 'purchase' then 'record-completed'
  else 'loading-model' end as status
from events""",
    "fx_batches": """
select user_id as batch_id, ts, event_id, case event_type when 'signup' then 'extracting-foundation'
  when 'view' then 'foundation-indexed' when 'click' then 'synthesizing' when 'purchase' then 'completed'
  else 'loading-model' end as status,
  case when event_type in ('signup', 'view') then event_id end as "current",
  case when event_type in ('signup', 'view') then 2 * event_id + 1 end as total,
  case when event_type = 'click' then event_id % 2048 end as token_index, 2048 as token_limit,
  case when event_type = 'error' then cast(value as double) end as progress
from events""",
    "fx_tokens": """
select conv_id as record_id, turn as seq, case when role = 'system' or turn % 4 = 0 then 'synthesizing-start'
  else 'synthesizing' end as status, text as token_text
from conversations""",
    "fx_responses": """
select e.event_id as record_id, case when e.event_id % 7 = 0 then 'no json here'
  when e.event_id % 5 = 0 then 'think {bad'
  else ' think ' || '{"object_description": "' || e.event_type || '", "observations": ["a'
       || cast(e.user_id as varchar(20)) || '", 1, "b"]}' end as generated
from events e""",
    "fx_page_ops": """
select cast(l_orderkey as varchar(20)) as record_id, l_linenumber as page, l_linenumber as seq, 're' as op,
  l_extendedprice / 100 as x, l_discount * 1000 as y, l_quantity as w, l_tax * 100 as h
from lineitem""",
    "fx_page_text": """
select cast(conv_id as varchar(20)) as record_id, 1 as page, turn as seq, 'Tj' as op, text || '  ' as text
from conversations""",
    "fx_info": """
select cast(c_custkey as varchar(20)) as record_id, c_mktsegment as "key", c_name as value from customer""",
    "fx_forensics": """
select cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(4)) as id,
  cast(l_orderkey as varchar(20)) as record_id, l_linenumber as seq,
  case l_returnflag when 'A' then 'improper_redaction' when 'N' then 'hidden_text' else 'metadata_leak' end
    as layer_type,
  'Item ' || cast(l_partkey as varchar(20)) as content, cast(l_linenumber as double) / 8 as confidence,
  case when l_linestatus = 'O' then '[1.5,2,' || cast(l_linenumber as varchar(4)) || ',4]' else '[1.5,' end
    as bounding_box_json
from lineitem""",
    "fx_logs": """
select 'log' || cast(event_id as varchar(20)) as id, cast(user_id as varchar(20)) as record_id,
  '2024-12-31T00:00:' || lpad(cast(event_id % 60 as varchar(2)), 2, '0') || '+00:00' as created_at
from events""",
    "fx_fragments": """
select 'v' || cast(vec_id as varchar(20)) as id, cast(label as varchar(20)) as record_id,
  'fragment ' || cast(vec_id as varchar(20)) as text, embedding
from embeddings""",
}

_SHA = re.compile(r"SHA\[(.*?)\]")


def spark_sql(view: str) -> str:
    text = _SHA.sub(r"sha2(\1, 256)", VIEWS[view])
    return re.sub(r'"(current|key)"', r"`\1`", text)


def duck_sql(view: str) -> str:
    return _SHA.sub(r"sha256(\1)", VIEWS[view])


def with_views(sql: str) -> str:
    """The statement with every adapter view it names as a common table expression."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    ctes = ",\n".join(f"{name} as ({duck_sql(name)})" for name in used)
    body = sql.strip()
    if not used:
        return body
    recursive = re.match(r"with\s+recursive\s+", body, re.I)
    plain = re.match(r"with\s+", body, re.I)
    if recursive:
        return f"with recursive {ctes},\n{body[recursive.end():]}"
    if plain:
        return f"with {ctes},\n{body[plain.end():]}"
    return f"with {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files; like :func:`table`, one file or a folder of them."""
    # as a pattern, because a stream takes a plain path for a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over the default number of tasks, for work that is heavy per row on tables of few files."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the tables of one folder."""
    text = spark_sql(name)
    for base in TABLES:
        if re.search(rf"\b{base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)
