"""Text pipeline, search and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import match_percent
from ..operators import layers as ly, postings as po, search as se, terms as te, texts as tx
from ..operators.common import union_all
from ..plans.indexing import IndexTables, run_index
from ..session import scratch_path
from .registry import query
from .sql import chunk_ctes, embed_ctes, fold
from .views import spread, table, view

#: Frequent words of the test documents stand in for the default dictionary.
WORDS = {"w1": ["the", "of", "and"], "w2": ["to", "in", "is"]}
TS = "2024-06-01T00:00:00+00:00"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(view(spark, sf, "fx_docs"), "record_id")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return tx.chunk_rows(_docs(spark, sf), WORDS).select(
        F.col("chunk_id").alias("id"), "record_id", "chunk_index", "text"
    )


@query(
    "x01_chunk_text",
    f"with recursive {chunk_ctes('fx_docs')} select record_id, chunk_index, chunk from chunk",
)
def x01(spark: SparkSession, sf: str) -> DataFrame:
    chunks = tx.chunk_text(_docs(spark, sf).select("record_id", "text"))
    return chunks.select("record_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def _cells(vectors: DataFrame, key: str) -> DataFrame:
    """Non-zero components of vectors, rounded."""
    cells = vectors.select(key, F.posexplode("embedding").alias("slot", "x"))
    return cells.filter(F.abs("x") >= 5e-7).select(key, "slot", (F.round("x", 6) + 0.0).alias("v"))


@query(
    "x02_hash_embed",
    f"with {embed_ctes('fx_docs', 'record_id')} select record_id, slot, round(v, 6) + 0.0 as v from vec where round(v, 6) <> 0",
)
def x02(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(tx.hash_embed(_docs(spark, sf), ["record_id"]), "record_id")


@query(
    "x03_mean_pool",
    """
with ranked as (select label, embedding, row_number() over (partition by label order by vec_id) as rn from embeddings),
cells as (select label, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as x from ranked
  where rn <= 512)
select label, pos, round(avg(x), 6) + 0.0 as mean from cells group by label, pos""",
)
def x03(spark: SparkSession, sf: str) -> DataFrame:
    pooled = tx.mean_pool(table(spark, sf, "embeddings"), "label", "vec_id")
    cells = pooled.select("label", F.posexplode("embedding").alias("pos", "x"))
    return cells.select("label", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("mean"))


# neighbours are spelt out, because the check engine's word boundary is ASCII; doubled separators
# keep adjacent words from sharing one
_W = "\\p{L}\\p{M}\\p{N}_"


def _hits(kind: str, words: str, confidence: float) -> str:
    pattern = f"(?i)(?:^|[^{_W}])({words})(?:[^{_W}]|$)"
    return f"""
select record_id, '{kind}' as entity_type, unnest(regexp_extract_all(t, '{pattern}', 1)) as name,
  generate_subscripts(regexp_extract_all(t, '{pattern}', 1), 1) as pos, {confidence} as confidence from spaced"""


_HITS = f"""
spaced as (
  select record_id, title, text,
    regexp_replace(text || ' 2024-05-12', '([^{_W}])', '\\1\\1', 'g') as t from fx_docs
),
dates as (
  select record_id, title, text, regexp_replace(text || ' 2024-05-12', '([^{_W}-])', '\\1\\1', 'g') as t from fx_docs
),
found as (
{_hits("w1", "the|of|and", 0.85)} union all {_hits("w2", "to|in|is", 0.85)}
  union all {_hits("date", "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.8).replace("from spaced", "from dates")}
),
hits as (
  select record_id, arg_min(name, pos) as name, entity_type, cast(min(confidence) as double) as confidence
  from found group by record_id, lower(name), entity_type
)"""


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("text", F.concat("text", F.lit(" 2024-05-12")))


@query(
    "x04_extract_entities",
    f"with {_HITS} select record_id, name, entity_type, confidence, 'deterministic' as source from hits",
)
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return tx.extract_entities(_dated(spark, sf), dictionary=WORDS)


@query(
    "x04_extract_terms",
    f"with {_HITS} select record_id, name, entity_type, confidence, 'deterministic' as source from hits",
)
def x04_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The same dictionary as a table, by the join."""
    rows = [(kind, term) for kind, terms in WORDS.items() for term in terms]
    return te.extract_terms(_dated(spark, sf), spark.createDataFrame(rows, "entity_type string, term string"))


@query(
    "x04_extract_terms_table",
    f"""
with word as (
  select record_id, unnest(regexp_extract_all(text, '[{_W}]+')) as name,
    generate_subscripts(regexp_extract_all(text, '[{_W}]+'), 1) as pos from fx_docs
),
term as (select distinct lower(unnest(regexp_extract_all(text, '[{_W}]+'))) as low from benchmark)
select record_id, arg_min(name, pos) as name, 'benchmark' as entity_type, cast(0.85 as double) as confidence,
  'deterministic' as source
from word join term on lower(name) = low group by record_id, low""",
)
def x04_terms_table(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary that grows with its table: every word of the benchmark texts."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))
    terms = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("entity_type"), word.alias("term"))
    return te.extract_terms(_docs(spark, sf), terms).filter("entity_type <> 'date'")


_KNOWN = [("e1", "the", "w1", "old"), ("e2", "orb", "shape", "old")]


def _known_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_KNOWN, "id string, name string, entity_type string, description string")


_ENTITY_CTES = f"""{_HITS},
known as (select * from (values ('e1', 'the', 'w1', 'old'), ('e2', 'orb', 'shape', 'old')) t(id, name, entity_type, description)),
entity as (
  select coalesce(k.id, sha256('entity|' || entity_type || '|' || name)) as id, name, entity_type,
    case when h.name is null then k.description else 'deterministic' end as description
  from known k full join (select distinct name, entity_type from hits) h using (name, entity_type)
)"""


@query("x05_upsert_entities", f"with {_ENTITY_CTES} select id, name, entity_type, description from entity")
def x05(spark: SparkSession, sf: str) -> DataFrame:
    hits = tx.extract_entities(_dated(spark, sf), dictionary=WORDS)
    return tx.upsert_entities(_known_entities(spark), hits)


@query(
    "x06_link_entities",
    f"""
with {_ENTITY_CTES}
select record_id, id as entity_id, confidence from hits join entity using (name, entity_type)
union all
select record_id, name, confidence from fx_links where record_id not in (select record_id from fx_docs)""",
)
def x06(spark: SparkSession, sf: str) -> DataFrame:
    docs = _dated(spark, sf)
    hits = tx.extract_entities(docs, dictionary=WORDS)
    entities = tx.upsert_entities(_known_entities(spark), hits)
    links = view(spark, sf, "fx_links").select("record_id", F.col("name").alias("entity_id"), "confidence")
    return tx.link_entities(links, hits, entities, docs.select("record_id"))


@query(
    "x07_index_chunks",
    f"""
with recursive {chunk_ctes("fx_docs")},
{_HITS},
named as (
  select record_id, string_agg(name, ' ' order by lower(name), entity_type) as entities from hits
  where entity_type <> 'date' or exists (select 1 from fx_docs d where d.record_id = hits.record_id
    and regexp_matches(d.text, name)) group by record_id
)
select sha256('chunk|' || record_id || '|' || chunk_index) as chunk_id, record_id, d.title as title,
  c.chunk as text, coalesce(n.entities, '') as entities
from chunk c join fx_docs d using (record_id) left join named n using (record_id)""",
)
def x07(spark: SparkSession, sf: str) -> DataFrame:
    _, _, documents = tx.index_chunks(_docs(spark, sf), TS, WORDS)
    return documents


@query(
    "x08_save_text",
    """
with writes as (
  select record_id, text, 'a' as stamp from fx_docs union all
  select record_id, title, case when strlen(text) % 2 = 0 then 'b' else '0' end from fx_docs
),
last as (select record_id, arg_max(text, stamp) as text, max(stamp) as stamp from writes group by record_id)
select record_id, l.text as ocr_text, 'indexed' as status, l.stamp as processed_at
from fx_results r full join last l using (record_id)""",
)
def x08(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "fx_docs")
    late = F.when(F.octet_length("text") % 2 == 0, "b").otherwise("0")
    writes = docs.select("record_id", "text", F.lit("a").alias("processed_at")).unionByName(
        docs.select("record_id", F.col("title").alias("text"), late.alias("processed_at"))
    )
    return tx.save_text(view(spark, sf, "fx_results"), writes)


@query(
    "x09_select_targets",
    """
select 'index' as stage, id from fx_records where local_path is not null
  and (analysis_status is null or analysis_status not in ('indexed', 'completed'))
union all
select 'synthesise', id from fx_records where local_path is not null and analysis_status = 'indexed'
union all
select 'reprocess', id from fx_records where local_path is not null""",
)
def x09(spark: SparkSession, sf: str) -> DataFrame:
    records = view(spark, sf, "fx_records")
    frames = [
        tx.select_targets(records, stage).select(F.lit(stage).alias("stage"), "id")
        for stage in ("index", "synthesise", "reprocess")
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "x09_target_counts",
    """
select count(*) filter (local_path is not null
    and (analysis_status is null or analysis_status not in ('indexed', 'completed'))) as pending,
  count(*) filter (local_path is null) as skipped_remote
from fx_records""",
)
def x09_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tx.target_counts(view(spark, sf, "fx_records"), "index")


def _index_pass(spark: SparkSession, sf: str) -> IndexTables:
    records = view(spark, sf, "fx_records").select(
        "id",
        "title",
        "local_path",
        "analysis_status",
        F.lit(None).cast("string").alias("analysis_error"),
        F.lit(None).cast("double").alias("redaction_score"),
    )
    results = view(spark, sf, "fx_results")
    texts = spread(results, "record_id").select(
        "record_id", F.col("ocr_text").alias("text"), F.lit(None).cast("string").alias("error")
    )

    def empty(ddl: str) -> DataFrame:
        return spark.createDataFrame([], ddl)

    tables = IndexTables(
        records=records,
        entities=_known_entities(spark),
        links=view(spark, sf, "fx_links").select("record_id", F.col("name").alias("entity_id"), "confidence"),
        chunks=empty(
            "id string, record_id string, chunk_index long, text string, engine_name string, model_version string, "
            "created_at string"
        ),
        vectors=empty("chunk_id string, embedding array<float>"),
        search_documents=empty("chunk_id string, record_id string, title string, text string, entities string"),
        results=results.withColumn("ocr_text", F.lit("old")),
    )
    return run_index(tables, texts, TS, WORDS)


@query(
    "x10_run_index",
    """
with target as (
  select id, local_path is not null and (analysis_status is null or analysis_status not in ('indexed', 'completed'))
    as hit from fx_records
)
select r.id as id, case when not hit then analysis_status when x.ocr_text is null then 'failed' else 'indexed' end
    as analysis_status,
  case when hit and x.ocr_text is null then 'no text extracted' end as analysis_error,
  case when hit and x.ocr_text is not null then cast(0 as double) end as redaction_score
from fx_records r join target t using (id) left join fx_results x on x.record_id = r.id""",
)
def x10(spark: SparkSession, sf: str) -> DataFrame:
    return _index_pass(spark, sf).records.select("id", "analysis_status", "analysis_error", "redaction_score")


@query(
    "x10_run_index_chunks",
    f"""
with recursive todo as (
  select x.record_id, x.ocr_text as text from fx_records r join fx_results x on x.record_id = r.id
  where r.local_path is not null and (r.analysis_status is null or r.analysis_status not in ('indexed', 'completed'))
    and x.ocr_text is not null
), {chunk_ctes("todo")}
select record_id, chunk_index, chunk as text, 'bge-small' as engine_name, 'v1.5' as model_version from chunk""",
)
def x10_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _index_pass(spark, sf).chunks.select("record_id", "chunk_index", "text", "engine_name", "model_version")


_TODO = """todo as (
  select x.record_id, x.ocr_text as text from fx_records r join fx_results x on x.record_id = r.id
  where r.local_path is not null and (r.analysis_status is null or r.analysis_status not in ('indexed', 'completed'))
    and x.ocr_text is not null
)"""


@query(
    "x10_run_index_documents",
    f"""
with recursive {_TODO}, {chunk_ctes("todo")},
{_HITS},
named as (
  select record_id, string_agg(name, ' ' order by lower(name), entity_type) as entities from hits
  where entity_type <> 'date' or exists (select 1 from fx_docs d where d.record_id = hits.record_id
    and regexp_matches(d.text, name)) group by record_id
)
select sha256('chunk|' || record_id || '|' || chunk_index) as chunk_id, record_id, d.title as title,
  c.chunk as text, coalesce(n.entities, '') as entities
from chunk c join fx_docs d using (record_id) left join named n using (record_id)""",
)
def x10_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _index_pass(spark, sf).search_documents.select("chunk_id", "record_id", "title", "text", "entities")


@query(
    "x10_run_index_vectors",
    f"""
with recursive {_TODO}, {chunk_ctes("todo")}
select sha256('chunk|' || record_id || '|' || chunk_index) as chunk_id, 384 as dims, cast(1.0 as double) as norm from chunk""",
)
def x10_vectors(spark: SparkSession, sf: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return _index_pass(spark, sf).vectors.select("chunk_id", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 4).alias("norm"))


@query(
    "x10_run_index_results",
    f"""
with {_TODO}
select x.record_id, coalesce(t.text, 'old') as ocr_text, case when t.record_id is null then x.processed_at else '{TS}' end
  as processed_at
from fx_results x left join todo t using (record_id)""",
)
def x10_results(spark: SparkSession, sf: str) -> DataFrame:
    return _index_pass(spark, sf).results.select("record_id", "ocr_text", "processed_at")


@query(
    "x10_run_index_links",
    f"""
with {_TODO}, {_HITS},
own as (
  select h.record_id, count(*) as links from hits h join todo t using (record_id)
  where entity_type <> 'date' or regexp_matches(t.text, name) group by 1
),
kept as (select record_id, count(*) as links from fx_links where record_id not in (select record_id from todo) group by 1)
select record_id, links from own union all select record_id, links from kept""",
)
def x10_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links per record: new ones where the pass read a text, the old ones elsewhere."""
    links = _index_pass(spark, sf).links
    return links.groupBy("record_id").agg(F.count(F.lit(1)).alias("links"))


@query(
    "x11_forensic_boxes",
    """
select record_id, cast(page as bigint) as page, cast(seq as bigint) as seq, 'Graphic Overlay @ Page ' || page as content,
  round(x, 6) as nx, round(1414 - (y + h) + 0.0, 6) as ny, round(w, 6) as nw, round(h, 6) as nh
from fx_page_ops where w > 10 and h > 5""",
)
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return ly.box_layers(view(spark, sf, "fx_page_ops")).select(
        "record_id",
        F.col("page").cast("long").alias("page"),
        F.col("seq").cast("long").alias("seq"),
        "content",
        *[F.round(F.get("bbox", i), 6).alias(n) for i, n in enumerate(["nx", "ny", "nw", "nh"])],
    )


@query(
    "x11_forensic_text",
    """
select record_id, cast(0 as bigint) as part, 'hidden_text' as layer_type, trim(string_agg(text, '' order by seq)) as content,
  cast(0.7 as double) as confidence
from fx_page_text group by record_id, page having sum(strlen(text)) > 5
union all
select record_id, null, 'metadata_leak', "key" || ': ' || value, cast(1.0 as double) from fx_info""",
)
def x11_text(spark: SparkSession, sf: str) -> DataFrame:
    text = ly.text_layers(view(spark, sf, "fx_page_text"))
    info = ly.metadata_layers(view(spark, sf, "fx_info"))
    columns = ["record_id", "part", "layer_type", "content", "confidence"]
    return text.select(*columns).unionByName(info.withColumn("part", F.lit(None).cast("long")).select(*columns))


@query(
    "x12_redaction_score",
    """
with scan as (
  select vec_id // 64 as image_id, vec_id % 64 as y, generate_subscripts(embedding, 1) - 1 as x,
    unnest(embedding)::double < -0.05 as dark
  from embeddings
),
ranked as (select image_id, y, x - row_number() over (partition by image_id, y order by x) as run from scan where dark),
size as (select image_id, max(x) + 1 as width, max(y) + 1 as height from scan group by image_id),
runs as (select image_id, y, run, count(*) as n from ranked group by all),
sums as (
  select r.image_id, y, sum(n) as own from runs r join size s on s.image_id = r.image_id
  where n > s.width // 8 group by 1, 2
),
kept as (
  select a.image_id, sum(a.own) as covered from sums a join size s on s.image_id = a.image_id
  where a.y between 1 and s.height - 2
    and exists (select 1 from sums b where b.image_id = a.image_id and b.y in (a.y - 1, a.y + 1))
  group by a.image_id
)
select image_id, round(coalesce(covered, 0) / (width * height), 6) as redaction_score
from size left join kept using (image_id)""",
)
def x12(spark: SparkSession, sf: str) -> DataFrame:
    # 64 consecutive vectors are the scan lines of an image
    scan = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 64").alias("image_id"),
        (F.col("vec_id") % 64).alias("y"),
        F.posexplode("embedding").alias("x", "v"),
    )
    dark = F.col("v").cast("double") < F.lit(-0.05)
    pixels = scan.select("image_id", "y", F.col("x").cast("long").alias("x"), dark.alias("dark"))
    scores = ly.redaction_score_of_pixels(pixels)
    return scores.select("image_id", F.round("redaction_score", 6).alias("redaction_score"))


@query(
    "x13_save_forensics",
    """
select record_id, 'improper_redaction' as layer_type, 'Graphic Overlay @ Page ' || page as content,
  cast(0.9 as double) as confidence, true as has_box
from fx_page_ops where w > 10 and h > 5
union all
select record_id, layer_type, content, confidence, true from fx_forensics f
where not exists (select 1 from fx_page_ops o where o.record_id = f.record_id and o.w > 10 and o.h > 5)""",
)
def x13(spark: SparkSession, sf: str) -> DataFrame:
    layers = ly.box_layers(view(spark, sf, "fx_page_ops"))
    old = view(spark, sf, "fx_forensics").select(
        "id",
        "record_id",
        "layer_type",
        "content",
        "confidence",
        "bounding_box_json",
        F.lit("{}").alias("metadata_json"),
        F.lit("2024").alias("created_at"),
    )
    saved = ly.save_forensics(old, layers, TS)
    return saved.select(
        "record_id", "layer_type", "content", "confidence", F.col("bounding_box_json").isNotNull().alias("has_box")
    )


@query("x13_layer_ids", "select count(*) as layers, count(*) as ids from fx_page_ops where w > 10 and h > 5")
def x13_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored layer has an id of its own."""
    layers = ly.box_layers(view(spark, sf, "fx_page_ops"))
    none = spark.createDataFrame([], "id string, record_id string, layer_type string, content string, confidence double, "
                                 "bounding_box_json string, metadata_json string, created_at string")  # fmt: skip
    saved = ly.save_forensics(none, layers, TS)
    return saved.agg(F.count(F.lit(1)).alias("layers"), F.count_distinct("id").alias("ids"))


@query(
    "x14_seal_unseal",
    """
select doc_id, cast(strlen(text) + 8 + 12 + 16 as bigint) as sealed_bytes, 'PVAULT01' as magic, sha256(text) as opened_hash,
  true as wrong_key_fails
from documents""",
)
def x14(spark: SparkSession, sf: str) -> DataFrame:
    key, other = F.lit("0123456789abcdef0123456789abcdef"), F.lit("f" * 32)
    sealed = table(spark, sf, "documents").select(
        "doc_id", ly.seal(F.col("text").cast("binary"), key).alias("sealed")
    )
    return sealed.select(
        "doc_id",
        F.octet_length("sealed").cast("long").alias("sealed_bytes"),
        F.substring("sealed", 1, 8).cast("string").alias("magic"),
        F.sha2(ly.unseal(F.col("sealed"), key), 256).alias("opened_hash"),
        ly.try_unseal(F.col("sealed"), other).isNull().alias("wrong_key_fails"),
    )


# --- search -----------------------------------------------------------------


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tx.hash_embed(_asked(spark, sf), ["query_id"])


def _vectors(chunks: DataFrame) -> DataFrame:
    return tx.hash_embed(chunks.select(F.col("id").alias("chunk_id"), "text"), ["chunk_id"])


_KNN = f"""
{chunk_ctes("fx_docs")},
stored as (
  select sha256('chunk|' || record_id || '|' || chunk_index) as id, record_id, chunk_index, chunk as text from chunk
),
asked as (select item_id as query_id, text from benchmark),
{embed_ctes("stored", "id")},
{embed_ctes("asked", "query_id", "q_")},
near as (
  select query_id, id, round(1 - coalesce(sum(q.v * c.v), 0), 6) + 0.0 as distance
  from q_vec q join vec c using (slot) group by query_id, id
),
top as (
  select * from (select *, row_number() over (partition by query_id order by distance, id) as rn from near) where rn <= 20
)"""

_SEARCH_COLUMNS = ["query_id", "id", "title", "agency", "document_url", "artifact_sha256", "distance", "chunk_id"]


def _search_sql(condition: str) -> str:
    return f"""
with recursive {_KNN}
select t.query_id as query_id, r.id as id, r.title as title, r.agency as agency, r.document_url as document_url,
  a.sha256 as artifact_sha256, t.distance as distance, t.id as chunk_id, sha256(s.text) as excerpt_hash
from top t join stored s on s.id = t.id join fx_records r on r.id = s.record_id
left join fx_artifacts a on a.record_id = r.id
where {condition}"""


def _search(spark: SparkSession, sf: str, **options) -> DataFrame:
    chunks = _chunks(spark, sf)
    found = se.vector_search(
        _query_vectors(spark, sf),
        chunks,
        _vectors(chunks),
        view(spark, sf, "fx_records"),
        view(spark, sf, "fx_artifacts"),
        view(spark, sf, "fx_case_records"),
        **options,
    )
    return found.select(*_SEARCH_COLUMNS, F.sha2("excerpt", 256).alias("excerpt_hash"))


@query("v01_vector_search", _search_sql("true"))
def v01(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf)


@query(
    "v01_vector_search_filtered",
    _search_sql(
        "r.source_type = 'official' and r.local_path is not null "
        "and exists (select 1 from fx_case_records m where m.record_id = r.id and m.case_id = 'case7')"
    ),
)
def v01_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, filters=se.Filters("official", True, "case7"))


@query(
    "v01_nearest_by_l2",
    """
with near as (
  select q.vec_id as query_id, v.vec_id as item_id,
    round(list_distance(q.embedding::double[], v.embedding::double[]), 6) + 0.0 as rank_distance,
    round(1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) + 0.0 as distance
  from embeddings q, embeddings v
)
select query_id, item_id, distance from (
  select *, row_number() over (partition by query_id order by rank_distance, item_id) as rn from near) where rn <= 5""",
)
def v01_l2(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    stored = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    return se.nearest(queries, stored, 5, "l2", chunk=128).select("query_id", "item_id", "distance")


_KEYWORD_SQL = f"""
with recursive {chunk_ctes("fx_docs")},
found as (
  select c.*, r.title, r.agency from chunk c join fx_records r on r.id = c.record_id
  where r.source_type = 'official' and (lower(r.title) like '% the_%' or lower(c.chunk) like '% the_%')
  order by record_id, chunk_index limit 20
)
select f.record_id as id, f.title as title, f.agency as agency, a.sha256 as artifact_sha256, f.chunk_index as chunk_index,
  sha256(f.chunk) as excerpt_hash, cast(0 as double) as distance
from found f left join fx_artifacts a on a.record_id = f.record_id
order by f.record_id, f.chunk_index, a.sha256 nulls first limit 20"""


@query("v02_keyword_search", _KEYWORD_SQL)
def v02(spark: SparkSession, sf: str) -> DataFrame:
    found = se.keyword_search(
        " The_",
        _chunks(spark, sf),
        view(spark, sf, "fx_records"),
        view(spark, sf, "fx_artifacts"),
        filters=se.Filters("official"),
    )
    return found.select(
        "id", "title", "agency", "artifact_sha256", "chunk_index", F.sha2("excerpt", 256).alias("excerpt_hash"), "distance"
    )


def _keyword_index(spark: SparkSession, sf: str) -> po.KeywordIndex:
    """Postings of all chunks, written as an index pass would leave them."""
    shelves = 1 + table(spark, sf, "documents").count() // 4096
    return po.write_postings(_chunks(spark, sf), scratch_path(spark, "keywords"), shelves)


@query("v02_keyword_search_indexed", _KEYWORD_SQL)
def v02_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same search, by postings."""
    found = se.keyword_search(
        " The_",
        None,
        view(spark, sf, "fx_records"),
        view(spark, sf, "fx_artifacts"),
        filters=se.Filters("official"),
        index=_keyword_index(spark, sf),
    )
    return found.select(
        "id", "title", "agency", "artifact_sha256", "chunk_index", F.sha2("excerpt", 256).alias("excerpt_hash"), "distance"
    )


#: Runs of three and more literals, of one and two, wildcards between and at the ends.
_PATTERNS = ["Which", "in th%of the", "q_", "Z%x", "e_e_%an", "a__%"]


@query(
    "v02_keyword_postings",
    f"""
with recursive {chunk_ctes("fx_docs")},
asked as (select unnest({_PATTERNS}) as pattern)
select pattern, record_id, chunk_index from chunk
join asked on {fold("chunk")} like '%' || {fold("pattern")} || '%'""",
)
def v02_postings(spark: SparkSession, sf: str) -> DataFrame:
    """All matches of several patterns from one index."""
    index = _keyword_index(spark, sf)
    found = [
        po.keyword_matches(index, pattern).select(F.lit(pattern).alias("pattern"), "record_id", "chunk_index")
        for pattern in _PATTERNS
    ]
    return union_all(found)


@query(
    "v03_search_total",
    f"""
with recursive {chunk_ctes("fx_docs")},
found as (
  select c.record_id from chunk c join fx_records r on r.id = c.record_id
  where lower(r.title) like '%the%' or lower(c.chunk) like '%the%' order by c.record_id, chunk_index limit 20
)
select least(count(*), 20) as total from found f left join fx_artifacts a on a.record_id = f.record_id""",
)
def v03(spark: SparkSession, sf: str) -> DataFrame:
    # without a vector table the search falls back to keywords
    _, total = se.search(
        "the", None, _chunks(spark, sf), None, view(spark, sf, "fx_records"), view(spark, sf, "fx_artifacts")
    )
    return total


@query(
    "v03_search_vectors",
    f"""
select id, title, agency, document_url, artifact_sha256, distance, chunk_id, excerpt_hash, count(*) over () as total
from ({_search_sql("t.query_id = (select min(item_id) from benchmark)")})""",
)
def v03_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One text through the entry point of the search, where vectors exist: rows and total."""
    text = table(spark, sf, "benchmark").agg(F.min_by("text", "item_id")).first()[0]
    chunks = _chunks(spark, sf)
    rows, total = se.search(
        text,
        lambda asked: tx.hash_embed(asked, ["query_id"]),
        chunks,
        _vectors(chunks),
        view(spark, sf, "fx_records"),
        view(spark, sf, "fx_artifacts"),
    )
    found = rows.select(*_SEARCH_COLUMNS[1:], F.sha2("excerpt", 256).alias("excerpt_hash"))
    return found.withColumn("total", F.lit(total.first()["total"]).cast("long"))


def _fragments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = view(spark, sf, "fx_fragments")
    queries = tx.mean_pool(table(spark, sf, "embeddings"), "label", "vec_id").select(
        F.col("label").cast("string").alias("record_id"), "embedding"
    )
    return queries, rows.drop("embedding"), rows.select(F.col("id").alias("fragment_id"), "embedding")


_POOLED = """
ranked as (select label, embedding, row_number() over (partition by label order by vec_id) as rn from embeddings),
cells as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from ranked where rn <= 512),
means as (select label, pos, avg(x) as m from cells group by label, pos),
pooled as (select cast(label as varchar) as record_id, list(m order by pos) as q from means group by label)"""


@query(
    "v04_fragment_search",
    f"""
with {_POOLED},
near as (
  select p.record_id as query_id, f.id as fragment_id, f.record_id, f.text,
    round(1 - list_cosine_similarity(p.q, f.embedding::double[]), 6) + 0.0 as distance
  from pooled p, fx_fragments f
)
select query_id, fragment_id, record_id, text, distance from (
  select *, row_number() over (partition by query_id order by distance, fragment_id) as rn from near) where rn <= 15""",
)
def v04(spark: SparkSession, sf: str) -> DataFrame:
    queries, fragments, vectors = _fragments(spark, sf)
    return se.fragment_search(queries.withColumnRenamed("record_id", "query_id"), fragments, vectors)


@query(
    "v05_fragment_search_by_record",
    f"""
with {_POOLED},
near as (
  select f.record_id, f.id as fragment_id, f.text,
    round(1 - list_cosine_similarity(p.q, f.embedding::double[]), 6) + 0.0 as distance
  from pooled p join fx_fragments f using (record_id)
)
select record_id, fragment_id, text, distance from (
  select *, row_number() over (partition by record_id order by distance, fragment_id) as rn from near) where rn <= 15""",
)
def v05(spark: SparkSession, sf: str) -> DataFrame:
    return se.fragment_search_by_record(*_fragments(spark, sf))


@query(
    "v05_fragment_search_post",
    f"""
with {_POOLED},
near as (
  select p.record_id as asked, f.id as fragment_id, f.record_id, f.text,
    round(1 - list_cosine_similarity(p.q, f.embedding::double[]), 6) + 0.0 as distance
  from pooled p, fx_fragments f
)
select record_id, fragment_id, text, distance from (
  select *, row_number() over (partition by asked order by distance, fragment_id) as rn from near)
where rn <= 15 and record_id = asked""",
)
def v05_post(spark: SparkSession, sf: str) -> DataFrame:
    return se.fragment_search_by_record(*_fragments(spark, sf), filter_mode="post")


def _half_up(x: str, digits: int) -> str:
    """Half up on the digits a double shows, as Spark rounds; the check engine multiplies first, which moves ties."""
    return f"coalesce(cast(round(try_cast(cast({x} as varchar) as decimal(38, 20)), {digits}) as double), {x})"


@query(
    "v06_match_percent",
    f"""
select vec_id, {_half_up("m", 1)} as match from (
  select vec_id, greatest(0.0, 1 - d) * 100 as m from (
    select vec_id, {_half_up("r", 6)} as d from (select vec_id, 1 - embedding[1]::double * 2 as r from embeddings)))""",
)
def v06(spark: SparkSession, sf: str) -> DataFrame:
    distance = F.round(1 - F.get("embedding", 0).cast("double") * 2, 6)
    return table(spark, sf, "embeddings").select("vec_id", match_percent(distance).alias("match"))


_LIST_SQL = """
select r.id as id, r.title as title, r.agency as agency, a.sha256 as artifact_sha256,
  coalesce(a.byte_size, 0) as artifact_size,
  (select count(*) from fx_links l where l.record_id = r.id) as entity_count,
  (select arg_min(s.local_path, s.id) from fx_assets s where s.record_id = r.id and s.asset_type = 'image')
    as thumbnail_path
from fx_records r left join fx_artifacts a on a.record_id = r.id"""
_LIST_COLUMNS = ["id", "title", "agency", "artifact_sha256", "artifact_size", "entity_count", "thumbnail_path"]


def _list_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [view(spark, sf, name) for name in ("fx_records", "fx_artifacts", "fx_links", "fx_assets")]


@query("v07_list_records", _LIST_SQL)
def v07(spark: SparkSession, sf: str) -> DataFrame:
    return se.list_records(*_list_tables(spark, sf)).select(*_LIST_COLUMNS)


@query(
    "v07_list_records_filtered",
    _LIST_SQL
    + """
where r.source_type = 'official' and r.local_path is not null
  and (lower(r.title) like '%src1%' or lower(coalesce(r.agency, '')) like '%src1%'
    or lower(coalesce(r.incident_location, '')) like '%src1%')""",
)
def v07_filtered(spark: SparkSession, sf: str) -> DataFrame:
    listed = se.list_records(*_list_tables(spark, sf), source_type="official", local_only=True, query="SRC1")
    return listed.select(*_LIST_COLUMNS)


@query("v08_get_records", _LIST_SQL + " where r.id in (select record_id from fx_links where name = 'quality 0')")
def v08(spark: SparkSession, sf: str) -> DataFrame:
    tables = _list_tables(spark, sf)
    ids = tables[2].filter(F.col("name") == "quality 0").select(F.col("record_id").alias("id"))
    return se.get_records(ids, *tables).select(*_LIST_COLUMNS)


