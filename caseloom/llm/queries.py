"""Registered queries of the text operators: thin, each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bloomsketch, chat, decontaminate, langid, licences, mixing, neardup, personal, prefixtrie, quality, tokenfile, urls
from .common import table

#: Vocabulary of the registered token queries; the operators take any path.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def _term_count(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int" for t in terms)


_URL_SQL = f"""
with part as (
  select page_id, coalesce(lower(url), '') as low,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
),
piece as (
  select page_id, low, lower(regexp_extract(rest, '^([^/?#]*)', 1)) as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from part
),
rule(verdict, rhost, rpath) as (
  values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)}
),
hit as (
  select page_id, rhost || rpath as rule, verdict,
    row_number() over (partition by page_id order by length(rhost || rpath) desc) as rn
  from piece join rule on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
),
term as (select page_id, {_term_count(urls.STRICT)} as strict_hits, {_term_count(urls.SOFT)} as soft_hits from piece)
select p.page_id, p.host, p.path, h.rule,
  coalesce(h.verdict, case when strict_hits > 0 or soft_hits >= 2 then 'block' else 'allow' end) as verdict,
  strict_hits, soft_hits
from piece p join term t using (page_id) left join hit h on h.page_id = p.page_id and h.rn = 1
"""


@query("op10_url_vocabulary", _URL_SQL)
def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query("op1_bagminhash_classes")
def op1_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_digest")


@query("op7_token_codes")
def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(table(spark, sf_dir, "documents"), TOKENIZER).drop("shard")


@query("op2_water_filling")
def op2_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


@query("op3_compression_language")
def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold_of(F.col("doc_id")) == 0
    model = langid.fit_languages(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model).drop("text")
    return found.withColumn("held_out", held_out)


@query("op9_contained_items")
def op9_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_personal_spans")
def op5_personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["is_base"])
    return found.select(
        "doc_id",
        *[F.size(personal.of_kind(F.col("spans"), k, base_only=True)).cast("long").alias(f"n_{k}") for k in personal.KINDS],
        F.sha2(personal.joined_spans(base), 256).alias("base_sha256"),
        personal.joined_spans(F.col("spans")).alias("spans"),
    )


@query("op8_paragraph_sketches")
def op8_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bloomsketch.fingerprints(table(spark, sf_dir, "documents"))
    return found.drop("added", "removed")


@query("op4_role_repair")
def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@query("op6_weak_quality")
def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.fit_quality(docs)).drop("text")


@query("op11_pair_bitmaps")
def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


_TRIE_SQL = """
with turns as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t,
    row_number() over (partition by conv_id order by turn nulls first) as rn
  from conversations where conv_id is not null
),
conv as (
  select c, c - c % 5 as base,
    (4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 9 as h
  from (select distinct c from turns)
),
piece as (
  select conv.c, 0 as part, rn, r, t from conv join turns on turns.c = conv.base where rn <= h
  union all
  select conv.c, 1, rn, r, t from conv join turns on turns.c = conv.c where rn > h
),
sequence as (
  select c, coalesce(s, []) as s from (select c from conv)
  left join (select c, list({'r': r, 't': t} order by part, rn) as s from piece group by c) using (c)
),
member as (select c, len(s) as n, unnest(range(0, len(s) + 1)) as d, s from sequence),
node as (
  select s[:d] as p, d, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256
  from member group by 1, 2
),
linked as (
  select n.p, n.d, n.conv_id, n.n_convs, n.ends_sha256, up.conv_id as parent_conv_id, coalesce(kids.k, 0) as n_children
  from node n left join node up on up.d = n.d - 1 and up.p = n.p[:n.d - 1]
  left join (select p[:d - 1] as p, d - 1 as d, count(*) as k from node where d > 0 group by 1, 2) kids on kids.d = n.d and kids.p = n.p
),
below as (
  select p[:k] as p, k as d, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from (
    select p, (n_children = 0)::int as leaf, case when d = 0 then 0 else (n_convs - 1) * strlen(p[d].t) end as saved,
      unnest(range(0, d + 1)) as k from linked
  ) group by 1, 2
)
select conv_id, d as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from linked join below using (p, d)
"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_licence_words")
def op13_licence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
