"""Pieces of check SQL used by several queries."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def fold(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def norm_title(x: str) -> str:
    return f"lower(regexp_replace({x}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'))"


def chunk_ctes(source: str, key: str = "record_id") -> str:
    """CTEs up to ``chunk`` (key, chunk_index, chunk) of ``source`` (key, text). Needs WITH RECURSIVE."""
    full = "strlen(p.cur) + strlen(l.line) > 1200 and trim(p.cur, chr(10) || chr(9) || chr(13) || ' ') <> ''"
    return f"""
line as (
  select {key}, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from {source}
),
pack as (
  select {key}, i, line || chr(10) as cur, cast(null as varchar) as done from line where i = 1
  union all
  select l.{key}, l.i, case when {full} then '' else p.cur end || l.line || chr(10), case when {full} then p.cur end
  from pack p join line l on l.{key} = p.{key} and l.i = p.i + 1
),
piece as (
  select {key}, i, done as raw from pack where done is not null
  union all
  select {key}, i + 1, cur from pack p where i = (select max(i) from line l where l.{key} = p.{key})
    and trim(cur, chr(10) || chr(9) || chr(13) || ' ') <> ''
),
chunk as (
  select {key}, row_number() over (partition by {key} order by i) - 1 as chunk_index,
    trim(raw, chr(10) || chr(9) || chr(13) || ' ') as chunk
  from piece
)"""


def embed_ctes(source: str, key: str, prefix: str = "", dims: int = 384) -> str:
    """CTEs up to ``<prefix>vec`` (key, slot, v): the non-zero components of unit vectors of ``source`` (key, text)."""
    p = prefix
    return f"""
{p}tok as (
  select {key}, unnest(regexp_split_to_array({fold('text')}, '[^\\p{{L}}\\p{{N}}]+')) as token from {source}
),
{p}cnt as (select {key}, token, count(*) as n from {p}tok where token <> '' group by all),
{p}dig as (select {key}, n * (1 + ln(strlen(token))) as w, sha256(token) as h, unnest(range(8)) as g from {p}cnt),
{p}raw as (
  select {key}, ('0x' || h[8*g+3:8*g+4] || h[8*g+1:8*g+2])::int % {dims} as slot,
    sum(case when h[8*g+6:8*g+6] in ('0','2','4','6','8','a','c','e') then w else -w end) as v
  from {p}dig group by 1, 2
  union all
  select {key}, 0, 1 from {source} s where not exists (select 1 from {p}cnt c where c.{key} = s.{key})
),
{p}vec as (
  select {key}, slot, v / sqrt(sum(v * v) over (partition by {key})) as v from {p}raw
)"""
