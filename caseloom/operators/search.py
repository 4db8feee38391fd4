"""Vector search, keyword search and record listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_pattern
from ..functions.vectors import cosine_distance, l2_distance
from ..session import settled
from .common import first_rows, join_many_to_one, join_one_to_many
from .neighbours import CHUNK, VectorIndex, build_index, nearest_join
from .postings import KeywordIndex, keyword_matches, on_shelves

#: Results of a search, and fragments picked as context of a record.
SEARCH_K, FRAGMENT_K = 20, 15

@dataclass(frozen=True)
class Filters:
    """Optional restrictions of a search; unset ones add nothing to the plan."""

    source_type: str | None = None
    local_only: bool = False
    case_id: str | None = None


def nearest(
    queries: DataFrame, vectors: DataFrame | VectorIndex, k: int = SEARCH_K, metric: str = "cosine", chunk: int = CHUNK
) -> DataFrame:
    """Exact k nearest items of every query: (query_id, item_id, rank_distance, distance).

    ``queries`` is (query_id, embedding), ``vectors`` (item_id, embedding) or an index
    of them. Neighbours are picked by ``metric`` (``cosine`` or ``l2``), ties by item id;
    ``distance`` is the cosine distance either way. See :mod:`.neighbours`: one plan for
    any number of queries, none of which reaches the driver.
    """
    index = vectors if isinstance(vectors, VectorIndex) else build_index(vectors, k, metric, chunk=chunk)
    return nearest_join(queries, index, k)


def _allowed(records: DataFrame, filters: Filters) -> DataFrame:
    if filters.source_type is not None:
        records = records.filter(F.col("source_type") == filters.source_type)
    if filters.local_only:
        records = records.filter(F.col("local_path").isNotNull())
    return records


def _in_case(df: DataFrame, case_records: DataFrame | None, filters: Filters) -> DataFrame:
    if filters.case_id is None:
        return df
    if case_records is None:
        raise ValueError("a case filter needs case_records")
    members = case_records.filter(F.col("case_id") == filters.case_id).select("record_id")
    return df.join(members, "record_id", "left_semi")


_RESULT = ["agency", "release_date", "document_url", "local_path"]


def _record_columns(records: DataFrame) -> DataFrame:
    summary = F.col("intelligence_json") if "intelligence_json" in records.columns else F.lit(None).cast("string")
    return records.select(F.col("id").alias("record_id"), "title", *_RESULT, summary.alias("summary"))


def vector_search(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    records: DataFrame,
    artifacts: DataFrame,
    case_records: DataFrame | None = None,
    filters: Filters = Filters(),
    k: int = SEARCH_K,
    metric: str = "cosine",
    filter_mode: str = "post",
) -> DataFrame:
    """Nearest chunks of every query with their records, closest first.

    In ``post`` mode the filters run after the k nearest were picked, so fewer than
    k rows may remain; ``pre`` searches among the allowed records only. A record
    with several artifacts appears once for each.
    """
    stored = vectors.select(F.col("chunk_id").alias("item_id"), "embedding")
    allowed = _allowed(records, filters)
    if filter_mode == "pre":
        scope = _in_case(allowed.select(F.col("id").alias("record_id")), case_records, filters)
        ids = join_many_to_one(chunks.select(F.col("id").alias("item_id"), "record_id"), scope, ["record_id"], "left_semi")
        stored = stored.join(ids.select("item_id"), "item_id", "left_semi")
    elif filter_mode != "post":
        raise ValueError(f"unknown filter mode: {filter_mode}")
    top = nearest(queries, stored, k, metric)
    body = chunks.select(F.col("id").alias("item_id"), "record_id", F.col("text").alias("excerpt"))
    # k rows per query: from here on the scan of all vectors is not repeated
    placed = settled(body.join(top, "item_id"), "hits")
    if filter_mode == "post":
        placed = _in_case(placed, case_records, filters)
    # the big tables are cut down to the hits where they lie; only what is left is joined
    wanted = placed.select("record_id").distinct()
    heads = _record_columns(allowed).join(wanted, "record_id", "left_semi")
    files = artifacts.select("record_id", F.col("sha256").alias("artifact_sha256")).join(
        wanted, "record_id", "left_semi"
    )
    return (
        placed.join(heads, "record_id")
        .join(files, "record_id", "left")
        .select(
            "query_id",
            F.col("record_id").alias("id"),
            "title",
            *_RESULT,
            "summary",
            "artifact_sha256",
            "distance",
            "excerpt",
            F.col("item_id").alias("chunk_id"),
        )
    )


def keyword_search(
    query: str,
    chunks: DataFrame,
    records: DataFrame,
    artifacts: DataFrame,
    case_records: DataFrame | None = None,
    filters: Filters = Filters(),
    k: int = SEARCH_K,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Chunks whose text or record title contains ``query``; the first k by record, chunk and artifact.

    Texts are tested where they lie and stay there: only the outcome is joined with
    the records, and the texts of the k results are looked up at the end. With an
    ``index`` of the chunks its postings say which texts are tested, and ``chunks`` is not read.
    """
    allowed = _in_case(_record_columns(_allowed(records, filters)), case_records, filters)
    titles = allowed.select("record_id", F.coalesce(contains_pattern("title", query), F.lit(False)).alias("_title"))
    # an artifact only multiplies rows, so the first k chunks suffice for the first k results
    key = ["record_id", "chunk_index"]
    if index is None:
        own = F.coalesce(contains_pattern("text", query), F.lit(False)).alias("_own")
        tested = chunks.select("record_id", "chunk_index", own)
        found = join_many_to_one(tested, titles, ["record_id"], "inner").filter(F.col("_own") | F.col("_title"))
        first = settled(found.select(*key).orderBy(*key).limit(k), "first")
    else:
        titled, others = titles.filter("_title"), titles.filter("not _title")
        by_title = join_many_to_one(index.entries.select(*key, "shelf"), titled, ["record_id"], "left_semi")
        by_text = join_many_to_one(keyword_matches(index, query).select(*key, "shelf"), others, ["record_id"], "left_semi")
        first = settled(by_title.unionByName(by_text).orderBy(*key).limit(k), "first")
        chunks = on_shelves(index, first)
    of_first = first.select("record_id").distinct()
    texts = chunks.select(*key, F.col("text").alias("excerpt")).join(first, key, "left_semi")
    heads = allowed.join(of_first, "record_id", "left_semi")
    owned = artifacts.select("record_id", F.col("sha256").alias("artifact_sha256")).join(
        of_first, "record_id", "left_semi"
    )
    return (
        texts.join(heads, "record_id")
        .join(owned, "record_id", "left")
        .orderBy(*key, "artifact_sha256")
        .limit(k)
        .select(
            F.col("record_id").alias("id"),
            "title",
            *_RESULT,
            "summary",
            "artifact_sha256",
            F.lit(0.0).alias("distance"),
            "excerpt",
            "chunk_index",
        )
    )


def search(
    query: str,
    embed,
    chunks: DataFrame,
    vectors: DataFrame | None,
    records: DataFrame,
    artifacts: DataFrame,
    case_records: DataFrame | None = None,
    filters: Filters = Filters(),
    k: int = SEARCH_K,
) -> tuple[DataFrame, DataFrame]:
    """Results and their total: by vector, or by keyword where no usable vectors exist.

    ``embed`` maps a (query_id, text) table to (query_id, embedding). An empty vector
    result is a result; only a missing vector table leads to the keyword search.
    """
    if vectors is None or "embedding" not in vectors.columns:
        results = keyword_search(query, chunks, records, artifacts, case_records, filters, k)
    else:
        asked = embed(chunks.sparkSession.createDataFrame([(0, query)], "query_id long, text string"))
        results = vector_search(asked, chunks, vectors, records, artifacts, case_records, filters, k)
    return results, results.agg(F.count(F.lit(1)).alias("total"))


def fragment_search(
    queries: DataFrame, fragments: DataFrame, vectors: DataFrame, k: int = FRAGMENT_K, metric: str = "cosine"
) -> DataFrame:
    """k nearest fragments of every query over all records."""
    top = nearest(queries, vectors.select(F.col("fragment_id").alias("item_id"), "embedding"), k, metric)
    body = fragments.select(F.col("id").alias("item_id"), "record_id", "text")
    return body.join(top, "item_id").select(
        "query_id", F.col("item_id").alias("fragment_id"), "record_id", "text", "distance"
    )


def fragment_search_by_record(
    queries: DataFrame,
    fragments: DataFrame,
    vectors: DataFrame,
    k: int = FRAGMENT_K,
    metric: str = "cosine",
    filter_mode: str = "pre",
) -> DataFrame:
    """For every record its own k fragments nearest to its query vector (record_id, embedding).

    ``pre`` ranks within the record; ``post`` keeps of these what is also among the k
    nearest of all fragments, so fewer than k may remain. For that each record asks only
    for what is no farther than its own k nearest.
    """
    stored = vectors.select(F.col("fragment_id").alias("id"), F.col("embedding").alias("v"))
    placed = fragments.select("id", "record_id").join(stored, "id")
    asked = queries.select("record_id", F.col("embedding").alias("q"))
    pairs = join_many_to_one(placed, asked, ["record_id"], "inner")
    shown = cosine_distance(F.col("v"), F.col("q"))
    rank = shown if metric == "cosine" else l2_distance(F.col("v"), F.col("q"))
    ranked = pairs.select("record_id", "id", shown.alias("distance"), rank.alias("rank_distance"))
    top = first_rows(ranked, ["record_id"], [F.col("rank_distance"), F.col("id")], k)
    if filter_mode == "post":
        # only fragments as near as the record's own ones can push these out of the first k
        top = settled(top, "own")
        bound = top.groupBy("record_id").agg(F.max("rank_distance").alias("bound"))
        near = asked.join(bound, "record_id").select(F.col("record_id").alias("query_id"), F.col("q").alias("embedding"), "bound")
        found = nearest(near, vectors.select(F.col("fragment_id").alias("item_id"), "embedding"), k, metric)
        own = found.select(F.col("query_id").alias("record_id"), F.col("item_id").alias("id"))
        top = top.join(own, ["record_id", "id"], "left_semi")
    elif filter_mode != "pre":
        raise ValueError(f"unknown filter mode: {filter_mode}")
    return top.join(fragments.select("id", "text"), "id").select(
        "record_id", F.col("id").alias("fragment_id"), "text", "distance"
    )


# --- listings ---------------------------------------------------------------

_SUMMARY = [
    "id",
    "title",
    "agency",
    "release_date",
    "incident_date",
    "incident_location",
    "document_url",
    "local_path",
    "file_type",
    "source_type",
    "summary",
    "stable_key",
    "content_hash",
    "removed_from_source_at",
    "analysis_status",
    "intelligence_json",
    "redaction_score",
    "analysis_error",
]


def _summaries(
    records: DataFrame, artifacts: DataFrame, links: DataFrame, assets: DataFrame
) -> DataFrame:
    entity_count = links.groupBy(F.col("record_id").alias("id")).agg(F.count(F.lit(1)).alias("_entities"))
    image = (
        assets.filter(F.col("asset_type") == "image")
        .groupBy(F.col("record_id").alias("id"))
        .agg(F.min(F.struct("id", "local_path")).alias("_asset"))
        .select("id", F.col("_asset.local_path").alias("_image"))
    )
    files = artifacts.filter(F.col("record_id").isNotNull()).select(
        F.col("record_id").alias("id"), F.col("sha256").alias("artifact_sha256"), "byte_size"
    )
    known = [c for c in _SUMMARY if c in records.columns]
    thumbnail = F.col("thumbnail_path") if "thumbnail_path" in records.columns else F.lit(None).cast("string")
    base = (
        records.select(*known, "created_at", thumbnail.alias("_thumb"))
        .join(entity_count, "id", "left")
        .join(image, "id", "left")
    )
    return join_one_to_many(base, files, ["id"]).select(
        *known,
        "created_at",
        "artifact_sha256",
        F.coalesce("byte_size", F.lit(0).cast("long")).alias("artifact_size"),
        F.coalesce("_entities", F.lit(0).cast("long")).alias("entity_count"),
        F.coalesce("_thumb", "_image").alias("thumbnail_path"),
    )


def list_records(
    records: DataFrame,
    artifacts: DataFrame,
    links: DataFrame,
    assets: DataFrame,
    source_type: str | None = None,
    agency: str | None = None,
    local_only: bool = False,
    query: str | None = None,
) -> DataFrame:
    """Record summaries, newest release first, then by title; a record repeats per artifact."""
    chosen = _allowed(records, Filters(source_type, local_only))
    if agency is not None:
        chosen = chosen.filter(F.col("agency") == agency)
    if query is not None:
        where = [c for c in ("title", "summary", "agency", "incident_location") if c in records.columns]
        matches = [F.coalesce(contains_pattern(c, query), F.lit(False)) for c in where]
        any_match: Column = matches[0]
        for match in matches[1:]:
            any_match = any_match | match
        chosen = chosen.filter(any_match)
    listed = _summaries(chosen, artifacts, links, assets)
    newest = F.coalesce("release_date", "created_at")
    return listed.orderBy(newest.desc(), F.col("title"), F.col("id"), F.col("artifact_sha256")).drop("created_at")


def get_records(
    ids: DataFrame, records: DataFrame, artifacts: DataFrame, links: DataFrame, assets: DataFrame
) -> DataFrame:
    """The same summaries for a table of ids."""
    wanted = ids.select("id").distinct()

    def of(df: DataFrame) -> DataFrame:
        return join_many_to_one(df, wanted.withColumnRenamed("id", "record_id"), ["record_id"], "left_semi")

    chosen = records.join(wanted, "id", "left_semi")
    return _summaries(chosen, of(artifacts), of(links), of(assets)).drop("created_at")
