"""Tables around model responses: prompts in, parsed answers out. The model itself is elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_ws
from .common import derived_id, first_rows, join_many_to_one, joined_text
from .texts import hash_embed

#: Texts above so many bytes are shown by so many first characters; fragments of a prompt.
LONG_TEXT_BYTES, EXCERPT_CHARS, FRAGMENTS = 5000, 2000, 15
FRAGMENT_CONFIDENCE = 0.9
#: Seconds a record may be newer than its last synthesis.
STALE_SECONDS = 5

# fixed values: the texts a prompt is framed with
_MANIFEST_HEAD = "FORENSIC VISUAL MANIFEST:\n"
_NO_FINDING = "- No visual anomalies detected by foundation OCR.\n"
_CONTEXT_HEAD = "\n\nCRITICAL CONTEXT FROM SEMANTIC INDEX:\n"
_CONTEXT_SEPARATOR = "\n---\n"
_INPUT_HEAD = "\n\n\nInput Document:\n"
_LONG_TEXT_HEAD = "SOURCE DATA EXCERPT (Refer to Semantic Index below for full context):\n"
_IMAGES = "AUDIT NOTICE: %d visual assets are attached. Perform a forensic comparison."
_NO_IMAGES = "No visual assets attached."
_DIRECTIVES = "Directives:\n1. STRUCTURE: Return valid JSON only.\n2. AUDIT: "


def forensic_manifest(forensics: DataFrame, records: DataFrame, span: int = 1024) -> DataFrame:
    """Findings of every record as text: (record_id, part, manifest), whole once the parts are joined.

    ``forensics`` carries ``seq``, the position of a finding within its record. Part 0
    holds the heading; a record without findings gets one fixed line.
    """
    line = F.concat(
        F.lit("- ["),
        F.upper("layer_type"),
        F.lit("] "),
        F.col("content"),
        F.lit(" (Confidence: "),
        F.format_string("%.2f", F.col("confidence")),
        F.lit(")\n"),
    )
    lines = forensics.select("record_id", "seq", line.alias("line"))
    parts = joined_text(lines, ["record_id"], "seq", "line", "lines", span=span)
    heads = records.select(F.col("id").alias("record_id")).join(
        forensics.select("record_id", F.lit(True).alias("_some")).distinct(), "record_id", "left"
    )
    none = F.when(F.col("_some").isNull(), _NO_FINDING).otherwise("")
    top = heads.select(
        "record_id", F.lit(-1).cast("long").alias("part"), F.concat(F.lit(_MANIFEST_HEAD), none).alias("manifest")
    )
    return top.unionByName(parts.select("record_id", "part", F.col("lines").alias("manifest")))


def build_prompts(
    texts: DataFrame,
    manifest: DataFrame,
    fragments: DataFrame,
    assets: DataFrame,
    system: str = "You audit documents for an evidence archive.",
    task: str = "Perform the audit.",
    k: int = FRAGMENTS,
    long_bytes: int | None = LONG_TEXT_BYTES,
    excerpt_chars: int = EXCERPT_CHARS,
) -> DataFrame:
    """Prompts as numbered parts (record_id, part, prompt); joined in order they are the prompt.

    ``fragments`` is (record_id, rank, text), of which each record's ``k`` first by rank
    are shown, cut before the shuffle; ``manifest`` the parts of :func:`forensic_manifest`.
    The manifest may be of any length, so it keeps its parts and only the frame around
    it is added. A text of more than ``long_bytes`` (None: no text) is shown by its first
    ``excerpt_chars``.
    """
    context = first_rows(fragments, ["record_id"], [F.col("rank"), F.col("text")], k).groupBy("record_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda f: f["text"]), _CONTEXT_SEPARATOR).alias(
            "context"
        )
    )
    images = assets.filter(F.col("asset_type") == "image").groupBy("record_id").agg(F.count(F.lit(1)).alias("images"))
    shown = F.col("text")
    if long_bytes is not None:
        excerpt = F.concat(F.lit(_LONG_TEXT_HEAD), F.substring("text", 1, excerpt_chars), F.lit("\n"))
        shown = F.when(F.octet_length("text") > long_bytes, excerpt).otherwise(shown)
    framed = texts.join(context, "record_id", "left").join(images, "record_id", "left")
    notice = F.when(
        F.coalesce("images", F.lit(0)) > 0,
        F.format_string(_IMAGES, F.col("images")),
    ).otherwise(_NO_IMAGES)
    head = F.concat(
        F.lit(f"<|im_start|>system\n{system} \n{_DIRECTIVES}"),
        notice,
        F.lit("\n\n"),
    )
    tail = F.concat(
        F.lit(_CONTEXT_HEAD),
        F.coalesce("context", F.lit("")),
        F.lit(_INPUT_HEAD),
        shown,
        F.lit(f"<|im_end|>\n<|im_start|>user\n{task}<|im_end|>\n<|im_start|>thought\n"),
    )
    last = F.lit(2**62)
    return (
        framed.select("record_id", F.lit(-2).cast("long").alias("part"), head.alias("prompt"))
        .unionByName(manifest.select("record_id", "part", F.col("manifest").alias("prompt")))
        .unionByName(framed.select("record_id", last.alias("part"), tail.alias("prompt")))
    )


def _strict_json(text: Column) -> Column:
    """Parsed JSON, NULL unless the text is exactly one value.

    Spark's parser ignores what follows a complete value; inside an array and inside
    an object any rest is an error, and no rest can close both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.try_variant_get(in_array, "$[1]", "variant").isNull()
    return F.when(in_array.isNotNull() & in_object.isNotNull() & single, F.try_parse_json(text))


def parse_responses(df: DataFrame, text: str = "generated") -> DataFrame:
    """(record_id, thought, response_json, parsed) of generated texts.

    The thought is what precedes the first brace, the answer reaches to the last one.
    An answer that is no JSON is wrapped, raw text included.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    first = F.instr(raw, "{")
    start = F.greatest(first, F.lit(1))
    from_end = F.instr(F.reverse(raw), "}")
    stop = F.when(from_end == 0, F.length(raw)).otherwise(F.length(raw) - from_end + 1)
    answer = F.substring(raw, start, F.greatest(stop - start + 1, F.lit(0)))
    split = df.select("record_id", raw.alias("_raw"), answer.alias("_answer"), F.substring(raw, F.lit(1), start - 1).alias("_thought"))
    value = _strict_json(F.col("_answer"))
    fallback = F.to_json(
        F.struct(F.lit("Extraction failed").alias("object_description"), F.col("_raw").alias("raw_response"))
    )
    return split.withColumn("_value", value).select(
        "record_id",
        trim_ws("_thought").alias("thought"),
        F.coalesce(F.to_json("_value"), fallback).alias("response_json"),
        F.col("_value").isNotNull().alias("parsed"),
    )


def explode_observations(df: DataFrame, ts: str, json: str = "response_json") -> DataFrame:
    """A fragment for every *text* element of ``observations``; other elements are skipped."""
    elements = F.try_variant_get(F.try_parse_json(json), "$.observations", "array<variant>")
    flat = df.select("record_id", F.posexplode(elements).alias("position", "_v"))
    return flat.filter(F.schema_of_variant("_v") == "STRING").select(
        derived_id("observation", "record_id", F.lit(ts), "position").alias("id"),
        "record_id",
        "position",
        F.lit("observation").alias("fragment_type"),
        F.try_variant_get("_v", "$", "string").alias("text"),
        F.lit(FRAGMENT_CONFIDENCE).alias("confidence"),
        F.lit(ts).alias("created_at"),
    )


def fragment_vectors(fragments: DataFrame) -> DataFrame:
    """(fragment_id, embedding) of new fragments."""
    return hash_embed(fragments.withColumnRenamed("id", "fragment_id"), ["fragment_id"], "text")


def _truthy(value: Column) -> Column:
    """Text of a variant, NULL where a script would call it false: null, empty, 0 or false."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    empty = (
        F.is_variant_null(value)
        | ((kind == "STRING") & (text == ""))
        | ((kind == "BOOLEAN") & (text == "false"))
        | (~kind.isin("STRING", "BOOLEAN") & F.coalesce(number == 0, F.lit(False)))
    )
    return F.when(value.isNotNull() & ~empty, text)


def intel_projection(records: DataFrame) -> DataFrame:
    """Display columns of analysed records, each with its fallback."""
    analysed = records.filter(F.coalesce("intelligence_json", F.lit("")) != "").withColumn(
        "_v", F.try_parse_json("intelligence_json")
    )
    field = lambda name: _truthy(F.try_variant_get("_v", f"$.{name}", "variant"))
    own = lambda name: F.nullif(F.col(name), F.lit(""))
    score = F.try_variant_get("_v", "$.intelligence_score", "double")
    return analysed.select(
        F.col("id").alias("record_id"),
        F.coalesce(field("object_description"), F.lit("No summary available.")).alias("description"),
        F.coalesce(field("incident_date"), own("incident_date"), F.lit("UNDISCLOSED")).alias("target_date"),
        F.coalesce(field("location"), own("incident_location"), F.lit("GLOBAL")).alias("location"),
        F.coalesce(
            F.try_variant_get("_v", "$.agencies", "array<string>"), F.expr("cast(array() as array<string>)")
        ).alias("agencies"),
        F.coalesce(field("pilot_observations"), F.lit("No observational data resolved.")).alias("observations"),
        F.floor(F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(0.6)) * 100 + 0.5).cast("long").alias("fidelity"),
    )


def log_history(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Logs of every record, newest first; the newest ``limit`` only where asked."""
    order = [F.col("created_at").desc(), F.col("id")]
    kept = logs if limit is None else first_rows(logs, ["record_id"], order, limit)
    return kept.orderBy("record_id", *order)


def stale_synthesis(records: DataFrame, texts: DataFrame, logs: DataFrame) -> DataFrame:
    """(record_id, stale): was the record's text renewed more than 5 s after its last synthesis?"""
    latest = logs.groupBy(F.col("record_id").alias("id")).agg(F.max(F.to_timestamp("created_at")).alias("_log"))
    filled = texts.filter(F.coalesce("ocr_text", F.lit("")) != "").select(
        F.col("record_id").alias("id"), F.lit(True).alias("_text")
    )
    joined = records.join(latest, "id", "left").join(filled, "id", "left")
    newer = F.to_timestamp("updated_at") > F.col("_log") + F.expr(f"interval {STALE_SECONDS} seconds")
    has_json = F.coalesce("intelligence_json", F.lit("")) != ""
    return joined.select(
        F.col("id").alias("record_id"),
        (has_json & F.col("_text").isNotNull() & F.coalesce(newer, F.lit(False))).alias("stale"),
    )


RESET, TOKEN = "synthesizing-start", "synthesizing"


def assemble_token_stream(events: DataFrame, span: int = 1024) -> DataFrame:
    """Text of every record's last run: (record_id, part, text), whole once the parts are joined.

    ``events`` is (record_id, seq, status, token_text). The last start of a run is a
    plain aggregate; only tokens after it are assembled, part by part.
    """
    starts = (
        events.filter(F.col("status") == RESET).groupBy("record_id").agg(F.max("seq").alias("_start"))
    )
    tokens = events.filter((F.col("status") == TOKEN) & (F.coalesce("token_text", F.lit("")) != ""))
    current = join_many_to_one(
        tokens.select("record_id", "seq", "token_text"), starts, ["record_id"], "left"
    ).filter(F.col("_start").isNull() | (F.col("seq") > F.col("_start")))
    return joined_text(current, ["record_id"], "seq", "token_text", "text", span=span)


