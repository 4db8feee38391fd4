"""Cases, their members and notes, and dossiers as ordered blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, trim_ws
from .common import derived_id, first_row, join_many_to_one, union_all

#: Fixed value: characters of a record's text shown in a dossier.
EXCERPT_CHARS = 1600


def _known(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def case_summary(cases: DataFrame, members: DataFrame, notes: DataFrame) -> DataFrame:
    """Cases with their numbers of records and notes, newest first.

    Both sides are counted before the joins, so they never multiply each other.
    """
    records = members.groupBy(F.col("case_id").alias("id")).agg(F.count_distinct("record_id").alias("record_count"))
    written = notes.groupBy(F.col("case_id").alias("id")).agg(F.count_distinct("id").alias("note_count"))
    return (
        cases.join(records, "id", "left")
        .join(written, "id", "left")
        .fillna(0, ["record_count", "note_count"])
        .orderBy(F.col("created_at").desc(), "id")
    )


def _when(df: DataFrame) -> Column:
    return F.coalesce(_known(df, "incident_date"), _known(df, "release_date"), F.col("created_at"))


def timeline_rows(members: DataFrame, records: DataFrame) -> DataFrame:
    """Member records with case_id, the membership note and ``occurred``, the date they are ordered by."""
    notes = _known(members, "notes")
    placed = members.select("case_id", F.col("record_id").alias("id"), notes.alias("case_record_notes"))
    dated = records.withColumn("occurred", _when(records))
    return join_many_to_one(placed, dated, ["id"], "inner")


def case_timeline(members: DataFrame, records: DataFrame) -> DataFrame:
    """The records of every case in the order of their dates (as text, NULL first)."""
    return timeline_rows(members, records).orderBy("case_id", "occurred", "id")


def add_members(
    members: DataFrame, requests: DataFrame, cases: DataFrame, records: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Memberships after (case_id, record_id, notes, ordinal) requests, and the rejected ones.

    A request for an unknown case or record is rejected. The last valid request of a
    pair sets its note, also to NULL.
    """
    by_case = cases.select(F.col("id").alias("case_id"), F.lit(True).alias("_case"))
    by_record = records.select(F.col("id").alias("record_id"), F.lit(True).alias("_record"))
    judged = join_many_to_one(requests, by_case, ["case_id"], "left")
    judged = join_many_to_one(judged, by_record, ["record_id"], "left").withColumn(
        "reason",
        F.when(F.col("_case").isNull(), F.concat(F.lit("case not found: "), F.col("case_id"))).when(
            F.col("_record").isNull(), F.concat(F.lit("record not found: "), F.col("record_id"))
        ),
    )
    pair = ["case_id", "record_id"]
    rejects = judged.filter(F.col("reason").isNotNull()).select(*pair, "reason")
    last = first_row(judged.filter(F.col("reason").isNull()), pair, [F.col("ordinal").desc()]).select(
        *pair, F.col("notes").alias("_note"), F.lit(True).alias("_new")
    )
    merged = members.join(last, pair, "full_outer").select(
        *pair, F.when(F.col("_new").isNotNull(), F.col("_note")).otherwise(F.col("notes")).alias("notes")
    )
    return merged, rejects


def create_cases(requests: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Cases from (request_id, title, description), and the requests without a title."""
    blank = is_blank("title")
    cases = requests.filter(~blank).select(
        derived_id("case", "request_id").alias("id"),
        trim_ws("title").alias("title"),
        F.when(~is_blank("description"), F.col("description")).alias("description"),
        F.lit(ts).alias("created_at"),
    )
    return cases, requests.filter(blank).select("request_id", F.lit("case title is required").alias("reason"))


def append_notes(
    notes: DataFrame, requests: DataFrame, cases: DataFrame, ts: str
) -> tuple[DataFrame, DataFrame]:
    """Notes after (request_id, case_id, record_id, body) requests, and the rejected ones."""
    by_case = cases.select(F.col("id").alias("case_id"), F.lit(True).alias("_case"))
    judged = join_many_to_one(requests, by_case, ["case_id"], "left").withColumn(
        "reason",
        F.when(F.col("_case").isNull(), F.concat(F.lit("case not found: "), F.col("case_id"))).when(
            is_blank("body"), "note body is required"
        ),
    )
    fresh = judged.filter(F.col("reason").isNull()).select(
        derived_id("note", "request_id").alias("id"),
        "case_id",
        "record_id",
        trim_ws("body").alias("body"),
        F.lit(ts).alias("created_at"),
        F.lit(ts).alias("updated_at"),
    )
    rejects = judged.filter(F.col("reason").isNotNull()).select("request_id", "case_id", "reason")
    return notes.unionByName(fresh, allowMissingColumns=True), rejects


def list_notes(notes: DataFrame) -> DataFrame:
    """Notes of every case, oldest first."""
    return notes.orderBy("case_id", "created_at", "id")


# --- dossiers ---------------------------------------------------------------

#: Order of the blocks of a dossier.
BLOCK_ORDER = ["case_id", "section", "occurred", "item_id", "part", "kind", "name"]


def _block(df: DataFrame, section: int, part: int, text: Column, **order: Column) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return df.select(
        "case_id",
        F.lit(section).alias("section"),
        order.get("occurred", nothing).alias("occurred"),
        order.get("item_id", nothing).cast("string").alias("item_id"),
        F.lit(part).alias("part"),
        order.get("kind", nothing).alias("kind"),
        order.get("name", nothing).alias("name"),
        text.alias("block"),
    )


# fixed values: labels of the optional facts of a record, and the column each one shows
_FACTS = [
    ("Agency", "agency"),
    ("Release Date", "release_date"),
    ("Incident Date", "incident_date"),
    ("Incident Location", "incident_location"),
    ("Source URL", "document_url"),
    ("Local Path", "local_path"),
]
# fixed values: headings and lines of a dossier
_SUMMARY_HEAD, _EVIDENCE_HEAD, _NOTES_HEAD = "## Case Summary\n\n", "\n## Evidence\n\n", "## Investigator Notes\n\n"
_ENTITY_HEAD, _EXCERPT_HEAD = "\nEntities:\n", "\nAnalysis Excerpt:\n\n> "
_NO_NOTES = "No investigator notes have been added.\n"


def _fact(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: `"), value, F.lit("`\n"))


def _optional_fact(label: str, column: str) -> Column:
    return F.when(is_blank(column), F.lit("")).otherwise(_fact(label, trim_ws(column)))


def _record_pieces(records: DataFrame, links: DataFrame, results: DataFrame, excerpt_chars: int | None) -> DataFrame:
    """Per record, independent of any case: date, texts around the membership note, entity flag."""
    text = F.replace(F.col("ocr_text"), F.lit("\n"), F.lit("\n> "))
    shown = text if excerpt_chars is None else F.substring(text, 1, excerpt_chars)
    excerpts = results.filter(~is_blank("ocr_text")).select(
        F.col("record_id").alias("id"),
        F.concat(F.lit(_EXCERPT_HEAD), shown, F.lit("\n\n")).alias("_excerpt"),
    )
    owners = links.select(F.col("record_id").alias("id")).distinct().withColumn("_owner", F.lit(True))
    facts = [_optional_fact(label, column) for label, column in _FACTS if column in records.columns]
    summary = F.concat(F.lit("\n"), trim_ws(_known(records, "summary")), F.lit("\n"))
    described = records.select(
        "id",
        _when(records).alias("occurred"),
        F.concat(F.lit("### "), F.col("title"), F.lit("\n\n"), _fact("Record ID", F.col("id").cast("string")), *facts).alias(
            "_facts"
        ),
        F.coalesce(summary, F.lit("")).alias("_summary"),
    )
    return (
        described.join(excerpts, "id", "left")
        .join(owners, "id", "left")
        .select("id", "occurred", "_facts", "_summary", "_owner", F.coalesce("_excerpt", F.lit("\n")).alias("_excerpt"))
    )


def dossier_blocks(
    cases: DataFrame,
    members: DataFrame,
    notes: DataFrame,
    records: DataFrame,
    links: DataFrame,
    results: DataFrame,
    excerpt_chars: int | None = EXCERPT_CHARS,
) -> DataFrame:
    """The Markdown dossier of every case as blocks, whole once sorted by :data:`BLOCK_ORDER`.

    ``links`` is (record_id, name, entity_type, confidence), ``results`` (record_id,
    ocr_text), of which the first ``excerpt_chars`` characters are shown (None: all). The text of a record is put together once, however many cases it is
    in. No task gathers a case: a case of any size is a sorted range of rows.
    """
    known_cases = cases.select(F.col("id").alias("case_id"))
    members = join_many_to_one(members, known_cases, ["case_id"], "left_semi")
    notes = join_many_to_one(notes, known_cases, ["case_id"], "left_semi")
    places = members.select("case_id", F.col("record_id").alias("id"), _known(members, "notes").alias("_note"))

    # per membership: the record's facts with the note, its entity heading, its excerpt
    pieces = _record_pieces(records, links, results, excerpt_chars)
    evidence = join_many_to_one(places, pieces, ["id"], "inner")
    entry = F.concat("_facts", _optional_fact("Case Notes", "_note"), "_summary")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), entry.alias("block")),
        F.struct(F.lit(1).alias("part"), F.when(F.col("_owner"), _ENTITY_HEAD).alias("block")),
        F.struct(F.lit(3).alias("part"), F.col("_excerpt").alias("block")),
    )
    texts = evidence.select("case_id", "occurred", "id", F.inline(parts)).filter(F.col("block").isNotNull())
    nothing = F.lit(None).cast("string")
    record_blocks = texts.select(
        "case_id",
        F.lit(1).alias("section"),
        "occurred",
        F.col("id").cast("string").alias("item_id"),
        "part",
        nothing.alias("kind"),
        nothing.alias("name"),
        "block",
    )

    # per membership and entity: many to many, where AQE splits skew on either side
    dated = records.select("id", _when(records).alias("occurred"))
    named = links.select(F.col("record_id").alias("id"), "name", "entity_type", "confidence")
    dated_places = join_many_to_one(places.select("case_id", "id"), dated, ["id"], "inner")
    entity = F.concat(
        F.lit("- "),
        F.col("entity_type"),
        F.lit(" `"),
        F.col("name"),
        F.lit("` ("),
        F.format_string("%.2f", F.col("confidence")),
        F.lit(")\n"),
    )
    at = {"occurred": F.col("occurred"), "item_id": F.col("id"), "kind": F.col("entity_type"), "name": F.col("name")}
    entity_blocks = _block(dated_places.join(named, "id"), 1, 2, entity, **at)

    n_records = (
        join_many_to_one(places.select("case_id", "id"), records.select("id"), ["id"], "left_semi")
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    n_notes = notes.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_notes"))
    heads = (
        cases.select(F.col("id").alias("case_id"), "title", "description", "created_at")
        .join(n_records, "case_id", "left")
        .join(n_notes, "case_id", "left")
        .fillna(0, ["n_records", "n_notes"])
    )
    header = F.concat(
        F.lit("# "),
        F.col("title"),
        F.lit("\n\n"),
        F.coalesce(F.concat("description", F.lit("\n\n")), F.lit("")),
        F.lit(_SUMMARY_HEAD),
        _fact("Case ID", F.col("case_id")),
        _fact("Created", F.col("created_at").cast("string")),
        _fact("Evidence records", F.col("n_records").cast("string")),
        _fact("Notes", F.col("n_notes").cast("string")),
        F.lit(_EVIDENCE_HEAD),
    )
    notes_head = F.concat(F.lit(_NOTES_HEAD), F.when(F.col("n_notes") == 0, _NO_NOTES).otherwise(""))
    written = F.col("created_at").cast("string")
    note = F.concat(F.lit("- `"), written, F.lit("`: "), F.col("body"), F.lit("\n"))
    return union_all(
        [
            _block(heads, 0, 0, header),
            record_blocks,
            entity_blocks,
            _block(heads, 2, 0, notes_head),
            _block(notes, 2, 1, note, occurred=written, item_id=F.col("id")),
        ]
    ).select(*BLOCK_ORDER, "block")


def dossier_lines(blocks: DataFrame) -> DataFrame:
    """Blocks cut into lines, numbered within the block."""
    text = F.regexp_replace(F.regexp_replace("block", r"\n\z", ""), r"\r(?=\n|\z)", "")
    return blocks.select(*BLOCK_ORDER, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def escape_html(col: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(plain), F.lit(safe))
    return col


_PREFIXES = [
    ("# ", "<h1>", "</h1>"),
    ("## ", "<h2>", "</h2>"),
    ("### ", "<h3>", "</h3>"),
    ("- ", '<p class="bullet">', "</p>"),
    ("> ", "<blockquote>", "</blockquote>"),
]

_PAGE_STYLE = (
    "body { font: 16px/1.5 sans-serif; max-width: 60em; margin: 3em auto; } "
    "blockquote { white-space: pre-wrap; border-left: 3px solid; padding-left: 1em; } "
    ".bullet { margin: 0.2em 0 0.2em 1.5em; }"
)


def html_of_line(line: Column) -> Column:
    """One Markdown line as HTML."""
    html = F.when(is_blank(line), "").otherwise(F.concat(F.lit("<p>"), escape_html(line), F.lit("</p>")))
    for prefix, start, end in reversed(_PREFIXES):
        rest = F.substring(line, len(prefix) + 1, 2**31 - 1)
        html = F.when(line.startswith(prefix), F.concat(F.lit(start), escape_html(rest), F.lit(end))).otherwise(html)
    return html


def markdown_to_html(blocks: DataFrame, cases: DataFrame) -> DataFrame:
    """The dossiers as HTML blocks, one per Markdown line, inside a fixed page."""
    titled = cases.select(F.col("id").alias("case_id"), "title")
    head = F.concat(
        F.lit('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'),
        escape_html(F.col("title")),
        F.lit(f"</title>\n<style>{_PAGE_STYLE}</style>\n</head>\n<body>\n"),
    )
    lines = dossier_lines(blocks).select(
        *BLOCK_ORDER, "line_no", F.concat(html_of_line(F.col("line")), F.lit("\n")).alias("block")
    )
    first = _block(titled, -1, 0, head).withColumn("line_no", F.lit(0))
    last = _block(titled, 9, 0, F.lit("</body>\n</html>\n")).withColumn("line_no", F.lit(0))
    return union_all([first, lines, last]).select(*BLOCK_ORDER, "line_no", "block")


def export_manifest(requests: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Exports for (case_id, format) requests, and the requests of an unknown format."""
    kind = F.lower("format")
    suffix = F.when(kind == "markdown", ".md").when(kind == "html", ".html")
    judged = requests.select("case_id", kind.alias("format"), suffix.alias("_suffix"))
    export = derived_id("export", "case_id", "format", F.lit(ts))
    good = judged.filter(F.col("_suffix").isNotNull()).select(
        export.alias("id"),
        "case_id",
        "format",
        F.concat(F.col("case_id"), F.lit("/"), export, F.col("_suffix")).alias("relative_path"),
        F.lit(ts).alias("created_at"),
    )
    bad = judged.filter(F.col("_suffix").isNull()).select(
        "case_id", "format", F.lit("export format must be `markdown` or `html`").alias("reason")
    )
    return good, bad
