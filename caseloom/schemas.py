"""Fixed schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; needs no session, unlike a DDL string."""
    pairs = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# fixed values: catalogue header -> column name
CATALOGUE_HEADERS: dict[str, str] = {
    "Redaction": "redaction",
    "Release Date": "release_date",
    "Title": "title",
    "Type": "file_type",
    "Video Pairing": "video_pairing",
    "PDF Pairing": "pdf_pairing",
    "Description Blurb": "summary",
    "DVIDS Video ID": "dvids_video_id",
    "Video Title": "video_title",
    "Agency": "agency",
    "Incident Date": "incident_date",
    "Incident Location": "incident_location",
    "PDF | Image Link": "document_url",
    "Modal Image": "modal_image",
    "Image Alt Text": "image_alt_text",
    "Image VIRIN": "image_virin",
}

CATALOGUE = T.StructType([T.StructField(c, T.StringType()) for c in CATALOGUE_HEADERS.values()])

RECORDS = _struct(
    "id string, stable_key string, source_snapshot_id string, content_hash string, title string, "
    "agency string, release_date string, incident_date string, incident_location string, "
    "document_url string, local_path string, file_type string, source_type string, summary string, "
    "intelligence_json string, redaction_score double, analysis_status string, analysis_error string, "
    "thumbnail_path string, removed_from_source_at string, updated_at string, created_at string"
)
SNAPSHOT_ROWS = _struct(
    "snapshot_id string, stable_key string, content_hash string, title string, document_url string, "
    "record_json string"
)
ARTIFACTS = _struct(
    "id string, record_id string, sha256 string, original_filename string, media_type string, "
    "byte_size long, source_url string, relative_path string, source_type string, created_at string"
)
EXPORTS = _struct("id string, case_id string, format string, relative_path string, created_at string")
