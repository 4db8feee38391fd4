"""Text cleaning expressions shared by the operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: A value from its first to its last character that is no Unicode white space, found from the ends.
_INNER = r"(?Us)\A\s*+(.*\S)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(col: Column | str) -> Column:
    """Strip all Unicode white space, not only blanks."""
    return F.regexp_extract(col, _INNER, 1)


def ltrim_ws(col: Column | str) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+", "")


def rtrim_ws(col: Column | str) -> Column:
    return F.regexp_replace(col, r"(?U)\s+\z", "")


def blank_to_null(col: Column | str) -> Column:
    """Trimmed value, or NULL when nothing is left."""
    return F.nullif(trim_ws(col), F.lit(""))


def is_blank(col: Column | str) -> Column:
    """True for NULL and for white space only."""
    column = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~column.rlike(r"(?U)\S"), F.lit(True))


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only, as the catalogue's text comparisons do."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def contains_pattern(col: Column | str, needle: str) -> Column:
    """``LIKE '%needle%'`` with ``%`` and ``_`` live, no escape, ASCII case folded.

    What stands between two ``%`` is taken where it first fits and never tried again, so the test
    takes one pass. ``(?i)`` folds A-Z only.
    """

    def literal(char: str) -> str:
        return "." if char == "_" else char if char.isascii() and char.isalnum() else "\\x{%x}" % ord(char)

    runs = ["".join(map(literal, run)) for run in needle.split("%") if run]
    column = F.col(col) if isinstance(col, str) else col
    return column.rlike(r"(?is)\A" + "".join(f"(?>.*?{run})" for run in runs))


def _beyond(limit: int) -> str:
    """Regex for the digit runs without leading zeros that exceed ``limit``."""
    digits = str(limit)
    longer = "[0-9]{%d,}" % (len(digits) + 1)
    same_length = [
        digits[:i] + "[%d-9]" % (int(d) + 1) + "[0-9]{%d}" % (len(digits) - i - 1)
        for i, d in enumerate(digits)
        if d != "9"
    ]
    return "(?<![0-9])(?:%s)(?![0-9])" % "|".join([longer, *same_length])


_OVERFLOW = _beyond(2**64 - 1)


def normalise_title(col: Column | str) -> Column:
    """Drop leading zeros of every digit run, then lower-case.

    A run that does not fit an unsigned 64-bit integer counts as ``0``.
    """
    stripped = F.regexp_replace(col, "(?<![0-9])0+(?=[0-9])", "")
    # hardly any title has a run that long, and the cheap test decides
    fits = lambda t: F.when(t.rlike("[0-9]{20}"), F.regexp_replace(t, _OVERFLOW, "0")).otherwise(t)
    return F.lower(let(stripped, fits))


# --- URLs -------------------------------------------------------------------

_WEB = r"^(?i)(https?|wss?|ftp)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_DEFAULT_PORTS = {"http": "80", "ws": "80", "https": "443", "wss": "443", "ftp": "21"}


def _percent(col: Column, reserved: str) -> Column:
    """Percent-encode control, non-ASCII and ``reserved`` characters as UTF-8."""
    unsafe = r"[^\x21-\x7E]|[" + reserved + "]"

    def encode(text: Column) -> Column:
        chars = F.transform(
            F.split(text, ""),
            lambda ch: F.when(
                ch.rlike(unsafe), F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", r"%$1")
            ).otherwise(ch),
        )
        return F.when(text.rlike(unsafe), F.array_join(chars, "")).otherwise(text)

    return let(col, encode)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(acc: Column, seg: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    def fold(text: Column) -> Column:
        folded = F.aggregate(F.split(text, "/"), F.expr("cast(array() as array<string>)"), step)
        end = F.when(text.rlike(r"/\.\.?\z"), "/").otherwise("")
        return F.when(text.rlike(r"/\.\.?(/|\z)"), F.concat(F.array_join(folded, "/"), end)).otherwise(text)

    return let(path, fold)


def _rebuilt(clean: Column) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(clean, _WEB, i), F.lit(""))
    place = r"^(.*@)?([^@]*?)(?::0*([0-9]*))?$"

    def authority(text: Column) -> Column:
        port = F.regexp_extract(text, place, 3)
        scheme = F.lower(part(1))
        usual = F.coalesce(*[F.when(scheme == s, p) for s, p in _DEFAULT_PORTS.items()], F.lit(""))
        return F.concat(
            F.regexp_extract(text, place, 1),
            F.lower(F.regexp_extract(text, place, 2)),
            F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)),
        )

    path = F.replace(part(3), F.lit("\\"), F.lit("/"))
    return F.concat(
        F.lower(part(1)),
        F.lit("://"),
        let(part(2), authority),
        _fold_dots(_percent(F.when(path == "", "/").otherwise(path), r'"<>`{}')),
        _percent(part(4), r"\"<>'"),
        _percent(part(5), r'"<>`'),
    )


def normalise_url(col: Column | str) -> Column:
    """Canonical form of an absolute web URL; anything else only loses its spaces.

    Scheme and host are lower-cased, default ports dropped, an empty path becomes
    ``/``, dot segments are folded and unsafe characters percent-encoded.
    """
    raw = F.col(col) if isinstance(col, str) else col

    def choose(clean: Column) -> Column:
        # printable ASCII host without characters a host cannot have
        usable = clean.rlike(r"^(?i)(https?|wss?|ftp)://([^/?#\\]*@)?[^/?#\\@\s<>^|%\x7f-\x{10ffff}:]+(:[0-9]*)?([/?#\\]|\z)")
        other = clean.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^ ]*\z") & ~clean.rlike(r"^(?i)(https?|wss?|ftp):")
        return (
            F.when(usable, _rebuilt(clean)).when(other, clean).otherwise(F.replace(clean, F.lit(" "), F.lit("%20")))
        )

    return let(F.regexp_replace(raw, r"[\t\n\r]", ""), choose)


def filename_of_url(col: Column | str) -> Column:
    """Last path segment of a URL (or path), percent-decoded."""
    raw = F.col(col) if isinstance(col, str) else col
    path = F.coalesce(F.try_parse_url(F.regexp_replace(raw, " ", "%20"), F.lit("PATH")), raw)
    segment = F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(""))
    # a literal plus sign is data in a path, not a blank
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def extension_of(col: Column | str) -> Column:
    """Lower-cased file extension, NULL when there is none."""
    base = F.regexp_extract(col, r"([^/]*)$", 1)
    return F.nullif(ascii_lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1)), F.lit(""))


# --- display ----------------------------------------------------------------


def match_percent(distance: Column | str) -> Column:
    """Search distance as a percentage with one decimal, never below zero."""
    column = F.col(distance) if isinstance(distance, str) else distance
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - column) * 100, 1)


def format_bytes(col: Column | str) -> Column:
    """1024-step size label: no decimals for plain bytes and from 10 up, else one."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    label = None
    for power, unit in enumerate(units):
        scaled = value / float(1024**power)
        whole = F.concat(F.format_string("%.0f", F.round(scaled, 0)), F.lit(f" {unit}"))
        tenth = F.concat(F.format_string("%.1f", F.round(scaled, 1)), F.lit(f" {unit}"))
        text = whole if power == 0 else F.when(scaled >= 10, whole).otherwise(tenth)
        last = power == len(units) - 1
        fits = F.lit(True) if last else value < float(1024 ** (power + 1))
        label = F.when(fits, text) if label is None else label.when(fits, text)
    return F.when(value.isNull() | F.isnan(value) | (value == 0), "0 B").otherwise(label)


# fixed values: file extensions of each media kind
_IMAGE = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff"]
_VIDEO = ["mp4", "webm", "ogg", "mov"]


def media_kind(file_type: Column | str) -> Column:
    """image / video / pdf / other."""
    kind = F.lower(F.coalesce(file_type if isinstance(file_type, Column) else F.col(file_type), F.lit("")))
    return (
        F.when(kind.isin(_IMAGE), "image")
        .when(kind.isin(_VIDEO), "video")
        .when(kind == "pdf", "pdf")
        .otherwise("other")
    )
