"""Personal data in texts: fixed patterns, and spans that weakly supervised labelers agree on.

Everything on the rows is SQL functions of the JVM: texts are read once, matches are
found with regular expressions, and positions come from the lengths of the pieces
between them. Five labelers vote on every candidate (a token with digits or an @,
and the number-like tokens after it); how often each combination of votes occurs, a
table of at most 3**5 rows, is all that expectation-maximisation needs to estimate
how reliable they are. The resulting posterior probabilities train a naive Bayes
classifier of the candidates' own features, again from one small table of counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .weak import any_objection, estimate

KINDS = ("email", "ip", "card", "phone")
#: Spans of base patterns: fixed values. Groups are possessive, so a long run of digits
#: needs no stack; a card begins with its first 13 digits, shorter runs never count.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that a text with such a span meets.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: From the first digit or @ of a token on; up to 64 characters of it before are added.
CANDIDATE = r"[0-9@]\S*+(?:\x20[0-9(+-]\S*+)*+"
LABELERS = ("pattern", "shape", "gazetteer", "context", "checksum")
#: Gazetteers and context words of the labelers, lower case.
MAIL_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
NOT_PERSONAL = ("version", "license", "licence", "copyright", "page", "chapter", "section", "figure", "table", "year", "item", "no", "vol", "isbn", "doi", "http", "www")
PERSONAL_CONTEXT = ("call", "tel", "telephone", "phone", "mobile", "fax", "contact", "mail", "email", "e-mail", "card", "visa", "iban", "account", "passport", "ssn", "address", "ip", "host")
#: Probability from which on a candidate becomes a span.
THRESHOLD = 0.9
#: Most of a labeler's votes on personal data that may be a no: an objection outweighs a shape that fits.
FALSE_NO = 0.02
_RUN = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_starts_of(lengths: Column) -> Column:
    """Sums of all lengths before each place; long arrays are added up in runs of 512."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _RUN).cast("int") - 1, F.lit(0))),
        lambda r: F.aggregate(F.slice(lengths, r * _RUN + 1, _RUN), zero, add),
    )
    bases = lambda runs: F.aggregate(runs, zero, lambda sums, run: add(sums, F.element_at(run, -1)))
    shifted = lambda runs, bases: F.transform(
        runs, lambda run, r: let(F.get(bases, r), lambda base: F.transform(F.slice(run, F.lit(1), F.size(run) - 1), lambda v: v + base))
    )
    return F.flatten(let(runs, lambda runs: let(bases(runs), lambda bases: shifted(runs, bases))))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (found, before, start), positions in code points."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")
    )
    return let(parts, lambda p: _placed(p["found"], p["between"]))


def _placed(found: Column, between: Column) -> Column:
    lengths = F.transform(
        found, lambda m, i: F.length(F.get(between, i)).cast("long") + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)
    )
    place = lambda lengths, starts: F.transform(
        found,
        lambda m, i: F.struct(
            m.alias("found"), F.get(between, i).alias("before"), (F.get(starts, i) + F.get(lengths, i)).alias("start")
        ),
    )
    return let(lengths, lambda lengths: let(running_starts_of(lengths), lambda starts: place(lengths, starts)))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda sum_, i: sum_
        + F.when(
            (F.length(digits) - i) % 2 == 1,
            F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, 1).cast("int")),
        ).otherwise(F.substring(digits, i, 1).cast("int")),
    )
    return total % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "email":
        return lambda x: F.lit(True)
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
        return lambda x: F.forall(F.split(x, r"\."), part)
    if kind == "card":
        return lambda x: F.when(F.length(digits_of(x)).between(13, 19), passes_luhn(digits_of(x))).otherwise(False)
    return lambda x: F.length(digits_of(x)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans (start, end) of a kind; matches that fail the check are dropped and not tried again."""
    hint = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    spans = F.transform(
        F.filter(located(text, PATTERNS[kind]), lambda m: _valid(kind)(m["found"])),
        lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["found"])).alias("end")),
    )
    return F.when(hint, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _any_word(x: Column, words: Sequence[str]) -> Column:
    return x.rlike(r"(?i)(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z])")


def _candidates(text: Column, base: Column) -> Column:
    """Candidates with their votes (-1 no, 0 none, 1 yes, in the order of LABELERS) and features."""

    def widen(m: Column) -> Column:
        head = F.regexp_extract(F.right(m["before"], F.lit(64)), r"\S*$", 0)
        return let(
            F.struct(
                F.concat(head, m["found"]).alias("found"), (m["start"] - F.length(head)).alias("start"), m["before"].alias("before")
            ),
            trim,
        )

    def trim(m: Column) -> Column:
        found = F.regexp_replace(m["found"], r"^[(\[\"'<]+|[.,;:!?)\]\"'>]+$", "")
        lead = F.length(m["found"]) - F.length(F.regexp_replace(m["found"], r"^[(\[\"'<]+", ""))
        start = m["start"] + lead
        known = F.struct(
            # what is longer than 128 characters is judged by its beginning, and never like any kind
            F.left(found, F.lit(128)).alias("found"), start.alias("start"), (start + F.length(found)).alias("end"),
            F.length(digits_of(F.left(found, F.lit(128)))).alias("digits"), F.lower(F.right(m["before"], F.lit(32))).alias("near"),
        )
        return let(known, judge)

    def judge(m: Column) -> Column:
        found, start, end, digits, near = (m[c] for c in ("found", "start", "end", "digits", "near"))
        covered = F.exists(base, lambda b: (b["start"] < end) & (b["end"] > start))
        mail = (F.length(found) < 128) & found.rlike(r"^[^\s@]+@[^\s@]+$")
        phone = found.rlike(r"^\+?[(]?[0-9][0-9\x20().+/-]*[0-9]$") & digits.between(9, 15)
        card = found.rlike(r"^[0-9](?:[\x20-]?[0-9])*+$") & digits.between(13, 19)
        quad = found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
        right = card & passes_luhn(digits_of(found))
        vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
        votes = F.array(
            vote(covered, F.lit(False)),
            vote(mail | phone | card | quad, (digits <= 4) | found.rlike(r"[A-Za-z].*[0-9].*[A-Za-z]")),
            vote(mail & found.rlike(r"(?i)\.(?:" + "|".join(MAIL_ENDS) + r")$"), _any_word(found, NOT_PERSONAL) | found.rlike(r"(?:[$€£%]|[0-9](?:st|nd|rd|th)$)")),
            vote(_any_word(near, PERSONAL_CONTEXT), _any_word(near, NOT_PERSONAL)),
            vote(right, found.rlike(r"^(?:19|20)[0-9]{2}$") | (card & ~right)),
        )
        kind = F.when(mail, "email").when(quad, "ip").when(right, "card").when(phone, "phone").otherwise("other")
        features = F.array(
            F.least(digits, F.lit(20)),
            F.least(F.floor(F.length(found) / 4), F.lit(12)).cast("int"),
            F.when(found.contains("@"), 1).otherwise(0) + F.when(found.startswith("+"), 2).otherwise(0) + F.when(found.contains("="), 4).otherwise(0),
            F.when(found.rlike("[A-Za-z]"), 1).otherwise(0) + F.when(found.contains("."), 2).otherwise(0) + F.when(found.rlike(r"[\x20-]"), 4).otherwise(0),
            F.when(right, 1).when(card, 2).otherwise(0),
        )
        return F.struct(
            start.alias("start"), end.alias("end"), kind.alias("kind"), covered.alias("covered"), votes.alias("votes"), features.alias("features")
        )

    found = F.when(text.rlike("[0-9@]"), F.transform(located(text, CANDIDATE), widen))
    empty = "array<struct<start:bigint,end:bigint,kind:string,covered:boolean,votes:array<int>,features:array<int>>>"
    return F.coalesce(found.cast(empty), F.array().cast(empty))


# ---- the model: sums over small tables, on the driver -------------------------------


def _votes_key(votes: Column) -> Column:
    """The votes as one number in base 3."""
    return F.aggregate(votes, F.lit(0), lambda key, v: key * 3 + v + 1)


def _probability(features: Column, scores: dict[tuple[int, int], float], prior: float) -> Column:
    odds = F.lit(prior)
    for at in sorted({f for f, _ in scores}):
        table = {v: s for (f, v), s in scores.items() if f == at}
        line = F.array(*[F.lit(table.get(v, 0.0)) for v in range(max(table) + 1)])
        odds = odds + F.coalesce(F.get(line, F.get(features, F.lit(at))), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans of every row; a span is (kind, start, end, is_base, probability), positions in code points.

    Base spans (email, ip, card, phone) are always among them, with probability 1. A
    candidate that overlaps none of them is added if the classifier gives it
    ``threshold`` or more; its kind is one of the four or ``other``. A number that fails
    its checksum is never a card; the classifier sees that as a feature. Spans are sorted
    by kind in this order, then start. NULL and empty texts have none; rows that repeat
    are judged alike; other columns are ignored. Nothing is shuffled but two tables of
    counts (at most 243 and 60 rows); texts are read once and what was found in them
    is written to the shared folder.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"))
    rows = rows.select("doc_id", "_text", *[base_spans(F.col("_text"), k).alias(f"_{k}") for k in KINDS])
    rows = rows.select("doc_id", "_text", *[f"_{k}" for k in KINDS], F.concat(*[F.col(f"_{k}") for k in KINDS]).alias("_base"))
    seen = stored(
        rows.select("doc_id", *[f"_{k}" for k in KINDS], _candidates(F.col("_text"), F.col("_base")).alias("_more")), "personal"
    )
    each = seen.select(F.explode("_more").alias("c")).select("c.*")
    counts = each.groupBy("votes").count().collect()
    after = estimate({tuple(r["votes"]): r["count"] for r in counts}, start=any_objection, most_false_no=FALSE_NO)
    labels = F.array(*[F.lit(after.get(_unkey(k), 0.0)) for k in range(3 ** len(LABELERS))])
    known = each.select(F.get(labels, _votes_key(F.col("votes"))).alias("p"), F.posexplode("features").alias("f", "v"))
    table = known.groupBy("f", "v").agg(F.sum(F.round("p", 6).cast("decimal(20,6)")).alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    scores, prior = _naive_bayes([(r["f"], r["v"], float(r["yes"]), r["n"]) for r in table])
    chance = lambda c: _probability(c["features"], scores, prior)
    added = F.transform(
        F.filter(F.col("_more"), lambda c: ~c["covered"] & (c["end"] > c["start"]) & (chance(c) >= threshold)),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(False).alias("is_base"), chance(c).alias("probability")),
    )
    every = seen.select("doc_id", F.concat(*[_as_base(k) for k in KINDS], added).alias("_all"))
    ordered = [F.array_sort(of_kind(F.col("_all"), k)) for k in (*KINDS, "other")]
    return every.select("doc_id", F.concat(*ordered).alias("spans"))


def _as_base(kind: str) -> Column:
    return F.transform(
        f"_{kind}",
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("is_base"), F.lit(1.0).alias("probability")
        ),
    )


def of_kind(spans: Column, kind: str, base_only: bool = False) -> Column:
    return F.filter(spans, lambda s: (s["kind"] == kind) & (s["is_base"] | F.lit(not base_only)))


def _unkey(key: int) -> tuple[int, ...]:
    votes = []
    for _ in LABELERS:
        votes.append(key % 3 - 1)
        key //= 3
    return tuple(reversed(votes))


def _naive_bayes(table: list[tuple[int, int, float, int]]) -> tuple[dict[tuple[int, int], float], float]:
    """Log odds of every feature value, and of a candidate as such; without candidates nothing is ever added."""
    first = [(yes, n) for f, _, yes, n in table if f == 0]
    yes_all, n_all = sum(y for y, _ in first), sum(n for _, n in first)
    if not n_all:
        return {}, -30.0
    no_all = n_all - yes_all
    scores = {
        (f, v): math.log((yes + 0.5) / (yes_all + 1)) - math.log((n - yes + 0.5) / (no_all + 1)) for f, v, yes, n in table
    }
    return scores, math.log((yes_all + 0.5) / (no_all + 0.5))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap an earlier one are part of it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        ordered,
        start,
        lambda acc, s: F.when(
            s["s"] >= acc["at"],
            F.struct(
                F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, (s["s"] - acc["at"]).cast("int")), F.lit("<"), s["k"], F.lit(">")).alias("out"),
                s["e"].alias("at"),
            ),
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["e"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1)),
    )
    return F.when(text.isNotNull(), done)
