"""Entities from a dictionary table of any size, by a join on word n-grams.

The patterns of :func:`~.texts.entity_array` name every term in the plan; here terms are rows.
Texts are cut into words, every run of words that is as long as some term is looked up, and
what is found is narrowed to the hits a pattern with the longest terms first would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from .texts import ENTITY_SOURCE, TERM_CONFIDENCE, entity_array

_WORD = r"(?U)\w+"
#: A word with what follows it up to the next one.
_STEP = r"(?U)\w+\W*"


def _fold(text: Column) -> Column:
    """What case-insensitive patterns take for equal, apart from letters that grow."""
    return F.lower(F.upper(text))


def dictionary_rows(terms: DataFrame) -> DataFrame:
    """(entity_type, folded, chars, words) of a dictionary table (entity_type, term), each once.

    A term must begin and end with a word character: between other characters there is no
    word border to find it by. NULL and empty terms match nothing.
    """
    term = F.col("term")
    return (
        terms.filter(term.rlike(r"(?sU)^\w(.*\w)?\z"))
        .select(
            "entity_type",
            _fold(term).alias("folded"),
            F.char_length(term).alias("chars"),
            F.size(F.regexp_extract_all(term, F.lit(_WORD), F.lit(0))).alias("words"),
        )
        .distinct()
    )


def _runs(text: Column, lengths: list[int], longest: int) -> Column:
    """Array of (pos, words, name): the runs of words of the given lengths, by their first word's number."""

    def of(words: Column, steps: Column) -> Column:
        def run(i: Column, n: int) -> Column:
            last = F.get(words, i + (n - 1))
            name = last if n == 1 else F.concat(F.array_join(F.slice(steps, i + 1, n - 1), ""), last)
            return F.struct(i.alias("pos"), F.lit(n).alias("words"), name.alias("name"))

        every = F.sequence(F.lit(0), F.size(words) - 1)
        runs = F.flatten(F.transform(every, lambda i: F.array(*[run(i, n) for n in lengths])))
        # a run past the last word is NULL
        kept = F.filter(runs, lambda r: F.char_length(r["name"]) <= longest)
        return F.when(F.size(words) > 0, kept)

    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    steps = F.regexp_extract_all(text, F.lit(_STEP), F.lit(0))
    return let(words, lambda w: let(steps, lambda s: of(w, s)))


def _looked_up(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs (name and more) that are a term, with its entity_type, by their folded text.

    The dictionary is unique on it, so frequent words pile up on the other side, which is
    the one that adaptive execution splits, and a small dictionary needs no shuffle at all.
    """
    # one row a term, however many types it has
    grouped = known.groupBy("folded", "chars").agg(F.collect_set("entity_type").alias("types"))
    found = runs.join(grouped, (_fold(F.col("name")) == F.col("folded")) & (F.char_length("name") == F.col("chars")))
    return found.select(*runs.columns, F.explode("types").alias("entity_type"))


def _sizes(known: DataFrame) -> tuple[list[int], int]:
    """The different word counts of terms and the greatest length; nothing else reaches the driver."""
    row = known.agg(F.sort_array(F.collect_set("words")).alias("lengths"), F.max("chars").alias("longest")).first()
    return row["lengths"], row["longest"] or 0


def _hits(df: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    lengths, longest = _sizes(known)
    # the digest is taken once a text, not again for every run; outer, because a filter on the list would list it twice
    listed = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("digest"), _runs(F.col(text), lengths or [1], longest).alias("_runs"))
    runs = listed.select("_key", "digest", F.inline_outer("_runs")).filter("name is not null")
    return _looked_up(runs, known).select("_key", "digest", "entity_type", "pos", "words", "name")


def term_hits(df: DataFrame, terms: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """Every place where a term stands: (key, digest, entity_type, pos, words, name), overlaps included.

    ``digest`` tells texts of one key apart. Runs of words are joined by their folded text.
    """
    return _hits(df, dictionary_rows(terms), key, text)


def _first_words(df: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, entity_type, low, pos, name) of the one-word terms: each surface form of a text once.

    Words never overlap, so a text's words come down to the different ones, in the order in
    which they first stand, before anything is joined or shuffled.
    """
    _, longest = _sizes(known)
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0)))
    listed = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("digest"), words.alias("_words"))
    forms = listed.select("_key", "digest", F.posexplode_outer("_words").alias("pos", "name"))
    found = _looked_up(forms.filter(F.char_length("name") <= longest), known)
    return found.select("_key", "digest", "entity_type", F.lower("name").alias("low"), "pos", "name")


def _chosen(cluster: Column) -> Column:
    """Left to right, what does not overlap the hit taken before: (low, pos, name), the first of each low."""

    def step(acc: Column, hit: Column) -> Column:
        low = F.lower(hit["name"])
        free = hit["pos"] >= acc["end"]
        fresh = free & ~F.exists(acc["kept"], lambda k: k["low"] == low)
        row = F.struct(low.alias("low"), hit["pos"].alias("pos"), hit["name"].alias("name"))
        return F.struct(
            F.when(free, hit["pos"] + hit["words"]).otherwise(acc["end"]).alias("end"),
            F.when(fresh, F.concat(acc["kept"], F.array(row))).otherwise(acc["kept"]).alias("kept"),
        )

    empty = F.expr("cast(array() as array<struct<low: string, pos: int, name: string>>)")
    start = F.struct(F.lit(0).alias("end"), empty.alias("kept"))
    return F.aggregate(cluster, start, step, lambda acc: acc["kept"])


def extract_terms(df: DataFrame, terms: DataFrame, key: str = "record_id", text: str = "text") -> DataFrame:
    """(key, name, entity_type, confidence, source) of every distinct hit of a dictionary table, and the dates.

    ``terms`` is (entity_type, term). As with patterns, hits stand between word borders, case
    does not matter, hits of one type do not overlap: the leftmost counts, of those the
    longest; the first surface form of a text is the name. Rows that repeat key and text
    give their hits once; a NULL or empty text gives none; other columns are not read.
    """
    known = dictionary_rows(terms)
    # only a term of several words can overlap another of its type
    several = known.groupBy("entity_type").agg(F.max("words").alias("_most")).filter("_most > 1").select("entity_type")
    group = ["_key", "digest", "entity_type"]
    kept = _first_words(df, known.join(several, "entity_type", "left_anti"), key, text)
    if not several.isEmpty():
        settled = _settled_hits(_hits(df, known.join(several, "entity_type", "left_semi"), key, text))
        kept = kept.unionByName(settled)
    names = kept.groupBy(*group, "low").agg(F.min_by("name", "pos").alias("name"))
    found = names.select(
        F.col("_key").alias(key),
        "name",
        "entity_type",
        F.lit(TERM_CONFIDENCE).alias("confidence"),
        F.lit(ENTITY_SOURCE).alias("source"),
    )
    dated = F.explode(entity_array(F.col(text), {})).alias("e")
    dates = df.select(key, F.xxhash64(text).alias("digest"), dated).distinct()
    return found.unionByName(
        dates.select(key, "e.name", "e.entity_type", "e.confidence", F.lit(ENTITY_SOURCE).alias("source"))
    )


def _settled_hits(hits: DataFrame) -> DataFrame:
    """(key, digest, entity_type, low, pos, name): of hits that overlap those a pattern would take."""
    group = ["_key", "digest", "entity_type"]
    # partial aggregates fold repeated rows before anything is shuffled by text
    widest = hits.groupBy(*group, "pos").agg(F.max(F.struct("words", "name")).alias("w"))
    before = Window.partitionBy(*group).orderBy("pos")
    reached = F.max(F.col("pos") + F.col("w.words")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = widest.withColumn("opens", F.coalesce(F.col("pos") >= reached, F.lit(True)).cast("int"))
    clustered = opened.withColumn("cluster", F.sum("opens").over(before))
    # overlapping hits are settled cluster by cluster, a hit alone is a cluster of its own
    members = F.sort_array(F.collect_list(F.struct("pos", "w.words", "w.name")))
    return clustered.groupBy(*group, "cluster").agg(members.alias("m")).select(*group, F.inline(_chosen(F.col("m"))))
