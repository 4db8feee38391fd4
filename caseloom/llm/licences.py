"""Licence notices by a positional index of rare words.

Every template (a short notice) lists its words with their positions. For each document and
each template whose key words it has, the words of the template that are rarest in the
corpus (highest inverse document frequency) and stand in the document are looked up; their
positions less their positions in the template give the places where the notice could begin.
Places on which enough of the rare words agree are verified: the words of the mandatory key
phrases must stand exactly where the template has them, and the words in place must carry
enough of the template's weight.

SQL functions only. One scan of the texts; documents without the key words of any template,
nearly all of them, go no further than that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.operators.common import join_many_to_one

from .common import stored


@dataclass(frozen=True)
class Template:
    """A notice and the phrases in it that are mandatory, as lower-case words; ``base`` ones count whole, place by place."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


# Phrases whose places are counted, and their labels.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
)
#: Notices of common licences; any other list can be passed.
TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "creative commons attribution sharealike", ("creative commons", "sharealike")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("and or distribute this software",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("reserved", "copyright all rights reserved", ("all rights reserved",)),
    Template("unlicense", "free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Rare words looked up per file and template, the share of them that must agree on a place, and of the weight that must stand there.
LOOKUPS, AGREE, COVER = 4, 0.5, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is neither a digit, a lower-case letter nor beyond ASCII.
_BETWEEN = r"[\x00-/:-`{-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case, joined by single spaces."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(low, _BETWEEN, " "))


def _key_places(template: Template) -> set[int]:
    """Positions of the words of the key phrases within the template."""
    words, places = template.text.split(), set()
    for phrase in template.keys:
        part = phrase.split()
        at = next((i for i in range(len(words)) if words[i : i + len(part)] == part), None)
        if at is None:
            raise ValueError(f"{phrase!r} is not part of {template.text!r}")
        places.update(range(at, at + len(part)))
    return places


def _constants(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*rows)).alias("_x")).select("_x.*")


def word_index(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, word, place, is_key): the words of all templates with their positions."""
    rows = [
        F.struct(F.lit(t).alias("template"), F.lit(w).alias("word"), F.lit(q).alias("place"), F.lit(q in keys).alias("is_key"))
        for t, template in enumerate(templates)
        for keys in [_key_places(template)]
        for q, w in enumerate(template.text.split())
    ]
    return _constants(spark, rows)


def _read(docs: DataFrame, templates: tuple[Template, ...], doc_id: str, text: str) -> DataFrame:
    """_row, doc_id, n_words, the different licence words, and for candidates their templates and all their words."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    body = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), normal_words(F.col(text)).alias("_body"))
    words = F.split("_body", " ", -1)
    known = body.withColumn("known", F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary])))
    needs = F.array(
        *[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(t.text.split()[q]) for q in sorted(_key_places(t))]).alias("need")) for i, t in enumerate(templates)]
    )
    possible = F.transform(F.filter(needs, lambda t: F.size(F.array_except(t["need"], "known")) == 0), lambda t: t["i"])
    found = known.withColumn("templates", F.when(F.size("known") > 0, possible).otherwise(F.array().cast("array<int>")))
    count = F.when(F.col("_body") == "", F.lit(0)).otherwise(F.length("_body") - F.length(F.replace(F.col("_body"), F.lit(" "), F.lit(""))) + 1)
    return found.select("_row", "doc_id", count.cast("long").alias("n_words"), "known", "templates", F.when(F.size("templates") > 0, F.col("_body")).alias("_body"))


def find_places(read: DataFrame, templates: tuple[Template, ...], lookups: int = LOOKUPS, agree: float = AGREE, cover: float = COVER) -> DataFrame:
    """(_row, template, place, share): the places in the documents of :func:`_read` where a template stands."""
    spark = read.sparkSession
    index = word_index(spark, templates)
    frequency = read.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    n = read.count()
    # one row for every template word: small, whatever the corpus
    idf = 1 + F.log((1 + F.lit(n)) / (1 + F.coalesce("_df", F.lit(0))))
    rows = stored(index.join(frequency, "word", "left").select("template", "word", "place", "is_key", idf.alias("idf")), "licence-words")
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("idf")).alias("i"), F.col("word").alias("w"))))
    heads = rows.groupBy("template").agg(
        F.transform(ranked, lambda x: x["w"]).alias("_rarest"), F.sum("idf").alias("_mass"), F.sum(F.col("is_key").cast("int")).alias("_keys")
    )
    asked = read.filter("_body is not null").select("_row", "known", "_body", F.explode("templates").alias("template"))
    asked = join_many_to_one(asked, heads, ["template"])
    asked = asked.withColumn("_looked", F.slice(F.array_intersect("_rarest", "known"), 1, lookups))
    words = asked.select("_row", "template", "_looked", "_mass", "_keys", F.posexplode(F.split("_body", " ", -1)).alias("_at", "word"))
    hits = join_many_to_one(words, rows, ["template", "word"]).withColumn("place", (F.col("_at") - F.col("place")).cast("long"))
    rare = F.array_contains("_looked", F.col("word"))
    places = hits.groupBy("_row", "template", "place").agg(
        F.size(F.collect_set(F.when(rare, F.col("word")))).alias("_agreed"),
        F.first(F.size("_looked")).alias("_asked"),
        F.sum(F.col("is_key").cast("int")).alias("_verified"),
        F.first("_keys").alias("_keys"),
        (F.sum("idf") / F.first("_mass")).alias("share"),
    )
    # places where no rare word stands were never looked up
    kept = (F.col("_agreed") >= F.greatest(F.lit(1), F.ceil(F.col("_asked") * agree))) & (F.col("_verified") == F.col("_keys"))
    return places.filter(kept & (F.col("share") >= cover - 1e-9)).select("_row", "template", "place", F.least(F.lit(1.0), "share").alias("share"))


def scan_licences(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: tuple[Template, ...] = BASE,
    lookups: int = LOOKUPS, agree: float = AGREE, cover: float = COVER,
) -> DataFrame:
    """Licence notices in every document, one row each.

    doc_id, n_words, n_base (places where a base phrase stands), first_word and last_word
    (the smallest and largest of these, from 0), base_labels and labels (different ones,
    sorted, joined by commas; ``labels`` has those of the templates too) and score: the
    largest share of a template's weight that stands in place, 1 for a base phrase, 0
    without a notice.

    Inverse document frequencies are counted over all rows, repeated ones included. A NULL
    text is empty; a document without a notice has NULL places, empty labels and score 0.
    Notices repeated in a document count at each place; ties of rarity go to the lower
    word. An empty table gives an empty one. Other columns are ignored.
    """
    every = (*base, *templates)
    read = stored(_read(docs, every, doc_id, text), "licences")
    found = find_places(read, every, lookups, agree, cover)
    names = F.array(*[F.lit(t.label) for t in every])
    is_base = F.col("template") < len(base)
    label = F.element_at(names, F.col("template") + 1)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    sums = found.groupBy("_row").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("place"))).alias("first_word"),
        F.max(F.when(is_base, F.col("place"))).alias("last_word"),
        joined(F.when(is_base, label)).alias("base_labels"),
        joined(label).alias("labels"),
        F.round(F.max(F.when(is_base, 1.0).otherwise(F.col("share"))), 6).alias("score"),
    )
    rows = read.select("_row", "doc_id", "n_words").join(sums, "_row", "left")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    columns = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.select("doc_id", "n_words", *[(F.coalesce(c, empty[c]) if c in empty else F.col(c)).alias(c) for c in columns])
