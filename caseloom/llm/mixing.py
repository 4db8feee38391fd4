"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import running_starts, stored, unit_hash

#: Documents of a source that are put in order together, on average.
BUCKET = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; NULL counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_weights(sources: DataFrame, weights: Sequence[float], parts: int = 16) -> DataFrame:
    """Add ``weight``: the given ones in turn over the sources in code point order, NULL last.

    Sources are sorted by range, so their number is not limited to what one task can hold.
    """
    name = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(parts, *name).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "sources")
    starts = running_starts(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")), "_part", "_rows", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*name)) - 1
    ranked = dealt.withColumn("_nth", inside).join(starts.select("_part", "_before"), "_part")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.get(turn, F.pmod(F.col("_before") + F.col("_nth"), F.lit(len(weights))).cast("int"))).drop(
        "_part", "_before", "_nth"
    )


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Add ``target`` to (weight, size): ``total`` shared by weight, none above ``cap`` times its size.

    A source whose share exceeds its cap is clamped there; what it leaves is shared
    among the others by weight, again and again until none exceeds its cap. Every
    round is one aggregate over the sources that returns two numbers, and clamps one
    source at least. If the caps together are below ``total``, all end at their caps.
    A source without words or without weight gets 0.
    """
    most = F.lit(float(cap)) * F.col("size")
    some = (F.col("weight") > 0) & (F.col("size") > 0)
    level = 0.0
    while True:
        held = some & (F.lit(level) * F.col("weight") >= most)
        fixed, free = sources.agg(F.sum(F.when(held, most)), F.sum(F.when(some & ~held, F.col("weight")))).first()
        if not free:
            break
        higher = (total - (fixed or 0.0)) / free
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.when(some, F.least(most, F.lit(level) * F.col("weight"))).otherwise(F.lit(0.0)))


def _measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """Every column of ``docs`` and its size, source and place in the random order."""
    return docs.withColumns(
        {
            "_mix_size": word_count(F.col(text)),
            "_mix_source": F.col(source).cast("string"),
            "_mix_u": unit_hash(seed, F.col(doc_id), F.xxhash64(F.col(text))),
            "_mix_id": F.col(doc_id),
        }
    )


def _planned(measured: DataFrame, sources: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Join the sources and find each document's place among those of its bucket."""
    name = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    plan = sources.select(
        name[0].alias("_mix_key"), name[1].alias("_mix_none"), F.col("size").alias("_mix_total"), F.col("target").alias("_mix_target"),
        F.ceil(F.col("documents") / BUCKET).alias("_mix_buckets"),
    )
    rows = measured.withColumns({"_mix_key": F.coalesce("_mix_source", F.lit("")), "_mix_none": F.col("_mix_source").isNull()})
    rows = rows.join(plan, ["_mix_key", "_mix_none"])
    rows = rows.withColumn("_mix_bucket", F.floor(F.col("_mix_u") * F.col("_mix_buckets")))
    if starts is None:
        return rows
    bucket = ["_mix_key", "_mix_none", "_mix_bucket"]
    order = Window.partitionBy(*bucket).orderBy("_mix_u", "_mix_id", "_mix_size")
    before = F.coalesce(F.sum("_mix_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_mix_inside", before).join(starts, bucket)
    whole = F.when(F.col("_mix_total") > 0, F.floor(F.col("_mix_target") / F.col("_mix_total"))).otherwise(F.lit(0))
    rest = F.round(F.col("_mix_target") - whole * F.col("_mix_total")).cast("long")
    left = rest - F.col("_mix_start") - F.col("_mix_inside")
    return rows.withColumns({"_mix_whole": whole, "_mix_left": left})


def _mix(docs, doc_id, text, source, weights, share, cap, seed, carried: bool) -> DataFrame:
    narrow = _measured(docs.select(doc_id, text, source), doc_id, text, source, seed)
    narrow = stored(narrow.select("_mix_id", "_mix_source", "_mix_size", "_mix_u"), "sizes")
    sources = narrow.groupBy(F.col("_mix_source").alias("source")).agg(
        F.sum("_mix_size").alias("size"), F.count(F.lit(1)).alias("documents")
    )
    sources = with_weights(sources, weights)
    total = sources.agg(F.sum("size")).first()[0] or 0
    sources = stored(water_fill(sources, share * total, cap), "targets")
    bucket = ["_mix_key", "_mix_none", "_mix_bucket"]
    sums = _planned(narrow, sources, None).groupBy(*bucket).agg(F.sum("_mix_size").alias("_mix_words"))
    place = Window.partitionBy("_mix_key", "_mix_none").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*bucket, F.coalesce(F.sum("_mix_words").over(place), F.lit(0)).alias("_mix_start"))
    return _planned(_measured(docs, doc_id, text, source, seed) if carried else narrow, sources, starts)


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken, copies.

    Sources (NULL is one of its own) share ``share`` times all words by weight, none
    more than ``cap`` times its own (:func:`water_fill`). With a target of e times its
    size a source's documents are all taken floor(e) times, and once more in a seeded
    random order until the target is reached; the document on the border is taken in
    part, so that ``taken`` (words, repeats counted) adds up to the rounded target.
    ``copies`` counts whole documents, the one on the border once more if half of it
    or more lies within.

    Documents are put in order within buckets of about 4,096 of a source, and bucket
    sums are added up, so a source of any size is spread. Empty and NULL texts have
    size 0 and take no words. Repeated rows are documents of their own. Other columns
    are ignored; an empty table gives an empty plan.
    """
    rows = _mix(docs, doc_id, text, source, weights, share, cap, seed, carried=False)
    return rows.select(
        F.col("_mix_id").alias("doc_id"),
        F.col("_mix_size").alias("size"),
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_whole") * F.col("_mix_size") + F.least(F.greatest("_mix_left", F.lit(0)), "_mix_size")).alias("taken"),
        _copies().cast("int").alias("copies"),
    )


def _copies() -> Column:
    return F.col("_mix_whole") + F.when(F.col("_mix_left") * 2 >= F.greatest("_mix_size", F.lit(1)), 1).otherwise(0)


def mix_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
) -> DataFrame:
    """The mixed rows of ``docs``, its columns unchanged: every document as often as :func:`mix_plan` has ``copies``.

    Texts move once, with their rows, to their bucket.
    """
    columns = docs.columns
    rows = _mix(docs, doc_id, text, source, weights, share, cap, seed, carried=True)
    repeats = F.explode(F.sequence(F.lit(1), _copies().cast("int"))).alias("_mix_copy")
    return rows.filter(_copies() > 0).select(*columns, repeats).drop("_mix_copy")
