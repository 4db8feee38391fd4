"""Building blocks that keep hot keys apart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def join_many_to_one(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that may pile up on few keys with one that is unique on them.

    ``how`` is inner, left, left_semi or left_anti, ``many`` being the left side. It is
    then the side whose large partitions adaptive execution splits at run time, by their
    measured size, also where that costs another shuffle (see the session settings).
    NULL keys match nothing.
    """
    return many.join(one, list(keys), how)


def join_one_to_many(one: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join whose right side may pile up on few keys: the matches, then the unmatched rows.

    The right side of a left join is never split; as an inner join and an anti join with
    the distinct keys it can be, whatever its size.
    """
    keys = list(keys)
    matched = join_many_to_one(many, one, keys)
    present = many.select(*keys).distinct()
    return matched.unionByName(one.join(present, keys, "left_anti"), allowMissingColumns=True)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of every key.

    Spark limits each group before the shuffle (WindowGroupLimit), so a hot key
    sends ``n`` rows per task, not the whole group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_rows(df, keys, order, 1)


def joined_text(
    df: DataFrame, keys: Sequence[str], seq: str, text: str, out: str, sep: str = "", span: int = 1024
) -> DataFrame:
    """Concatenate ``text`` in ``seq`` order into numbered parts.

    Part p covers the positions [p*span, (p+1)*span), so no task ever gathers more
    than ``span`` rows of one key; the parts in order, joined by ``sep``, are the
    whole text. ``seq`` must be an integer unique within the key.
    """
    part = F.floor(F.col(seq) / F.lit(span)).cast("long").alias("part")
    pieces = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return (
        df.select(*keys, part, seq, text)
        .groupBy(*keys, "part")
        .agg(pieces.alias("_p"))
        .select(*keys, "part", F.array_join(F.transform("_p", lambda x: x["t"]), sep).alias(out))
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def derived_id(kind: str, *cols: Column | str) -> Column:
    """Repeatable identifier from natural keys: SHA-256 of their texts, separated by bars.

    Bars and backslashes in a text are escaped, NULL is a backslash and an N; so different
    keys never give the same text.
    """
    slash, bar = F.lit("\\"), F.lit("|")

    def part(c: Column | str) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        escaped = F.replace(F.replace(text, slash, F.lit("\\\\")), bar, F.lit("\\|"))
        return F.coalesce(escaped, F.lit("\\N"))

    return F.sha2(F.concat_ws("|", F.lit(kind), *[part(c) for c in cols]), 256)
