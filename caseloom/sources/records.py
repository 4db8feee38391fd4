"""Records of CSV files of any size: one file is cut into blocks that many tasks read.

Whether a line feed ends a record depends on all quotes before it in the file. What a
line does to that state (inside or outside of a quoted field) is a function of two
values, told from the line alone by two patterns; such functions can be composed in any
grouping. So each block composes its own lines for both states it may begin in, one
row per block gives the state every block does begin in, and only then are lines
joined to records. The files are scanned once; what was read is written to the shared
folder, so all later steps see the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..operators.common import join_many_to_one
from ..session import scratch_path, settled

# a quoted text without its closing quote; a field that ends before the next comma
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:[ \t]*+"{_QUOTED}"[^,]*+|(?![ \t]*+")[^,]*+)'
_OPENED = rf'[ \t]*+"{_QUOTED}\z'
#: Lines that end inside of a quoted field, if they begin outside of one, and if inside.
OPENS = rf"\A(?:{_FIELD},)*+{_OPENED}"
STAYS = rf'\A{_QUOTED}(?:\z|"[^,]*+(?:,{_FIELD})*+,{_OPENED})'

_HEAD, _ALL = Window.unboundedPreceding, Window.currentRow


def _states(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """Adds ``from0`` and ``from1``: is the state before a row inside, if the stretch begins outside, or inside.

    ``to0`` and ``to1`` are what a row makes of either state. After the last row that
    leads to one state from both, only the number of rows that swap them counts.
    """
    before = order.rowsBetween(_HEAD, -1)
    fixed, swap = F.col("to0") == F.col("to1"), F.col("to0") & ~F.col("to1")
    rows = rows.withColumn("_swaps", F.coalesce(F.sum(swap.cast("int")).over(before), F.lit(0)))
    rows = rows.withColumns({
        "_at": F.last(F.when(fixed, F.col("_swaps")), ignorenulls=True).over(before),
        "_level": F.last(F.when(fixed, F.col("to0")), ignorenulls=True).over(before),
    })
    odd = (F.col("_swaps") - F.coalesce("_at", F.lit(0))) % 2 == 1
    state = lambda start: F.coalesce("_level", F.lit(start)) != odd
    return rows.withColumns({"from0": state(False), "from1": state(True)}).drop("_swaps", "_at", "_level")


def _after(inside: Column | str) -> Column:
    return F.when(inside if isinstance(inside, Column) else F.col(inside), F.col("to1")).otherwise(F.col("to0"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of records by (file, block, n): for both states of the block's start where they begin, and their states.

    ``from`` and ``out`` are the states before and after a piece, ``start`` the number of
    the line where its record begins (NULL: in a block before).
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
        F.make_valid_utf8("value").alias("_line"),
    )
    # a carriage return ends a line as well; it stays with the line, as does the line feed
    whole = F.concat("_line", F.lit("\n"))
    cut = F.when(F.contains("_line", F.lit("\r")), F.regexp_extract_all(whole, F.lit(r"[^\r\n]*+(?:\r\n|\r|\n)"), F.lit(0)))
    raw = raw.select("file", "block", "_id", F.posexplode(F.coalesce(cut, F.array(whole))).alias("_pos", "text"))
    order = Window.partitionBy("file", "block").orderBy("_id", "_pos")
    lines = raw.withColumn("n", F.row_number().over(order))
    first = (F.col("block") == 0) & (F.col("n") == 1)
    lines = lines.withColumn("text", F.when(first, F.ltrim("text", F.lit("﻿"))).otherwise(F.col("text")))
    lines = lines.withColumns({"to0": F.rlike("text", F.lit(OPENS)), "to1": F.rlike("text", F.lit(STAYS))})
    lines = _states(lines, order)
    start = lambda state: F.max(F.when(~F.col(state), F.col("n"))).over(order.rowsBetween(_HEAD, _ALL))
    lines = lines.withColumns({"start0": start("from0"), "start1": start("from1"), "out0": _after("from0"), "out1": _after("from1")})
    # a record that begins at the same line whatever the state at the block's start can be joined here, without a shuffle
    sure = F.when(F.col("start0") == F.col("start1"), F.col("start0")).otherwise(-F.col("n"))
    pieces = lines.groupBy("file", "block", sure.alias("_piece")).agg(
        F.sort_array(F.collect_list(F.struct("n", "text"))).alias("_lines"),
        F.min("n").alias("n"),
        F.min_by(F.struct("from0", "from1"), "n").alias("_from"),
        F.max_by(F.struct("out0", "out1"), "n").alias("_out"),
        F.max("start0").alias("start0"),
        F.max("start1").alias("start1"),
    )
    text = F.array_join(F.transform("_lines", lambda p: p["text"]), "")
    pieces = pieces.select("file", "block", "n", text.alias("text"), "_from.*", "_out.*", "start0", "start1")
    return pieces.withColumn("blank", F.trim("text", F.lit(" \t\r\n")) == "")


def _block_starts(pieces: DataFrame) -> DataFrame:
    """For every block whether it begins inside of a field, and of which record (home, key): one row per block."""
    blocks = pieces.groupBy("file", "block").agg(
        F.max_by(F.struct(F.col("out0").alias("to0"), F.col("out1").alias("to1")), "n").alias("_end"),
        F.max("start0").alias("_last0"),
        F.max("start1").alias("_last1"),
    )
    order = Window.partitionBy("file").orderBy("block")
    blocks = _states(blocks.select("file", "block", "_end.*", "_last0", "_last1"), order)
    last = F.when(F.col("from0"), F.col("_last1")).otherwise(F.col("_last0"))
    here = F.when(last.isNotNull(), F.struct(F.col("block").alias("home"), last.alias("key")))
    owner = F.last(here, ignorenulls=True).over(order.rowsBetween(_HEAD, -1))
    return blocks.select("file", "block", F.col("from0").alias("_inside"), owner.alias("_owner"))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """All text of the files as pieces of records, stored once: (file, _at, block, n, text, _in, _out, blank).

    ``_at`` (home, key) is the record, ``_in`` and ``_out`` tell whether a piece begins
    and ends inside of a field. Most pieces are whole records; others stand at block borders.
    """
    place = scratch_path(spark, "release-pieces")
    fresh = _pieces(spark, path)
    fresh.write.option("compression", "zstd").parquet(place)
    pieces = spark.read.schema(fresh.schema).parquet(place)
    blocks = settled(_block_starts(pieces), "release-blocks")
    pick = lambda name: F.when(F.col("_inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    here = F.when(pick("start").isNotNull(), F.struct(F.col("block").alias("home"), pick("start").alias("key")))
    return join_many_to_one(pieces, blocks, ["file", "block"]).select(
        "file", F.coalesce(here, "_owner").alias("_at"), "block", "n", "text", pick("from").alias("_in"), pick("out").alias("_out"), "blank"
    )


def records_of(pieces: DataFrame) -> DataFrame:
    """``file``, ``ordinal``, ``record`` of :func:`read_pieces`, without blank records; only pieces at borders are shuffled."""
    alone = pieces.filter(~F.col("_in") & ~F.col("_out") & ~F.col("blank")).select("file", "_at", "text")
    parts = F.sort_array(F.collect_list(F.struct("block", "n", "text")))
    several = pieces.filter(F.col("_in") | F.col("_out")).groupBy("file", "_at").agg(parts.alias("_parts"))
    joined = several.select("file", "_at", F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))
    # a line takes a byte at least, so this grows across blocks as well
    ordinal = F.when(F.col("_at.home") > 0, F.col("_at.home")).otherwise(-1) + F.col("_at.key")
    return alone.unionByName(joined).select("file", ordinal.alias("ordinal"), F.rtrim("text", F.lit("\r\n")).alias("record"))


def first_records(pieces: DataFrame) -> DataFrame:
    """The first record of every file that has one, like :func:`records_of`; other texts are not read."""
    starts = pieces.filter(~F.col("_in") & (F.col("_out") | ~F.col("blank"))).groupBy("file").agg(F.min("_at").alias("_at"))
    return records_of(join_many_to_one(pieces, settled(starts, "release-starts"), ["file", "_at"]))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below a path: ``file``, ``ordinal`` (grows with the place in the file), ``record``.

    A record is a text as it stands in the file, without its line end; blank ones are
    left out. A byte order mark is removed, bytes that are not UTF-8 become replacement
    characters. Line feed, carriage return or both end a record outside of quotes; a
    quote counts only where a field begins with one. A quote that is never closed makes
    the rest of its file one record. Lines are shuffled once, by block. A compressed
    file is one block.
    """
    return records_of(read_pieces(spark, path))
