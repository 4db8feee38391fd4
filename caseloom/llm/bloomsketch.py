"""Fingerprints of documents as invertible Bloom lookup sketches of their paragraphs.

A sketch deals the digest of every paragraph to one cell in each of three rows; a cell
holds how many digests it got, their exclusive or, and the exclusive or of their check
hashes. Sketches of two versions subtract cell by cell: what both have cancels out.
From the difference the digests that only one has are peeled: a cell with a single
digest gives it away, and taking that out of its other cells lays open more. Where this
gets stuck, both versions are sketched again with four times the cells.

Cells are rows of a table, and all steps are aggregates by (document, cell). Documents
are dealt to tasks once; from then on no step needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import range_bounds, range_number, stored

#: Ends of paragraphs: line ends, and in long lines ends of sentences before a word that begins with A to E.
PARAGRAPH = r"\s*[\r\n]\s*|(?<=[.!?]) +(?=[A-EÀ-Ë])"
#: Cells for every digest of the two versions at first, and how often a failure is retried, four times larger each.
CELLS, RETRIES = 2.0, 3
_ROUNDS = 15
_SIGNED = "array<struct<n:int,k:bigint>>"


def digests(text: Column) -> Column:
    """Digests of the different paragraphs of a text, in order; blank ones are none."""
    parts = F.filter(F.split(text, PARAGRAPH, -1), lambda p: F.length(F.trim(p)) > 0)
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def signed(keys: Column, n: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(n).alias("n"), k.alias("k"))).cast(_SIGNED)


def _width(size: Column, factor: float) -> Column:
    """Cells in each of the three rows, a power of two: 8 at least."""
    return F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(3), F.ceil(F.log2(F.greatest(size, F.lit(1)) * factor / 3)).cast("int")))


def _places(check: Column, width: Column) -> Column:
    """The cell in each row: every row reads other bits of the check hash."""
    one = lambda r: F.call_function("shiftrightunsigned", check, F.lit(21 * r)).bitwiseAND((width - 1).cast("long")) + width * r
    return F.array(*[one(r) for r in range(3)])


def sketches(rows: DataFrame, keys: str, by: list[str], factor: float = CELLS) -> DataFrame:
    """Cells (*by, width, cell, n, k, c) of the signed digests of every row; empty cells are left out.

    Digests of sign -1 are subtracted, so both versions in one list give the difference of their sketches.
    """
    each = rows.select(*by, _width(F.size(keys), factor).alias("width"), F.explode(keys).alias("_x"))
    each = each.select(*by, "width", "_x.*", F.xxhash64("_x.k", F.lit(1)).alias("c"))
    return _gathered(each.select(*by, "width", "n", "k", "c", F.explode(_places(F.col("c"), F.col("width"))).alias("cell")), by)


def _gathered(cells: DataFrame, by: list[str]) -> DataFrame:
    whole = cells.groupBy(*by, "width", "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return whole.filter("n <> 0 or k <> 0 or c <> 0")


def peeled(cells: DataFrame, by: list[str]) -> DataFrame:
    """Digests (*by, n, k) told from the cells of differences, and a row with a NULL ``k`` for each cell left over.

    The rows of cells take turns: in one row a digest has one cell, so it is taken out
    once. What is found travels on as a cell of its own, numbered below zero.
    """
    mark = F.lit(-1).cast("long")
    rest = cells.withColumn("cell", F.col("cell").cast("long")).withColumn("found", F.lit(0).cast("long"))
    for turn in range(_ROUNDS):
        here = (F.col("cell") >= 0) & (F.floor(F.col("cell") / F.col("width")) == turn % 3)
        single = here & (F.abs("n") == 1) & (F.xxhash64("k", F.lit(1)) == F.col("c"))
        cell = lambda at, n, found: F.struct(at.cast("long").alias("cell"), n.cast("int").alias("n"), F.col("k"), F.col("c"), found.alias("found"))
        own = cell(F.col("cell"), F.col("n"), F.col("found"))
        places = _places(F.col("c"), F.col("width"))
        # itself goes as well: it is one of its digest's three cells
        out = F.array(own, *[cell(F.get(places, F.lit(r)), -F.col("n"), F.lit(0).cast("long")) for r in range(3)], cell(mark, F.col("n"), F.col("k")))
        moved = rest.select(*by, "width", F.explode(F.when(single, out).otherwise(F.array(own))).alias("_x")).select(*by, "width", "_x.*")
        rest = (
            moved.groupBy(*by, "width", "cell", "found")
            .agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
            .filter("n <> 0 or k <> 0 or c <> 0")
        )
    return rest.select(*by, "n", F.when(F.col("cell") < 0, F.col("found")).alias("k"))


def differing(pairs: DataFrame, by: list[str], one: str, other: str) -> DataFrame:
    """Digests that only one of two lists has: (*by, n, k), n being 1 for ``one`` and -1 for ``other``.

    ``by`` identifies a pair. Pairs that cannot be peeled are retried with larger sketches;
    what is left after the last one (digests of equal check hash) is told from the lists.
    """
    done, left = None, pairs.withColumn("_keys", F.concat(signed(F.col(one), 1), signed(F.col(other), -1)))
    for turn in range(RETRIES + 1):
        dealt = left.repartition(by[0])
        found = stored(peeled(sketches(dealt, "_keys", by, CELLS * 4**turn), by), "peeled")
        failed = found.filter("k is null").select(*by).distinct()
        good = found.join(failed, by, "left_anti")
        done = good if done is None else done.unionByName(good)
        left = left.join(failed, by, "left_semi")
        if failed.isEmpty():
            return done
    only = F.concat(signed(F.array_except(one, other), 1), signed(F.array_except(other, one), -1))
    return done.unionByName(left.select(*by, F.explode(only).alias("_x")).select(*by, "_x.*"))


def named(rows: DataFrame, keys: str, by: list[str]) -> DataFrame:
    """(*by, fingerprint): number of paragraphs and a SHA-256 over the cells of the sketch."""
    cells = sketches(rows, keys, by)
    line = F.concat_ws(",", F.col("cell"), F.col("n"), F.col("k"), F.col("c"))
    whole = cells.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";"), 256).alias("_sum"))
    return whole.select(*by, "_sum")


def with_next(docs: DataFrame, doc_id: str, text: str, make: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, ``made`` of it, and both of the next row in ascending order (id, then text; NULL ids first).

    After the last row comes the first one. Rows are dealt to ranges of ids, and the
    first row of each range stands at the end of the range before as well.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_range", range_number(range_bounds(docs, doc_id), F.col("_id")))
    first = stored(rows.groupBy("_range").agg(F.min(F.struct("_id", "_text")).alias("_first")), "firsts")
    ranges = Window.orderBy("_range")
    last = F.max("_range").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = first.select(F.coalesce(F.lag("_range").over(ranges), last).alias("_range"), "_first._id", "_first._text")
    both = rows.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    both = both.withColumn("_made", make(F.col("_text")))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_id").asc_nulls_first(), "_text")
    both = both.withColumns({"_next_text": F.lead("_text").over(order), "_next_made": F.lead("_made").over(order)})
    return both.filter("_guest = 0").select(F.col("_id").alias("doc_id"), "_text", "_made", "_next_text", "_next_made")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of an edited version of it, and how alike they and the next document are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and added, removed: the digests that only the edited text, or only the document, has.
    Likeness is the share of common paragraphs, common over all, from the number of
    paragraphs and the peeled difference. The edited text is the document with its last
    half (rounded down) replaced by as many characters from the start of the next
    document, or by all of it.

    A NULL text is empty; a document without paragraphs is like any other such one (1)
    and unlike the rest (0); an only document is its own next one. Repeated rows follow
    each other. Other columns are ignored.
    """
    rows = with_next(docs, doc_id, text, digests)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), n - half), F.substr("_next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), F.col("_made").alias("_own"), F.col("_next_made").alias("_next"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        "_own", digests(F.col("_edited")).alias("_new"), "_next",
    )
    rows = stored(rows, "paragraphs")
    versions = rows.repartition("_row").select("_row", F.posexplode(F.array(signed(F.col("_own"), 1), signed(F.col("_new"), 1))).alias("_side", "_keys"))
    sums = named(versions, "_keys", ["_row", "_side"]).groupBy("_row").agg(
        *[F.max(F.when(F.col("_side") == i, F.col("_sum"))).alias(name) for i, name in enumerate(("_fp", "_fe"))]
    )
    pairs = rows.select("_row", F.posexplode(F.array("_new", "_next")).alias("_side", "_other"), "_own")
    change = differing(pairs, ["_row", "_side"], "_other", "_own")
    edits = F.col("_side") == 0
    change = change.groupBy("_row").agg(
        F.count(F.when(edits, 1)).alias("_de"),
        F.count(F.when(~edits, 1)).alias("_dn"),
        F.sort_array(F.collect_list(F.when(edits & (F.col("n") > 0), F.col("k")))).alias("added"),
        F.sort_array(F.collect_list(F.when(edits & (F.col("n") < 0), F.col("k")))).alias("removed"),
    )
    found = rows.join(sums, "_row", "left").join(change, "_row", "left")

    def like(other: str, differ: str) -> Column:
        total, d = F.size("_own") + F.size(other), F.coalesce(differ, F.lit(0))
        return F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d))

    name = lambda keys, column: F.concat_ws("-", F.size(keys), F.coalesce(column, F.sha2(F.lit("").cast("binary"), 256)))
    empty = F.array().cast("array<bigint>")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        name("_own", "_fp").alias("fingerprint"),
        name("_new", "_fe").alias("edited_fingerprint"),
        like("_new", "_de").alias("near_edited"),
        like("_next", "_dn").alias("near_next"),
        F.coalesce("added", empty).alias("added"),
        F.coalesce("removed", empty).alias("removed"),
    )
