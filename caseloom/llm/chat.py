"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

Legal sequences: an optional system turn, then user and assistant in alternation, the
user first. The automaton that accepts them has the states below. Every given turn is
kept as its role, relabelled, or merged into the turn before; empty turns may be
inserted before it. Each choice has a cost, and the cheapest path from start to end is
a shortest path; its step costs form a small matrix per turn, and matrices of
consecutive turns combine (min-plus product) in any grouping. So a conversation is cut
into segments: each segment gives one matrix, the matrices of a conversation are
chained to find the states at the cuts, and each segment then traces its own path. A
conversation of any length is spread over as many tasks as it has segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next roles by state.
NEXT = {START: ("system", "user"), SYSTEM: ("user",), USER: ("assistant",), ASSISTANT: ("user",)}
AFTER = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: Names that stand for a role, lower case.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
SEGMENT = 256
_FAR = 1e18


@dataclass(frozen=True)
class Costs:
    """Cost of merging a turn, of another role (less if it had none, more for system), and of an empty turn before it."""

    merge: float = 1.0
    relabel: float = 3.0
    unknown: float = 0.5
    system: float = 0.25
    insert: float = 2.0


def _fills() -> dict[tuple[int, str], tuple[str, ...]]:
    """Shortest rows of empty turns that make a role legal in a state."""
    found = {}
    for state in range(4):
        for role in ROLES:
            queue = [((), state)]
            for fill, at in queue:
                if role in NEXT[at]:
                    found[state, role] = fill
                    break
                if len(fill) < 2:
                    queue += [((*fill, r), AFTER[r]) for r in NEXT[at] if r != "system"]
    return found


FILLS = _fills()


def _choices(role: str | None, costs: Costs) -> list[tuple[int, int, float, str, str]]:
    """(state before, state after, cost, action, role) of every way to take a turn."""
    out = []
    known = role in ROLES
    for state in range(4):
        if state != START:
            same = role == ROLES[state - 1]
            out.append((state, state, costs.merge + (0.0 if same else costs.relabel if known else costs.unknown), "merge", ROLES[state - 1]))
        for target in ROLES:
            fill = FILLS.get((state, target))
            if fill is not None:
                change = 0.0 if target == role else costs.relabel if known else costs.unknown
                change += costs.system if target == "system" != role else 0.0
                out.append((state, AFTER[target], change + costs.insert * len(fill), "keep" if target == role else "relabel", target))
    return out


def _tables(costs: Costs) -> dict[str | None, tuple[np.ndarray, dict]]:
    """For every role (None: unknown) its cost matrix and the best choice for each pair of states."""
    made = {}
    for role in (*ROLES, None):
        matrix, best = np.full((4, 4), _FAR), {}
        for before, after, cost, action, target in _choices(role, costs):
            if cost < matrix[before, after]:
                matrix[before, after], best[before, after] = cost, (action, target)
        made[role] = (matrix, best)
    return made


def product(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Min-plus product: cheapest way over any state in between."""
    return (one[:, :, None] + other[None, :, :]).min(axis=1)


def _known(role) -> str | None:
    name = role.strip().lower() if isinstance(role, str) else None
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def _segment_matrix(costs: Costs):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, key, matrix, rows = _tables(costs), None, None, []
        for batch in batches:
            for conv, segment, role in zip(batch["_conv"], batch["_segment"], batch["_role"], strict=True):
                if (conv, segment) != key:
                    if key is not None:
                        rows.append((*key, matrix.ravel().tolist()))
                    key, matrix = (conv, segment), np.where(np.eye(4, dtype=bool), 0.0, _FAR)
                matrix = product(matrix, tables[_known(role)][0])
            yield pd.DataFrame(rows, columns=["_conv", "_segment", "_matrix"])
            rows = []
        if key is not None:
            yield pd.DataFrame([(*key, matrix.ravel().tolist())], columns=["_conv", "_segment", "_matrix"])

    return work


def best_states(matrices: list[np.ndarray], start: int = START, end: int | None = None) -> list[int]:
    """States before, between and after consecutive steps on the cheapest path; ties go to the smaller state.

    Without ``end`` any state may be the last.
    """
    cost = np.full(4, _FAR)
    cost[start] = 0.0
    steps = []
    for m in matrices:
        total = cost[:, None] + m
        steps.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    at = int(cost.argmin()) if end is None else end
    path = [at]
    for back in reversed(steps):
        at = int(back[at])
        path.append(at)
    return path[::-1]


def _trace(costs: Costs):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables(costs)

        def close(rows: list) -> list:
            first = rows[0]
            path = best_states([tables[_known(r[3])][0] for r in rows], first[5], first[6])
            out = []
            for row, before, after in zip(rows, path[:-1], path[1:], strict=True):
                action, target = tables[_known(row[3])][1][before, after]
                fill = FILLS[before, target] if action != "merge" else ()
                out.append((*row[:3], row[3], row[4], target, action, list(fill)))
            return out

        held: list = []
        names = ["_conv", "_segment", "_place", "_role", "_text", "role", "action", "inserted"]
        for batch in batches:
            done = []
            for row in batch[["_conv", "_segment", "_place", "_role", "_text", "_in", "_out"]].itertuples(index=False, name=None):
                if held and held[0][:2] != row[:2]:
                    done += close(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame(close(held), columns=names)

    return work


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs | None = None) -> DataFrame:
    """One row for each given turn of the repaired conversation, with its rendering.

    conv_id, turn (place in the given order, from 0), out_turn (place in the repaired
    one), role, action (keep, relabel, merge), inserted (roles of empty turns put in
    before), rendered (all that this turn adds to the conversation's text; rows in order
    joined give the whole rendering ``<|role|>\\ntext\\n<|end|>\\n``...).

    Turns are ordered by turn number (NULL first), then role and text; equal turns are
    kept side by side and merge. Roles are trimmed, case does not count, common aliases
    are understood; NULL and other roles are unknown and may take any role cheaply. A
    NULL text is empty. A NULL conv_id is a conversation of its own. An empty table gives
    an empty result; other columns are ignored.
    """
    costs = costs or Costs()
    rows = turns.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("_conv"), F.col(conv).isNull().alias("_none"), F.col(conv).alias("_id"),
        F.col(turn).alias("_turn"), F.col(role).cast("string").alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    key = F.concat(F.when(F.col("_none"), "0").otherwise("1"), F.col("_conv"))
    order = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text")]
    # equal rows of a conversation may be very many: a number of their own lets ranges cut them
    rows = rows.withColumn("_conv", key).withColumn("_tie", F.monotonically_increasing_id())
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_line", F.monotonically_increasing_id()), "turns")

    # place of each turn: within its range, then over the ranges of its conversation
    counts = dealt.groupBy("_conv", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_line").alias("_from"))
    before = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_conv", "_part", "_from", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = dealt.join(counts, ["_conv", "_part"]).withColumn("_place", F.col("_before") + F.col("_line") - F.col("_from"))
    placed = stored(
        placed.select("_conv", "_id", "_role", "_text", "_place", F.floor(F.col("_place") / SEGMENT).alias("_segment")), "placed"
    )
    together = lambda df: df.repartition("_conv", "_segment").sortWithinPartitions("_conv", "_segment", "_place")
    matrices = together(placed).select("_conv", "_segment", "_role").mapInPandas(
        _segment_matrix(costs), "_conv string, _segment long, _matrix array<double>"
    )
    cuts = _cuts(stored(matrices, "matrices"))
    traced = together(placed.join(cuts, ["_conv", "_segment"]).drop("_id")).mapInPandas(
        _trace(costs), "_conv string, _segment long, _place long, _role string, _text string, role string, action string, inserted array<string>"
    )
    traced = stored(traced, "traced")
    # place in the repaired conversation: turns opened before, by segment and then within
    opened = F.size("inserted") + F.when(F.col("action") == "merge", 0).otherwise(1)
    sums = traced.groupBy("_conv", "_segment").agg(F.sum(opened).alias("_opened"))
    over = Window.partitionBy("_conv").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_conv", "_segment", F.coalesce(F.sum("_opened").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_conv", "_segment").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = traced.withColumn("_seen", F.sum(opened).over(inside)).join(sums, ["_conv", "_segment"])
    empty = F.array_join(F.transform("inserted", lambda r: F.concat(F.lit("<|end|>\n<|"), r, F.lit("|>\n"))), "")
    body = F.when(F.col("action") == "merge", F.concat(F.lit("\n"), F.col("_text"))).otherwise(
        F.concat(empty, F.lit("<|end|>\n<|"), F.col("role"), F.lit("|>\n"), F.col("_text"))
    )
    # each turn closes the one before it, the first one has none before
    body = F.when(F.col("_place") == 0, F.regexp_replace(body, r"^<\|end\|>\n", "")).otherwise(body)
    last = F.max("_place").over(Window.partitionBy("_conv", "_segment"))
    ends = cuts.select("_conv", "_segment", "_final")
    out = out.withColumn("_last", last).join(ends, ["_conv", "_segment"])
    body = F.when(F.col("_final") & (F.col("_place") == F.col("_last")), F.concat(body, F.lit("\n<|end|>\n"))).otherwise(body)
    return out.select(
        F.when(F.substring("_conv", 1, 1) == "1", F.expr("substring(_conv, 2)")).cast(turns.schema[conv].dataType).alias("conv_id"),
        F.col("_place").alias("turn"),
        (F.col("_base") + F.col("_seen") - 1).alias("out_turn"),
        "role",
        "action",
        "inserted",
        body.alias("rendered"),
    )


def _cuts(matrices: DataFrame) -> DataFrame:
    """States at the ends of every segment (_in, _out), and whether it is the last one.

    Chains of up to 256 segments are solved at once; longer ones are first folded, 256
    matrices into one, level by level, and unfolded again from the states found.
    """
    rows = matrices.select("_conv", "_segment", "_matrix")
    levels = [rows]
    while levels[-1].agg(F.max("_segment")).first()[0] not in (None,) and (levels[-1].agg(F.max("_segment")).first()[0] or 0) >= SEGMENT:
        folded = levels[-1].withColumn("_up", F.floor(F.col("_segment") / SEGMENT))

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            total = np.where(np.eye(4, dtype=bool), 0.0, _FAR)
            for m in group.sort_values("_segment")["_matrix"]:
                total = np.minimum(product(total, np.array(m).reshape(4, 4)), _FAR)
            return pd.DataFrame([(group["_conv"].iloc[0], group["_up"].iloc[0], total.ravel().tolist())], columns=["_conv", "_segment", "_matrix"])

        levels.append(stored(folded.groupBy("_conv", "_up").applyInPandas(fold, "_conv string, _segment long, _matrix array<double>"), "folded"))
    ends = levels[-1].select("_conv").distinct().select("_conv", F.lit(0).cast("long").alias("_up"), F.lit(START).alias("_a"), F.lit(-1).alias("_b"), F.lit(True).alias("_tail"))
    for level in reversed(levels):
        chained = level.withColumn("_up", F.floor(F.col("_segment") / SEGMENT)).join(ends, ["_conv", "_up"])

        def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, names = [], ["_conv", "_segment", "_in", "_out", "_final"]

            def close() -> list:
                path = best_states([np.array(r[3]).reshape(4, 4) for r in held], held[0][4], None if held[0][5] < 0 else held[0][5])
                return [(r[0], r[2], a, b, bool(r[6]) and k == len(held) - 1) for k, (r, a, b) in enumerate(zip(held, path[:-1], path[1:], strict=True))]

            for batch in batches:
                done = []
                for row in batch[["_conv", "_up", "_segment", "_matrix", "_a", "_b", "_tail"]].itertuples(index=False, name=None):
                    if held and held[0][:2] != row[:2]:
                        done += close()
                        held = []
                    held.append(row)
                yield pd.DataFrame(done, columns=names)
            if held:
                yield pd.DataFrame(close(), columns=names)

        solved = chained.repartition("_conv", "_up").sortWithinPartitions("_conv", "_up", "_segment").mapInPandas(
            chain, "_conv string, _segment long, _in int, _out int, _final boolean"
        )
        solved = stored(solved, "cuts")
        ends = solved.select("_conv", F.col("_segment").alias("_up"), F.col("_in").alias("_a"), F.col("_out").alias("_b"), F.col("_final").alias("_tail"))
    return solved
