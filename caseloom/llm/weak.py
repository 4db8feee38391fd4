"""Weak supervision: how reliable labelers are, estimated from nothing but their votes."""

from __future__ import annotations

import math
from collections.abc import Callable


def majority(votes: tuple[int, ...]) -> float:
    lead = sum(votes)
    return 0.9 if lead > 0 else 0.1 if lead < 0 else 0.3


def any_objection(votes: tuple[int, ...]) -> float:
    return 0.02 if -1 in votes else 0.98 if 1 in votes else 0.5


def estimate(
    patterns: dict[tuple[int, ...], int],
    start: Callable[[tuple[int, ...]], float] = majority,
    most_false_no: float = 1.0,
    rounds: int = 50,
) -> dict[tuple[int, ...], float]:
    """Posterior probability of each combination of votes (1 yes, -1 no, 0 none), by expectation-maximisation.

    Labelers err independently given the truth; for each the chance of a yes among its
    votes is estimated for both truths, starting from the labels that ``start`` gives:
    the majority of votes, or a label that one objection decides. Not to vote says nothing.
    ``most_false_no`` bounds the chance of a no where yes is true: where there are several
    unlike reasons for a no, each labeler misses most of them, and without the bound
    the many that do not object to a rare one would talk the one down that does.
    """
    after = {votes: start(votes) for votes in patterns}
    for _ in range(rounds):
        weight = {True: 1.0, False: 1.0}
        seen = {}
        for votes, n in patterns.items():
            for truth, share in ((True, after[votes]), (False, 1 - after[votes])):
                weight[truth] += n * share
                for j, v in enumerate(votes):
                    if v:
                        seen[truth, j, v] = seen.get((truth, j, v), 0.0) + n * share
        new = {}
        for votes in patterns:
            odds = math.log(weight[True] / weight[False])
            for j, v in enumerate(votes):
                if v:
                    # one observation of each right vote, a tenth of each wrong one, keeps labels the right way up
                    up, down = (1.0, 0.1) if v > 0 else (0.1, 1.0)
                    for truth, sign, extra in ((True, 1, up), (False, -1, down)):
                        all_votes = seen.get((truth, j, 1), 0.0) + seen.get((truth, j, -1), 0.0)
                        chance = (seen.get((truth, j, v), 0.0) + extra) / (all_votes + 1.1)
                        odds += sign * math.log(min(chance, most_false_no) if truth and v < 0 else chance)
            new[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[v] - after[v]) for v in patterns), default=0.0)
        after = new
        if moved < 1e-9:
            break
    return after
