"""Rounds of search for what is missing, until it is found, nothing more is found, or the budget is spent."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from enum import StrEnum
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


class Stop(StrEnum):
    """Why the rounds ended."""

    SECONDS = "seconds"
    ROUNDS = "rounds"
    COST = "cost"
    NO_GAP = "no_gap"
    NO_PROGRESS = "no_progress"


@dataclass(frozen=True)
class Budget:
    """Limits of all rounds together; None: none. cost is that of the rows found, such as pages read."""

    rounds: int
    cost: float | None = None
    seconds: float | None = None


@dataclass(frozen=True)
class Round:
    number: int
    found: int
    left: int
    cost: float


@dataclass(frozen=True)
class Outcome:
    """known: (*keys, value columns, round) of what was found; gaps: the keys still missing."""

    known: DataFrame
    gaps: DataFrame
    stop: Stop
    rounds: list[Round]


def stop_reason(budget: Budget, rounds: list[Round], left: int, elapsed: float) -> Stop | None:
    """The first that holds, asked in this order: a limit reached, no gap left, a round that found nothing new."""
    if budget.seconds is not None and elapsed >= budget.seconds:
        return Stop.SECONDS
    if len(rounds) >= budget.rounds:
        return Stop.ROUNDS
    if budget.cost is not None and sum(r.cost for r in rounds) >= budget.cost:
        return Stop.COST
    if not left:
        return Stop.NO_GAP
    return Stop.NO_PROGRESS if rounds and not rounds[-1].found else None


def fill_gaps(wanted: DataFrame, keys: list[str], search: Callable[[DataFrame, int], DataFrame], budget: Budget, clock: Callable[[], float] = time.monotonic) -> Outcome:
    """Search for the keys of wanted, round by round; each round sees only what is still missing.

    search(gaps, number) returns rows with the keys and, for a cost budget, a column cost; of several rows of a key
    one stays, any with the same values. Rows of other keys, and of keys with null parts, are left out. The limits are
    asked before and after each round, so no round begins beyond them. What a round finds and leaves is written to the
    shared folder: plans do not grow with the rounds, and a lost executor costs no earlier round. The driver holds
    counts alone."""
    start, rounds, found = clock(), [], []
    gaps = staged(wanted.select(*keys).dropna().distinct())
    left = gaps.count()
    while (stop := stop_reason(budget, rounds, left, clock() - start)) is None:
        number = len(rounds) + 1
        got = search(gaps, number)
        values = [c for c in got.columns if c not in keys]
        got = staged(got.join(gaps, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, "_v.*", F.lit(number).alias("round")))
        n = got.count()
        cost = float(got.agg(F.sum("cost")).first()[0] or 0) if "cost" in values else 0.0
        if n:
            gaps = staged(gaps.join(got.select(*keys), keys, "left_anti"))
        left -= n
        rounds.append(Round(number, n, left, cost))
        found.append(got)
    known = reduce(DataFrame.unionByName, found) if found else gaps.limit(0).withColumn("round", F.lit(0))
    return Outcome(known, gaps, stop, rounds)
