"""Weekly walk-forward: predict a week from the weeks before it, freeze its pool, attach labels, only then learn from it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions.timeops import FIRST_MONDAY, WEEK, week_start
from rankflow.operators.requests import attach_labels, freeze_pool


def contiguous(weeks: Iterable[int]) -> list[int]:
    """The weeks in order; they must be Mondays and follow each other without a gap."""
    found = sorted(weeks)
    if any((w - FIRST_MONDAY) % WEEK for w in found):
        raise ValueError("a week does not start on a Monday")
    if any(b - a != WEEK for a, b in zip(found, found[1:])):
        raise ValueError("weeks are missing")
    return found


def walk(events: DataFrame, requests: DataFrame, truth: DataFrame, weeks: Iterable[int], rank: Callable[[DataFrame, DataFrame], DataFrame], pool: int) -> Iterator[tuple[int, DataFrame]]:
    """For each week, its frozen and labelled pool as ``rank(past events, requests of the week)`` gives it.

    The loop is over weeks; each step is one plan. Events of the week itself are never in the past.
    """
    for week in contiguous(weeks):
        past = events.filter(F.col("t") < week)
        asked = requests.filter(week_start(F.col("t")) == week)
        yield week, attach_labels(freeze_pool(rank(past, asked), pool), truth)
