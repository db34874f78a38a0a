"""Numeric encodings and normalisations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def log_bucket(value: Column, scale: float, cardinality: int) -> Column:
    """``floor(log1p(max(0, value)) * scale)``, at most ``cardinality - 1``; null counts as 0."""
    return F.least(F.lit(cardinality - 1), F.floor(F.log1p(F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))) * scale)).cast("long")


def piecewise(value: Column, knots: Sequence[float]) -> Column:
    """The two knots around a value and its weights on them; beyond the ends one knot has all the weight."""
    last = len(knots) - 1
    table = F.array(*(F.lit(float(k)) for k in knots))
    at = F.aggregate(table, F.lit(-1), lambda n, k: n + F.when(k <= value, 1).otherwise(0))
    low, high = F.greatest(at, F.lit(0)), F.least(F.greatest(at, F.lit(0)) + 1, F.lit(last))
    a, b = F.get(table, low), F.get(table, high)
    part = F.when((at < 0) | (at >= last), F.lit(0.0)).otherwise((value - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a))
    high = F.when((at < 0) | (at >= last), low).otherwise(high)
    return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), (1 - part).alias("low_weight"), part.alias("high_weight"))


def min_max(value: Column, group: str | Column) -> Column:
    """Position within the group's span; 0 where the span is none."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def z_score(value: Column, group: str | Column) -> Column:
    """By population deviation within the group; 0 where that is as good as 0."""
    w = Window.partitionBy(group)
    deviation = F.stddev_pop(value).over(w)
    return F.when(deviation > 1e-12, (value - F.avg(value).over(w)) / deviation).otherwise(0.0)


def smoothed_ctr(clicks: Column, shows: Column, prior: float = 20.0, add: float = 1.0) -> Column:
    """``(clicks + add) / (shows + prior)``; ``add=0`` is the variant without an added click."""
    return (clicks + F.lit(float(add))) / (shows + F.lit(float(prior)))


def log_cost(cost: Column, scale: float, positive: Column) -> Column:
    """Graded label: ``1 + log1p(cost / scale)`` of positives, else 0."""
    return F.when(positive, 1 + F.log1p(F.greatest(F.lit(0.0), F.coalesce(cost, F.lit(0.0))) / scale)).otherwise(0.0)
