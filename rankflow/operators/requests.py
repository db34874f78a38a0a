"""Requests with their labels: building, splitting, sampling, selecting weeks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.timeops import DAY, week_start


def clicked(click: Column, exact: bool = False) -> Column:
    """Whether a row is a click: any number above 0, or exactly 1 as request files have it; null is none."""
    return F.coalesce(click, F.lit(0)) == 1 if exact else F.coalesce(click, F.lit(0)) > 0


def build_requests(rows: DataFrame, order: str) -> DataFrame:
    """Click rows to one row per request: context of its first row, distinct items in order with their first cost.

    Labels are the parallel arrays ``items`` and ``costs``; ``t_min`` and ``t_max`` span all rows.
    """
    first = rows.groupBy("request", "item").agg(F.min(order).alias("_at"), F.min_by("cost", order).alias("_cost"))
    labels = first.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("_at", "item", "_cost"))).alias("_l"))
    context = rows.groupBy("request").agg(F.min_by("user", order).alias("user"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    return context.join(labels, "request").select("request", "user", "t_min", "t_max", F.col("_l.item").alias("items"), F.col("_l._cost").alias("costs"))


def explode_labels(requests: DataFrame, last_wins: bool = False) -> DataFrame:
    """``(request, item, cost, position)`` of the parallel arrays; of a repeated item one row, the first or the last."""
    rows = requests.select("request", F.posexplode(F.arrays_zip("items", "costs")).alias("position", "_z")).select("request", F.col("_z.items").alias("item"), F.col("_z.costs").alias("cost"), "position")
    best = F.max_by if last_wins else F.min_by
    return rows.groupBy("request", "item").agg(best("cost", "position").alias("cost"), (F.max if last_wins else F.min)("position").alias("position"))


def temporal_split(requests: DataFrame, boundary: int) -> DataFrame:
    """``part``: ``fit`` if all of a request is before the boundary, ``holdout`` if none is, else ``crossing``."""
    part = F.when(F.col("t_max") < boundary, "fit").when(F.col("t_min") >= boundary, "holdout").otherwise("crossing")
    return requests.withColumn("part", part)


def require_no_crossing(split: DataFrame) -> DataFrame:
    """``split`` unless a request crosses the boundary, which is an error."""
    crossing = split.filter("part = 'crossing'").limit(1).count()
    if crossing:
        raise ValueError("a request crosses the temporal boundary")
    return split


def bottom_k(requests: DataFrame, priority: Column, k: int) -> DataFrame:
    """Per week, the ``k`` requests of least priority; stable as more requests come."""
    ranked = requests.withColumn("week", week_start(F.col("t"))).withColumn("_p", priority)
    w = Window.partitionBy("week").orderBy("_p", "request")
    return ranked.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k).drop("_p")


def recent_groups(rows: DataFrame, days: int, positives_only: bool = True) -> DataFrame:
    """Whole requests of the last ``days`` before the newest, if wanted only those with a positive."""
    newest = rows.agg(F.max("t").alias("_newest"))
    groups = rows.groupBy("request").agg(F.max("t").alias("_t"), F.max("label").alias("_label")).crossJoin(F.broadcast(newest))  # one row
    chosen = groups.filter(F.col("_t") >= F.col("_newest") - days * DAY)
    if positives_only:
        chosen = chosen.filter(F.col("_label") > 0)
    return rows.join(chosen.select("request"), "request", "left_semi")


def whole_groups(rows: DataFrame, least: int) -> DataFrame:
    """Whole requests in order until at least ``least`` rows are reached; ``request`` is an integer.

    Rows are summed by 1,000 key ranges first, and only the ranges that begin before ``least`` rows are summed by request.
    """
    sizes = rows.groupBy("request").agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.agg(F.min("request").alias("_least"), F.max("request").alias("_most"))
    width = F.floor((F.col("_most") - F.col("_least")) / 1000) + 1
    sizes = sizes.crossJoin(F.broadcast(ends)).withColumn("_range", F.floor((F.col("request") - F.col("_least")) / width)).select("request", "_n", "_range")  # one row
    ranges = sizes.groupBy("_range").agg(F.sum("_n").alias("_rows"))
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    begun = sizes.join(F.broadcast(ranges.filter(F.col("_start") < least).select("_range", "_start")), "_range")
    before = F.col("_start") + F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("request").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(begun.withColumn("_before", before).filter(F.col("_before") < least).select("request"), "request", "left_semi")


def select_weeks(weeks: DataFrame, least_clicks: int, drop_first: int, drop_last: int, most: int) -> DataFrame:
    """Weeks with enough clicks, without the first and last ones, at most the newest ``most``."""
    enough = weeks.filter(F.col("clicks") >= least_clicks)
    up, down = Window.orderBy("week"), Window.orderBy(F.desc("week"))  # one row a week
    ranked = enough.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down))
    return ranked.filter((F.col("_a") > drop_first) & (F.col("_z") > drop_last) & (F.col("_z") <= drop_last + most)).drop("_a", "_z")


def freeze_pool(candidates: DataFrame, n: int) -> DataFrame:
    """The natural pool: the first ``n`` by ``(pre_rank, item)``, chosen before any label is seen."""
    w = Window.partitionBy("request").orderBy("pre_rank", "item")
    return candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def attach_labels(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """Labels and costs joined after the cut; membership never changes."""
    labels = truth.groupBy("request", "item").agg(F.max("cost").alias("label_cost"))
    joined = pool.join(labels, ["request", "item"], "left")
    return joined.withColumn("label", F.col("label_cost").isNotNull().cast("int")).withColumn("label_cost", F.coalesce("label_cost", F.lit(0.0)))


def by_snapshot(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshot of each request's week, else the final one (that of no week)."""
    weekly = snapshots.filter("week is not null")
    final = snapshots.filter("week is null").select(F.max("snapshot").alias("_final"))
    joined = requests.withColumn("week", week_start(F.col("t"))).join(weekly, "week", "left").crossJoin(F.broadcast(final))  # one row
    return joined.withColumn("snapshot", F.coalesce("snapshot", "_final")).drop("_final")
