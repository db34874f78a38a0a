"""Checks of outputs, universes, time and caches; each is a table of findings, none a driver-side loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_report(ranking: DataFrame, requests: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Counts of faults of a submission ``(request, item, rank)``; all zero is a valid one.

    Faults: requests without a list or unknown, lists that are short or long, repeated items, unknown items, and ranks
    that are not 1 to the list's length.
    """
    return report_of_faults(faults_of_lists(ranking, catalog), requests, k)


def faults_of_lists(ranking: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a request: its list's length, distinct and unknown items, least, greatest and distinct ranks."""
    items = catalog.select("item").distinct().withColumn("_item", F.lit(1))
    return ranking.join(items, "item", "left").groupBy("request").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("item").alias("_d"), F.count_if(F.col("_item").isNull()).alias("_u"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi"), F.countDistinct("rank").alias("_r")
    )


def report_of_faults(rows: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """The report of ``output_report`` from the rows of ``faults_of_lists``."""
    known = requests.select("request").distinct().withColumn("_known", F.lit(1))
    both = rows.join(known, "request", "full_outer")
    n = F.coalesce("_n", F.lit(0))
    return both.agg(
        F.count_if(n == 0).alias("missing_requests"),
        F.count_if(F.col("_known").isNull()).alias("unknown_requests"),
        F.count_if((n > 0) & (n < k)).alias("short_lists"),
        F.count_if(n > k).alias("long_lists"),
        F.coalesce(F.sum(F.col("_n") - F.col("_d")), F.lit(0)).alias("repeated_items"),
        F.coalesce(F.sum("_u"), F.lit(0)).alias("unknown_items"),
        F.count_if((n > 0) & ((F.col("_lo") != 1) | (F.col("_hi") != F.col("_n")) | (F.col("_r") != F.col("_n")))).alias("bad_ranks"),
    )


def outside(ids: DataFrame, *universes: DataFrame, column: str = "item") -> DataFrame:
    """Ids that none of the universes has."""
    known = universes[0].select(column)
    for u in universes[1:]:
        known = known.unionByName(u.select(column))
    return ids.select(column).distinct().join(known, column, "left_anti")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with their side and count."""
    left = a.exceptAll(b.select(*a.columns)).withColumn("side", F.lit("left"))
    right = b.select(*a.columns).exceptAll(a).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def leakage(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest history and oldest request time, and whether history ends before."""
    h, r = history.agg(F.max("t").alias("history_max")), requests.agg(F.min("t").alias("request_min"))
    return h.crossJoin(r).withColumn("ok", F.coalesce(F.col("history_max") < F.col("request_min"), F.lit(True)))  # one row each


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Requests that only one ranking has."""
    left, right = a.select("request").distinct().withColumn("_a", F.lit(1)), b.select("request").distinct().withColumn("_b", F.lit(1))
    return left.join(right, "request", "full_outer").agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"))


def require(report: DataFrame) -> DataFrame:
    """``report`` if all its counts are zero, else an error that names the others."""
    row = report.first().asDict()
    bad = {k: v for k, v in row.items() if v not in (0, True)}
    if bad:
        raise ValueError(f"validation failed: {bad}")
    return report


def temporal_guards(oof: DataFrame, validation: DataFrame) -> DataFrame:
    """Repeated out-of-fold ids, ids in both sets, and whether the former are all strictly earlier."""
    repeated = oof.groupBy("request").agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
    shared = oof.select("request").distinct().join(validation.select("request").distinct(), "request").agg(F.count(F.lit(1)).alias("shared"))
    return repeated.crossJoin(shared).crossJoin(leakage(oof, validation).select("ok"))  # one row each
