"""Exact quantiles of a whole column, without a task that sees all its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that the distinct values are cut into, and the accuracy of where.
PIECES, ACCURACY = 200, 10_000


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row per share q: ``q``, ``rank`` (``q * (n - 1)``, from 0), and the values at its floor and ceiling.

    Columns ``lower`` and ``upper``. Nulls don't count; repeated values count each; a column without values gives no
    rows. Distinct values are counted first and cut into pieces at approximate quantiles; the pieces' sums say in which
    piece a rank is, and only those pieces are ordered. The cuts are found at once: a sketch depends on the order in which
    its parts come, so one that the plan evaluates twice may cut in two ways.
    """
    value = F.col(column).cast("double").alias("_value")
    counts = df.select(value).filter("_value is not null").groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.agg(F.percentile_approx("_value", [k / PIECES for k in range(1, PIECES)], ACCURACY).alias("cuts"), F.sum("_n").alias("all")).first()
    found = F.array(*(F.lit(float(c)) for c in cuts["cuts"] or ())).cast("array<double>")
    placed = counts.withColumn("_piece", F.size(F.filter(found, lambda c: c < F.col("_value")))).withColumn("_all", F.lit(cuts["all"]).cast("long"))
    upto = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    pieces = placed.groupBy("_piece").agg(F.sum("_n").alias("_rows"), F.first("_all").alias("_all")).withColumn("_start", F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
    rank = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    asked = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), rank(q).alias("rank"), side(rank(q)).alias("at"), F.lit(name).alias("side")) for q in shares for name, side in (("lower", F.floor), ("upper", F.ceil)))))
    wanted = pieces.select("_piece", "_start", "_rows", asked.alias("_q")).filter((F.col("_q.at") >= F.col("_start")) & (F.col("_q.at") < F.col("_start") + F.col("_rows")))
    inner = placed.select("_value", "_n", "_piece").join(F.broadcast(wanted.select("_piece", "_start").distinct()), "_piece")
    inner = inner.withColumn("_upto", F.col("_start") + F.sum("_n").over(Window.partitionBy("_piece").orderBy("_value")))
    found = inner.drop("_start").join(F.broadcast(wanted.select("_piece", "_q.*")), "_piece").filter((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_n")))
    one = lambda name: F.max(F.when(F.col("side") == name, F.col("_value"))).alias(name)
    return found.groupBy("q").agg(F.max("rank").alias("rank"), one("lower"), one("upper"))


def interpolated(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row: ``values``, the linearly interpolated quantiles by rising share; an empty array without values."""
    at = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("rank") - F.floor("rank"))
    return quantiles(df, column, shares).agg(F.array_sort(F.collect_list(F.struct("q", at.alias("v")))).alias("_l")).select(F.col("_l.v").alias("values"))  # a row a share
