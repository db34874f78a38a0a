"""Resampling: paired bootstrap, permutation importance, listwise sampling, shuffling."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Replicates that one digest decides, each by 32 bits of it.
DRAWS = 4


def poisson_bounds() -> list[int]:
    """Of 32 random bits, the numbers from which a Poisson(1) draw is 1 or more, 2 or more, and so on."""
    bounds, below, k = [], 0.0, 0
    while True:
        below += exp(-1) / factorial(k)
        at = round(below * 2**32)
        if at >= 2**32:
            return bounds
        bounds.append(at)
        k += 1


def bootstrap(clusters: DataFrame, whole: str, a: str, b: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Difference of two ratios of sums under resampling of clusters: one row per replicate.

    The first column names a cluster. Each cluster is drawn a Poisson(1) number of times by the MD5 digest of
    ``cluster:block:seed``, so the draws don't depend on partitions and no cluster has to meet another; sums combine by
    replicate before they are shuffled. A cluster that is named twice is drawn alike; without clusters there are no rows.
    """
    blocks = -(-replicates // DRAWS)
    name = F.col(clusters.columns[0]).cast("string")
    drawn = clusters.select(name.alias("_c"), whole, a, b, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    drawn = drawn.withColumn("_h", F.md5(F.concat_ws(":", "_c", "_b", F.lit(seed)).cast("binary")))
    bits = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(DRAWS)]
    each = drawn.select(whole, a, b, F.explode(F.array(*(F.struct((F.col("_b") * DRAWS + i).cast("long").alias("replicate"), x.alias("bits")) for i, x in enumerate(bits)))).alias("_d"))
    times = sum(((F.col("_d.bits") >= bound).cast("int") for bound in poisson_bounds()), F.lit(0))
    each = each.select("_d.replicate", times.alias("_n"), whole, a, b).filter((F.col("replicate") < replicates))
    total = lambda c: F.sum(F.col("_n") * F.col(c))
    sums = each.groupBy("replicate").agg(total(whole).alias("w"), total(a).alias("a"), total(b).alias("b"))
    return sums.select("replicate", F.when(F.col("w") > 0, (F.col("b") - F.col("a")) / F.col("w")).otherwise(0.0).alias("delta"))


def summarize_bootstrap(deltas: DataFrame) -> DataFrame:
    """Mean, median, 90 and 95 % intervals and shares of replicates above, and not below, zero."""
    return deltas.agg(
        F.count(F.lit(1)).alias("replicates"),
        F.avg("delta").alias("mean"),
        *(F.percentile("delta", q).alias(n) for n, q in (("median", 0.5), ("low_90", 0.05), ("high_90", 0.95), ("low_95", 0.025), ("high_95", 0.975))),
        F.avg((F.col("delta") > 0).cast("double")).alias("p_above"),
        F.avg((F.col("delta") >= 0).cast("double")).alias("p_not_below"),
    )


def seeded(seed: int, *keys: str) -> Column:
    """A random order that the keys and the seed decide: the MD5 digest of ``key:...:seed``."""
    return F.md5(F.concat_ws(":", *keys, F.lit(seed)).cast("binary"))


def permutation_importance(rows: DataFrame, columns: Sequence[str], score, k: int, repeats: int = 3, seed: int = 5, scored: str | None = None) -> DataFrame:
    """Mean drop in value capture when a column's values change places, by ``score(df) -> df with "score"``.

    Values change places by two row numbers over the same rows in different orders, within the 4096 parts that the
    first digits of one digest make; requests and items must be unique together. ``scored`` names a flag that all rows of
    a request share: requests without it must have no cost, so they capture 0 and are counted but not scored.

    A part is one group, ordered in both ways at once: rows are shuffled once a turn, and only those of scored requests
    come back, each with the values that it would have of all columns.
    """
    from rankflow.operators.metrics import value_capture

    known = rows if scored is None else rows.filter(F.col(scored))
    others = [c for c in rows.columns if c not in ("request", "item", *columns)]
    n_requests = rows.select("request").distinct().agg(F.count(F.lit(1)).alias("_requests"))
    base = value_capture(score(known), k).agg(F.coalesce(F.sum("capture"), F.lit(0.0)).alias("_base")).crossJoin(n_requests)  # one row each
    kept = [f.simpleString().replace(":", " ", 1) for f in rows.schema.fields]
    out = None
    for n in range(repeats):
        turn = F.unhex(seeded(seed + n + 1, "request", "item"))
        places = rows.select(*rows.columns, F.substring(seeded(n, "request", "item"), 1, 3).alias("_part"))
        moved = places.repartition("_part").withColumn("_turn", turn).groupBy("_part").applyInArrow(_exchange(list(rows.columns), list(columns), scored), ", ".join([*kept, *(f"_m_{c} {rows.schema[c].dataType.simpleString()}" for c in columns)]))
        each = F.explode(F.array(*(F.struct(F.lit(column).alias("feature"), *(F.col(f"_m_{c}" if c == column else c).alias(c) for c in columns)) for column in columns)))
        one = moved.select("request", "item", *others, each.alias("_e")).select(F.struct("_e.feature", "request").alias("request"), "item", *others, *(f"_e.{c}" for c in columns))
        one = value_capture(score(one), k).groupBy("request.feature").agg(F.sum("capture").alias("capture"))
        out = one if out is None else out.unionByName(one)
    names = rows.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = names.join(out.groupBy("feature").agg(F.sum("capture").alias("capture")), "feature", "left").withColumn("capture", F.coalesce("capture", F.lit(0.0)) / repeats)
    return out.crossJoin(F.broadcast(base)).select("feature", F.when(F.col("_requests") > 0, (F.col("_base") - F.col("capture")) / F.col("_requests")).alias("drop"))  # one row


def _exchange(names: list[str], columns: list[str], scored: str | None):
    """The rows of a part, or those that are flagged, with ``columns`` as the rows of their places in the other order have them."""

    def run(part: pa.Table) -> pa.Table:
        here = part.sort_by([("request", "ascending"), ("item", "ascending")])
        there = here.select(["_turn", *columns]).take(pc.sort_indices(here, [("_turn", "ascending"), ("request", "ascending"), ("item", "ascending")]))
        out = here.select(names)
        for c in columns:
            out = out.append_column(f"_m_{c}", there[c])
        return out if scored is None else out.filter(out[scored])

    return run


def listwise_sample(pool: DataFrame, positives: int, hard: int, random_tail: int, seed: int = 3) -> DataFrame:
    """Per request: positives by cost, hard negatives by rank, and a random tail; targets are square roots of cost, sum 1."""
    positive = F.col("label") > 0
    kind = F.when(positive, "positive").otherwise("negative")
    w = Window.partitionBy("request", "_kind")
    place = F.row_number().over(w.orderBy(F.desc(F.when(positive, F.col("cost"))), "pre_rank", "item"))
    ranked = pool.repartition("request").withColumn("_kind", kind).withColumn("_n", place)  # one shuffle for all that follows
    role = F.when(positive & (F.col("_n") <= positives), "positive").when(~positive & (F.col("_n") <= hard), "hard")
    taken = ranked.withColumn("role", role).withColumn("_rest", F.col("role").isNull() & ~positive)
    tail = Window.partitionBy("request", "_rest").orderBy(seeded(seed, "request", "item"), "item")
    drawn = F.col("_rest") & (F.row_number().over(tail) <= random_tail)
    out = taken.withColumn("role", F.coalesce("role", F.when(drawn, F.lit("tail")))).filter("role is not null")
    root = F.sqrt(F.greatest(F.lit(0.0), F.when(positive, F.col("cost")).otherwise(0.0)))
    total = F.sum(root).over(Window.partitionBy("request"))
    return out.withColumn("target", F.when(total > 0, root / total).otherwise(0.0)).drop("_kind", "_n", "_rest")


def shuffled(rows: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Rows in a random order that only the seed decides."""
    order = F.xxhash64(*keys, F.lit(seed))
    return rows.withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order", *keys).drop("_order")
