"""Recall, value capture, overlap and complementarity of rankings against labels.

Truth is ``(request, item, cost)``; a ranking is ``(request, item, rank)``, of one source or with ``source``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.operators.quantiles import interpolated, quantiles


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def recall(truth: DataFrame, ranking: DataFrame, cutoffs: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Recall and cost-weighted recall at each cutoff, ratios of sums; truth that was missed stays in the denominator."""
    joined = truth.join(ranking.select("request", "item", "rank"), ["request", "item"], "left")
    hit = [f for k in cutoffs for f in (F.count_if(F.col("rank") <= k).alias(f"_h{k}"), F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("cost"))), F.lit(0.0)).alias(f"_c{k}"))]
    sums = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("_c"), *hit)
    return sums.select(*by, F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), _share(F.col(f"_h{k}"), F.col("_n")).alias("recall"), _share(F.col(f"_c{k}"), F.col("_c")).alias("cost_recall")) for k in cutoffs))).alias("_m")).select(*by, "_m.*")


def pool_recall(pool: DataFrame, k: int) -> DataFrame:
    """Cost-weighted recall of the first ``k`` of each scored pool, labels outside the pool not counted."""
    return share_of_first(pool_ranks(pool), k)


def pool_ranks(pool: DataFrame) -> DataFrame:
    """``pool`` with ``_r``, the place by score in each request's pool."""
    return pool.withColumn("_r", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), F.asc("pre_rank"), F.asc("item"))))


def share_of_first(ranked: DataFrame, k: int) -> DataFrame:
    """The share of the cost of all rows that those with ``_r`` up to ``k`` have; rows of no cost may be left out."""
    return ranked.agg(_share(F.sum(F.when(F.col("_r") <= k, F.col("cost")).otherwise(0.0)), F.sum("cost")).alias("cost_recall"))


def value_capture(scored: DataFrame, k: int) -> DataFrame:
    """Per request, the share of its value that its first ``k`` by score hold."""
    return captures(score_ranks(scored), k)


def score_ranks(scored: DataFrame) -> DataFrame:
    """``scored`` with ``_r``, the place by score within the request."""
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), F.asc("item"))))


def captures(ranked: DataFrame, k: int) -> DataFrame:
    """Per request, the share of its cost that rows with ``_r`` up to ``k`` have; rows of no cost may be left out."""
    return ranked.groupBy("request").agg(_share(F.sum(F.when(F.col("_r") <= k, F.col("cost")).otherwise(0.0)), F.sum("cost")).alias("capture"))


def membership(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many true pairs each set of sources holds; ``miss`` for none."""
    have = candidates.groupBy("request", "item").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return truth.join(have, ["request", "item"], "left").groupBy(F.coalesce("sources", F.lit("miss")).alias("sources")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


def mean_jaccard(candidates: DataFrame, a: str, b: str, k: int, requests: DataFrame | None = None) -> DataFrame:
    """Mean Jaccard of two sources' first ``k``, over requests that either has, or over all ``requests``; both empty is 0."""
    return mean_of_jaccards(jaccards(candidates, a, b, k), requests)


def jaccards(candidates: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """``request`` and ``_j``, the Jaccard of two sources' first ``k``, null if both are empty."""
    near = candidates.filter((F.col("rank") <= k) & F.col("source").isin(a, b)).groupBy("request", "item").agg(F.countDistinct("source").alias("_n"))
    each = near.groupBy("request").agg((F.count_if(F.col("_n") == 2) / F.count(F.lit(1))).alias("_j"))
    return candidates.select("request").distinct().join(each, "request", "left")


def mean_of_jaccards(each: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    base = each if requests is None else requests.select("request").distinct().join(each, "request", "left")
    return base.agg(F.avg(F.coalesce("_j", F.lit(0.0))).alias("jaccard"), F.count(F.lit(1)).alias("requests"))


def ceil_rank_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """The value at rank ``ceil(q * (n - 1))`` from 0: no interpolation. One row, ``threshold``, null without values."""
    return quantiles(df, column, [q]).agg(F.max("upper").alias("threshold"))


def complementarity(truth: DataFrame, candidates: DataFrame, sources: Sequence[str], baseline: Sequence[str], q: float, k: int) -> DataFrame:
    """Per source: hits, cost, hits that no other source has, hits and cost the baseline lacks, high-value hits."""
    threshold = ceil_rank_quantile(truth, "cost", q)
    flags = candidates.filter(F.col("rank") <= k).groupBy("request", "item").agg(*(F.max((F.col("source") == s).cast("int")).alias(f"_{s}") for s in sources))
    joined = truth.join(flags, ["request", "item"], "left").crossJoin(F.broadcast(threshold))
    has = {s: F.coalesce(F.col(f"_{s}"), F.lit(0)) for s in sources}
    total = sum(has.values(), F.lit(0))
    base = sum((has[s] for s in baseline), F.lit(0))
    rows = [
        F.struct(
            F.lit(s).alias("source"),
            (has[s] == 1).alias("hit"),
            ((has[s] == 1) & (total == 1)).alias("alone"),
            ((has[s] == 1) & (base == 0)).alias("new"),
            ((has[s] == 1) & (F.col("cost") >= F.col("threshold"))).alias("high"),
            F.col("cost").alias("cost"),
        )
        for s in sources
    ]
    return joined.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.source").agg(
        F.count_if("r.hit").alias("hits"),
        F.sum(F.when(F.col("r.hit"), F.col("r.cost")).otherwise(0.0)).alias("cost"),
        F.count_if("r.alone").alias("unique_hits"),
        F.sum(F.when(F.col("r.alone"), F.col("r.cost")).otherwise(0.0)).alias("unique_cost"),
        F.count_if("r.new").alias("new_hits"),
        F.sum(F.when(F.col("r.new"), F.col("r.cost")).otherwise(0.0)).alias("new_cost"),
        F.count_if("r.high").alias("high_hits"),
    )


def oracle_union(truth: DataFrame, a: DataFrame, b: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Recall if each item had the better of its two ranks."""
    both = a.select("request", "item", F.col("rank").alias("_a")).join(b.select("request", "item", F.col("rank").alias("_b")), ["request", "item"], "full_outer")
    return recall(truth, both.select("request", "item", F.least("_a", "_b").alias("rank")), cutoffs)


def differences(truth: DataFrame, new: DataFrame, old: DataFrame, k: int) -> DataFrame:
    """True pairs that only one of two rankings has in its first ``k``, their cost, and items only one universe has."""
    n = new.filter(F.col("rank") <= k).select("request", "item", F.lit(True).alias("_n"))
    o = old.filter(F.col("rank") <= k).select("request", "item", F.lit(True).alias("_o"))
    joined = truth.join(n, ["request", "item"], "left").join(o, ["request", "item"], "left")
    only_new, only_old = F.col("_n").isNotNull() & F.col("_o").isNull(), F.col("_o").isNotNull() & F.col("_n").isNull()
    hits = joined.agg(
        F.count_if(only_new).alias("new_hits"),
        F.coalesce(F.sum(F.when(only_new, F.col("cost"))), F.lit(0.0)).alias("new_cost"),
        F.count_if(only_old).alias("lost_hits"),
        F.coalesce(F.sum(F.when(only_old, F.col("cost"))), F.lit(0.0)).alias("lost_cost"),
    )
    items = n.select("item").distinct().withColumn("_n", F.lit(1)).join(o.select("item").distinct().withColumn("_o", F.lit(1)), "item", "full_outer")
    return hits.crossJoin(items.agg(F.count_if(F.col("_o").isNull()).alias("new_items"), F.count_if(F.col("_n").isNull()).alias("lost_items")))  # one row each


def cost_strata(truth: DataFrame, ranking: DataFrame, shares: Sequence[float], k: int) -> DataFrame:
    """Recall within bands of cost between interpolated quantiles; bands are half open, the last is closed."""
    edges = interpolated(truth, "cost", shares).withColumnRenamed("values", "_e")
    joined = truth.join(ranking.filter(F.col("rank") <= k).select("request", "item", F.lit(1).alias("_hit")), ["request", "item"], "left").crossJoin(F.broadcast(edges))
    band = F.least(F.aggregate("_e", F.lit(0), lambda n, e: n + F.when(F.col("cost") >= e, 1).otherwise(0)), F.lit(len(shares) - 1))
    return joined.groupBy(band.cast("long").alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("cost").alias("cost"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), _share(F.sum(F.when(F.col("_hit") == 1, F.col("cost")).otherwise(0.0)), F.sum("cost")).alias("cost_recall"))


def halves(requests: DataFrame, boundary: int) -> DataFrame:
    """``request`` and ``part``: early before the boundary, late from it on."""
    return requests.select("request", F.when(F.col("t") < boundary, "early").otherwise("late").alias("part"))


def coverage(ranking: DataFrame, requests: DataFrame) -> DataFrame:
    """Share of requests with a list, mean and median length of all lists."""
    sizes = requests.select("request").distinct().join(ranking.groupBy("request").agg(F.count(F.lit(1)).alias("_n")), "request", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return sizes.agg(F.count(F.lit(1)).alias("requests"), F.avg((F.col("_n") > 0).cast("double")).alias("covered"), F.avg("_n").alias("mean_size"), F.percentile("_n", 0.5).alias("median_size"))


def cluster_sums(truth: DataFrame, users: DataFrame | None, rankings: dict[str, DataFrame], k: int) -> DataFrame:
    """Per user, true cost and what each ranking's first ``k`` have of it; without ``users``, truth has ``user`` itself."""
    joined = truth if users is None else truth.join(users, "request")
    for name, ranking in rankings.items():
        joined = joined.join(ranking.filter(F.col("rank") <= k).select("request", "item", F.lit(1).alias(f"_{name}")), ["request", "item"], "left")
    return joined.groupBy("user").agg(F.sum("cost").alias("cost"), *(F.sum(F.when(F.col(f"_{n}") == 1, F.col("cost")).otherwise(0.0)).alias(n) for n in rankings))


def promotion(trials: DataFrame, floor: float) -> DataFrame:
    """The trial with the best of ``max(min(early, late), full)`` among those whose gains all reach the floor."""
    passing = trials.filter((F.col("early") >= floor) & (F.col("late") >= floor) & (F.col("full") >= floor))
    return passing.withColumn("robust", F.greatest(F.least("early", "late"), F.col("full"))).orderBy(F.desc("robust"), F.asc("trial")).limit(1)


def best_trial(trials: DataFrame, *by: str, floors: dict[str, float] | None = None, prefer: str | None = None) -> DataFrame:
    """The first trial by several metrics, each larger first, among those that reach all floors.

    Exact ties go to the trial named ``prefer``, then to the smaller name.
    """
    passing = trials
    for name, floor in (floors or {}).items():
        passing = passing.filter(F.col(name) >= floor)
    return passing.orderBy(*(F.desc(c) for c in by), F.desc(F.col("trial") == F.lit(prefer)), F.asc("trial")).limit(1)


def retrieval_gate(old: DataFrame, new: DataFrame, least_gain: float, most_loss: float, least_union: float) -> DataFrame:
    """Whether a source is accepted: gain at the short cutoff, loss at the long one, gain of the union. One row each."""
    both = old.select(F.col("short").alias("_s"), F.col("long").alias("_l")).crossJoin(new.select("short", "long", "union"))
    return both.select(((F.col("short") - F.col("_s") >= least_gain) & (F.col("_l") - F.col("long") <= most_loss) & (F.col("union") - F.col("_s") >= least_union)).alias("accepted"))
