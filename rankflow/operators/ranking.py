"""Rankings in long form ``(request, item, rank)``: top-k, fusion, re-ranking, list algebra.

Every order ends in the item, so results don't depend on how rows are dealt out. Float scores that ranks depend on are
summed in a fixed order of sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUND = 12


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def numbered(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_columns(by)).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups before the shuffle."""
    return numbered(df, by, order, name).filter(F.col(name) <= k)


def numbered_many(df: DataFrame, by: str | Sequence[str], orders: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Several row numbers over one partitioning: one shuffle, a sort each."""
    for name, order in orders.items():
        df = numbered(df, by, order, name)
    return df


def any_rank(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Rows that one of several ranks places in the first ``k``."""
    return df.filter(F.least(*names) <= k)


#: Rows of a key from which it is dealt out in slots, and rows that a slot has then.
SLOT = 50_000


def ranks_of_first(df: DataFrame, by: str | Sequence[str], orders: Mapping[str, Sequence[Column]], k: int, item: str = "item", slot: int = SLOT) -> DataFrame:
    """What ``any_rank`` leaves of ``numbered_many``: rows among the first ``k`` of any order, with their ranks in all.

    ``item`` is unique in its key, and orders end in it. The first rows of each order are found before a shuffle. Then a
    key's rows are dealt out in slots of bounded size, each first row goes to every slot of its key, and what precedes it
    there is counted and summed over the slots: no task sees all rows of a key.
    """
    keys = _columns(by)
    first = None
    for order in orders.values():
        one = top_k(df, keys, order, k, "_first").drop("_first")
        first = one if first is None else first.unionByName(one)
    first = first.dropDuplicates([*keys, item])
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slot).select(*keys, F.ceil(F.col("_n") / slot).alias("_slots"))
    sized = lambda x: x.join(F.broadcast(large), keys, "left").withColumn("_slots", F.coalesce("_slots", F.lit(1)))  # noqa: E731  # a key of more rows than a slot has
    own = sized(df).withColumn("_slot", F.pmod(F.xxhash64(item), F.col("_slots"))).withColumn("_own", F.lit(1))
    asked = sized(first).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1))).withColumn("_own", F.lit(0))
    both = own.unionByName(asked).drop("_slots").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_slot")  # not merged: small when packed, large when sorted
    for name, order in orders.items():
        w = Window.partitionBy(*keys, "_slot").orderBy(*order, F.asc("_own")).rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn(name, F.coalesce(F.sum("_own").over(w), F.lit(0)))
    return both.filter("_own = 0").groupBy(*df.columns).agg(*((F.sum(name) + 1).alias(name) for name in orders))


def first_occurrences(df: DataFrame, by: Sequence[str], item: str = "item", rank: str = "rank", quota: int | None = None, keep: Mapping[str, Column] | None = None) -> DataFrame:
    """Each item once at its best rank, at most ``quota`` of them; ranks stay as given."""
    out = df.groupBy(*by, item).agg(F.min(rank).alias(rank), *(c.alias(n) for n, c in (keep or {}).items()))
    if quota is None:
        return out
    return top_k(out, by, [F.col(rank), F.col(item)], quota, "_place").drop("_place")


def rrf_parts(weights: Mapping[str, float], k: float, source: str = "source", rank: str = "rank") -> list[Column]:
    """One summand for each source, in the order given; sources of no weight are left out."""
    if k <= 0 or any(w < 0 for w in weights.values()) or max(weights.values(), default=0) <= 0:
        raise ValueError("weights must be 0 or more, one above 0, and K above 0")
    return [F.coalesce(F.max(F.when(F.col(source) == s, F.lit(float(w)) / (F.lit(float(k)) + F.col(rank)))), F.lit(0.0)) for s, w in weights.items() if w > 0]


def fuse(candidates: DataFrame, weights: Mapping[str, float], k: float = 60.0, limit: int | None = None, quota: int | None = None, request: str = "request", item: str = "item", ties: str = "sources", extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of ``(source, request, item, rank)``.

    ``score`` is the sum of ``weight / (K + rank)``, ``sources`` how many have the item, ``best_rank`` its best rank. Ties
    go to more sources (``ties="sources"``) or the better best rank (``"best"``), then the smaller item.
    """
    wanted = [s for s, w in weights.items() if w > 0]
    known = first_occurrences(candidates.filter(F.col("source").isin(wanted)), ["source", request], item, quota=quota, keep={n: c for n, c in (extra or {}).items()})
    parts = rrf_parts(weights, k)
    score = parts[0]
    for part in parts[1:]:
        score = score + part
    fused = known.groupBy(request, item).agg(F.round(score, ROUND).alias("score"), F.count(F.lit(1)).alias("sources"), F.min("rank").alias("best_rank"), *(F.max(n).alias(n) for n in extra or ()))
    tie = [F.desc("sources")] if ties == "sources" else [F.asc("best_rank")]
    order = [F.desc("score"), *tie, F.asc(item)]
    return numbered(fused, request, order) if limit is None else top_k(fused, request, order, limit)


def provenance(candidates: DataFrame, sources: Sequence[str], request: str = "request", item: str = "item") -> DataFrame:
    """Presence, rank and score of each source as columns, 0 where it lacks the item."""
    known = candidates.groupBy("source", request, item).agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    columns = []
    for s in sources:
        here = F.col("source") == s
        columns += [F.max(F.when(here, 1).otherwise(0)).alias(f"{s}_present"), F.coalesce(F.max(F.when(here, F.col("rank"))), F.lit(0)).alias(f"{s}_rank"), F.coalesce(F.max(F.when(here, F.col("score"))), F.lit(0.0)).alias(f"{s}_score")]
    return known.groupBy(request, item).agg(*columns)


def two_list_fusion(a: DataFrame, b: DataFrame, weight: float, k: float, limit: int) -> DataFrame:
    """Fusion of two rankings with costs by full outer join; an item's cost is the larger of the two."""
    a = a.select("request", "item", F.col("rank").alias("_a"), F.col("cost").alias("_ca"))
    b = b.select("request", "item", F.col("rank").alias("_b"), F.col("cost").alias("_cb"))
    both = a.join(b, ["request", "item"], "full_outer")
    part = lambda w, r: F.when(F.col(r).isNotNull(), F.lit(w) / (F.lit(float(k)) + F.col(r))).otherwise(0.0)
    both = both.select("request", "item", F.round(part(1 - weight, "_a") + part(weight, "_b"), ROUND).alias("score"), F.least("_a", "_b").alias("best_rank"), F.greatest(F.coalesce("_ca", F.lit(0.0)), F.coalesce("_cb", F.lit(0.0))).alias("cost"))
    return top_k(both, "request", [F.desc("score"), F.asc("best_rank"), F.asc("item")], limit)


def fill(first: DataFrame, second: DataFrame, prefix: int, size: int, request: str = "request", item: str = "item") -> DataFrame:
    """The first ``prefix`` items of one ranking, then those of another that are new, up to ``size`` in all."""
    head = first.filter(F.col("rank") <= prefix).select(request, item, F.col("rank").alias("_first"), F.lit(None).cast("long").alias("_then"))
    tail = second.select(request, item, F.lit(None).cast("long").alias("_first"), F.col("rank").alias("_then"))
    both = head.unionByName(tail).groupBy(request, item).agg(F.min("_first").alias("_first"), F.min("_then").alias("_then"))
    return top_k(both, request, [F.asc_nulls_last("_first"), F.asc(F.when(F.col("_first").isNull(), F.col("_then"))), F.asc(item)], size).drop("_first", "_then")


def without(ranking: DataFrame, excluded: DataFrame, request: str = "request", item: str = "item") -> DataFrame:
    """Drop excluded items and number the rest densely in their order."""
    left = ranking.join(excluded.select(item).distinct(), item, "left_anti")
    return numbered(left.withColumnRenamed("rank", "_old"), request, [F.col("_old"), F.col(item)]).drop("_old")


def linear_blend(df: DataFrame, terms: Mapping[str, float], pre_rank: str = "pre_rank") -> DataFrame:
    """Order by a weighted sum of rank columns; ties by ``pre_rank``, then item."""
    total = sum((F.lit(float(w)) * F.col(c) for c, w in terms.items()), F.lit(0.0))
    return numbered(df.withColumn("blend", F.round(total, ROUND)), "request", [F.asc("blend"), F.asc(pre_rank), F.asc("item")])


def two_model_blend(df: DataFrame, a: str, b: str, share: float, weight: float, pre_rank: str = "pre_rank") -> DataFrame:
    """``weight * (share * rank_a + (1 - share) * rank_b) + (1 - weight) * pre_rank``."""
    return linear_blend(df, {a: weight * share, b: weight * (1 - share), pre_rank: 1 - weight}, pre_rank)


def score_blend(df: DataFrame, a: str, b: str, weight: float) -> DataFrame:
    """Weighted sum of two scores, each scaled to its span within the request."""
    from rankflow.functions.numeric import min_max

    blend = F.round(F.lit(weight) * min_max(F.col(a), "request") + F.lit(1 - weight) * min_max(F.col(b), "request"), ROUND)
    return numbered(df.withColumn("blend", blend), "request", [F.desc("blend"), F.asc("pre_rank"), F.asc("item")])


def value_geometry(df: DataFrame, exponent: float, scale: float, head: int, rank: str = "rank", cost: str = "cost") -> DataFrame:
    """Among the first ``head``, order by ``ln(rank) - exponent * ln(1 + max(0, cost) / scale)``; the tail stays.

    An exponent of 0 changes nothing.
    """
    if exponent < 0 or scale <= 0:
        raise ValueError("exponent must be 0 or more and scale above 0")
    if exponent == 0:
        return df.withColumn("new_rank", F.col(rank).cast("long"))
    worth = F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(cost), F.lit(0.0))) / scale)
    key = F.when(F.col(rank) <= head, F.round(F.log(F.col(rank).cast("double")) - exponent * worth, ROUND))
    order = [F.asc(F.col(rank) > head), F.asc(key), F.asc(rank), F.asc("item")]
    return numbered(df, "request", order, "new_rank")


def exact_blend(exact: DataFrame, model: DataFrame, weight: float, missing: int = 501) -> DataFrame:
    """Blend an exact list with model ranks: ``(1 - w) * rank / size + w * min(model, missing) / missing``.

    Ties by model rank, exact rank, item; a weight of 0 or less keeps the exact order.
    """
    joined = exact.join(model.select("request", "item", F.col("rank").alias("_model")), ["request", "item"], "left")
    joined = joined.withColumn("_model", F.least(F.coalesce("_model", F.lit(missing)), F.lit(missing)).cast("long"))
    if weight <= 0:
        return joined.withColumn("new_rank", F.col("rank").cast("long")).drop("_model")
    size = F.count(F.lit(1)).over(Window.partitionBy("request"))
    key = F.round(F.lit(1 - weight) * F.col("rank") / size + F.lit(weight) * F.col("_model") / missing, ROUND)
    return numbered(joined.withColumn("_key", key), "request", [F.asc("_key"), F.asc("_model"), F.asc("rank"), F.asc("item")], "new_rank").drop("_key", "_model")


def consensus_tail(control: DataFrame, other: DataFrame, keep: int, size: int, weight: float, k: float, exponent: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Keep the first ``keep`` of ``control``; order the rest of both by fused score times a power of value."""
    part = lambda df, w, name: df.select("request", "item", "cost", "rank", (F.lit(w) / (F.lit(float(k)) + F.col("rank"))).alias("_s"), F.lit(name).alias("_of"))
    both = part(control, 1 - weight, "c").unionByName(part(other, weight, "o"))
    one = lambda name: F.coalesce(F.max(F.when(F.col("_of") == name, F.col("_s"))), F.lit(0.0))
    pooled = both.groupBy("request", "item").agg((one("c") + one("o")).alias("_s"), F.min("rank").alias("_best"), F.max("cost").alias("cost"), F.min(F.when(F.col("_of") == "c", F.col("rank"))).alias("_c"))
    worth = F.pow(1 + F.greatest(F.lit(0.0), F.coalesce(F.col("cost"), F.lit(0.0))) / scale, F.lit(float(exponent)))
    kept = F.coalesce(F.col("_c") <= keep, F.lit(False))
    pooled = pooled.withColumn("_key", F.when(kept, -F.col("_c").cast("double")).otherwise(F.round(F.col("_s") * worth, ROUND))).withColumn("_tail", ~kept)
    return top_k(pooled, "request", [F.asc("_tail"), F.desc("_key"), F.asc("_best"), F.asc("item")], size).select("request", "item", "rank")


def confidence(scored: DataFrame, depth: int) -> DataFrame:
    """Per request, how far the top score is above the mean of the first ``depth``, in population deviations.

    One score or none is infinitely confident.
    """
    first = scored.filter(F.col("rank") <= depth)
    stats = first.groupBy("request").agg(F.count("score").alias("_n"), F.avg("score").alias("_m"), F.stddev_pop("score").alias("_d"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_top"))
    return stats.select("request", F.when(F.col("_n") < 2, F.lit(float("inf"))).otherwise((F.col("_top") - F.col("_m")) / (F.col("_d") + 1e-6)).alias("z"))


def replace_tail(control: DataFrame, scored: DataFrame, size: int, depth: int, limit: float) -> DataFrame:
    """Where the scored list is not confident, its best item that ``control`` lacks takes the last place."""
    unseen = scored.join(control.select("request", "item"), ["request", "item"], "left_anti")
    best = unseen.groupBy("request").agg(F.min_by("item", F.struct("rank", "item")).alias("_new"))
    unsure = confidence(scored, depth).filter(F.col("z") <= limit).select("request")
    out = control.filter(F.col("rank") <= size).join(best.join(unsure, "request", "left_semi"), "request", "left")
    return out.select("request", F.when((F.col("rank") == size) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("item")).alias("item"), "rank")


def restore_frequency(ranking: DataFrame, counts: DataFrame, alpha: float, head: int) -> DataFrame:
    """Among the first ``head``, order by ``score + alpha * ln(count)``, an unseen item counting 1; the tail stays."""
    joined = ranking.join(counts.select("item", F.col("n").alias("_n")), "item", "left")
    key = F.when(F.col("rank") <= head, F.round(F.col("score") + alpha * F.log(F.coalesce("_n", F.lit(1)).cast("double")), 9))
    return numbered(joined.withColumn("_key", key), "request", [F.asc(F.col("rank") > head), F.desc("_key"), F.asc("rank")], "new_rank").drop("_n", "_key")


def gate_rare(candidates: DataFrame, counts: DataFrame, primary: str, most: int, query: str = "query") -> DataFrame:
    """Sources other than ``primary`` only for queries seen at most ``most`` times."""
    joined = candidates.join(counts.select(query, F.col("n").alias("_n")), query, "left")
    return joined.filter((F.col("source") == primary) | (F.coalesce("_n", F.lit(0)) <= most)).drop("_n")


def simplex(parts: int, step: float, least_first: float = 0.0) -> list[tuple[float, ...]]:
    """All weight vectors of ``parts`` in steps that sum to 1, the first at least ``least_first``."""
    total = round(1 / step)

    def rest(n, left):
        if n == 1:
            yield (left,)
            return
        for x in range(left + 1):
            yield from ((x, *more) for more in rest(n - 1, left - x))

    return [tuple(x / total for x in w) for w in rest(parts, total) if w[0] / total >= least_first - 1e-12]
