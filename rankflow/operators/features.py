"""Feature columns for ranking: retrieval, text, static, counters, weights, standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions import text as X
from rankflow.functions.hashing import bucket
from rankflow.functions.numeric import min_max, z_score
from rankflow.functions.timeops import DAY
from rankflow.operators.quantiles import interpolated


def check_names(names: Sequence[str]) -> list[str]:
    if len(set(names)) != len(names):
        raise ValueError("feature names are not unique")
    return list(names)


def source_features(candidates: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Per candidate and source: present, reciprocal and log rank, score, z and span position within the request."""
    scaled = candidates.withColumn("_group", F.concat_ws("\x1f", "source", "request"))
    scaled = scaled.withColumn("_z", z_score(F.col("score"), "_group")).withColumn("_m", min_max(F.col("score"), "_group"))
    columns = []
    for s in sources:
        here = F.col("source") == s
        pick = lambda c: F.coalesce(F.max(F.when(here, c)), F.lit(0.0))  # noqa: B023, E731
        columns += [
            F.max(here.cast("int")).alias(f"{s}_present"),
            pick(1 / F.col("rank")).alias(f"{s}_reciprocal"),
            pick(F.log1p(F.col("rank").cast("double"))).alias(f"{s}_log_rank"),
            pick(F.col("score")).alias(f"{s}_score"),
            pick(F.col("_z")).alias(f"{s}_z"),
            pick(F.col("_m")).alias(f"{s}_span"),
        ]
    return scaled.groupBy("request", "item").agg(*columns)


def crosses(features: DataFrame, sources: Sequence[str], neural: Sequence[str] = (), lexical: Sequence[str] = ()) -> DataFrame:
    """Best and second z, their margin, rank statistics, and which kinds of source alone have the item."""
    z = F.sort_array(F.array(*(F.col(f"{s}_z") for s in sources)), asc=False)
    ranks = F.filter(F.array(*(F.when(F.col(f"{s}_present") == 1, F.round(F.expm1(f"{s}_log_rank"))) for s in sources)), lambda r: r.isNotNull())
    count = sum((F.col(f"{s}_present") for s in sources), F.lit(0))
    of = lambda kind: sum((F.col(f"{s}_present") for s in kind), F.lit(0))
    return features.withColumns(
        {
            "best_z": F.get(z, 0),
            "second_z": F.coalesce(F.get(z, 1), F.lit(0.0)),
            "z_margin": F.get(z, 0) - F.coalesce(F.get(z, 1), F.lit(0.0)),
            "min_rank": F.coalesce(F.array_min(ranks), F.lit(0.0)),
            "mean_rank": X.ratio(F.aggregate(ranks, F.lit(0.0), lambda a, b: a + b), F.size(ranks)),
            "source_count": count,
            "neural_only": ((of(neural) > 0) & (of(neural) == count)).cast("int"),
            "lexical_only": ((of(lexical) > 0) & (of(lexical) == count)).cast("int"),
        }
    )


def text_match(query: Column, title: Column) -> dict[str, Column]:
    """Overlap, Jaccard, coverages, prefix, phrase, trigram similarity and lengths of two texts."""
    q, t = X.tokens(query), X.tokens(title)
    q, t = F.array_distinct(q), F.array_distinct(t)
    qn, tn = X.normalize(query), X.normalize(title)
    common = X.overlap(q, t)
    return {
        "overlap": common,
        "jaccard": X.jaccard(q, t),
        "query_coverage": X.ratio(common, F.size(q)),
        "title_coverage": X.ratio(common, F.size(t)),
        "prefix": ((F.length(qn) > 0) & F.startswith(tn, qn)).cast("int"),
        "phrase": ((F.length(qn) > 0) & F.contains(tn, qn)).cast("int"),
        "trigram": X.jaccard(X.trigrams(qn), X.trigrams(tn)),
        "query_tokens": F.size(q),
        "title_tokens": F.size(t),
    }


def base_features(query: Column, title: Column, text: Column) -> dict[str, Column]:
    """Score, sources, lengths, overlaps and history of a candidate; the row has ``score, sources, cost, clicks, value, in_query, in_region``."""
    q, t, b = (F.array_distinct(X.tokens(c)) for c in (query, title, text))
    qn, tn, bn = (X.normalize(c) for c in (query, title, text))
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    return {
        "fused_score": F.col("score"),
        "sources": F.col("sources").cast("double"),
        **{f"{n}_chars": F.length(c).cast("double") for n, c in (("query", qn), ("title", tn), ("text", bn))},
        **{f"{n}_tokens": F.size(c).cast("double") for n, c in (("query", q), ("title", t), ("text", b))},
        "title_overlap": X.overlap(q, t).cast("double"),
        "text_overlap": X.overlap(q, b).cast("double"),
        "any_overlap": X.overlap(q, F.array_union(t, b)).cast("double"),
        "title_jaccard": X.jaccard(q, t),
        "text_jaccard": X.jaccard(q, b),
        "phrase_in_title": ((F.length(qn) > 0) & F.contains(tn, qn)).cast("double"),
        "log_cost": log("cost"),
        "log_history_clicks": log("clicks"),
        "log_history_value": log("value"),
        "in_query_history": F.coalesce(F.col("in_query"), F.lit(False)).cast("double"),
        "in_region_history": F.coalesce(F.col("in_region"), F.lit(False)).cast("double"),
    }


def numbered_or_missing(name: str, value: Column, step: int | None = None) -> dict[str, Column]:
    """A number with 0 for a missing one, whether it is missing, and, with ``step``, its bucket."""
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    out = {name: number, f"{name}_missing": value.isNull().cast("double")}
    return out | ({f"{name}_bucket": F.floor(number / step).cast("double")} if step else {})


def hashed_or_missing(name: str, value: Column) -> dict[str, Column]:
    """A hash bucket of a name, 0 for a missing or empty one, and whether it is."""
    known = F.coalesce(value.cast("string"), F.lit(""))
    return {f"{name}_hash": bucket(known).cast("double"), f"{name}_missing": (known == "").cast("double")}


def request_features(query: Column) -> dict[str, Column]:
    """Context of the request: ``region, user, device, age, gender, income`` and the kinds of its query's characters."""
    text = X.normalize(query)
    return {
        **numbered_or_missing("region", F.col("region")),
        "user_present": F.col("user").isNotNull().cast("double"),
        **hashed_or_missing("device", F.col("device")),
        **numbered_or_missing("age", F.col("age"), 10),
        **numbered_or_missing("gender", F.col("gender")),
        **{f"query_{n}": X.share(text, p) for n, p in (("digits", "[0-9]"), ("cyrillic", "[а-яё]"), ("latin", "[a-z]"))},
        **numbered_or_missing("income", F.col("income"), 1),
    }


def static_features(url: Column, title: Column, text: Column) -> dict[str, Column]:
    """What a candidate is by itself and in its group and domain, as ``group_stats`` joins them."""
    cost = F.coalesce(F.col("cost"), F.lit(0.0))
    number = F.greatest(F.lit(0.0), F.coalesce(F.col("price"), F.lit(0.0)))
    return {
        "cost": cost,
        "cost_missing": F.col("cost").isNull().cast("double"),
        **numbered_or_missing("price", F.col("price")),
        "log_price": F.log1p(number),
        **{k: v for n in ("group", "client", "domain") for k, v in hashed_or_missing(n, F.col(n)).items()},
        "url_chars": F.length(X.normalize(url)).cast("double"),
        "url_tokens": F.size(F.array_distinct(X.tokens(url))).cast("double"),
        **{f"{n}_digits": X.share(X.normalize(c), "[0-9]") for n, c in (("url", url), ("title", title), ("text", text))},
        **{f"{n}_missing": (X.normalize(c) == "").cast("double") for n, c in (("title", title), ("text", text))},
        **{f"log_{n}_items": F.log1p(F.coalesce(F.col(f"{n}_items"), F.lit(0)).cast("double")) for n in ("group", "domain")},
        **{f"{n}_mean": F.coalesce(F.col(f"{n}_mean"), F.lit(0.0)) for n in ("group", "domain")},
        **{f"cost_to_{n}_mean": X.ratio(cost, F.coalesce(F.col(f"{n}_mean"), F.lit(0.0))) for n in ("group", "domain")},
    }


def group_stats(catalog: DataFrame, group: str, cost: str) -> DataFrame:
    """Items, and mean cost with a missing one counting as 0, of each item's group, joined to the items."""
    stats = catalog.groupBy(group).agg(F.count(F.lit(1)).alias(f"{group}_items"), F.avg(F.coalesce(F.col(cost), F.lit(0.0))).alias(f"{group}_mean"))
    return catalog.join(stats, group, "left")


def counter_features(prefix: str) -> list[Column]:
    """Model inputs of one as-of counter: logs of clicks and sum, average, age, presence."""
    c = lambda n: F.col(f"{prefix}_{n}")
    return [F.log1p(c("clicks")).alias(f"{prefix}_log_clicks"), F.log1p(F.greatest(F.lit(0.0), c("sum"))).alias(f"{prefix}_log_sum"), c("avg"), c("age"), c("present")]


def counter_table(counters: DataFrame, keys: Sequence[str], families: Sequence[str], windows: Sequence[str], zeros: bool = False) -> DataFrame:
    """As-of counters ``(*keys, family, <window>_clicks, ...)`` as one row per key: five model inputs of each family and window.

    A family that a key lacks gives nulls, or with ``zeros`` what no clicks give. Rows are shuffled as they are and become
    columns afterwards, so what is shuffled doesn't grow with the number of columns.
    """
    names = [f"{w}_{c}" for w in windows for c in ("clicks", "sum", "avg", "age", "present")]
    once = counters.select(*keys, "family", *names).repartition(*keys).groupBy(*keys, "family").agg(*(F.max(c).alias(c) for c in names))  # keys may repeat
    rows = once.select(*keys, "family", F.struct(*names).alias("_c")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", "_c"))).alias("_m"))
    rows = rows.select(*keys, *(F.try_element_at("_m", F.lit(f)).alias(f"_{f}") for f in families))
    columns = []
    for f in families:
        for w in windows:
            of = lambda c: F.coalesce(F.col(f"_{f}.{w}_{c}"), F.lit(0)) if zeros else F.col(f"_{f}.{w}_{c}")  # noqa: B023, E731
            columns += [
                F.log1p(of("clicks").cast("double")).alias(f"{f}_{w}_log_clicks"),
                F.log1p(F.greatest(F.lit(0.0), of("sum"))).alias(f"{f}_{w}_log_sum"),
                *(of(c).alias(f"{f}_{w}_{c}") for c in ("avg", "age", "present")),
            ]
    return rows.select(*keys, *columns)


def counter_crosses(a: str, b: str) -> dict[str, Column]:
    """Products and differences of two counters' logs."""
    la, lb = F.log1p(f"{a}_clicks"), F.log1p(f"{b}_clicks")
    return {f"{a}_x_{b}": la * lb, f"{a}_minus_{b}": la - lb, f"{a}_per_{b}": X.ratio(F.col(f"{a}_clicks"), F.col(f"{b}_clicks"))}


def impression_features(stats: DataFrame, end: int) -> DataFrame:
    """Logs, rates, age and window shares of exact-key statistics, with the size of the key's pool."""
    pool = F.count(F.lit(1)).over(Window.partitionBy("key"))
    log = lambda c: F.log1p(F.col(c).cast("double"))
    return stats.select(
        "key",
        "item",
        *(log(c).alias(f"log_{c}") for c in ("shows", "clicks", "value", "shows_7d", "clicks_7d", "shows_42d", "clicks_42d")),
        (F.col("clicks") / (F.col("shows") + 20.0)).alias("ctr20"),
        X.ratio(F.col("value"), F.col("clicks")).alias("mean_value"),
        ((F.lit(end) - F.col("last")) / DAY).alias("age_days"),
        *(X.ratio(F.col(f"{c}_{w}"), F.col(c)).alias(f"{c}_{w}_share") for c in ("shows", "clicks") for w in ("7d", "42d")),
        F.log1p(pool.cast("double")).alias("log_pool"),
    )


def group_weights(rows: DataFrame, quantile: float, floor: float, power: float) -> DataFrame:
    """Per request: its value, capped at a quantile of all, floored, raised to a power, scaled to a mean of 1."""
    sums = rows.groupBy("request").agg(F.sum("cost").alias("_v"))
    cap = interpolated(sums, "_v", [quantile]).select(F.get("values", F.lit(0)).alias("_cap"))
    raw = sums.crossJoin(F.broadcast(cap)).withColumn("_w", F.pow(F.greatest(F.least("_v", "_cap"), F.lit(float(floor))), F.lit(float(power))))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select("request", (F.col("_w") / F.col("_mean")).alias("weight"))


def example_weights(rows: DataFrame, batch: str, power: float, low: float, high: float) -> DataFrame:
    """``(log1p(cost) / lower median of positives of the batch) ** power``, clamped, scaled to a batch mean of 1."""
    logs = rows.withColumn("_l", F.log1p(F.greatest(F.lit(0.0), F.col("cost"))))
    median = logs.filter(F.col("_l") > 0).groupBy(batch).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _l)").alias("_median"))
    joined = logs.join(median, batch, "left")
    raw = F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.coalesce(F.col("_l") / F.col("_median"), F.lit(1.0)), F.lit(float(power)))))
    joined = joined.withColumn("_w", raw)
    return joined.withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(batch))).drop("_l", "_median", "_w")


def standardize(df: DataFrame, columns: Sequence[str], clip: float = 8.0, least: float = 1e-6) -> DataFrame:
    """Columns less their mean by their population deviation, clipped; those that hardly vary are 0.

    All statistics come from one aggregation.
    """
    one = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.avg(F.col(c) * F.col(c)).alias(f"_s_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(one))  # one row
    deviation = {c: F.sqrt(F.greatest(F.lit(0.0), F.col(f"_s_{c}") - F.col(f"_m_{c}") * F.col(f"_m_{c}"))) for c in columns}
    scaled = {c: F.when(deviation[c] > least, F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"_m_{c}")) / deviation[c]))).otherwise(0.0) for c in columns}
    return joined.select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns))


def batch_log_frequency(rows: DataFrame, batch: str, identity: str) -> DataFrame:
    return rows.withColumn("log_frequency", F.log(F.count(F.lit(1)).over(Window.partitionBy(batch, identity)).cast("double")))


def patch_columns(features: DataFrame, donor: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``features`` with ``columns`` from ``donor``; every row must be in both."""
    joined = features.drop(*columns).join(donor.select(*keys, *columns, F.lit(1).alias("_have")), list(keys), "full_outer")
    checked = joined.withColumn("_have", F.when(F.col("_have").isNull(), F.raise_error(F.lit("a row is missing in the donor"))).otherwise(F.col("_have")))
    return checked.filter("_have = 1").select(*features.columns)
