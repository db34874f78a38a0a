"""Strictly past-only statistics: as-of counters, temporal candidates, exact-key history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.timeops import DAY, week_start
from rankflow.operators.ranking import numbered_many, ranks_of_first, top_k


def exact_key_stats(impressions: DataFrame, keys: Sequence[str], end: int, windows: Sequence[int] = (7, 42)) -> DataFrame:
    """Shows, clicks, value of clicks, last time, and shows and clicks of recent windows, per key and item."""
    click = F.coalesce(F.col("click"), F.lit(0)) > 0
    cost, t = F.coalesce(F.col("cost"), F.lit(0.0)), F.coalesce(F.col("t"), F.lit(0))
    recent = [f for d in windows for f in (F.count_if(t >= end - d * DAY).alias(f"shows_{d}d"), F.count_if((t >= end - d * DAY) & click).alias(f"clicks_{d}d"))]
    return impressions.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("shows"), F.count_if(click).alias("clicks"), F.sum(F.when(click, cost).otherwise(0.0)).alias("value"), F.max(t).alias("last"), *recent)


def _nine() -> dict[str, list[Column]]:
    last = [F.desc("last"), F.asc("item")]
    ctr = (F.col("clicks") + F.lit(1.0)) / (F.col("shows") + F.lit(20.0))
    return {
        "rank_shows": [F.desc("shows"), F.desc("clicks"), *last],
        "rank_clicks": [F.desc("clicks"), F.desc("shows"), *last],
        "rank_ctr": [F.desc(ctr), F.desc("clicks"), *last],
        "rank_value": [F.desc("value"), F.desc("clicks"), *last],
        "rank_recent": [F.desc("last"), F.desc("clicks"), F.desc("shows"), F.asc("item")],
        "rank_shows_7d": [F.desc("shows_7d"), F.desc("clicks_7d"), *last],
        "rank_clicks_7d": [F.desc("clicks_7d"), F.desc("shows_7d"), *last],
        "rank_shows_42d": [F.desc("shows_42d"), F.desc("clicks_42d"), *last],
        "rank_clicks_42d": [F.desc("clicks_42d"), F.desc("shows_42d"), *last],
    }


def nine_orders(stats: DataFrame, keys: Sequence[str], first: int | None = None) -> DataFrame:
    """Ranks by shows, clicks, smoothed CTR, value, recency and by recent shows and clicks.

    With ``first``, only the rows that one of the orders has among its first so many, without a task that sees a whole key.
    """
    return numbered_many(stats, keys, _nine()) if first is None else ranks_of_first(stats, keys, _nine(), first)


def mode_order(mode: str) -> list[Column]:
    """Orders over exact-key statistics; ``ctr`` has no added click."""
    ctr = F.col("clicks") / (F.col("shows") + F.lit(20.0))
    mean = F.when(F.col("clicks") > 0, F.col("value") / F.col("clicks")).otherwise(0.0)
    first = {
        "shows": ["shows", "clicks"],
        "clicks": ["clicks", "shows"],
        "ctr": [ctr, "clicks"],
        "value": ["value", "clicks"],
        "mean_value": [mean, "clicks"],
        "recency": ["last", "clicks"],
        "shows_7d": ["shows_7d", "clicks_7d"],
        "clicks_7d": ["clicks_7d", "shows_7d"],
        "clicks_42d": ["clicks_42d", "shows_42d"],
    }[mode]
    return [*(F.desc(c) if isinstance(c, str) else c.desc() for c in first), F.desc("last"), F.asc("item")]


def click_score(mode: str) -> Column:
    """Scores of click history ``(n, value, last)``."""
    return {
        "value": F.col("value"),
        "count": F.col("n").cast("double"),
        "recency": F.col("last").cast("double"),
        "count_cost": F.log1p("n") + 0.25 * F.log1p(F.when(F.col("n") > 0, F.col("value") / F.col("n")).otherwise(0.0)),
    }[mode]


def two_grains(clicks: DataFrame, query: str, region: str, k: int) -> DataFrame:
    """Click statistics by query and by query and region in one pass, the first ``k`` of each key.

    ``grain`` names the key; the region of the query grain is 0.
    """
    both = clicks.withColumn("_g", F.explode(F.array(F.struct(F.lit("query").alias("grain"), F.lit(0).cast("long").alias("_r")), F.struct(F.lit("query_region").alias("grain"), F.col(region).cast("long").alias("_r")))))
    stats = both.groupBy("_g.grain", F.col(query).alias("query"), F.col("_g._r").alias("region"), "item").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("value"), F.max("t").alias("last"))
    return top_k(stats, ["grain", "query", "region"], [F.desc(F.round("value", 6)), F.desc("n"), F.desc("last"), F.asc("item")], k)


def asof(events: DataFrame, probes: DataFrame, windows: Mapping[str, int], frozen: int | None = None, hot: int | None = None) -> DataFrame:
    """Counters of ``events (family, key, t, cost)`` for ``probes (id, family, key, t)``, strictly before the probe.

    A window of d days holds events with ``t - d * 86400 <= event < t``; 0 days are all before. A probe without time has
    the ``frozen`` cutoff. Columns by window name: clicks, sum, avg, age in days, present; zeros without events. Events
    of the probe's own second are not seen, nor events without time. Empty keys never match. Repeated probes are
    answered alike; without events or probes the result has zeros or no rows.

    Events and probes of a key meet in one shuffle, in one window ordered by time. Keys of buckets with more than ``hot``
    rows are dealt out by spans of time, so that the window over a hot key is many windows: their events are first summed
    by second, and each span holds its own events, those of the span before (no window is longer than a span), and one
    row with what all earlier spans sum to.
    """
    hot = HOT if hot is None else hot
    blank = F.coalesce(F.col("key"), F.lit("")) == ""
    width = max([*windows.values(), 0]) * DAY or 28 * DAY
    span = F.floor(F.col("t") / width)
    bucket = F.pmod(F.xxhash64("family", "key"), F.lit(BUCKETS)).cast("int").alias("bucket")
    seen = events.filter(~blank & F.col("t").isNotNull()).select("family", "key", "t", F.coalesce("cost", F.lit(0.0)).alias("v"), bucket)
    time = F.coalesce("t", F.lit(frozen)).cast("long")
    p = probes.select("family", F.when(~blank & time.isNotNull(), F.col("key")).alias("key"), time.alias("t"), "id").withColumn("bucket", bucket)
    rows = seen.select("family", "bucket").unionByName(p.filter("key is not null").select("family", "bucket"))
    large = rows.groupBy("family", "bucket").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot).select("family", "bucket", F.lit(True).alias("hot"))
    mark = lambda df: df.join(F.broadcast(large), ["family", "bucket"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("bucket")  # noqa: E731  # a row for each ``hot`` rows
    seen, p = mark(seen), mark(p)

    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    seconds = seen.filter("hot").groupBy("family", "key", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).withColumn("span", span)
    asked = p.filter("hot and key is not null").select("family", "key", span.alias("span")).distinct()
    sums = seconds.groupBy("family", "key", "span").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("t").alias("last"), F.lit(0).alias("asked"))
    spans = sums.unionByName(asked.select("family", "key", "span", zero.alias("n"), F.lit(0.0).alias("v"), none.alias("last"), F.lit(1).alias("asked")))
    spans = spans.groupBy("family", "key", "span").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("last").alias("last"), F.max("asked").alias("asked"))
    earlier = Window.partitionBy("family", "key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    before = spans.select("family", "key", "span", "asked", F.sum("n").over(earlier).alias("all_n"), F.sum("v").over(earlier).alias("all_v"), F.max("last").over(earlier).alias("all_last")).filter("asked = 1 and all_n > 0")

    # What a row is: a probe, an event, an event of the span before, all earlier spans.
    probe, event, near, far = 0, 1, 2, 3
    nobody = F.lit(None).cast(p.schema["id"].dataType)
    row = lambda df, slot, t, n, v, last, kind, id=nobody: df.select("family", "key", slot.cast("long").alias("slot"), t.alias("t"), n.cast("long").alias("n"), v.alias("v"), last.alias("last"), F.lit(kind).cast("byte").alias("kind"), id.alias("id"))
    t, n, v = F.col("t"), F.col("n"), F.col("v")
    alone = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))  # of probes that nothing matches
    both = row(p, F.when(F.col("key").isNull(), alone).when(F.col("hot"), span).otherwise(0), t, F.lit(None), F.lit(None).cast("double"), none, probe, F.col("id"))
    both = both.unionByName(row(seen.filter("not hot"), F.lit(0), t, F.lit(1), v, none, event)).unionByName(row(seconds, F.col("span"), t, n, v, none, event))
    both = both.unionByName(row(before, F.col("span"), F.col("span") * width - 1, F.col("all_n"), F.col("all_v"), F.col("all_last"), far))
    if any(windows.values()):
        both = both.unionByName(row(seconds, F.col("span") + 1, t, n, v, none, near))
    columns, kind = [], F.col("kind")
    for name, days in windows.items():
        w = Window.partitionBy("family", "key", "slot").orderBy("t").rangeBetween(-days * DAY if days else Window.unboundedPreceding, -1)
        of = lambda c: F.when(kind.isin([event, near] if days else [event, far]), c)  # noqa: B023, E731
        clicks = F.coalesce(F.sum(of(n)).over(w), zero)
        total = F.coalesce(F.sum(of(v)).over(w), F.lit(0.0))
        last = F.max(of(F.coalesce("last", "t"))).over(w)
        columns += [
            clicks.alias(f"{name}_clicks"),
            total.alias(f"{name}_sum"),
            F.when(clicks > 0, total / clicks).otherwise(0.0).alias(f"{name}_avg"),
            F.coalesce((F.col("t") - last) / DAY, F.lit(0.0)).alias(f"{name}_age"),
            (clicks > 0).cast("int").alias(f"{name}_present"),
        ]
    names = [f"{name}_{c}" for name in windows for c in ("clicks", "sum", "avg", "age", "present")]
    return both.select("family", "key", "id", "kind", *columns).filter(kind == probe).select("family", "key", "id", *names)


#: Buckets of keys whose rows are counted, of each family, and rows from which a bucket's keys are hot.
BUCKETS, HOT = 4096, 500_000


def families(parts: Mapping[str, Sequence[Column]]) -> Column:
    """``(family, key)`` for each family: its components joined by ``|``, empty if one is null or empty."""
    out = []
    for name, columns in parts.items():
        texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
        empty = texts[0] == ""
        for text in texts[1:]:
            empty = empty | (text == "")
        out.append(F.struct(F.lit(name).alias("family"), F.when(empty, F.lit("")).otherwise(F.concat_ws("|", *texts)).alias("key")))
    return F.explode(F.array(*out))


def past_weeks(events: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """Events of the weeks before the probe's week: ``id``, ``clicks``, ``value``."""
    weekly = events.groupBy(key, week_start(F.col("t")).alias("week")).agg(F.count(F.lit(1)).alias("_n"), F.sum("cost").alias("_v"), F.lit(None).cast(probes.schema["id"].dataType).alias("id"))
    asked = probes.select(key, week_start(F.col("t")).alias("week"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_v"), "id")
    w = Window.partitionBy(key).orderBy("week").rangeBetween(Window.unboundedPreceding, -1)
    out = weekly.select(key, "week", "_n", "_v", "id").unionByName(asked)
    out = out.withColumn("clicks", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("value", F.coalesce(F.sum("_v").over(w), F.lit(0.0)))
    return out.filter("id is not null").select("id", key, "clicks", "value")


def score(mode: str, prior: float = 20.0) -> Column:
    """Of an item's past ``n, value, last``: recency, clicks, value, mean value, or value shrunk by a prior."""
    n = F.col("n")
    return {
        "recency": F.col("last").cast("double"),
        "clicks": n.cast("double"),
        "value": F.col("value"),
        "mean_value": F.col("value") / n,
        "shrunk": F.col("value") * n / (n + F.lit(prior)),
    }[mode]


#: Levels of the tree of time below which a node spans one second; its root spans about two thousand years.
LEVELS = 36


def cover(start: Column, end: Column) -> Column:
    """The few nodes ``(level, node)`` that cover the seconds from ``start`` up to ``end`` exactly, two a level at most.

    Node n of level l spans seconds ``n * 2**l`` up to ``(n + 1) * 2**l``; times are 0 or more.
    """

    def at(level):
        half = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low = F.call_function("shiftright", start + half - 1, level)
        high = F.call_function("shiftright", end, level)
        take = lambda odd, node: F.when((low < high) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), node.alias("node")))
        return F.array(take(low, low), take(high, high - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)), lambda x: x.isNotNull())


def first_at(states: DataFrame, requests: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` of the states that hold at each request's time: ``request`` and the columns of ``states``, ``rank``.

    ``states`` has ``key``, ``start`` and ``end``, the seconds in which a state holds (no end: for ever); ``requests``
    has ``request``, ``key`` and ``t``. Each state is filed under the few nodes of the tree of time that cover it, each
    node keeps its first ``k``, and a request asks the nodes above its second: at most ``k`` rows of each, so neither
    the items of a key nor its requests meet one by one. Requests of one key and second are answered once.
    """
    times = requests.filter(F.col(key).isNotNull() & F.col("t").isNotNull())
    origin = times.agg(F.min("t").alias("_origin"))
    filed = states.crossJoin(F.broadcast(origin))  # one row
    start, end = F.greatest(F.col("start") - F.col("_origin"), F.lit(0)), F.coalesce(F.col("end") - F.col("_origin"), F.lit(1 << LEVELS))
    filed = filed.filter(end > start).withColumn("_at", F.explode(cover(start, end))).drop("start", "end", "_origin")
    firsts = top_k(filed, [key, "_at"], order, k).drop("rank")
    asked = times.select(key, "t").distinct().crossJoin(F.broadcast(origin))  # one row
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    asked = asked.withColumn("_l", levels).select(key, "t", F.struct(F.col("_l").alias("level"), F.expr("shiftright(t - _origin, _l)").alias("node")).alias("_at"))
    best = top_k(asked.join(firsts, [key, "_at"]).drop("_at"), [key, "t"], order, k)
    return times.select("request", key, "t").join(best, [key, "t"])


def temporal_candidates(events: DataFrame, requests: DataFrame, key: str, mode: str, k: int, least: int = 1, strict: bool = True, prior: float = 20.0) -> DataFrame:
    """The first ``k`` items by past events of a request's key.

    ``events (key, item, t, cost)``; ``requests (request, key, t)``. A request sees events strictly before its time, and
    all of them if it has none or ``strict`` is off (frozen state). Ties: more clicks, later, smaller item. Null keys
    never match, events without time are seen by requests without time only, repeated requests are answered each.

    Events of a key and item are summed by second; what an item's sums are from one event to the next is a state, and
    ``first_at`` finds the best states of each request's second. Modes are free to rise and fall.
    """
    known = events.filter(F.col(key).isNotNull())
    order = [F.desc("score"), F.desc("n"), F.desc("last"), F.asc("item")]
    judged = lambda df: df.withColumn("value", F.round("value", 6)).filter(F.col("n") >= least).withColumn("score", F.round(score(mode, prior), 9))
    final = judged(known.groupBy(key, "item").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("value"), F.max("t").alias("last")))
    final = top_k(final, key, order, k)
    columns = ["request", "item", "n", "value", "last", "score", "rank"]
    if not strict:
        return requests.filter(F.col(key).isNotNull()).select("request", key).join(final, key).select(*columns)
    seconds = known.filter(F.col("t").isNotNull()).groupBy(key, "item", "t").agg(F.count(F.lit(1)).alias("_n"), F.sum("cost").alias("_v"))
    w = Window.partitionBy(key, "item").orderBy("t")  # a row a second of one item
    sums = seconds.select(key, "item", F.sum("_n").over(w).alias("n"), F.sum("_v").over(w).alias("value"), F.col("t").alias("last"), (F.col("t") + 1).alias("start"), (F.lead("t").over(w) + 1).alias("end"))
    timed = first_at(judged(sums), requests, key, order, k).select(*columns)
    untimed = requests.filter(F.col(key).isNotNull() & F.col("t").isNull()).select("request", key).join(final, key).select(*columns)
    return timed.unionByName(untimed)
