"""Strictly past statistics, requests and time on literal rows."""

import pytest
from pyspark.sql import functions as F

from rankflow.functions.timeops import week_start
from rankflow.operators import history
from rankflow.operators import requests as R
from rankflow.operators.ranking import numbered_many

DAY = 86_400


def counters(spark, events, probe, frozen=None):
    e = spark.createDataFrame([("f", "k", t, c) for t, c in events], "family string, key string, t long, cost double")
    p = spark.createDataFrame([(1, "f", "k", probe)], "id long, family string, key string, t long")
    return history.asof(e, p, {"d7": 7, "all": 0}, frozen).first()


def test_events_of_the_same_second_are_not_seen(spark):
    events = [(100, 10.0), (100, 20.0)]
    assert counters(spark, events, 100).all_clicks == 0
    row = counters(spark, events, 101)
    assert (row.all_clicks, row.all_sum, row.all_avg, row.all_present) == (2, 30.0, 15.0, 1) and row.all_age == pytest.approx(1 / DAY)


def test_untimed_probe_has_the_frozen_cutoff(spark):
    row = counters(spark, [(100, 10.0), (200, 5.0)], None, 150)
    assert (row.all_clicks, row.all_sum) == (1, 10.0)


def test_window_starts_inclusive(spark):
    assert counters(spark, [(1000, 1.0)], 1000 + 7 * DAY).d7_clicks == 1
    assert counters(spark, [(999, 1.0)], 1000 + 7 * DAY).d7_clicks == 0


def test_empty_keys_never_match(spark):
    e = spark.createDataFrame([("f", "", 1, 1.0)], "family string, key string, t long, cost double")
    p = spark.createDataFrame([(1, "f", "", 5), (2, "f", None, 5)], "id long, family string, key string, t long")
    assert [r.all_clicks for r in history.asof(e, p, {"all": 0}).collect()] == [0, 0]


def test_families(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a long, b long").select(history.families({"a": [F.col("a")], "a_b": [F.col("a"), F.col("b")]}).alias("f"))
    assert [tuple(r.f) for r in df.collect()] == [("a", "1"), ("a_b", ""), ("a", "1"), ("a_b", "1|2")]


def temporal(spark, events, requests, mode="clicks", **options):
    e = spark.createDataFrame(events, "key long, item long, t long, cost double")
    r = spark.createDataFrame(requests, "request long, key long, t long")
    out = history.temporal_candidates(e, r, "key", mode, 10, **options)
    got = {}
    for row in out.orderBy("request", "rank").collect():
        got.setdefault(row.request, []).append(row["item"])
    return got


def test_requests_of_one_second_see_nothing_of_each_other(spark):
    events = [(1, 10, 100, 1.0), (1, 20, 100, 1.0)]
    assert temporal(spark, events, [(1, 1, 100), (2, 1, 100), (3, 1, 101)]) == {3: [10, 20]}


def test_untimed_requests_see_all(spark):
    events = [(1, 10, 100, 1.0), (1, 20, 500, 1.0)]
    assert temporal(spark, events, [(1, 1, None), (2, 1, 200)]) == {1: [20, 10], 2: [10]}
    assert temporal(spark, events, [(2, 1, 50)], strict=False) == {2: [20, 10]}


def test_recency_and_mean_modes(spark):
    events = [(1, 1, 100, 99.0), (1, 2, 200, 1.0)]
    assert temporal(spark, events, [(1, 1, 300)], "recency") == {1: [2, 1]}
    events = [(1, 1, 100, 10.0), (1, 1, 110, 10.0), (1, 2, 100, 15.0)]
    assert temporal(spark, events, [(1, 1, 300)], "mean_value") == {1: [2, 1]}
    assert temporal(spark, events, [(1, 1, 300)], least=2) == {1: [1]}


def test_any_partitioning_gives_the_same(spark):
    e = spark.createDataFrame([(1, i % 5, 100 + i % 7, float(i % 3)) for i in range(200)], "key long, item long, t long, cost double")
    r = spark.createDataFrame([(i, 1, 100 + i) for i in range(9)], "request long, key long, t long")
    runs = [sorted(map(tuple, history.temporal_candidates(e.repartition(n), r.repartition(n), "key", "shrunk", 3).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_exact_key_orders(spark):
    end = 100 * DAY
    rows = [("q", 10, 1, 5.0, 90 * DAY)] * 3 + [("q", 20, 0, 5.0, 95 * DAY)] * 2 + [("q", 30, 1, 50.0, 99 * DAY)] + [("q", 30, None, None, None)]
    stats = history.exact_key_stats(spark.createDataFrame(rows, "key string, item long, click long, cost double, t long"), ["key"], end)
    got = {r["item"]: r for r in stats.collect()}
    assert (got[10].shows, got[10].clicks, got[10].value, got[20].clicks, got[30].shows, got[30].shows_7d, got[20].shows_7d, got[10].shows_42d) == (3, 3, 15.0, 0, 2, 1, 2, 3)
    ranked = numbered_many(stats, "key", {m: history.mode_order(m) for m in ("value", "recency")})
    assert {r["item"]: (r["value"], r.recency) for r in ranked.drop("value").join(ranked.select("item", F.col("value")), "item").select("item", "value", "recency").collect()}[30] == (1, 1)


def test_week_start_floors(spark):
    df = spark.createDataFrame([(0,), (345_599,), (345_600,), (950_400,), (1_704_067_200,)], "t long").select(week_start(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [-259_200, -259_200, 345_600, 950_400, 1_704_067_200]


def test_temporal_split_and_crossing(spark):
    df = spark.createDataFrame([(1, 9, 9), (2, 10, 10), (3, 9, 10)], "request long, t_min long, t_max long")
    split = R.temporal_split(df, 10)
    assert [r.part for r in split.orderBy("request").collect()] == ["fit", "holdout", "crossing"]
    with pytest.raises(ValueError):
        R.require_no_crossing(split)
    assert R.require_no_crossing(split.filter("request < 3")).count() == 2


def test_pool_never_gets_labels_injected(spark):
    pool = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "request long, item long, pre_rank long")
    truth = spark.createDataFrame([(1, 30, 5.0)], "request long, item long, cost double")
    out = R.attach_labels(R.freeze_pool(pool, 2), truth).collect()
    assert sorted(r["item"] for r in out) == [10, 20] and sum(r.label for r in out) == 0


def test_labels_first_and_last_cost(spark):
    rows = spark.createDataFrame([(1, 7, 5, 100, 10.0, 1), (1, 8, 6, 90, 20.0, 2), (1, 8, 5, 110, 30.0, 3)], "request long, user long, item long, t long, cost double, line long")
    built = R.build_requests(rows, "line").first()
    assert (built.user, built.t_min, built.t_max, built["items"], built.costs) == (7, 90, 110, [5, 6], [10.0, 20.0])
    arrays = spark.createDataFrame([(1, [5, 6, 5], [1.0, 2.0, 3.0])], "request long, items array<long>, costs array<double>")
    assert {r["item"]: r.cost for r in R.explode_labels(arrays, last_wins=True).collect()} == {5: 3.0, 6: 2.0}


def test_bottom_k_is_stable_as_requests_come(spark):
    base = spark.createDataFrame([(i, 345_600 + i) for i in range(50)], "request long, t long")
    more = spark.createDataFrame([(i, 345_600 + i) for i in range(80)], "request long, t long")
    pick = lambda df: {r.request for r in R.bottom_k(df, F.sha1(F.col("request").cast("string").cast("binary")), 5).collect()}
    assert pick(more) & {*range(50)} <= pick(base)
