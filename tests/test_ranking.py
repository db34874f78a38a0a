"""Contracts of fusion, re-ranking and lists on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from rankflow.operators import metrics, ranking
from rankflow.operators.validate import output_report, require


def lists(spark, rows, names="source string, request long, item long, rank long"):
    return spark.createDataFrame(rows, names)


def order(df, by="rank", item="item"):
    return [r[item] for r in df.orderBy(by).collect()]


def test_rrf_orders_by_score(spark):
    rows = [("a", 1, i, r) for r, i in enumerate([1, 2], 1)] + [("b", 1, i, r) for r, i in enumerate([2, 3], 1)]
    out = ranking.fuse(lists(spark, rows), {"a": 1.0, "b": 1.0}, 10.0)
    assert order(out)[0] == 2 and {r.item: r.sources for r in out.collect()} == {1: 1, 2: 2, 3: 1}


def test_quota_counts_distinct_items_and_keeps_ranks(spark):
    rows = [("a", 1, 1, 1), ("a", 1, 1, 2), ("a", 1, 2, 3)]
    kept = ranking.first_occurrences(lists(spark, rows), ["source", "request"], quota=2)
    assert {r.item: r["rank"] for r in kept.collect()} == {1: 1, 2: 3}
    one = ranking.fuse(lists(spark, [("a", 1, 7, 3)]), {"a": 1.0}, 10.0).first()
    assert one.score == pytest.approx(1 / 13, abs=1e-11)


def test_region_and_query_backoff(spark):
    rows = [("region", 1, 10, 1), ("region", 1, 20, 2), ("query", 1, 20, 1), ("query", 1, 30, 2)]
    assert order(ranking.fuse(lists(spark, rows), {"region": 1.0, "query": 0.7}, 20.0)) == [20, 10, 30]


def test_list_fusion_ties_by_best_rank_and_zero_weights(spark):
    rows = [("a", 1, i, r) for r, i in enumerate([1, 2, 3], 1)] + [("b", 1, i, r) for r, i in enumerate([3, 4, 5], 1)] + [("c", 1, 99, 1)]
    assert order(ranking.fuse(lists(spark, rows), {"a": 1.0, "b": 1.0, "c": 0.0}, 10.0, 4, ties="best")) == [3, 1, 2, 4]


@pytest.mark.parametrize("weights,k", [({"a": -1.0}, 10), ({"a": 1.0}, 0), ({"a": 0.0}, 10)])
def test_bad_weights(weights, k):
    with pytest.raises(ValueError):
        ranking.rrf_parts(weights, k)


def pool(spark):
    return spark.createDataFrame([(1, 10, 3, 1), (1, 20, 1, 2), (1, 30, 2, 3)], "request long, item long, pre_rank long, model long")


@pytest.mark.parametrize("weight,expected", [(1.0, [10, 20, 30]), (0.0, [20, 30, 10]), (0.5, [20, 10, 30])])
def test_linear_blend(spark, weight, expected):
    assert order(ranking.linear_blend(pool(spark), {"model": weight, "pre_rank": 1 - weight})) == expected


def test_two_models(spark):
    df = pool(spark).withColumn("other", F.lit(4) - F.col("model"))
    assert order(ranking.two_model_blend(df, "model", "other", 0.5, 1.0)) == [20, 30, 10]


def test_value_geometry_promotes_in_the_head_only(spark):
    df = spark.createDataFrame([(1, 10, 1, 0.0), (1, 20, 2, 0.0), (1, 30, 3, 1e5), (1, 40, 4, 1e9)], "request long, item long, rank long, cost double")
    out = ranking.value_geometry(df, 1.0, 1e4, 3)
    assert order(out, "new_rank") == [30, 10, 20, 40]
    assert order(ranking.value_geometry(df, 0.0, 1e4, 3), "new_rank") == [10, 20, 30, 40]
    with pytest.raises(ValueError):
        ranking.value_geometry(df, -1.0, 1e4, 3)


@pytest.mark.parametrize("weight,expected", [(0.0, [10, 20, 30]), (1.0, [30, 20, 10])])
def test_exact_blend(spark, weight, expected):
    exact = spark.createDataFrame([(1, i, r) for r, i in enumerate([10, 20, 30], 1)], "request long, item long, rank long")
    model = spark.createDataFrame([(1, 30, 1), (1, 20, 2), (1, 10, 3)], "request long, item long, rank long")
    assert order(ranking.exact_blend(exact, model, weight), "new_rank") == expected


def test_consensus_tail_keeps_its_head(spark):
    names = "request long, item long, rank long, cost double"
    control = spark.createDataFrame([(1, i, i, 1.0) for i in range(1, 51)], names)
    other = spark.createDataFrame([(1, 200 - i, i, 1.0) for i in range(1, 51)], names)
    out = ranking.consensus_tail(control, other, 10, 50, 0.9, 20.0)
    got = order(out)
    assert got[:10] == list(range(1, 11)) and len(set(got)) == 50 and any(i > 100 for i in got[10:])
    assert order(ranking.consensus_tail(control, control, 10, 50, 0.5, 20.0)) == list(range(1, 51))


@pytest.mark.parametrize("scores,last", [([1.0, 1.0, 1.0], 100), ([9.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 50), ([1.0], 50)])
def test_lexical_tail(spark, scores, last):
    control = spark.createDataFrame([(1, i, i) for i in range(1, 51)], "request long, item long, rank long")
    scored = spark.createDataFrame([(1, 100 + k, k + 1, s) for k, s in enumerate(scores)], "request long, item long, rank long, score double")
    out = ranking.replace_tail(control, scored, 50, 20, 2.0)
    assert order(out)[-1] == last and order(out)[:49] == list(range(1, 50))
    if len(scores) == 1:
        assert math.isinf(ranking.confidence(scored, 20).first().z)


def test_fill_and_dense_ranks_after_exclusion(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "request long, item long, rank long")
    b = spark.createDataFrame([(1, 2, 1), (1, 5, 2), (1, 6, 3)], "request long, item long, rank long")
    assert order(ranking.fill(a, b, 2, 4)) == [1, 2, 5, 6]
    out = ranking.without(a, spark.createDataFrame([(2,)], "item long"))
    assert [(r.item, r["rank"]) for r in out.orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_frequency_restores_unseen_items_to_their_score(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 3, 0.1)], "request long, item long, rank long, score double")
    counts = spark.createDataFrame([(2, 100), (3, 10**9)], "item long, n long")
    assert order(ranking.restore_frequency(df, counts, 0.1, 2), "new_rank") == [2, 1, 3]


def test_simplex():
    found = ranking.simplex(3, 0.5)
    assert len(found) == 6 and all(sum(w) == pytest.approx(1) for w in found)
    assert all(w[0] >= 0.5 for w in ranking.simplex(3, 0.5, 0.5))


def test_complementarity_gate(spark):
    truth = spark.createDataFrame([(1, 1, 20.0), (1, 2, 20.0), (1, 3, 100.0)], "request long, item long, cost double")
    cand = lists(spark, [("old", 1, 1, 1), ("new", 1, 2, 1), ("new", 1, 3, 2)])
    got = {r.source: r for r in metrics.complementarity(truth, cand, ["old", "new"], ["old"], 0.9, 10).collect()}
    assert (got["new"].new_hits, got["new"].new_cost, got["new"].high_hits, got["old"].unique_hits) == (2, 120.0, 1, 1)


def test_recall_counts_missed_truth(spark):
    truth = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 9, 4.0)], "request long, item long, cost double")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 1, 5)], "request long, item long, rank long")
    got = {r.k: (r.recall, r.cost_recall) for r in metrics.recall(truth, ranked, (1, 10)).collect()}
    assert got[1] == pytest.approx((1 / 3, 3 / 8)) and got[10] == pytest.approx((2 / 3, 4 / 8))
    assert metrics.recall(truth.limit(0), ranked, (1,)).first().recall == 0


@pytest.mark.parametrize("q,expected", [(0.0, 1.0), (0.5, 3.0), (0.51, 4.0), (1.0, 5.0)])
def test_ceil_rank_quantile(spark, q, expected):
    df = spark.createDataFrame([(float(x),) for x in (3, 1, 2, 5, 4)], "cost double")
    assert metrics.ceil_rank_quantile(df, "cost", q).first().threshold == expected


def test_promotion_rule(spark):
    trials = spark.createDataFrame([("a", 0.1, 0.3, 0.2), ("b", 0.2, 0.2, 0.2), ("c", -0.1, 0.9, 0.9)], "trial string, early double, late double, full double")
    assert metrics.promotion(trials, 0.0).first().trial == "a"


def test_output_report(spark):
    requests = spark.createDataFrame([(1,), (2,)], "request long")
    catalog = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    good = spark.createDataFrame([(r, i, i) for r in (1, 2) for i in (1, 2)], "request long, item long, rank long")
    assert require(output_report(good, requests, catalog, 2)).count() == 1
    bad = spark.createDataFrame([(1, 9, 1), (1, 9, 3), (3, 1, 1)], "request long, item long, rank long")
    got = output_report(bad, requests, catalog, 2).first().asDict()
    assert got == {"missing_requests": 1, "unknown_requests": 1, "short_lists": 1, "long_lists": 0, "repeated_items": 1, "unknown_items": 2, "bad_ranks": 1}
    with pytest.raises(ValueError):
        require(output_report(bad, requests, catalog, 2))
