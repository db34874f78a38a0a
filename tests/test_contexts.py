"""What depends on a request's keys alone is found once a context, and large keys are ranked without a task that sees them whole."""

import re

import pytest
from pyspark.sql import functions as F

from rankflow.operators import ranking
from rankflow.plans import base, registry
from rankflow.plans.ranking_queries import fused

SF = "/root/testdata/sf0.001"
SHARED = ["rrf_union", "value_geometry", "source_features", "chained_fill", "feature_table", "feature_patch", "prefix_fill", "cache_parity", "consensus_tail", "final_ranking"]


@pytest.mark.parametrize("name", SHARED)
def test_rows_of_requests_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = re.split(r"\bJoin\b", plan)[0]  # what comes after rows of contexts have become rows of requests
    assert not re.search(r"\b(Window|Aggregate|Sort|Distinct|Repartition\w*)\b", above), above


@pytest.mark.parametrize("name", ["pool_recall", "value_capture", "grid_tune", "grid_refine", "promotion_gate", "retrieval_gate", "bootstrap"])
def test_labels_meet_the_lists_of_contexts(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[row_number\(\) windowspecdefinition\((\w+#\d+L, )?request#\d+L", plan)


def test_a_request_of_several_keys_has_the_candidates_of_all(spark, tmp_path):
    for name in ("lineitem", "customer", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    again = orders.filter("o_orderkey % 3 = 0").withColumn("o_custkey", (F.col("o_custkey") * 7) % 100 + 1)
    orders.unionByName(again).write.parquet(f"{tmp_path}/orders.parquet")
    asked = base.requests(spark, str(tmp_path)).select("request", "key")
    assert asked.groupBy("request").agg(F.countDistinct("key").alias("n")).filter("n > 1").count() > 0
    each = asked.join(base.by_key(spark, str(tmp_path)).filter("rank <= 50"), "key").drop("key")
    rows = lambda df: sorted(map(tuple, df.select("request", "item", "score", "sources", "rank").collect()))
    expected = ranking.fuse(each, {"value": 1.0, "count": 0.7, "recency": 0.4}, 60.0, 50)
    assert rows(base.for_requests(spark, str(tmp_path), fused(spark, str(tmp_path)))) == rows(expected)


@pytest.mark.parametrize("slot", [3, 40, 10**6])
def test_ranks_of_first_equal_full_ranks(spark, slot):
    df = spark.range(400).select((F.col("id") % 3).alias("key"), F.col("id").alias("item"), (F.col("id") * 7 % 11).alias("a"), (F.col("id") * 13 % 5).alias("b"))
    df = df.withColumn("key", F.when(F.col("item") > 390, F.lit(9)).otherwise(F.col("key")))
    orders = {"ra": [F.desc("a"), F.asc("b"), F.asc("item")], "rb": [F.asc("b"), F.desc("item")]}
    rows = lambda x: sorted(map(tuple, x.select("key", "item", "a", "b", "ra", "rb").collect()))
    expected = ranking.any_rank(ranking.numbered_many(df, "key", orders), list(orders), 4)
    assert rows(ranking.ranks_of_first(df, "key", orders, 4, slot=slot)) == rows(expected)


def test_nine_orders_see_no_whole_key(spark):
    plan = registry.QUERIES["exact_key_ranked"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit [key#") == 9  # the only windows over a whole key
    assert len(re.findall(r"windowspecdefinition\(key#\d+L, _slot#", plan)) == 9 and len(re.findall(r"windowspecdefinition\(key#\d+L, (?!_slot#)", plan)) == 9
