"""Permutations and samples of requests in one shuffle."""

from pyspark.sql import functions as F

from rankflow.operators import stats


def test_importance_of_scored_requests_equals_that_of_all(spark):
    rows = spark.range(300).select((F.col("id") % 30).alias("request"), F.col("id").alias("item"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 89).cast("double").alias("y"))
    rows = rows.withColumn("cost", F.when((F.col("request") % 4 == 0) & (F.col("item") % 7 == 0), 5.0).otherwise(0.0))
    flagged = rows.withColumn("flag", F.col("request") % 4 == 0)
    score = lambda df: df.withColumn("score", F.col("x") + 0.5 * F.col("y"))
    of = lambda df, **more: {r.feature: round(r["drop"], 12) for r in stats.permutation_importance(df, ["x", "y"], score, 2, repeats=2, **more).collect()}
    assert of(rows) == of(flagged, scored="flag") and set(of(rows)) == {"x", "y"}


def test_listwise_sample_shuffles_once(spark):
    pool = spark.range(100).select((F.col("id") % 5).alias("request"), F.col("id").alias("item"), F.col("id").alias("pre_rank"), (F.col("id") % 9 == 0).cast("int").alias("label"), F.lit(4.0).alias("cost"))
    plan = stats.listwise_sample(pool, 2, 3, 2)._jdf.queryExecution().sparkPlan().toString()
    assert "Union" not in plan and plan.count("Range (") == 1
