"""Quantiles whose values are cut in pieces."""

import pytest
from pyspark.sql import functions as F


def test_quantiles_cut_their_values_once(spark):
    from rankflow.operators.quantiles import interpolated

    df = spark.range(5000).select(((F.col("id") * 7919) % 4001).cast("double").alias("v"))
    out = interpolated(df, "v", [0.0, 0.5, 0.9, 1.0])
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    ordered = sorted(r.v for r in df.collect())
    assert out.first()[0] == pytest.approx([ordered[0], (ordered[2499] + ordered[2500]) / 2, ordered[4499] + 0.1 * (ordered[4500] - ordered[4499]), ordered[-1]])
