"""Truncation by whole requests over all requests, wherever their keys begin."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rankflow.operators.requests import whole_groups
from rankflow.plans import registry

SF = "/root/testdata/sf0.001"


def test_all_requests_are_seen(spark, tmp_path):
    for name in os.listdir(SF):
        if name not in ("lineitem.parquet", "orders.parquet"):
            os.symlink(f"{SF}/{name}", tmp_path / name)
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn(key, F.col(key) + 100000).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = lambda sf, more: sorted((r.request + more, r.item, r.line) for r in registry.QUERIES["group_truncation"](spark, sf).collect())
    expected = rows(SF, 100000)
    assert len(expected) >= 1000 and rows(str(tmp_path), 0) == expected


@pytest.mark.parametrize("least", [0, 1, 37, 500, 10**6])
def test_equal_to_a_running_sum(spark, least):
    rng = random.Random(least)
    keys = sorted(rng.sample(range(-5000, 50000), 60)) + [10**9]
    sizes = {k: rng.randint(1, 20) for k in keys}
    got = whole_groups(spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "request long, i int"), least)
    expected, total = set(), 0
    for k in keys:
        if total < least:
            expected.update((k, i) for i in range(sizes[k]))
        total += sizes[k]
    assert {(r.request, r.i) for r in got.collect()} == expected
