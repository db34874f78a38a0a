"""Every query against its SQL on the smallest tables, and what has no SQL against its own contract."""

import pytest
from compare import connection, difference

import __spark_entry__ as entry
from rankflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_repeats(spark):
    runs = [registry.QUERIES["bootstrap"](spark, SF).first().asDict() for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]["low_95"] <= runs[0]["median"] <= runs[0]["high_95"]


def test_listwise_sample(spark):
    rows = registry.QUERIES["listwise_sample"](spark, SF).collect()
    per = {}
    for r in rows:
        per.setdefault(r.request, []).append(r)
    assert all(sum(r.role == "hard" for r in x) <= 16 and sum(r.role == "tail" for r in x) <= 8 for x in per.values())
    assert all(abs(sum(r.target for r in x) - 1) < 1e-6 or sum(r.target for r in x) == 0 for x in per.values())


def test_importance_of_the_main_term(spark):
    drops = {r.feature: r["drop"] for r in registry.QUERIES["importance"](spark, SF).collect()}
    assert set(drops) == {"pre_rank", "model_a", "model_b"}
