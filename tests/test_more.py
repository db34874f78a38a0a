"""Model scoring, keyed hashes, walk-forward, caches, plug-ins, streams and resampling."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.functions import hashing as H
from rankflow.functions.timeops import FIRST_MONDAY, WEEK
from rankflow.operators import metrics, retrieval
from rankflow.operators.stats import bootstrap, shuffled
from rankflow.operators.validate import parity, temporal_guards
from rankflow.operators.walk_forward import contiguous, walk
from rankflow.sources.cache import cached, fingerprint


def test_keyed_hashes(spark):
    df = spark.createDataFrame([(str(i),) for i in range(400)], "k string")
    row = df.filter("k = '7'").select(H.blake2b_64(F.col("k")).alias("h")).first()
    assert row.h == int.from_bytes(hashlib.blake2b(b"7", digest_size=8).digest(), "little", signed=True)
    kept = df.filter(H.sampled(F.col("k"), "s", 0.25)).count()
    assert 60 < kept < 140 and kept == df.repartition(7).filter(H.sampled(F.col("k"), "s", 0.25)).count()
    out = spark.createDataFrame([(None,), ("",), ("x",)], "k string").select(H.categorical(F.col("k"), 9).alias("h")).collect()
    assert [r.h for r in out[:2]] == [0, 0] and 1 <= out[2].h <= 9
    got = spark.createDataFrame([(3, -5)], "a long, b long").select(H.cross_64("a", "b").alias("x")).first().x
    want = (3 * 0x9E3779B97F4A7C15 % 2**64) ^ ((-5 % 2**64) * 0xC2B2AE3D27D4EB4F % 2**64)
    assert got % 2**64 == want


def test_model_scores(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "item long, x double")
    out = retrieval.score_rows(rows, lambda: 2.0, lambda m, b: m * b["x"].to_numpy() + 1, ["x"])
    assert {r["item"]: r.score for r in out.collect()} == {i: 2.0 * i + 1 for i in range(10)}


def test_vector_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    data = np.random.default_rng(1).normal(size=(90, 6)).round(3)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<double>")
    out = retrieval.vector_top_k(frame.filter("id % 10 = 0"), frame, 4).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["item"])
    for q, items in got.items():
        assert items == sorted(range(90), key=lambda i: (-(data[i] @ data[q]), i))[:4]
    assert len(got) == 9


def test_registered_sources(spark):
    retrieval.register("test-source", lambda asked: asked.select("request", F.lit(1).alias("item"), F.lit(1).alias("rank"), F.lit(0.5).alias("score")))
    asked = spark.createDataFrame([(5,)], "request long")
    assert retrieval.retrieve(asked, ["test-source"]).first().source == "test-source"
    with pytest.raises(ValueError):
        retrieval.register("test-source", None)


def test_walk_forward_sees_only_earlier_weeks(spark):
    w = [FIRST_MONDAY + k * WEEK for k in range(3)]
    events = spark.createDataFrame([(10, w[0] + 5), (20, w[1]), (30, w[2] + 1)], "item long, t long")
    requests = spark.createDataFrame([(k, w[k] + 100) for k in range(3)], "request long, t long")
    truth = spark.createDataFrame([(1, 10, 2.0), (2, 30, 1.0)], "request long, item long, cost double")
    rank = lambda past, asked: asked.crossJoin(past.select("item")).select("request", "item", F.col("item").alias("pre_rank"))
    got = {week: sorted((r["item"], r.label) for r in pool.collect()) for week, pool in walk(events, requests, truth, w, rank, 10)}
    assert got == {w[0]: [], w[1]: [(10, 1)], w[2]: [(10, 0), (20, 0)]}
    with pytest.raises(ValueError):
        contiguous([w[0], w[2]])
    with pytest.raises(ValueError):
        contiguous([w[0] + 1])


def test_cache_is_reused_until_its_key_changes(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls) * 10)

    path = str(tmp_path / "t")
    a, b = fingerprint("s", 1, {"k": 1}, {}), fingerprint("s", 2, {"k": 1}, {})
    assert cached(spark, path, a, build).count() == cached(spark, path, a, build).count() == 10 and len(calls) == 1
    assert a != b and cached(spark, path, b, build).count() == 20 and len(calls) == 2


def test_choices(spark):
    trials = spark.createDataFrame([("rrf", 0.5, 0.1), ("model", 0.5, 0.1), ("low", 0.9, 0.0)], "trial string, a double, b double")
    assert metrics.best_trial(trials, "a", "b", floors={"b": 0.05}, prefer="rrf").first().trial == "rrf"
    assert metrics.best_trial(trials, "a", "b", floors={"b": 0.05}, prefer="model").first().trial == "model"
    old, new = spark.createDataFrame([(0.5, 0.7)], "short double, long double"), spark.createDataFrame([(0.52, 0.69, 0.6)], "short double, long double, union double")
    assert metrics.retrieval_gate(old, new, 0.01, 0.02, 0.05).first().accepted and not metrics.retrieval_gate(old, new, 0.05, 0.02, 0.05).first().accepted


def test_parity_and_guards(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "request long, item long")
    assert parity(a, a.repartition(3)).count() == 0
    assert {(r["item"], r.side) for r in parity(a, a.filter("item = 1").union(spark.createDataFrame([(1, 9)], "request long, item long"))).collect()} == {(2, "left"), (9, "right")}
    oof = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "request long, t long")
    row = temporal_guards(oof, spark.createDataFrame([(2, 8)], "request long, t long")).first()
    assert (row.repeated, row["shared"], row.ok) == (1, 1, True)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, 10.0, float(i % 3), float(i % 4)) for i in range(40)], "user long, cost double, old double, new double")
    runs = [sorted((r.replicate, round(r.delta, 9)) for r in bootstrap(df.repartition(n), "cost", "old", "new", 50).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 50


def test_shuffle_is_decided_by_the_seed(spark):
    df = spark.range(50)
    orders = [[r.id for r in shuffled(df.repartition(n), ["id"], s).collect()] for n, s in ((1, 1), (6, 1), (1, 2))]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == list(range(50))


def test_order_statistics(spark):
    from rankflow.operators.quantiles import interpolated, quantiles

    rng = np.random.default_rng(2)
    values = np.round(np.concatenate([rng.normal(0, 100, 3000), np.full(2000, 7.0), rng.pareto(1, 1000)]), 3)
    frame = spark.createDataFrame([(float(v), "clash") for v in values] + [(None, "x")], "x double, _value string").repartition(7)
    shares = [0.0, 0.1, 0.5, 0.505, 0.9, 0.999, 1.0]
    got = interpolated(frame, "x", shares).first()["values"]
    assert np.allclose(got, np.quantile(values, shares), rtol=1e-12)
    row = quantiles(frame, "x", [0.25]).first()
    assert row.upper == np.sort(values)[int(np.ceil(0.25 * (len(values) - 1)))] and interpolated(frame.limit(0), "x", [0.5]).first()["values"] == []


def test_reports_scopes_and_parts(spark, tmp_path):
    from rankflow.sources import tables

    frame = spark.createDataFrame([(1, "full"), (2, "full")], "n long, scope string")
    assert tables.write_report(frame, str(tmp_path / "r"), "csv") == 2 and len(list((tmp_path / "r").glob("*.csv"))) == 1
    assert tables.write_report(frame, str(tmp_path / "j"), "json") == 2 and spark.read.json(str(tmp_path / "j")).count() == 2
    for bad in ({"kind": "xml"}, {"most": 1}):
        with pytest.raises(ValueError):
            tables.write_report(frame, str(tmp_path / "x"), **bad)
    assert tables.require_scope(frame, "full").columns == ["n"] and tables.require_scope(frame, "full").count() == 2
    for rows in (frame, spark.createDataFrame([(1, None)], "n long, scope string")):
        with pytest.raises(Exception, match="asked for scope offline"):
            tables.require_scope(rows, "offline").collect()
    spark.range(2).write.parquet(str(tmp_path / "p" / "a"))
    spark.range(3).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "p" / "b"))
    both = tables.parts(spark, [str(tmp_path / "p" / x) for x in "ab"])
    assert both.count() == 5 and both.filter("more is null").count() == 2 and both.columns == ["id", "more", "part"]


def test_compatibility_forms_and_word_tokens(spark):
    from rankflow.functions import text as X

    row = spark.createDataFrame([("ﬁne Ⅳ ё２", None)], "a string, b string").select(X.normalize(F.col("a"), compose=True).alias("n"), X.tokens(F.col("a"), fold=False).alias("w"), *(c.alias(k) for k, c in X.normalizers(F.col("b")).items())).first()
    assert row.n == "fine iv е2" and row.w == ["ne", "ё"] and {row[k] for k in ("raw", "trim_lower", "nfkc", "whitespace", "project", "canonical")} == {""}


def test_poisson_draws_have_their_mean(spark):
    from rankflow.operators.stats import poisson_bounds

    bounds = poisson_bounds()
    assert bounds == sorted(bounds) and abs(bounds[0] / 2**32 - np.exp(-1)) < 1e-9 and len(bounds) > 8
    assert abs(sum(1 - b / 2**32 for b in bounds) - 1) < 1e-6


def test_tree_of_time_covers_exactly(spark):
    from rankflow.operators.history import LEVELS, cover

    rng = np.random.default_rng(4)
    rows = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 2000, 200), rng.integers(0, 900, 200))] + [(0, 1 << LEVELS), (5, 5), (3, 1 << LEVELS)]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in found:
        spans = sorted((x.node << x.level, (x.node + 1) << x.level) for x in r.c)
        assert sum(hi - lo for lo, hi in spans) == r.b - r.a and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert not spans or (spans[0][0], spans[-1][1]) == (r.a, r.b)


@pytest.mark.parametrize("mode", ["recency", "clicks", "value", "mean_value", "shrunk"])
def test_temporal_candidates_equal_brute_force(spark, mode):
    from rankflow.operators import history

    rng = np.random.default_rng(6)
    events = [(int(rng.integers(0, 3)) or None, int(rng.integers(0, 12)), int(t) if rng.random() > 0.05 else None, float(rng.integers(1, 50))) for t in rng.integers(50, 400, 300)]
    asked = [(i, int(rng.integers(1, 4)), int(t) if rng.random() > 0.1 else None) for i, t in enumerate(rng.integers(40, 420, 60))]
    e = spark.createDataFrame(events, "key long, item long, t long, cost double").repartition(5)
    r = spark.createDataFrame([*asked, asked[0], (99, None, 100)], "request long, key long, t long")
    got = sorted((x.request, x["rank"], x["item"], x.n) for x in history.temporal_candidates(e, r, "key", mode, 3, 2).collect())
    want = []
    for request, key, t in [*asked, asked[0]]:
        past = {}
        for k, item, at, cost in events:
            if k == key and (t is None or at is not None and at < t):
                past.setdefault(item, []).append((at or 0, cost))
        rows = []
        for item, seen in past.items():
            n, value, last = len(seen), sum(c for _, c in seen), max(a for a, _ in seen)
            if n >= 2:
                score = {"recency": last, "clicks": n, "value": value, "mean_value": value / n, "shrunk": value * n / (n + 20)}[mode]
                rows.append((-round(score, 9), -n, -last, item))
        want += [(request, place, item, -n) for place, (_, n, _, item) in enumerate(sorted(rows)[:3], 1)]
    assert got == sorted(want)


def test_counters_equal_brute_force(spark):
    from rankflow.operators import history

    rng = np.random.default_rng(8)
    day = 86_400
    events = [(f"k{rng.integers(0, 3)}", int(t), float(rng.integers(1, 9))) for t in rng.integers(0, 100 * day, 400)]
    events += [(k, t, 1.0) for k, t, _ in events[:30]]
    probes = [(i, f"k{rng.integers(0, 4)}", int(t)) for i, t in enumerate(rng.integers(-day, 110 * day, 80))] + [(900 + i, k, t) for i, (k, t, _) in enumerate(events[:20])] + [(0, "k1", 5 * day), (1000, "k0", None)]
    e = spark.createDataFrame([("f", *x) for x in events], "family string, key string, t long, cost double").repartition(4)
    p = spark.createDataFrame([(i, "f", k, t) for i, k, t in probes], "id long, family string, key string, t long")
    got = sorted((r.id, r.w_clicks, r.w_sum, round(r.w_age, 6), r.m_clicks, r.all_clicks, r.all_sum, round(r.all_age, 6), r.all_present) for r in history.asof(e, p, {"w": 7, "m": 28, "all": 0}, 40 * day).collect())
    want = []
    for i, k, t in probes:
        t = 40 * day if t is None else t
        seen = [(a, c) for x, a, c in events if x == k and a < t]
        near = [(a, c) for a, c in seen if a >= t - 7 * day]
        age = lambda rows: round((t - max(a for a, _ in rows)) / day, 6) if rows else 0.0
        want.append((i, len(near), sum(c for _, c in near), age(near), len([a for a, _ in seen if a >= t - 28 * day]), len(seen), sum(c for _, c in seen), age(seen), int(bool(seen))))
    assert got == sorted(want)
