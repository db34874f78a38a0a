import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm.site_quality import BUCKETS, classify, fit, posteriors, site


def test_fit_finds_the_word_that_matters():
    rng = np.random.default_rng(1)
    bad = rng.random(600) < 0.3
    lists = [[*rng.integers(10, 60, 20).tolist(), *([3] if b else [])] for b in bad]
    index = np.array([i for x in lists for i in x])
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    weights, bias = fit(index, starts, bad.astype(float))
    assert weights.shape == (BUCKETS,) and weights[3] > 3 and np.count_nonzero(weights) < 5
    assert [(weights[x].sum() + bias > 0) for x in lists] == bad.tolist()
    assert fit(index, starts, np.zeros(600))[1] == -20 and fit(index[:0], starts[:1], np.empty(0))[1] == -20


def test_sites(spark):
    rows = [("https://www.News.example:8080/sport/a/b.html",), ("src0",), ("example.org/x",), ("",), ("ftp://u@h.example/d/",)]
    host, folder = site(F.col("s"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "s string").select(host, folder).collect()]
    assert got == [("news.example", "sport"), ("src0", ""), ("example.org", ""), ("", ""), ("h.example", "d")]


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "", 0.9)] * 40 + [("mid", "f", 0.2)] * 20 + [("mid", "g", 0.8)] * 20 + [("one", "f", 0.1), ("", "", 0.5)]
    one, hosts, folders = posteriors(spark.createDataFrame(rows, "host string, folder string, p double"))
    one, hosts = one.first(), {r.host: (r.host_n, round(r.host_s, 6)) for r in hosts.collect()}
    assert hosts == {"big": (40, 36.0), "mid": (40, 20.0), "one": (1, 0.1)}
    assert one.mean == pytest.approx(np.mean([r[2] for r in rows]))
    means, var = np.array([0.9, 0.5]), 0.04
    assert one.host_weight == pytest.approx(means.mean() * (1 - means.mean()) / var - 1)
    assert {(r.host, r.folder) for r in folders.collect()} == {("mid", "f"), ("mid", "g"), ("one", "f")}


def documents(spark):
    rng = random.Random(4)
    rows, labels = [(None, None, None), (0, "", ""), (1, "good words here " * 9, None)], []
    for i in range(2, 400):
        kind = i % 3
        words = [f"w{rng.randint(0, 80)}" for _ in range(60)] + (["idiotic", "moronic"] if kind == 1 else [])
        text = " ".join(w + "***" * (kind == 2) for w in words)
        rows.append((i, text, f"http://h{i % 7 if kind else 'clean'}.example/f{i % 2}/p"))
        if i % 2:
            labels.append((i, 0 if kind == 2 else 1, 1 if kind == 1 else 0))
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, host string")
    return frame, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    frame, labels = documents(spark)
    got = {r.doc_id: r for r in classify(frame, labels).collect()}
    assert len(got) == 401
    unseen = [i for i in range(2, 400, 2)]
    assert {got[i].kept for i in unseen if i % 3} == {False} and {got[i].kept for i in unseen if i % 3 == 0} == {True}
    clean = [got[i].site_score for i in unseen if i % 3 == 0]
    assert min(clean) > max(got[i].site_score for i in unseen if i % 3)


def test_site_score_by_hand(spark):
    frame, labels = documents(spark)
    rows = classify(frame, labels).join(frame.select("doc_id", "source"), "doc_id").collect()
    p = {r.doc_id: (r.text_score, *r.source.removeprefix("http://").split("/")[:2]) for r in rows if r.source}
    overall = np.mean([r.text_score for r in classify(frame, labels).collect()])
    weight = lambda x: max(2.0, min(1000.0, np.mean(x) * (1 - np.mean(x)) / np.var(x) - 1))
    hosts, folders = {}, {}
    for q, h, f in p.values():
        hosts.setdefault(h, []).append(q)
        folders.setdefault((h, f), []).append(q)
    a, b = weight([np.mean(x) for x in hosts.values()]), weight([np.mean(x) for x in folders.values()])
    for r in rows:
        if r.source:
            q, h, f = p[r.doc_id]
            host = (sum(hosts[h]) - q + overall * a) / (len(hosts[h]) - 1 + a)
            assert r.site_score == pytest.approx((sum(folders[h, f]) - q + host * b) / (len(folders[h, f]) - 1 + b))


def test_empty_tables(spark):
    frame, labels = documents(spark)
    assert classify(frame.limit(0), labels).count() == 0
    assert {r.kept for r in classify(frame, labels.limit(0)).collect()} == {True}
