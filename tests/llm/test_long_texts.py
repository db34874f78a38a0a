"""Texts of millions of characters, ties and columns with clashing names, by operator."""

import random

from rankflow.llm.near_dedup import near_duplicates
from rankflow.llm.quality_rules import judge
from rankflow.llm.site_quality import classify

RNG = random.Random(21)
LONG = " ".join(f"w{RNG.randint(0, 10**6)}" for _ in range(250_000))


def frame(spark, *texts):
    rows = [(i, t, "Example.org", i, "clash", 0.5, True) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, cid long, host string, p double, kept boolean")


def test_near_duplicates(spark):
    got = {r.doc_id: r for r in near_duplicates(frame(spark, LONG, LONG.upper(), LONG[: len(LONG) * 9 // 10], "short text here", LONG[::-1])).collect()}
    assert [got[i].component_id for i in range(1, 6)] == [1, 1, 1, 4, 5] and got[1].n_shingles == 249_996 == got[2].n_shingles


def test_host_rules(spark):
    got = {r.doc_id: r for r in judge(frame(spark, LONG, "x " * 600_000, LONG)).collect()}
    assert got[1].n_words == 250_000 and got[1].kept and got[1].n_words == got[3].n_words and got[2].n_repeat_words == 600_000 and not got[2].kept


def test_site_quality(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(frame(spark, LONG, "bad " * 300_000, LONG, "vile words here"), labels).collect()}
    assert len(got) == 4 and got[1].text_score == got[3].text_score and all(0 <= r.quality <= 1 for r in got.values())
