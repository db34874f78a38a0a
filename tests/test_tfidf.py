"""TF-IDF search with frequent terms as a join's table and rare ones shuffled."""

import math
import re
from collections import Counter

import pytest

from rankflow.operators.retrieval import tfidf_top_k

DOCS = [(1, "a b b c"), (2, "a c d Ёж"), (3, None), (4, "b d x"), (4, "b y"), (5, ""), (6, "a a a"), (7, "a c d еж")]
ASKED = [(10, "a b"), (11, "d ёж"), (12, "unknown"), (13, None)]


def plain(docs, asked, k):
    words = lambda t: re.findall("[0-9a-zа-яё]+", (t or "").lower().replace("ё", "е"))
    tf, queries = {}, {i: Counter(words(t)) for i, t in asked}
    for i, t in docs:
        tf.setdefault(i, Counter()).update(words(t))
    df = Counter(w for c in tf.values() for w in c)
    w = lambda c: {t: (1 + math.log(n)) * math.log(1 + len(docs) / df[t]) for t, n in c.items() if t in df}
    norm = lambda v: math.sqrt(sum(round(x * x * 1e8) for x in v.values()))
    out = []
    for q, c in queries.items():
        a = w(c)
        found = [(round(sum(round(a[t] * b[t] * 1e8) for t in a if t in b) / (norm(a) * norm(b)), 8), i) for i, b in ((i, w(x)) for i, x in tf.items()) if set(a) & set(b)]
        out += [(q, i, s, r) for r, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("frequent", [0, 2, 5, 1000])
def test_equals_the_plain_search_whatever_is_frequent(spark, frequent):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame(ASKED, "id long, text string")
    found = sorted(map(tuple, tfidf_top_k(asked, docs, 3, frequent).select("query", "item", "score", "rank").collect()))
    expected = plain(DOCS, ASKED, 3)
    assert [x[:2] + x[3:] for x in found] == [x[:2] + x[3:] for x in expected]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in expected], abs=1e-7)


def test_products_are_summed_before_the_shuffle(spark):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame(ASKED, "id long, text string")
    plan = tfidf_top_k(asked, docs, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate explode(_asked"):].split("Exchange hash")[0]
    assert "BroadcastHashJoin" in below
