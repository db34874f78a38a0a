import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rankflow.llm.encoding import load
from rankflow.llm.packing import pack, place, plan, slots

WORD = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, capacity):
    groups = plan(histogram, capacity)
    used = Counter()
    for bins, content in groups:
        assert bins > 0 and sum(length * n for length, n in content) <= capacity
        assert sum(n for length, n in content if 3 * length > capacity) <= 2
        for length, n in content:
            used[length] += bins * n
    assert used == Counter({k: v for k, v in histogram.items() if v})
    return sum(bins for bins, _ in groups)


def one_by_one(histogram, capacity):
    """The same rules item by item: greedy matching of large items, then best fit in falling size."""
    large = sorted((x for x, n in histogram.items() for _ in range(n) if 3 * x > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        mate = next((x for x in large if a + x <= capacity), None)
        if mate is not None:
            large.remove(mate)
        gaps.append(capacity - a - (mate or 0))
    for x in sorted((x for x, n in histogram.items() for _ in range(n) if 3 * x <= capacity), reverse=True):
        best = min((g for g in gaps if g >= x), default=None)
        if best is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(best)
            gaps.append(best - x)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25))
def test_plan_is_best_fit(histogram):
    assert check_plan(histogram, 60) == one_by_one(histogram, 60)


def test_plan_size_does_not_follow_the_counts():
    rng = random.Random(3)
    histogram = {x: rng.randint(1, 10**7) for x in range(1, 4097)}
    assert check_plan(histogram, 4096) * 4096 < 1.05 * sum(k * v for k, v in histogram.items()) + 4096
    assert len(slots(plan(histogram))) < 200_000


def test_places_are_gapless():
    rng = random.Random(5)
    histogram = {x: rng.randint(1, 40) for x in range(1, 200)}
    table = slots(plan(histogram, 256))
    length = np.array([x for x, n in histogram.items() for _ in range(n)])
    rank = np.array([i for n in histogram.values() for i in range(n)])
    sequence, offset = place(table, length, rank)
    ends = {}
    for s, o, x in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist())):
        assert ends.get(s, 0) == o
        ends[s] = o + x
    assert max(ends.values()) <= 256


def test_rows(spark):
    texts = [None, "", "hello world", "hello world", "word " * 9000, "a b c " * 700, "漢字"]
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = pack(docs, WORD, with_ids=True, salts=2).collect()
    library = load(WORD)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if (r.doc_id or 0) == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == list(range(0, len(ids), 4096))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in own)
    for s in {r.sequence_id for r in rows}:
        end = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 4096
    assert pack(docs.limit(0), WORD).count() == 0
