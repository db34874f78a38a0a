import random
import re

import numpy as np

from rankflow.llm.near_dedup import band_keys, candidates, components, histogram, keep_first, linked, may_link, near_duplicates, needed, shingle_set, shingles, signature


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, threshold=80):
    """``(n_shingles, component_id)`` by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest.setdefault(find(i), []).append(doc)
    return [(len(s), min((d for d in smallest[find(i)] if d is not None), default=None) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, families=6, members=14):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three four five", "É a b c d", "é a b c d"]
    for _ in range(families):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(40, 260))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                text += [f"y{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))]
            texts.append(" ".join(text))
    texts += [t.upper() for t in texts[8:12]] + texts[9:11]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, "lone null id with its own words here"), (None, texts[0]), (3, texts[3])]


def check(spark, documents, **options):
    frame = spark.createDataFrame([(*r, "clash") for r in documents], "doc_id long, text string, set_id string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame, **options).collect())
    expected = sorted((d is None, d or 0, n, c, d == c) for (d, _), (n, c) in zip(documents, brute(documents, options.get("threshold", 80))))
    assert got == expected


def test_equal_to_brute_force(spark):
    check(spark, corpus(1))


def test_small_blocks_and_dissimilar_buckets(spark):
    """With one row a band, unlike texts meet in buckets, which are then compared in many blocks."""
    check(spark, corpus(2, 4, 12), bands=192, rows=1, block=5, threshold=85)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    a, b = np.unique(pool[:1500]), np.unique(pool[500:])
    same = (signature(a, 2048) == signature(b, 2048)).mean()
    assert abs(same - 0.5) < 0.06


def test_shingles_and_threshold():
    text = " ".join(map(str, range(104)))
    a = sorted(shingle_set(text))
    assert len(a) == 100 == len(shingles(text)) and len(shingles("a b c d")) == 1 and len(shingles("a b c d e a b c d e")) == 5 and not len(shingles(" "))
    assert shingle_set("A b c d") == {(b"a", b"b", b"c", b"d")} and shingle_set(" ") == set()
    assert linked(set(a), set(a[:85]), 85) and not linked(set(a), set(a[:84]), 85)
    assert linked(set(a), set(a[:80])) and not linked(set(a), set(a[:79]))


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_keep_first_and_empty(spark):
    text = " ".join(map(str, range(50)))
    frame = spark.createDataFrame([(2, text, 1), (1, text + " x", 2), (3, None, 3), (4, "", 4)], "doc_id long, text string, _lost int")
    kept = keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert near_duplicates(frame.limit(0)).count() == 0


def _pair(rng, size, similarity):
    """Two sets of hashes with about this similarity, at ``size`` members of both together."""
    pool = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    rng.shuffle(pool)
    apart = round((1 - similarity) * len(pool))
    cut = int(rng.integers(0, apart + 1))
    return np.sort(pool[cut:]), np.sort(np.concatenate((pool[: len(pool) - apart], pool[:0])) if cut == 0 else pool[: len(pool) - apart + cut])


def test_no_pair_at_the_threshold_is_lost():
    """Of tens of thousands of linked pairs the histograms rule out none, and candidates holds each once."""
    rng, met, tried = np.random.default_rng(17), 0, 0
    for k in range(24_000):
        a, b = _pair(rng, int(rng.integers(5, 400)), 0.8 + 0.15 * rng.random())
        common = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        tried += 1
        assert common >= needed(len(a), len(b), 80) and may_link(histogram(a), histogram(b), len(a), len(b), 80)
        if k % 8 == 0:
            keys = [set(band_keys(signature(s, 192), 32, 6).tolist()) for s in (a, b)]
            both = np.arange(2)
            found = [x for x in keys[0] & keys[1] if candidates([histogram(a), histogram(b)], keys, np.array([len(a), len(b)]), both, x, both, both, 80)]
            assert found == ([min(keys[0] & keys[1])] if keys[0] & keys[1] else [])
            met += bool(found)
    assert tried > 15_000 and met > 0.999 * tried / 8 - 10


def test_histograms_rule_out_unlike_pairs():
    rng = np.random.default_rng(5)
    out = 0
    for _ in range(200):
        a, b = _pair(rng, 300, 0.5)
        out += not may_link(histogram(a), histogram(b), len(a), len(b), 80)
    assert out > 190
    same = np.zeros(1000, np.uint64)  # all in one bin: no histogram, no verdict
    assert histogram(same) == b"" and may_link(b"", histogram(a), 250, len(a), 80)
