import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rankflow.llm.repeats import END, cut_out, find_repeats, gram_hashes, merge_bwts, repeated_windows, shard_bwt, window_minima


def brute(texts, length):
    """Bytes removed of each text, from a count of every window."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out.append((len(b), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n, vocabulary=500):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def corpus(seed, long=60):
    rng = random.Random(seed)
    shared = [words(rng, rng.randint(5, long)) for _ in range(6)]
    texts = [None, "", "short", "a" * 300, "ab" * 200, "a" * 300, "é漢" * 60]
    for _ in range(60):
        parts = [words(rng, rng.randint(0, long)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    line = words(rng, 12)
    texts += ["\n".join([words(rng, 20), line, words(rng, 20)]) for _ in range(30)]
    texts += ["\n".join([line] * 9 + [words(rng, 9)]), texts[10], texts[10], texts[20][3:], texts[20] + "!"]
    for _ in range(10):
        edited = list(texts[30])
        edited[rng.randrange(len(edited))] = "#"
        texts.append("".join(edited))
    return texts


def test_grams_and_minima():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 3, 500, dtype=np.uint8)] * 2)
    hashes = gram_hashes(data, 7)
    strings = [data[i : i + 7].tobytes() for i in range(len(hashes))]
    assert len(set(zip(strings, hashes.tolist()))) == len(set(strings)) == len(set(hashes.tolist()))
    assert window_minima(hashes, 11).tolist() == [min(hashes[i : i + 11]) for i in range(len(hashes) - 10)]


def test_merged_transforms_equal_a_sort():
    rng = random.Random(2)
    shards = [[rng.choice([97, 98, 300]) for _ in range(n)] + [END] for n in (40, 71)]
    sorts = [shard_bwt(np.array(s, np.uint16)) for s in shards]
    for s, (order, bwt) in zip(shards, sorts):
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:] + s[:i])
    for depth in (1, 2, 5, 12):
        of_second, block = merge_bwts(sorts[0][1], sorts[1][1], depth)
        turns = [iter(order.tolist()) for order, _ in sorts]
        prefixes = [((s := shards[int(k)]) * 2)[(i := next(turns[int(k)])) : i + depth] for k in of_second]
        assert prefixes == sorted(prefixes)
        assert [a == b for a, b in zip(prefixes, prefixes[1:])] == [a == b for a, b in zip(block, block[1:])]


@pytest.mark.parametrize("length", [3, 8])
def test_repeated_windows(length):
    rng = random.Random(length)
    for n in (1, 2, 3, 9):
        strings = [tuple(rng.choice([97, 98, 300]) for _ in range(rng.randint(length, 30))) for _ in range(n)]
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, hit in zip(strings, repeated_windows([np.array(s, np.uint16) for s in strings], length)):
            assert hit.tolist() == [seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def test_cut_out():
    assert cut_out(b"0123456789", [(5, 6), (1, 2), (2, 3)], 2) == (b"04789", 5, 2)
    assert cut_out(b"0123456789", [(1, 2), (3, 4)], 2) == (b"056789", 4, 1)
    assert cut_out(b"", [], 2) == (b"", 0, 0)


@pytest.mark.parametrize("length,gram,width,most", [(40, 12, 8, 2000), (40, 12, 4, 3), (24, 20, 2, 2000)])
def test_equal_to_brute_force(spark, length, gram, width, most):
    texts = corpus(length + width)
    frame = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, text_id string").repartition(5)
    got = sorted(find_repeats(frame, length=length, gram=gram, width=width, most_members=most).collect(), key=lambda r: r.doc_id or 0)
    expected = brute(texts, length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == expected
    assert sum(e[1] > 0 for e in expected) > 20


def test_default_length_and_empty(spark):
    rng = random.Random(9)
    passage = words(rng, 150)
    texts = [words(rng, 200) + " " + passage + words(rng, 100), passage + " " + words(rng, 300), words(rng, 400), "x" * 1000, words(rng, 50), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(find_repeats(frame).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, 400)
    assert find_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2000, 1])
def test_passage_twice_in_one_text_and_an_edited_copy(spark, most):
    rng = random.Random(12)
    texts = []
    for _ in range(4):
        passage = words(rng, 120)
        edited = passage[:200] + "#" + passage[201:]
        texts.append(" ".join([words(rng, 20), passage, words(rng, 20), passage, words(rng, 20)]))
        texts.append(" ".join([words(rng, 20), edited, words(rng, 20)]))
        passage = words(rng, 120)  # here the text itself holds the edited copy
        texts.append(" ".join([words(rng, 20), passage, words(rng, 20), passage, words(rng, 20), passage[:200] + "#" + passage[201:]]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(find_repeats(frame, length=100, gram=24, width=8, most_members=most).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, 100)
