import random
import zlib
from collections import Counter
from math import log, log10

import numpy as np
import public_tokenizers
import pytest

from rankflow.llm.lattice import Lattice, score_texts, tokens, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, pieces):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            yield from ([text[:k], *rest] for rest in segmentations(text[k:], pieces))


def all_words(pieces, logs, word):
    """Probability of a word, and expected pieces, over all its segmentations."""
    table = dict(zip(pieces, np.exp(logs)))
    total, expected = 0.0, Counter()
    for found in segmentations(b" " + word, table):
        chance = float(np.prod([table[p] for p in found]))
        total += chance
        for p in found:
            expected[p] += chance
    return total, {p: c / total for p, c in expected.items()}


def test_marginals_and_expected_counts():
    pieces = (b" ", b" a", b" ab", b"a", b"ab", b"aba", b"b", b"bb")
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1)))
    lattice = Lattice(pieces, logs)
    words = [b"a", b"b", b"ab", b"abab", b"bbaba", b"abba", b"aba" * 3, b"ab" * 50]
    got = lattice.log_probabilities(words)
    for word, value in zip(words[:-1], got):
        assert value == pytest.approx(log(all_words(pieces, logs, word)[0]))
    assert got[-1] == pytest.approx(lattice.log_probability(words[-1])) and got[0] == pytest.approx(lattice.log_probability(b"a"))
    block = np.frombuffer(b" abab abba", np.uint8).reshape(2, 5)
    total = np.zeros(len(logs))
    lattice.expected(block, np.array([2, 3]), total)
    parts = [all_words(pieces, logs, w)[1] for w in (b"abab", b"abba")]
    assert total[:-1] == pytest.approx([2 * parts[0].get(p, 0) + 3 * parts[1].get(p, 0) for p in pieces])


def test_vocabulary_reaches_every_word():
    pieces, prior = vocabulary(PATH)
    assert prior.sum() == pytest.approx(1) and prior.min() > 0 and 20_000 < len(pieces) < 33_000
    assert not any(b" " in p[1:] for p in pieces)
    lattice = Lattice(pieces, np.log(prior))
    words = ["é漢字🙂", "x" * 300, "the", "\x00\x7f", "ÀÉ", "\u2581mark"]
    assert np.isfinite(lattice.log_probabilities([w.encode() for w in words])).all()
    assert lattice.log_probability(b"the") > lattice.log_probability(b"xqzj")


def brute(rows, rounds):
    pieces, prior = vocabulary(PATH)
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    split = [tokens(t or "") for _, t in rows]
    counts, ends = Counter(), 0
    for h, s in zip(held, split):
        if not h:
            counts.update(s)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    p = prior
    for _ in range(rounds if counts else 0):
        lattice, total = Lattice(pieces, np.log(p)), np.zeros(len(prior))
        for word, c in counts.items():
            lattice.expected(np.frombuffer(b" " + word, np.uint8)[None, :], np.array([c]), total)
        total += len(prior) * prior
        total[-1] += ends
        p = total / total.sum()
    lattice = Lattice(pieces, np.log(p))
    first = sum(x for q, x in zip(pieces, p) if q[:1] == b" ") + p[-1]
    out = []
    for h, s in zip(held, split):
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in s) + log10((ends + 1) / (n + v + 1))
        score = sum(lattice.log_probability(w) for w in s) / log(10) + log10(p[-1]) - log10(first)
        out.append((h, len(s) + 1, sum(counts[w] > 0 for w in s) + (ends > 0), n, base, score))
    return out


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_equal_to_brute_force(spark, frequent):
    rng = random.Random(6)
    rows = [(None, None), (0, ""), (1, "The THE the\x0bend"), (1, "The THE the\x0bend"), (2, "z" * 200 + " é漢字")]
    rows += [(i, " ".join(rng.choice(["the", "cat", "Sat", f"w{rng.randint(0, 30)}", "éa", "𝔘"]) for _ in range(rng.randint(0, 40)))) for i in range(3, 40)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = score_texts(frame, PATH, frequent=frequent).collect()
    expected = brute(rows, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((r[0], *e) for r, e in zip(rows, expected)), key=key)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert len(got) == len(want) and any(w[1] for w in want)


def test_empty_and_untrained(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert score_texts(frame.limit(0), PATH).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_texts(spark.createDataFrame([(out, "a b")], "doc_id long, text string"), PATH).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0


def test_held_out_texts_score_better_than_under_the_prior(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = lambda rounds: score_texts(frame, PATH, rounds=rounds).filter("held_out").agg({"score": "sum"}).first()[0]
    assert total(2) > total(1) > total(0)


def test_very_long_words(spark):
    """Learned by portions, scored whole, in memory that doesn't grow with them."""
    pieces, prior = vocabulary(PATH)
    lattice = Lattice(pieces, np.log(prior))
    word = b"abcde" * 4000
    block = np.frombuffer(b" " + word, np.uint8)[None, :]
    assert lattice.log_probability(word) == pytest.approx(lattice.forward(block)[0][0, -1])
    frame = spark.createDataFrame([(1, "x" * 200_000 + " short words"), (2, "short words")], "doc_id long, text string")
    rows = {r.doc_id: r for r in score_texts(frame, PATH).collect()}
    assert rows[1].n_tokens == 4 and np.isfinite(rows[1].score) and rows[1].score < rows[2].score < 0
