"""Language-model scores of texts as the marginal probability over all segmentations into subwords.

The pieces of a public vocabulary and their scores are the start: a piece's prior weight falls with the rank its score
tells. Expected counts over all segmentations of the training words then refine the weights (expectation maximisation
on distinct words with their counts, so its cost follows the words, not the tokens). A text's probability is that of its
words and one end, each word's the sum over all its segmentations by a forward recursion in log space.

A word is a space and its bytes. Pieces that start with a space can only start a word, so where words part is never
ambiguous; single bytes are pieces too, so every word has a segmentation.
"""

from __future__ import annotations

from collections import Counter, deque
from functools import lru_cache
from math import exp, log, log10

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize, prepare

#: The most frequent words, resolved where texts are read; all others are looked up by a join.
FREQUENT = 100_000
#: Entries of a task's table of counts, after which it is sent on.
COUNTED = 300_000
#: Rounds of expectation maximisation, words that are handled together, bytes of a word that is handled alone.
ROUNDS, TOGETHER, LONG = 2, 4096, 64
#: Bytes of a very long word that are learned from at a time; scores are of the whole word.
PORTION = 1 << 16
#: Words that a task takes at a time.
WORDS_PER_BLOCK = 1 << 16
FOLDS, HELD_OUT = 7, 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MARK = "▁"
#: Bytes that a word in lower case never has after its space.
_NEVER = b" \t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[bytes, ...], np.ndarray]:
    """Pieces as bytes and their prior probabilities, from the scores of a SentencePiece file; the last is the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: Counter = Counter()
    least = min(model.get_score(i) for i in range(model.get_piece_size()))
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            text, rank = bytes([int(piece[3:5], 16)]), 1 - least
        else:
            text, rank = piece.replace(_MARK, " ").encode(), -model.get_score(i)
        if text == b" " or (text != b"" and not any(c in _NEVER for c in text.removeprefix(b" "))):
            weights[text] += 1 / (1 + rank)
    for b in {*range(256)}.difference(_NEVER):
        weights.setdefault(bytes([b]), 1 / (2 - least))
    pieces = tuple(sorted(weights))
    prior = np.array([weights[p] for p in pieces] + [sum(weights.values()) / 100])
    return pieces, prior / prior.sum()


class Lattice:
    """Segmentations of words into ``pieces`` with log probabilities ``logs`` (the last one is the end's)."""

    def __init__(self, pieces, logs):
        self.pieces, self.logs = pieces, logs
        self.number = {p: i for i, p in enumerate(pieces)}
        hashes = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * int(_BASE) + b + 1) % 2**64
            hashes[i] = h
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        assert len(np.unique(hashes)) == len(hashes)
        self.lengths = sorted({len(p) for p in pieces})
        self.present = np.zeros(1 << 22, bool)
        self.present[self._slot(hashes)] = True

    @staticmethod
    def _slot(hashes):
        return ((hashes ^ (hashes >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(42)).astype(np.int64)

    def _arcs(self, words: np.ndarray):
        """For words of one length, by piece length: which substrings are pieces, ``(length, row, start, number)``."""
        rolled, found = np.zeros(words.shape, np.uint64), []
        for size in range(1, min(words.shape[1], self.lengths[-1]) + 1):
            ends = words[:, size - 1 :].astype(np.uint64) + _U(1)
            rolled = rolled[:, : ends.shape[1]] * _BASE + ends
            row, start = np.nonzero(self.present[self._slot(rolled)])
            if len(row):
                hashes = rolled[row, start]
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                real = self.hashes[at] == hashes
                if real.any():
                    found.append((size, row[real], start[real], self.order[at[real]]))
        return found

    def forward(self, words: np.ndarray):
        """Log probability of every prefix, and the arcs sorted by where they end."""
        arcs = self._arcs(words)
        sizes = np.concatenate([np.full(len(r), s) for s, r, _, _ in arcs])
        row, start, number = (np.concatenate([a[k] for a in arcs]) for k in (1, 2, 3))
        order = np.lexsort((row, start + sizes))
        row, start, number, end = row[order], start[order], number[order], (start + sizes)[order]
        bounds = np.searchsorted(end, np.arange(words.shape[1] + 2))
        reach = np.full((words.shape[0], words.shape[1] + 1), -np.inf)
        reach[:, 0] = 0
        weight = self.logs[number]
        for e in range(1, words.shape[1] + 1):
            a, b = bounds[e], bounds[e + 1]
            reach[:, e] = _sum_by_row(row[a:b], reach[row[a:b], start[a:b]] + weight[a:b], words.shape[0])
        return reach, (row, start, number, end, weight)

    def expected(self, words: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
        """Add to ``total`` how often each piece is expected in the words."""
        reach, (row, start, number, end, weight) = self.forward(words)
        n, size = words.shape
        order = np.lexsort((row, start))
        bounds = np.searchsorted(start[order], np.arange(size + 1))
        back = np.full((n, size + 1), -np.inf)
        back[:, size] = 0
        for s in range(size - 1, -1, -1):
            pick = order[bounds[s] : bounds[s + 1]]
            back[:, s] = _sum_by_row(row[pick], back[row[pick], end[pick]] + weight[pick], n)
        share = np.exp(reach[row, start] + weight + back[row, end] - reach[row, size]) * counts[row]
        total += np.bincount(number, share, minlength=len(total))

    def log_probability(self, word: bytes) -> float:
        """Of one word of any length, byte by byte; it holds no more of it than the longest piece is."""
        text, longest = b" " + word, self.lengths[-1]
        reach = deque([0.0], maxlen=longest)
        for e in range(1, len(text) + 1):
            terms = [reach[s - e] + self.logs[i] for s in range(max(0, e - longest), e) if (i := self.number.get(text[s:e])) is not None]
            top = max(terms, default=-np.inf)
            reach.append(top + log(sum(exp(t - top) for t in terms)) if top > -np.inf else top)
        return reach[-1]

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for index, block in _by_length(words):
            out[index] = self.log_probability(words[index[0]]) if block is None else self.forward(block)[0][:, -1]
        return out


def _sum_by_row(rows: np.ndarray, logs: np.ndarray, n: int) -> np.ndarray:
    """Log of the sum of exponentials by row; ``rows`` is sorted."""
    out = np.full(n, -np.inf)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        top = np.maximum.reduceat(logs, first)
        safe = np.where(np.isfinite(top), top, 0)
        sums = np.add.reduceat(np.exp(logs - np.repeat(safe, np.diff(np.append(first, len(rows))))), first)
        with np.errstate(divide="ignore"):
            out[rows[first]] = safe + np.log(sums)
    return out


def _by_length(words: list[bytes]):
    """Blocks of words of one length, as ``(positions, matrix of their bytes after a space)``; long ones come alone."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(np.concatenate(([-1], sizes[order], [-1]))))
    for a, b in zip(bounds, bounds[1:]):
        size = int(sizes[order[a]])
        if size > LONG:
            yield from ((order[i : i + 1], None) for i in range(a, b))
        else:
            for k in range(a, b, TOGETHER):
                index = order[k : min(b, k + TOGETHER)]
                yield index, np.frombuffer(b"".join(b" " + words[i] for i in index), np.uint8).reshape(len(index), size + 1)


def _gathered(batches, rows: int = WORDS_PER_BLOCK):
    """Small batches as fewer of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def count_words(documents: DataFrame) -> DataFrame:
    """``word``, its count in training texts and in all, from ``(text, held_out)``; an end is the empty word."""

    def run(batches):
        counts: list[Counter] = [Counter(), Counter()]

        def flush():
            words = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(words, pa.binary()), pa.array([counts[0][w] for w in words], pa.int64()), pa.array([counts[0][w] + counts[1][w] for w in words], pa.int64())]
            counts[:] = Counter(), Counter()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n_train", "n_all"])

        for batch in batches:
            for text, held_out in zip(batch.column(0), batch.column(1)):
                own = counts[held_out.as_py()]
                own.update(tokens(text.as_py()))
                own[b""] += 1
                if len(counts[0]) + len(counts[1]) > COUNTED:
                    yield flush()
        yield flush()

    made = documents.select("text", "held_out").mapInArrow(run, "word binary, n_train bigint, n_all bigint")
    return made.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def learn(words: DataFrame, path: str, n_train: int, n_ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces (and the end) from ``words`` with their training counts."""
    pieces, prior = vocabulary(path)
    spark, p = words.sparkSession, prior
    training = words.filter("n_train > 0 and length(word) > 0").select("word", "n_train")
    for _ in range(rounds if n_train > n_ends else 0):
        shared = spark.sparkContext.broadcast(np.log(p))  # as long as the vocabulary

        def run(batches):
            lattice, total = Lattice(pieces_of(path), shared.value), np.zeros(len(shared.value))
            for batch in _gathered(batches):
                found, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for index, block in _by_length(found):
                    if block is not None:
                        lattice.expected(block, counts[index], total)
                        continue
                    long = np.frombuffer(b" " + found[index[0]], np.uint8)
                    for at in range(0, len(long), PORTION):
                        lattice.expected(long[None, at : at + PORTION], counts[index], total)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

        gathered = training.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        counted = len(prior) * prior
        for row in gathered.collect():  # as many rows as the vocabulary has at most
            counted[row["piece"]] += row["n"]
        counted[-1] += n_ends
        p = counted / counted.sum()
    return np.log(p)


def pieces_of(path: str):
    return vocabulary(path)[0]


def score_texts(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all texts under a model of those whose ``crc32(id as text) mod 7`` is not 2.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10
    probabilities). A null text is empty: its one token is the end. A null id counts as empty text and trains. Repeated
    rows are repeated and count each time. An empty table gives an empty result; other columns are ignored, so clashing
    names do no harm. Words of any length are scored whole; the model learns from very long ones by portions.
    """
    spark = prepare(documents.sparkSession)
    fold = F.pmod(F.crc32(F.coalesce(documents[id_col].cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    source = documents.select(documents[id_col].alias("doc_id"), (fold == HELD_OUT).alias("held_out"), F.coalesce(documents[text_col], F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = materialize(count_words(source), "words")
    size = counted.agg(F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1)), F.sum(F.when(F.length("word") == 0, F.col("n_train")))).first()
    n_train, n_words, n_ends = (int(x or 0) for x in size)
    path = vocabulary_path
    logs = spark.sparkContext.broadcast(learn(counted, path, n_train, n_ends, rounds))

    def weigh(batches):
        lattice = Lattice(pieces_of(path), logs.value)
        for batch in _gathered(batches):
            found = lattice.log_probabilities(batch.column(0).to_pylist()) / log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found)], names=["word", "n_train", "n_all", "weight"])

    words = materialize(counted.filter("length(word) > 0").mapInArrow(weigh, "word binary, n_train bigint, n_all bigint, weight double"), "weights")
    # Frequent words by a threshold from a histogram of about a thousand classes of frequency.
    level = F.floor(F.log2("n_all") * 16).cast("int")
    least, total = None, 0
    for row in sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        total += row["n"]
        if total > frequent:
            break
        least = row["level"]
    top = words.filter(level >= least).collect() if least is not None else []  # ``frequent`` rows at most
    known = spark.sparkContext.broadcast({bytes(r["word"]): (log10(r["n_train"] + 1), r["n_train"] > 0, r["weight"]) for r in top})

    def read(batches):
        table = known.value
        for batch in batches:
            n_tokens, n_known, base, score, ends, flat = [], [], [], [], [0], []
            for text in batch.column(2):
                own = Counter(tokens(text.as_py()))
                total = hits = 0
                plain = lattice = 0.0
                for word, n in own.items():
                    total += n
                    entry = table.get(word)
                    if entry is None:
                        flat.append((word, n))
                    else:
                        plain += n * entry[0]
                        lattice += n * entry[2]
                        hits += n if entry[1] else 0
                n_tokens.append(total + 1)
                n_known.append(hits)
                base.append(plain)
                score.append(lattice)
                ends.append(len(flat))
            columns = list(zip(*flat)) if flat else [(), ()]
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64())], names=["word", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), rare], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    texts = source.mapInArrow(read, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:binary,n:bigint>>")
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = texts.select("row", F.inline("rare")).join(words.select("word", "n_train", "weight"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("n_train") + 1)).alias("base_more"), F.sum(F.col("n") * F.col("weight")).alias("score_more"), F.sum(F.when(F.col("n_train") > 0, F.col("n")).otherwise(0)).alias("known_more"))
    # The end, and the first draw: a text can't start with a piece that goes on.
    chance = np.exp(logs.value)
    starts = np.array([p[:1] == b" " for p in pieces_of(path)] + [True])
    end_base, end_score = log10(n_ends + 1), float(logs.value[-1] / log(10) - log10(chance[starts].sum()))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return texts.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_more", F.lit(0)) + int(n_ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + none("base_more") + end_base - F.col("n_tokens") * log10(n_train + n_words + 1)).alias("base_score"),
        (F.col("score") + none("score_more") + end_score).alias("score"),
    )
