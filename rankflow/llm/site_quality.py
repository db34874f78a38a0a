"""Quality classifier with hierarchical empirical Bayes.

Logistic models on words and shape, of low quality and of toxicity, give each document its own evidence. Sites are two levels, hosts and the first
folder of a path: what the documents of a site amount to is summed by grouped aggregation and shrunk, a host's mean
towards the global one and a folder's towards its host's, with prior weights fitted to all sites by moments. A
document's verdict combines its own evidence with the mean of its site as the site's other documents show it.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize, prepare, site

#: Labelled documents that the classifier is fitted to at most; chosen by hash of their id.
SAMPLE = 20_000
BUCKETS = 1 << 18
#: Lengths of the beginnings of words that are evidence too.
PREFIXES = (4, 5)
#: Documents with a lower probability of being good are not kept.
LEAST_QUALITY = 0.5
#: Bounds of a prior's weight, in documents.
PRIOR_DOCUMENTS = (2.0, 1000.0)
#: Words that a worker remembers the bucket of.
REMEMBERED = 500_000
_BINS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 1.2, 2.0, 4.0])
_WORD = re.compile(r"\w+")


class Buckets(dict):
    """Buckets of a word and of its first letters (inflected forms share them); forgets all when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        names = [word, *(word[:k] + "\0" for k in PREFIXES if len(word) > k)]
        self[word] = found = tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)
        return found


def shape(text: str, words: list[str]) -> list[str]:
    """Names of the bins that the text's proportions fall in."""
    n = len(words) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    rates = {
        "symbols": sum(map(text.count, "#*$%&|<>!{}[]~^=_\\")) / n,
        "capitals": sum(map(str.isupper, words)) / n,
        "echoes": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct": len(set(words)) / n,
        "lines": 1 - len(set(lines)) / (len(lines) or 1),
        "digits": sum(map(str.isdigit, words)) / n,
    }
    return [f"{k}\1{int(np.searchsorted(_BINS, v, side='right'))}" for k, v in rates.items()] + [f"words\1{len(words).bit_length()}", f"letters\1{min(20, len(text) // n)}"]


def features(text: str, buckets: Buckets) -> list[int]:
    """Distinct buckets of a text's words and their beginnings, in lower case, and of its shape."""
    words = _WORD.findall(text)
    found = set(chain.from_iterable(map(buckets.__getitem__, set(map(str.lower, words)))))
    found.update(zlib.crc32(n.encode()) % BUCKETS for n in shape(text, words))
    return list(found)


def fit(index: np.ndarray, starts: np.ndarray, bad: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on binary features, by full-batch adaptive gradient steps.

    A feature's scale is how many standard errors its documents' share of bad ones is from the whole, less three: what
    is common among good and bad alike, as most words are, is no evidence at all.
    """
    weights, n = np.zeros(BUCKETS), len(bad)
    if not n or bad.all() or not bad.any():
        return weights, 20.0 if n and bad.all() else -20.0
    row = np.repeat(np.arange(n), np.diff(starts))
    seen, hit = np.bincount(index, minlength=BUCKETS), np.bincount(index, bad[row], minlength=BUCKETS)
    share = bad.mean()
    scale = np.maximum(0, np.abs(hit - seen * share) / np.sqrt(seen * share * (1 - share) + 1) - 3)
    scale = np.minimum(scale, 10) / 10
    pick = scale[index] > 0
    row, index = row[pick], index[pick]
    value = scale[index]
    bias = float(log(share / (1 - share)))
    squares = np.full(BUCKETS, 1e-10)
    for _ in range(rounds):
        score = np.bincount(row, weights[index] * value, minlength=n) + bias
        miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - bad
        slope = np.bincount(index, miss[row] * value, minlength=BUCKETS) / n + ridge * weights
        squares += slope * slope
        weights -= 0.3 * slope / np.sqrt(squares)
        bias -= 0.5 * float(miss.mean())
    return weights * scale, bias


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The models of ``documents (doc_id, text)`` from at most ``sample`` rows of ``labels (doc_id, low, toxic)``.

    Weights and biases of two heads: of being of low quality, and of being toxic.
    """
    known = labels.filter("doc_id is not null and low is not null and toxic is not null").groupBy("doc_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows of three numbers

    def read(batches):
        buckets = Buckets()
        for batch in batches:
            found = [features(t.as_py() or "", buckets) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "low", "toxic", "features"])

    rows = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "low", "toxic", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(read, f"doc_id {kind}, low boolean, toxic boolean, features array<int>").dropDuplicates(["doc_id"]).toArrow()
    rows = rows.sort_by("doc_id")
    lists = rows.column("features").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    index, starts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
    heads = [fit(index, starts, np.array(rows.column(head).to_pylist(), dtype=float)) for head in ("low", "toxic")]
    return np.array([w for w, _ in heads], dtype=np.float32).T.copy(), np.array([b for _, b in heads])


def _weight(mean: Column, variance: Column) -> Column:
    """Documents that a beta prior with these moments is worth."""
    low, high = map(F.lit, PRIOR_DOCUMENTS)
    return F.when(variance > 0, F.greatest(low, F.least(high, mean * (1 - mean) / variance - 1))).otherwise(high)


def posteriors(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``scored (host, folder, p)``: the global mean and prior weights (one row), hosts, and folders with their sums.

    Prior weights come from the moments of the means of all hosts, and of all folders, that have two documents or more.
    """
    folders = materialize(scored.filter("host <> ''").groupBy("host", "folder").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "folders")
    hosts = folders.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    overall = scored.agg(F.coalesce(F.avg("p"), F.lit(0.5)).alias("mean"))
    mean = F.col("host_s") / F.col("host_n")
    by_host = hosts.filter("host_n > 1").agg(F.avg(mean).alias("a"), F.var_pop(mean).alias("b")).select(F.coalesce(_weight(F.col("a"), F.col("b")), F.lit(PRIOR_DOCUMENTS[1])).alias("host_weight"))
    mean = F.col("s") / F.col("n")
    by_folder = folders.filter("folder <> '' and n > 1").agg(F.avg(mean).alias("a"), F.var_pop(mean).alias("b")).select(F.coalesce(_weight(F.col("a"), F.col("b")), F.lit(PRIOR_DOCUMENTS[1])).alias("folder_weight"))
    one = overall.crossJoin(by_host).crossJoin(by_folder)  # one row each
    return one, hosts, folders.filter("folder <> ''")


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sample: int = SAMPLE, least_quality: float = LEAST_QUALITY) -> DataFrame:
    """Quality of every document, one row per row of ``documents``.

    ``labels`` has ``doc_id``, ``quality`` (1 is good) and ``toxic`` (1 is). Good is both of quality and not toxic. Columns: ``doc_id``,
    ``text_score`` (probability by the text alone), ``site_score`` (mean of its site, shrunk, without the document),
    ``quality`` (both combined) and ``kept``. A null text is empty; a null or empty site has the global mean; rows of
    ``labels`` with nulls are ignored and of several for one id the worst counts; a kind that the
    labels don't show both ways is no evidence. Repeated rows are repeated; an empty table gives an empty result; other
    columns are ignored, so clashing names do no harm. Texts of any length are read whole. Labelled rows are chosen by
    the hash of their id, equal hashes by the id; verdicts need no order.
    """
    spark = prepare(documents.sparkSession)
    host, folder = site(F.coalesce(documents[site_col].cast("string"), F.lit("")))
    source = documents.select(documents[id_col].alias("doc_id"), host.alias("host"), folder.alias("folder"), documents[text_col].alias("text"))
    known = labels.select(labels["doc_id"].alias("doc_id"), (labels["quality"] == 0).alias("low"), (labels["toxic"] == 1).alias("toxic"))
    model = spark.sparkContext.broadcast(train(source.select("doc_id", "text"), known, sample))
    kind = source.schema["doc_id"].dataType.simpleString()

    def score(batches):
        weights, bias = model.value
        buckets = Buckets()
        for batch in batches:
            bad = [weights[features(t.as_py() or "", buckets)].sum(axis=0) + bias for t in batch.column(3)]
            p = (1 / (1 + np.exp(np.clip(np.array(bad).reshape(-1, 2), -12, 12)))).prod(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], names=["doc_id", "host", "folder", "p"])

    scored = materialize(source.mapInArrow(score, f"doc_id {kind}, host string, folder string, p double"), "scored")
    one, hosts, folders = posteriors(scored)
    # Spark splits the large partitions of these joins, so a hot host is dealt to many tasks.
    joined = scored.join(hosts, "host", "left").join(folders, ["host", "folder"], "left").crossJoin(F.broadcast(one))  # one row
    others = lambda total, n, prior, weight: (F.greatest(total - F.col("p"), F.lit(0.0)) + prior * weight) / (n - 1 + weight)
    of_host = F.when(F.col("host_n").isNull(), F.col("mean")).otherwise(others(F.col("host_s"), F.col("host_n"), F.col("mean"), F.col("host_weight")))
    of_site = F.when(F.col("n").isNull(), of_host).otherwise(others(F.col("s"), F.col("n"), of_host, F.col("folder_weight")))
    logit = lambda p: F.log(p / (1 - p))
    clipped = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("site_score", clipped(of_site))
    joined = joined.withColumn("quality", 1 / (1 + F.exp(-(logit(F.col("p")) + logit(F.col("site_score")) - logit(clipped(F.col("mean")))))))
    return joined.select("doc_id", F.col("p").alias("text_score"), "site_score", "quality", (F.col("quality") >= least_quality).alias("kept"))
