"""Retrieval: exact vector search in blocks, TF-IDF search, and candidate sources as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rankflow.functions.text import tokens
from rankflow.operators.ranking import top_k
from rankflow.sources.tables import work_table

#: Queries that a block holds, and pairs of blocks are scored in a task at a time.
QUERY_BLOCK, ITEM_BLOCK = 512, 4096


def vector_top_k(queries: DataFrame, items: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Exact top ``k`` by dot product of every query among all items: ``query, item, score, rank``.

    Both sides are packed in blocks of bounded size; each pair of blocks is one matrix product that keeps the block's
    best ``k`` of each query, and those few are ranked across blocks.
    """

    def pack(df: DataFrame, size: int, name: str) -> DataFrame:
        blocks = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct(id_col, vector_col)).alias(name)).drop("_block")

    blocks = pack(items, ITEM_BLOCK, "i").crossJoin(pack(queries, QUERY_BLOCK, "q"))  # a stated query set, in blocks

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, i in zip(batch.column(0), batch.column(1)):
                found = [x.as_py() for x in (q, i)]
                ids = [np.array([r[id_col] for r in part]) for part in found]
                a, b = (np.array([r[vector_col] for r in part], dtype=np.float64) for part in found)
                scores = a @ b.T
                n = min(k, scores.shape[1])
                best = np.lexsort((np.broadcast_to(ids[1], scores.shape), -scores))[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[0], n)), pa.array(ids[1][best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query", "item", "score"])

    kind = items.schema[id_col].dataType.simpleString()
    found = blocks.select("q", "i").mapInArrow(search, f"query {kind}, item {kind}, score double")
    return top_k(found, "query", [F.desc("score"), F.asc("item")], k)


#: Weights of terms are summed as whole numbers of this many to 1, so that a sum doesn't depend on its order.
FIXED = 100_000_000


#: Terms of whose weights a join's table is made, at most; all others are shuffled.
FREQUENT = 100_000


def _counted(df: DataFrame, name: str) -> DataFrame:
    """``(name, term, tf)`` of ``(id, text)``, counted within each text; texts of one id are one, an id's rows stay together."""
    if df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        df = df.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            at = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
            size = max(1, len(words.dictionary))
            pairs, tf = np.unique(at * size + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs // size)), words.dictionary.take(pa.array(pairs % size)), pa.array(tf.astype(np.int64))], names=[name, "term", "tf"])

    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # however few files there are
    return spread.select("id", tokens(F.col("text")).alias("terms")).mapInArrow(count, f"{name} {df.schema['id'].dataType.simpleString()}, term string, tf long")


def tfidf_top_k(queries: DataFrame, documents: DataFrame, k: int, frequent: int = FREQUENT) -> DataFrame:
    """Cosine of TF-IDF weights ``(1 + ln tf) * ln(1 + N / df)``; both sides are ``(id, text)``.

    ``query``, ``item``, ``score`` to 8 digits, ``rank``; ties go to the smaller item. A text without known terms finds
    nothing, and null texts have none. Terms are counted within texts and written once, a document's side by side. The
    weights of the most frequent terms are a join's table, so a document's norm is summed where it is read and only rare
    terms are shuffled; so are the queries' terms with their queries, if they are at most ``frequent``, and products are
    summed by query and document before the shuffle.
    """
    fixed = lambda x: F.round(x * FIXED).cast("long")
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    of_docs, of_queries = work_table(_counted(documents, "item"), "terms"), _counted(queries, "query")
    n = documents.agg(F.count(F.lit(1)).alias("_all"))
    df = of_docs.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = work_table(df.crossJoin(F.broadcast(n)).select("term", "_df", F.log(1 + F.col("_all") / F.col("_df")).alias("idf")), "idf")  # one row
    least, terms = 1 << 62, 0
    for row in idf.groupBy(F.floor(F.log2("_df")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("power")).collect():  # a row for each power of two
        terms += row["terms"]
        if terms > frequent:
            break
        least = 1 << row["power"]
    common = idf.filter(F.col("_df") >= least).select("term", "idf")
    rare = idf.filter(F.col("_df") < least).select("term", "idf")
    often = of_docs.join(F.broadcast(common), "term").select("item", weight.alias("w"))  # FREQUENT terms at most
    seldom = of_docs.join(F.broadcast(common.select("term")), "term", "left_anti").join(rare, "term").select("item", weight.alias("w"))
    squares = lambda x: x.groupBy("item").agg(F.sum(fixed(F.col("w") * F.col("w"))).alias("_s"))
    norms = squares(often).unionByName(squares(seldom)).groupBy("item").agg(F.sqrt(F.sum("_s").cast("double")).alias("_dn"))
    asked = of_queries.join(idf, "term").select("query", "term", "idf", weight.alias("w"))
    query_norms = asked.groupBy("query").agg(F.sqrt(F.sum(fixed(F.col("w") * F.col("w"))).cast("double")).alias("_qn"))
    asked = work_table(asked.join(query_norms, "query").groupBy("term", "idf").agg(F.collect_list(F.struct("query", "w", "_qn")).alias("_asked")), "asked")
    found = of_docs.join(F.broadcast(asked) if asked.count() <= frequent else asked, "term")
    each = found.select("item", weight.alias("_d"), F.explode("_asked").alias("_q"))
    dots = each.groupBy("_q.query", "_q._qn", "item").agg(F.sum(fixed(F.col("_q.w") * F.col("_d"))).cast("double").alias("_dot"))
    scored = dots.join(norms, "item").select("query", "item", F.round(F.col("_dot") / (F.col("_dn") * F.col("_qn")), 8).alias("score"))
    return top_k(scored, "query", [F.desc("score"), F.asc("item")], k)


class Source(Protocol):
    """A retrieval source: a table of candidates ``(request, item, rank, score)`` for a table of requests."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


_SOURCES: dict[str, Source] = {}


def register(name: str, source: Source) -> None:
    if name in _SOURCES:
        raise ValueError(f"a source named {name} is known")
    _SOURCES[name] = source


def batch_source(load: Callable[[], object], rank: Callable[[object, dict, int], list[dict]], top: int) -> Source:
    """A source from a model that ranks one request at a time: loaded once per task, fed in Arrow batches."""

    def run(requests: DataFrame) -> DataFrame:
        kind = requests.schema["request"].dataType.simpleString()

        def each(batches):
            model = load()
            for batch in batches:
                rows = [(r["request"], c["item"], n, float(c["score"])) for r in batch.to_pylist() for n, c in enumerate(rank(model, r, top), 1)]
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("request").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], names=["request", "item", "rank", "score"])

        return requests.mapInArrow(each, f"request {kind}, item bigint, rank bigint, score double")

    return run


def retrieve(requests: DataFrame, names: list[str], sources: Mapping[str, Source] | None = None) -> DataFrame:
    """Candidates of several registered sources, with ``source``."""
    known = sources or _SOURCES
    out = None
    for name in names:
        one = known[name](requests).select(F.lit(name).alias("source"), "request", "item", "rank", "score")
        out = one if out is None else out.unionByName(one)
    return out


def score_rows(rows: DataFrame, load: Callable[[], object], predict: Callable[[object, pd.DataFrame], np.ndarray], columns: list[str], name: str = "score") -> DataFrame:
    """``rows`` with a model's prediction: loaded once per task, fed with Arrow batches of the feature columns."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(np.asarray(predict(model, batch), dtype=float))

    return rows.withColumn(name, run(F.struct(*columns)))
