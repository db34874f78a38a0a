"""A training corpus from raw documents: quality rules, exact and near duplicates, secrets, packing.

Each stage takes what the one before kept, in the columns of ``documents``, as a written table; the last returns the
packed pieces. What a stage left in the shared folder is deleted when the next begins.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankflow.llm import exact_dedup, near_dedup, packing, quality_rules, secrets
from rankflow.llm.common import materialize, read_table, release, table_path, tracked

#: By thread and input, the work tables of the stages so far, which the next stage deletes.
_LEFT: dict[tuple[int, str], list[str]] = defaultdict(list)
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _left(sf_dir: str) -> list[str]:
    return _LEFT[threading.get_ident(), sf_dir]


def stage(function):
    """A stage: first deletes what the stages before it left, whose results are written by then.

    All stages give null, empty and very long texts, ties, repeated rows, empty tables and columns of any name the
    results that their operators state, and return the columns of ``docs``; nulls in other columns stay.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left(sf_dir), table_path(docs))
        with tracked(_left(sf_dir)):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and hosts that pass the quality rules."""
    return quality_rules.keep_good(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id; the stream reads the table that the stage before has written."""
    return exact_dedup.keep_one(docs, written=table_path(docs))


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: sets of five-word shingles, similarity of 0.8 or more."""
    return near_dedup.keep_first(docs, threshold=80)


@stage
def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.mask(docs, VOCABULARY)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("secret scans", mask), ("packing", pack)]
#: Shingle similarity, guess costs and tokens are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with tracked(_left(sf_dir)):
                docs = materialize(docs, name.replace(" ", "-"))
    _LEFT.pop((threading.get_ident(), sf_dir), None)  # the result still reads what the last stage left
    return docs
