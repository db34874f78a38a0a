"""Exact deduplication as a stateful stream.

Texts flow through a streaming aggregation keyed by digest whose state lives on disk (RocksDB) and never expires. The
state of a digest is how many rows have it, the identifier of the row that stays, and that row's content locator (file
and row). After the stream has run, the whole bytes of all rows of a digest that is found again (hits) are compared, so
a digest that two texts share can't merge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm.common import fresh_name, looked_up, lower_ascii, materialize, maybe_in, prepare, without, work_path

#: Input bytes that one micro-batch reads at most.
BATCH_BYTES = str(256 << 30)
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would reserve megabytes each
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    "spark.sql.streaming.metricsEnabled": "false",
}


def _keyed(source: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest of the normalised text, identifier and locator of every row."""
    return source.select(
        _digest(F.col(f"`{text_col}`")).alias("digest"),
        F.col(f"`{id_col}`").alias("id"),
        _locator(F.col("_metadata")).alias("locator"),
    )


def _locator(metadata: Column) -> Column:
    return F.struct(metadata["file_path"].alias("file"), metadata["row_index"].alias("row"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(lower_ascii(text), 256))


def as_pattern(path: str) -> str:
    """A pattern that only ``path`` matches, so that a stream's source may be a single file; it has no pattern characters."""
    last = max(i for i, c in enumerate(path) if c.isalnum())
    return f"{path[:last]}[{path[last]}]{path[last + 1 :]}"


def run_stream(spark: SparkSession, path: str, schema, id_col: str, text_col: str, work: str, batch: dict | None = None) -> None:
    """Absorb what is new at ``path`` into the state in ``work``.

    Two queries run one after the other: the first adds digest, identifier and locator of each new row to
    ``work/rows``, so texts are read once; the second is stateful, and its changed states go to ``work/states`` by
    batch. A call continues where the last one with the same ``work`` ended. A micro-batch that is repeated after a
    failure replaces its own output, so nothing is held twice.
    """
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    options = batch or {"maxBytesPerTrigger": BATCH_BYTES}
    try:
        # As a pattern, the path may also be a single file.
        texts = spark.readStream.schema(schema).options(**options).parquet(as_pattern(path.rstrip("/")))
        keyed = _keyed(texts, id_col, text_col)
        query = keyed.writeStream.format("parquet").option("path", f"{work}/rows").option("checkpointLocation", f"{work}/rows-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        if not _exists(spark, f"{work}/rows"):
            return
        stream = spark.readStream.schema(keyed.schema).options(**options).parquet(f"{work}/rows")
        states = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "locator")).alias("kept"))
        query = (
            states.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda part, number: part.write.mode("overwrite").parquet(f"{work}/states/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def states(spark: SparkSession, work: str) -> DataFrame:
    """The last state of every digest: ``digest``, ``n``, ``kept``; its count only grows."""
    return spark.read.parquet(f"{work}/states").groupBy("digest").agg(F.max(F.struct("n", "kept")).alias("s")).select("digest", "s.n", "s.kept")


def verdicts(spark: SparkSession, path: str, schema, id_col: str = "doc_id", text_col: str = "text", batch: dict | None = None, work: str | None = None) -> DataFrame:
    """Per row of the Parquet table at ``path``: ``id``, ``locator``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    Of equal texts (identical after lower-casing A-Z; null counts as empty) the row with the largest id stays, a null id
    counting as the smallest; of rows with the same id the one with the largest locator.
    """
    work = work or work_path(spark, "dedup")
    run_stream(spark, path, schema, id_col, text_col, work, batch)
    if not _exists(spark, f"{work}/states"):
        rows = _keyed(spark.read.schema(schema).parquet(path), id_col, text_col)
        return rows.select("id", "locator", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shared = materialize(states(spark, work).filter("n > 1"), "shared")
    joined = looked_up(spark.read.parquet(f"{work}/rows"), ["digest"], shared)
    # Hits: rows whose digest another row has. Their bytes are read again; of each digest the least and the greatest text
    # of every task meet, and are the same unless two texts have one digest.
    place = [F.col("locator.file"), F.col("locator.row")]
    wanted = materialize(joined.filter("n > 1").select("locator"), "hits")
    texts = spark.read.schema(schema).parquet(path).select(F.col(f"`{text_col}`").alias("text"), _locator(F.col("_metadata")).alias("locator"))
    hits = maybe_in(texts, place, wanted, place).select(_digest(F.col("text")).alias("digest"), lower_ascii(F.col("text")).alias("body"), "locator")
    differ = hits.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).filter("lo <> hi").select("digest")
    differ = materialize(differ, "clashes")
    if not differ.isEmpty():  # such digests are grouped by their bytes instead
        joined = _by_bytes(joined, hits, differ)
    alone = F.col("n").isNull()
    return joined.select(
        "id",
        "locator",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("kept.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("locator") == F.col("kept.locator"))).alias("kept"),
    )


def _by_bytes(joined: DataFrame, hits: DataFrame, clashing: DataFrame) -> DataFrame:
    """``joined`` with the groups of the ``clashing`` digests formed by whole bytes."""
    rows = hits.join(clashing, "digest", "left_semi").select("digest", "body", "locator")
    ids = joined.join(clashing, "digest", "left_semi").select("digest", "locator", "id")
    full = rows.join(ids, ["digest", "locator"])
    groups = full.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "locator")).alias("kept"))
    regrouped = full.join(groups, ["digest", "body"]).select("digest", "id", "locator", "n", "kept")
    return joined.select("digest", "id", "locator", "n", "kept").join(clashing, "digest", "left_anti").unionByName(regrouped)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def dedup_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", batch: dict | None = None) -> DataFrame:
    """Verdicts on the Parquet table at ``path``, which has no pattern characters: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null texts count as empty; null ids stay and count as the smallest; of repeated rows one stays; of rows with one text
    and one id that with the largest locator; texts of any length are read whole; an empty table gives an empty result; other columns are not read, so clashing names do no harm.
    """
    schema = spark.read.parquet(path).select(f"`{id_col}`", f"`{text_col}`").schema
    found = verdicts(spark, path, schema, id_col, text_col, batch)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: str | None = None) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns.

    They are first written as the stream's source, unless they are the whole Parquet table at ``written``, as which
    ``common.table_path`` knows a frame. Null texts count as empty; a null id counts as the smallest; of repeated rows
    one stays; an empty table stays empty; columns may have any names.
    """
    spark = prepare(documents.sparkSession)
    path = written or work_path(spark, "dedup-rows")
    if not written:
        documents.write.parquet(path)
    rows = spark.read.schema(documents.schema).parquet(path)
    gone = verdicts(spark, path, rows.select(f"`{id_col}`", f"`{text_col}`").schema, id_col, text_col).filter(~F.col("kept")).select("locator")
    name, other = fresh_name(documents.columns, "_locator"), fresh_name(documents.columns, "_gone")
    gone = materialize(gone.withColumnRenamed("locator", other), "gone")
    at = _locator(rows.metadataColumn("_metadata"))
    key = lambda c: [F.col(f"{c}.file"), F.col(f"{c}.row")]
    return without(rows.withColumn(name, at), key(name), gone, key(other), F.col(name) == F.col(other)).drop(name)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY body)
SELECT d.doc_id, keep_id, n AS group_size, d.doc_id = keep_id AS kept, sha256(d.body) AS text_sha256 FROM d JOIN g ON d.body = g.body
"""
