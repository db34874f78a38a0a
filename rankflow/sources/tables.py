"""Reading and writing tables: tolerant scans, partitioned and guarded sinks, rankings in long and wide form."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; only a session on one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints/rankflow"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what uses it twice doesn't make it twice."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def parts(spark: SparkSession, paths: Sequence[str], name: str = "part") -> DataFrame:
    """All rows of several files or folders of one table, whose columns may differ, with the file each row is from."""
    found = spark.read.option("mergeSchema", "true").parquet(*paths)
    return found.withColumn(name, found.metadataColumn("_metadata")["file_name"])


def write_report(df: DataFrame, path: str, kind: str = "csv", most: int = 100_000) -> int:
    """Write a small result as one CSV or JSON file with a header; returns its rows. More than ``most`` is an error."""
    rows = df.limit(most + 1).count()
    if kind not in ("csv", "json") or rows > most:
        raise ValueError(f"a report is csv or json and has {most} rows at most")
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if kind == "csv" else out.json(path)
    return rows


def require_scope(df: DataFrame, scope: str, column: str = "scope") -> DataFrame:
    """``df`` without ``column``; a row whose scope is not the one that is asked for ends the query."""
    told = F.when(F.col(column).eqNullSafe(F.lit(scope)), F.lit(scope)).otherwise(F.raise_error(F.concat(F.lit(f"asked for scope {scope}, found "), F.coalesce(F.col(column), F.lit("none")))))
    return df.filter(told == scope).drop(column)


def tolerant(df: DataFrame, wanted: Mapping[str, str], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """The ``wanted`` columns with their types; those that are absent are null or have their default."""
    have = {c.lower(): c for c in df.columns}
    default = defaults or {}
    columns = [F.col(f"`{have[c.lower()]}`").cast(t).alias(c) if c.lower() in have else default.get(c, F.lit(None)).cast(t).alias(c) for c, t in wanted.items()]
    return df.select(*columns)


def key_range(df: DataFrame, key: str, start, end) -> DataFrame:
    """Rows with ``start <= key < end``; the predicate reaches the scan."""
    return df.filter((F.col(key) >= start) & (F.col(key) < end))


def chronological(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """The same rows in time order across and within partitions."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def write_partitioned(df: DataFrame, path: str, key: Column, partitions: int = 32) -> None:
    """One directory for each of ``partitions`` buckets of ``key``; the commit is atomic."""
    from rankflow.functions.hashing import partition

    df.withColumn("bucket", partition(key, partitions)).repartition(partitions, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def overwrite_sorted(df: DataFrame, path: str, *order: str) -> None:
    """Replace what is at ``path`` by the rows in ``order``."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def publish_ids(ids: DataFrame, path: str, expected: int, column: str = "item") -> None:
    """Write ids once: exactly ``expected``, unique and positive; an existing target is an error."""
    found = ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(column).alias("unique"), F.count(F.when(F.col(column) > 0, 1)).alias("positive")).first()
    if (found["n"], found["unique"], found["positive"]) != (expected, expected, expected):
        raise ValueError(f"ids are not {expected} unique positive ones: {found.asDict()}")
    ids.select(column).write.mode("error").parquet(path)


def run_sql_to_parquet(spark: SparkSession, text: str, path: str, **parameters) -> int:
    """Analyse a single statement, run it, write its result; returns how many columns it has."""
    result = spark.sql(text, args=parameters or None)
    if not result.columns:
        raise ValueError("the statement has no result")
    result.write.mode("overwrite").parquet(path)
    return len(result.columns)


def append_catalog(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Both catalogs, with the columns of ``base``; ids must be positive, unique in each and apart."""
    missing = set(base.columns) - set(extra.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    both = base.unionByName(extra.select(*base.columns))
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("unique"), F.count(F.when(F.col(key) > 0, 1)).alias("positive")).first()
    if counts["n"] != counts["unique"] or counts["n"] != counts["positive"]:
        raise ValueError(f"ids are not positive and unique: {counts.asDict()}")
    return both


def to_wide(ranking: DataFrame, request: str = "request", item: str = "item", rank: str = "rank") -> DataFrame:
    """One row per request with its items in rank order; lists are as long as rankings are cut."""
    packed = ranking.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(rank, item))).alias("_r"))
    return packed.select(request, F.transform("_r", lambda x: x[item]).alias("items"))


def to_long(wide: DataFrame, request: str = "request", items: str = "items") -> DataFrame:
    """One row per item, ranks from 1."""
    return wide.select(request, F.posexplode(items).alias("rank", "item")).withColumn("rank", F.col("rank") + 1)
