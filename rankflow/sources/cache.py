"""Tables that are reused while what they were made from stays the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(stage: str, version: int, config: dict, inputs: dict[str, str]) -> str:
    """SHA-256 of the canonical JSON of what decides a stage's result."""
    text = json.dumps({"stage": stage, "version": version, "config": config, "inputs": inputs}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def content_digest(df: DataFrame) -> str:
    """Rows and an order-free sum of their hashes: equal for equal tables however they are partitioned."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def cached(spark: SparkSession, path: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if its manifest has this key and its rows, schema and digest; else it is built anew.

    The manifest is written after the table, so one that was cut short is never reused.
    """
    manifest = f"{path}.manifest"
    try:
        known = json.loads(spark.read.text(manifest).first()["value"])
        table = spark.read.parquet(path)
        if known == {"key": key, "schema": table.schema.json(), "digest": content_digest(table)}:
            return table
    except Exception as missing:  # no manifest, or none that can be read
        if "PATH_NOT_FOUND" not in str(missing) and not isinstance(missing, (TypeError, ValueError)):
            raise
    build().write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    said = json.dumps({"key": key, "schema": table.schema.json(), "digest": content_digest(table)})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return table
