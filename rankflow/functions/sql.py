"""The library's helpers as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rankflow.functions.hashing import BUCKETS
from rankflow.functions.text import TOKEN
from rankflow.functions.timeops import FIRST_MONDAY, WEEK

#: Name and arguments, type, and body of each function.
FUNCTIONS = {
    "week_start(t BIGINT)": ("BIGINT", f"CAST(floor((t - {FIRST_MONDAY}) / {WEEK}) AS BIGINT) * {WEEK} + {FIRST_MONDAY}"),
    "tokens(x STRING)": ("ARRAY<STRING>", f"regexp_extract_all(replace(lower(coalesce(x, '')), 'ё', 'е'), '{TOKEN}', 0)"),
    "bucket(x STRING)": (
        "BIGINT",
        "CASE WHEN coalesce(x, '') = '' THEN 0 ELSE CAST(CAST(conv(concat("
        + ", ".join(f"substr(sha1(CAST(x AS BINARY)), {2 * k + 1}, 2)" for k in range(7, -1, -1))
        + f"), 16, 10) AS DECIMAL(20, 0)) % {BUCKETS} AS BIGINT) + 1 END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for the session; their names, by which ``spark.sql`` calls them. Plans inline them."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rankflow_{head} RETURNS {kind} RETURN {body}")
    return [f"rankflow_{head.split('(')[0]}" for head in FUNCTIONS]
