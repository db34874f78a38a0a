"""Strictly past counters of an event stream from keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankflow.functions.timeops import epoch_seconds
from rankflow.streaming.weekly import as_pattern, shared_path

_OUT = "event_id long, n long, value double, last long"
#: Count, value and newest second before the last second seen; the same of that second alone.
_STATE = "n long, value double, last long, now long, now_n long, now_value double"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Answer each event from what was strictly before its second, then absorb it.

    Events of one second see none of each other, in one batch or in several: what the newest second adds is kept apart
    until a later one comes.
    """
    n, value, last, now, now_n, now_value = state.get if state.exists else (0, 0.0, 0, -1, 0, 0.0)
    rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
    out = []
    for event, t, v in zip(rows["event_id"], rows["t"], rows["value"]):
        if t > now:
            if now_n:
                n, value, last = n + now_n, value + now_value, now
            now, now_n, now_value = int(t), 0, 0.0
        out.append((event, n, value, last))
        now_n, now_value = now_n + 1, now_value + (0.0 if pd.isna(v) else float(v))
    state.update((n, value, last, now, now_n, now_value))
    yield pd.DataFrame(out, columns=["event_id", "n", "value", "last"])


def past_counters(events: DataFrame) -> DataFrame:
    """Per event: how many of its user and type came before its second, their value, and the newest one's time.

    Batches must come in time order; an event that is older than the newest second of its key is answered late, from
    all that was absorbed by then.
    """
    timed = events.select("event_id", "user_id", "event_type", epoch_seconds(F.col("ts")).alias("t"), "value")
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_replay(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream of the Parquet table at ``path`` to its end."""
    schema, work = spark.read.parquet(path).schema, shared_path(spark, "replay")
    stream = spark.readStream.schema(schema).parquet(as_pattern(path))
    query = past_counters(stream).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{work}/out").select("event_id", "n", F.round("value", 4).alias("value"), "last")
