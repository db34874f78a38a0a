"""What the operators of this package share: shared-folder work tables, batch bounds, shipping code to workers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of an Arrow batch: rows, and bytes, as texts may be long.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 64 << 20
#: Work tables that a thread has begun, in order.
_WORK = threading.local()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches, if they aren't yet, and make the package importable on workers."""
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        if not re.fullmatch(r"\d+b?", now := spark.conf.get(key).lower()) or not 0 < int(now.rstrip("b")) <= most:  # results are lazy: it can't be set back
            spark.conf.set(key, most)
    context = spark.sparkContext
    if getattr(context, "_rankflow_shipped", None) is None:
        context.addPyFile(_package_zip())
        context._rankflow_shipped = True
    return spark


def _package_zip() -> str:
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="rankflow-")) / "rankflow_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    return str(target)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine may leave it unset; its temporary folder is taken then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "rankflow")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _begun().append(path)
    return path


def _begun() -> list[str]:
    if not hasattr(_WORK, "paths"):
        _WORK.paths = []
    return _WORK.paths


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tracked(paths: list[str]):
    """Add the work tables that this thread begins within to ``paths``."""
    before = len(_begun())
    try:
        yield
    finally:
        paths.extend(_begun()[before:])


def release(spark: SparkSession, paths: list[str], *kept: str | None) -> None:
    """Delete the work tables at ``paths`` but ``kept`` ones, and forget them: for when their results are written."""
    names = {path.rsplit("/", 1)[-1] for path in kept if path}  # each has a name of its own
    configuration, of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in list(paths):
        if path.rsplit("/", 1)[-1] not in names:
            of(path).getFileSystem(configuration).delete(of(path), True)
            paths.remove(path)


def table_path(df: DataFrame) -> str | None:
    """Where the table is that ``df`` is, whole and unchanged, as one file or folder; None for any other frame."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getSimpleName():
        return None
    roots = plan.relation().location().rootPaths()
    return roots.head().toString().rstrip("/") if roots.size() == 1 else None


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site(source: Column) -> tuple[Column, Column]:
    """Host and first folder of a source, which may be a URL or a mere name; the folder is empty if it has none."""
    rest = F.regexp_replace(F.trim(source), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^(?:[^@]*@)?(?:www\.)?|:[0-9]*$", ""))
    return host, F.regexp_extract(rest, r"^[^/?#]*/([^/?#]+)/", 1)


def fresh_name(columns, wanted: str) -> str:
    """``wanted``, or a variant of it that no column has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _bit(rows: DataFrame, on: list[Column], members: DataFrame, member_on: list[Column], bits: int, how: str) -> tuple[DataFrame, Column, list[str]]:
    """``rows`` joined with a bitmap of the members' keys, whether a row's bit is set, and the columns that were added."""
    slot = lambda key: F.pmod(F.xxhash64(*key), F.lit(bits)) + 1
    number, bitmap, at = added = [fresh_name(rows.columns, n) for n in ("_number", "_bitmap", "_at")]
    slots = members.select(slot(member_on).alias(at)).select(F.bitmap_bucket_number(at).alias(number), F.bitmap_bit_position(at).alias(at))
    # Slots are dealt out, not partial bitmaps, of which every task would have as many as there are pieces.
    maps = slots.repartition(number).groupBy(number).agg(F.bitmap_construct_agg(at).alias(bitmap))
    found = rows.withColumn(at, slot(on)).withColumn(number, F.bitmap_bucket_number(at)).withColumn(at, F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, int({at} div 8) + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr(f"shiftleft(1, int({at} % 8))")) != 0
    return found.join(F.broadcast(maps), number, how), is_set, added


def maybe_in(rows: DataFrame, on: list[Column], members: DataFrame, member_on: list[Column], bits: int = 1 << 26) -> DataFrame:
    """``rows`` without most of those whose key no row of ``members`` has; none that has one is lost.

    A bitmap of ``bits`` slots (8 MB at most, however many members) is broadcast, so wide rows that a later join would
    drop are not shuffled for it. Of many members it lets more through.
    """
    found, is_set, added = _bit(rows, on, members, member_on, bits, "inner")
    return found.filter(is_set).drop(*added)


def looked_up(rows: DataFrame, on: list[str], lookup: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``lookup``, which has one row for each of a few keys ``on``.

    Rows whose key a bitmap rules out stay where they are and get nulls. The others are joined, by a join whose large
    partitions Spark splits: a hot key is dealt to many tasks, and only its one row of ``lookup`` is copied.
    """
    key = [F.col(f"`{c}`") for c in on]
    found, is_set, added = _bit(rows, key, lookup, key, 1 << 26, "left")
    is_set = F.coalesce(is_set, F.lit(False))
    new = [F.lit(None).cast(lookup.schema[c].dataType).alias(c) for c in lookup.columns if c not in on]
    joined = found.filter(is_set).drop(*added).join(lookup, on, "left").select(*(f"`{c}`" for c in [*rows.columns, *(c for c in lookup.columns if c not in on)]))
    return found.filter(~is_set).drop(*added).select(*(f"`{c}`" for c in rows.columns), *new).unionByName(joined)


def without(rows: DataFrame, on: list[Column], members: DataFrame, member_on: list[Column], same: Column, bits: int = 1 << 26) -> DataFrame:
    """``rows`` that no row of ``members`` matches by ``same``, which implies equal keys ``on`` and ``member_on``.

    Rows that the bitmap rules out stay where they are; only the others are shuffled for the anti join.
    """
    found, is_set, added = _bit(rows, on, members, member_on, bits, "left")
    is_set = F.coalesce(is_set, F.lit(False))
    return found.filter(~is_set).drop(*added).unionByName(found.filter(is_set).drop(*added).join(members, same, "left_anti"))
