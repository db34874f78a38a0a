"""Best-fit packing of tokenised documents into fixed-size sequences by large-item matching.

Packing depends on piece lengths alone, so the plan is made from the histogram of lengths (as many numbers as a sequence
has tokens, however many documents there are): items above a third of the capacity are matched greedily, at most two in
a bin, and smaller items best-fit the remaining gaps. Bins with the same content are planned as one group with a count.
Pieces are then numbered within their length and look their place up in the plan; no group of pieces meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import fresh_name, materialize, prepare
from rankflow.llm.encoding import WordEncoder, encoder

CAPACITY = 4096
#: Salts among which the pieces of one length are numbered.
SALTS = 256


class _Gaps:
    """Groups of equal bins by remaining gap; the smallest sufficient gap is found by bisection."""

    def __init__(self):
        self.by_gap: dict[int, list] = defaultdict(list)
        self.keys: list[int] = []

    def add(self, gap: int, content: tuple, count: int) -> None:
        if count:
            if not self.by_gap[gap]:
                insort(self.keys, gap)
            self.by_gap[gap].append((content, count))

    def best(self, size: int):
        """Take the whole group of the smallest gap that holds ``size``."""
        k = bisect_left(self.keys, size)
        if k == len(self.keys):
            return None
        gap = self.keys[k]
        content, count = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.keys.pop(k)
        return gap, content, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Groups ``(bins, content)`` where content is a tuple of ``(length, copies)`` in the order of the sequence.

    Each small length splits at most the last group it reaches and opens at most two, so there are at most about
    ``2 * capacity + 4 * capacity / 3`` groups with at most ``sqrt(2 * capacity)`` different lengths each: the plan's
    size has a bound that does not depend on the number of documents.
    """
    left = {length: n for length, n in histogram.items() if n > 0 and 0 < length <= capacity}
    gaps = _Gaps()
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k >= 0 and large[k] == a and left[a] < 2:
            k -= 1
        if k < 0:
            gaps.add(capacity - a, ((a, 1),), left.pop(a))
            large.pop()
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        gaps.add(capacity - a - b, ((a, 2),) if a == b else ((a, 1), (b, 1)), n)
        for length in (a, b):
            left[length] -= n
        for length in {a, b}:
            if not left[length]:
                del left[length]
                large.remove(length)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            gap, content, count = gaps.best(size) or (capacity, (), n)
            fit = gap // size
            full = min(count, n // fit)
            gaps.add(gap - fit * size, (*content, (size, fit)), full)
            n -= full * fit
            if full < count and n:
                gaps.add(gap - n * size, (*content, (size, n)), 1)
                full, n = full + 1, 0
            if content:
                gaps.add(gap, content, count - full)
    return [(count, content) for gap in gaps.keys for content, count in gaps.by_gap[gap]]


def slots(groups: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows ``(length, first rank, first sequence, copies, offset)``, sorted: the pieces of a length fill them in turn."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for bins, content in groups:
        offset = 0
        for length, copies in content:
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += bins * copies
            offset += length * copies
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks within their length."""
    shift = np.int64(44)
    keys = (table[:, 0] << shift) | table[:, 1]
    row = table[np.searchsorted(keys, (length << shift) | rank, side="right") - 1]
    turn = rank - row[:, 1]
    return row[:, 2] + turn // row[:, 3], row[:, 4] + turn % row[:, 3] * length


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, on demand, ``ids``."""
    source = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches):
        bpe = encoder(WordEncoder, tokenizer_path)
        for batch in batches:
            rows, out = [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.fromiter(bpe.encode(value.as_py() or ""), dtype="<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        out.append(part.astype(np.int32))
            at, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 5
            columns = [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(out, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return source.mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, salts: int = SALTS) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document's ids end with ``end_id``; only longer ones are cut, the last piece may be shorter. Null or empty texts
    are a lone ``end_id``. Null ids, repeated ids and repeated rows are packed like any other row. An empty table gives
    an empty result. Other columns are ignored, so clashing names do no harm. Texts of any length are encoded whole.
    Of pieces of one length, which are alike to the plan, the order by id, piece and content decides who goes where;
    equal gaps are filled in the order in which their bins were planned.
    """
    spark = prepare(documents.sparkSession)
    pieces = materialize(tokenize(documents, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    salt = fresh_name(pieces.columns, "salt")
    pieces = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", salt).orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("turn", F.row_number().over(within)).join(bases, ["length", salt]).withColumn("rank", F.col("base") + F.col("turn") - 1)
    names = [c for c in pieces.columns if c != salt]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id bigint, offset bigint"

    def run(batches):
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns))
            sequence, offset = place(table.value, at["length"].to_numpy(), at["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(at[c] for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, schema)
