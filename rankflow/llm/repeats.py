"""Repeated byte strings across documents: suffix blocks from merged shard Burrows-Wheeler transforms.

A string of ``length`` bytes is looked for only where it can recur. Each window of that many bytes names its anchor, the
leftmost of its grams with the smallest hash, so equal windows have equal anchors. Windows of one anchor make a context;
contexts whose anchor is alone are settled, as are those that all agree. What is left is cut into slices by offset and
settled alike by the core that all windows of a slice share. The slices that still disagree go, by core, to tasks that
build a Burrows-Wheeler transform for each of two shards and merge them by iterative interleave refinement: after k
steps suffixes with the same first k symbols form a block. The core being one symbol, windows are as many symbols as a
slice has windows, and after so many steps the blocks of two or more are the repeated strings. The slices of a core that
very many share are cut again into narrower ones, whose cores are longer and so shared by fewer unlike slices; a slice of
one window is its core, and all of one core are the same string. So no task gets more than a stated number of slices of
one core, whatever the texts hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import materialize, maybe_in, prepare

LENGTH, GRAM, SLICE = 400, 96, 32
#: Slices of one core up to which they meet in a task; beyond it they are cut into ``NARROWER`` times narrower ones.
MOST_MEMBERS, NARROWER = 2000, 4
#: Symbols that a merge takes at a time, and that a task has; symbols of bytes come first, then these.
MERGE_SYMBOLS, TASK_SYMBOLS = 256 << 10, 4 << 20
SEPARATOR, END, CORES, MOST_CORES = 256, 257, 257, 60_000
#: Windows that are hashed at a time.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(11).integers(1, 2**62, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i mod 2**64`` for i below ``n``."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known, done = np.ones(max(n, 1 << 12), np.uint64), 1
        while done < len(known):
            m = min(done, len(known) - done)
            known[done : done + m] = known[:m] * _U(pow(base, done, 2**64))
            done += m
        _POWERS[base] = known
    return known[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each position: rolling polynomial, then mixed."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, n), out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * _powers(pow(_BASE, -1, 2**64), n - gram + 1)
    found ^= found >> _U(29)
    found *= _U(0xBF58476D1CE4E5B9)
    found ^= found >> _U(32)
    return found


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(ahead, back)


def contexts(text: bytes, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> list[tuple[int, int, int, int]]:
    """Runs of windows with one anchor: ``(first window, windows, anchor position, anchor hash)`` in text order.

    A run is cut at chunk bounds only; where it is cut does not change which windows are found equal.
    """
    data, found = np.frombuffer(text, np.uint8), []
    for at in range(0, len(data) - length + 1, chunk):
        hashes = gram_hashes(data[at : at + chunk + length - 1], gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = window_minima((hashes >> _U(22) << _U(22)) | place, length - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        anchor = (least[first] & _U((1 << 22) - 1)).astype(np.int64)
        count = np.diff(np.append(first, len(least)))
        found += zip((first + at).tolist(), count.tolist(), (anchor + at).tolist(), hashes[anchor].view(np.int64).tolist())
    return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def occurrences(text: bytes, length: int, gram: int) -> tuple[list, list]:
    """Contexts of one text, each different one once, and the windows that repeat within the text by whole contexts.

    First list: ``(key, digest, first window, windows, anchor, weight)``; weight is 2 if the text has it again. The
    windows of such a context repeat at its first occurrence too, whatever other texts hold.
    """
    seen: dict[tuple[int, int], list] = {}
    first: list[list[int]] = []
    again: list[list[int]] = []

    def add(runs, lo, n):
        if runs and runs[-1][1] == lo:
            runs[-1][1] = lo + n
        else:
            runs.append([lo, lo + n])

    for lo, n, anchor, key in contexts(text, length, gram):
        digest = _signed(xxhash.xxh3_64_intdigest(text[lo : lo + n - 1 + length], anchor - lo))
        known = seen.get((key, digest))
        if known is None:
            seen[key, digest] = [key, digest, lo, n, anchor, 1]
        else:
            if known[5] == 1:
                add(first, known[2], known[3])
            known[5] = 2
            add(again, lo, n)
    return list(seen.values()), first + again


def slices(text: bytes, lo: int, n: int, anchor: int, length: int, gram: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """Cut a context by offset from its anchor: ``(core hash, whole hash, first window, windows, windows skipped)``.

    The core is what all ``width`` windows of a full slice share; a slice at a context's end lacks some of them.
    """
    found, base = [], anchor - (length - gram)
    for j in range((lo - base) // width, (lo + n - 1 - base) // width + 1):
        start = base + j * width
        a, b = max(lo, start), min(lo + n, start + width)
        core = xxhash.xxh3_64_intdigest(text[start + width - 1 : start + length], j if width > 1 else 0)
        whole = xxhash.xxh64_intdigest(text[a : b - 1 + length], a - start)
        found.append((_signed(core), _signed(whole), a, b - a, a - start))
    return found


def shard_bwt(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rotations of ``text`` (its last symbol, of 16 bits, must be found once) and the symbols before them."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key = key << _U(16) | np.roll(text, -j)
    step = 4
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], ranked[1:] != ranked[:-1])))
        if rank[order[-1]] == n - 1:
            return order, text[order - 1]
        key = (rank * n + np.roll(rank, -step)).view(np.uint64)
        step *= 2


def merge_bwts(first: np.ndarray, second: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms by iterative refinement, and each row's block of equal prefixes of ``depth`` symbols.

    Step k turns the order by k-1 symbols into the order by k: the symbol before each suffix is read from its own
    transform and suffixes are dealt out by it, stably. A row starts a block when its symbol or its successor's block
    differs from the row above: the step at which that happens is their common prefix plus one.
    """
    n = len(first) + len(second)
    of_second = np.zeros(n, bool)
    of_second[len(first) :] = True
    block = np.zeros(n, np.int32)
    starts = np.zeros(n, bool)
    symbol = np.empty(n, first.dtype)
    for _ in range(depth):
        symbol[~of_second], symbol[of_second] = first, second
        order = np.argsort(symbol, kind="stable")
        turned, dealt, below = of_second[order], symbol[order], block[order]
        fresh = np.empty(n, bool)
        fresh[0] = True
        np.not_equal(dealt[1:], dealt[:-1], out=fresh[1:])
        fresh[1:] |= below[1:] != below[:-1]
        if np.array_equal(fresh, starts) and np.array_equal(turned, of_second):
            break
        of_second, starts = turned, fresh
        block = np.cumsum(fresh, dtype=np.int32)
    return of_second, block


def repeated_windows(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each string of symbols: at which of its windows of ``length`` one starts that is found again in any string.

    ``SEPARATOR`` and ``END`` must not be in the strings.
    """
    half = len(strings) // 2
    orders, bwts, flags, starts = [], [], [], []
    for shard in (strings[:half], strings[half:]):
        sizes = np.array([len(s) + 1 for s in shard], dtype=np.int64)
        text = np.full(max(1, int(sizes.sum())), SEPARATOR, np.uint16)
        starts.append(np.cumsum(sizes) - sizes)
        for at, s in zip(starts[-1], shard):
            text[at : at + len(s)] = s
        text[-1] = END
        order, bwt = shard_bwt(text)
        orders.append(order)
        bwts.append(bwt)
        flags.append(np.zeros(len(text), bool))
    of_second, block = merge_bwts(*bwts, length)
    many = np.bincount(block)[block] > 1
    for k, rows in enumerate((~of_second, of_second)):
        flags[k][orders[k]] = many[rows]
    return [flags[k][s : s + max(0, len(t) - length + 1)] for k, part in enumerate((strings[:half], strings[half:])) for s, t in zip(starts[k], part)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _settle(rows, width):
    """Repeated windows of the slices ``(core, sid, lo, left, right)`` of one task, in portions of whole cores.

    All slices of a core have it in common, so it stands as one symbol of its own between the bytes to its left and
    right: each window is then ``width`` symbols, and as many steps of refinement tell which are equal.
    """
    rows.sort(key=lambda r: r[0])
    portion, size, cores = [], 0, 0
    for i, row in enumerate(rows):
        if not portion or portion[-1][0] != row[0]:
            cores += 1
        portion.append((row[0], *row[1:], CORES + cores))
        size += len(row[3]) + len(row[4]) + 2
        last = i + 1 == len(rows) or rows[i + 1][0] != row[0]
        if last and (i + 1 == len(rows) or size >= MERGE_SYMBOLS or cores >= MOST_CORES):
            groups: dict[tuple, list] = {}
            for r in portion:
                groups.setdefault((r[5], r[3], r[4]), []).append(r)
            strings = []
            for core, left, right in groups:
                text = np.empty(len(left) + 1 + len(right), np.uint16)
                text[: len(left)], text[len(left)], text[len(left) + 1 :] = np.frombuffer(left, np.uint8), core, np.frombuffer(right, np.uint8)
                strings.append(text)
            for members, hit in zip(groups.values(), repeated_windows(strings, width)):
                if len(members) > 1:
                    hit = np.ones(len(hit), bool)
                for _, sid, lo, *_ in members:
                    yield from ((sid, lo + a, lo + b) for a, b in _runs(hit))
            portion, size, cores = [], 0, 0


def _table(rows, schema: pa.Schema):
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


_OCC = pa.list_(pa.struct([("key", pa.int64()), ("digest", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("anchor", pa.int32()), ("weight", pa.int32())]))
_SLICE = pa.list_(pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("skip", pa.int32())]))


def _nested(rows, kind):
    """A list column of structs from lists of tuples."""
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = [x for r in rows for x in r]
    inner = kind.value_type
    columns = list(zip(*flat)) if flat else [()] * inner.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, inner.field(i).type) for i, c in enumerate(columns)], names=[inner.field(i).name for i in range(inner.num_fields)])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _agreeing(parts: DataFrame, by: str, digest: str, weight) -> DataFrame:
    """Groups of two or more: ``by``, ``members`` and whether they all agree."""
    groups = parts.groupBy(by).agg(F.sum(weight).alias("members"), F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    return groups.filter("members > 1").select(by, "members", (F.col("_lo") == F.col("_hi")).alias("agree"))


def _sliced(texts: DataFrame, wanted: str, width: int, length: int, gram: int) -> DataFrame:
    """``sid`` and the slices of the contexts ``(lo, n, anchor)`` in the list column ``wanted``."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for text, found in zip(batch.column(1), batch.column(2)):
                body = text.as_py()
                out.append([s for c in found.as_py() for s in slices(body, c["lo"], c["n"], c["anchor"], length, gram, width)])
            yield pa.RecordBatch.from_arrays([ids, _nested(out, _SLICE)], names=["sid", "slices"])

    made = texts.select("sid", "body", wanted).mapInArrow(run, "sid bigint, slices array<struct<core:bigint,whole:bigint,lo:int,n:int,skip:int>>")
    return made.select("sid", F.inline("slices"))


def find_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, width: int = SLICE, most_members: int = MOST_MEMBERS) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts anywhere else.

    One row per row of ``documents``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``. A null text is
    empty; texts shorter than ``length`` keep all; null ids stay; repeated rows are copies of each other and lose all;
    an empty table gives an empty result; other columns are ignored, so clashing names do no harm. Very long texts are
    hashed in portions; overlapping repeats count each. Equal contexts, slices and cores are known by their length,
    offset and two independent 64-bit digests; what differs is told apart by bytes.
    """
    spark = prepare(documents.sparkSession)
    source = documents.select(documents[id_col].alias("doc_id"), F.coalesce(documents[text_col], F.lit("")).cast("binary").alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            digests, sizes, found = [], [], []
            for value in batch.column(1):
                body = value.as_py()
                digests.append(hashlib.sha256(body).digest())
                sizes.append(len(body))
                found.append(occurrences(body, length, gram)[0] if len(body) >= length else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _nested(found, _OCC)], names=["doc_id", "text_id", "n_bytes", "occ"])

    rows = materialize(source.mapInArrow(read, f"doc_id {kind}, text_id binary, n_bytes bigint, occ array<struct<key:bigint,digest:bigint,lo:int,n:int,anchor:int,weight:int>>"), "repeat-rows")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # The row with the least id stands for all copies of a text.
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("row_name"))
    occ = rows.select("text_id", name.alias("row_name"), F.inline("occ"))
    shared = occ.join(_agreeing(occ, "key", "digest", "weight"), "key")
    by_text = shared.groupBy("text_id", "row_name").agg(F.collect_set(F.struct("lo", "n", "anchor", "agree")).alias("occ"), (F.max("weight") > 1).alias("twice"))
    wanted = materialize(by_text.join(copies, ["text_id", "row_name"]), "repeat-wanted")
    bodies = maybe_in(source.filter(F.length("body") >= length).withColumn("row_name", name), [F.col("row_name")], wanted, [F.col("row_name")])
    bodies = bodies.select(F.unhex(F.sha2("body", 256)).alias("text_id"), "row_name", "body")
    chosen = bodies.join(wanted, ["text_id", "row_name"]).dropDuplicates(["text_id", "row_name"])
    pick = lambda agree: F.transform(F.filter("occ", lambda c: c["agree"] == agree), lambda c: F.struct(c["lo"], c["n"], c["anchor"]))
    texts = materialize(chosen.select(F.monotonically_increasing_id().alias("sid"), "text_id", "body", "copies", "twice", pick(True).alias("whole"), pick(False).alias("parts")), "repeat-texts")

    pending, hits = texts.filter(F.size("parts") > 0).select("sid", "body", "parts"), None
    while hits is None or not pending.isEmpty():
        cut = materialize(_sliced(pending, "parts", width, length, gram), "repeat-slices")
        judged = materialize(cut.join(_agreeing(cut, "core", "whole", F.lit(1)), "core"), "repeat-judged")
        found = judged.filter("agree").select("sid", "lo", (F.col("lo") + F.col("n")).alias("hi"))
        hits = found if hits is None else hits.unionByName(found)
        if width == 1:
            break
        hits = hits.unionByName(_merged(judged.filter(~F.col("agree") & (F.col("members") <= most_members)), texts, length, width))
        hot = judged.filter(~F.col("agree") & (F.col("members") > most_members))
        hot = hot.groupBy("sid").agg(F.collect_list(F.struct("lo", "n", (F.col("lo") - F.col("skip") + length - gram).alias("anchor"))).alias("parts"))
        pending = materialize(texts.select("sid", "body").join(hot, "sid"), "repeat-pending")
        width = max(1, width // NARROWER)
    hits = hits.groupBy("sid").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))

    def remove(batches):
        for batch in batches:
            out = []
            for text_id, body, twice, whole, found in zip(*batch.columns):
                body = body.as_py()
                windows = [(c["lo"], c["lo"] + c["n"]) for c in whole.as_py()] + [(c["lo"], c["hi"]) for c in found.as_py() or ()]
                if twice.as_py():
                    windows += map(tuple, occurrences(body, length, gram)[1])
                kept, n_removed, n_spans = cut_out(body, windows, length)
                out.append((text_id.as_py(), n_removed, n_spans, hashlib.sha256(kept).hexdigest()))
            yield _table(out, pa.schema([("text_id", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    single = texts.filter("copies = 1").select("sid", "text_id", "body", "twice", "whole").join(hits, "sid", "left").select("text_id", "body", "twice", "whole", "hits")
    removed = single.mapInArrow(remove, "text_id binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    gone = copies.filter("copies > 1").select("text_id", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256"))
    verdicts = removed.unionByName(gone).withColumn("found", F.lit(True))
    return rows.select("doc_id", "text_id", "n_bytes").join(verdicts, "text_id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("found"), F.coalesce("n_removed", "n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("text_id"))).alias("kept_sha256"),
    )


def cut_out(body: bytes, windows, length: int) -> tuple[bytes, int, int]:
    """``body`` without the bytes that windows starting in any ``[lo, hi)`` cover; bytes removed; runs removed."""
    kept, at, n_spans = [], 0, 0
    end = -1
    for lo, hi in sorted(windows):
        if lo > end:
            kept.append(body[at:lo])
            n_spans += 1
            end = at = hi - 1 + length
        else:
            end = at = max(end, hi - 1 + length)
    kept.append(body[at:])
    kept = b"".join(kept)
    return kept, len(body) - len(kept), n_spans


def _merged(wanted: DataFrame, texts: DataFrame, length: int, width: int) -> DataFrame:
    """Repeated windows ``(sid, lo, hi)`` within the slices of each core, from merged transforms."""
    spark = wanted.sparkSession
    total = wanted.agg(F.sum(F.col("n") + (width + 1))).first()[0] or 0
    by_text = wanted.groupBy("sid").agg(F.collect_list(F.struct("core", "lo", "n", "skip")).alias("parts"))

    def read(batches):
        for batch in batches:
            out = []
            for sid, body, parts in zip(*batch.columns):
                body, sid = body.as_py(), sid.as_py()
                for c in parts.as_py():
                    lo, start = c["lo"], c["lo"] - c["skip"]
                    out.append((c["core"], sid, lo, body[lo : start + width - 1], body[start + length : lo + c["n"] - 1 + length]))
            yield _table(out, pa.schema([("core", pa.int64()), ("sid", pa.int64()), ("lo", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]))

    cut = texts.select("sid", "body").join(by_text, "sid").mapInArrow(read, "core bigint, sid bigint, lo int, left binary, right binary")

    def settle(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]  # about TASK_SYMBOLS
        yield _table(list(_settle(rows, width)), pa.schema([("sid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_SYMBOLS))
    return cut.repartition(tasks, "core").mapInArrow(settle, "sid bigint, lo int, hi int")
