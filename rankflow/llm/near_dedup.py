"""Near-duplicate detection by circulant MinHash, banding and exact verification.

A shingle's hash is permuted once; every coordinate of the signature is the minimum, over the document's shingles, of
one second permutation applied to that value after a circular shift by the coordinate's number. Documents that share a
band are candidates. Candidates that a bound from their histograms can't rule out are compared on the shingles of their
texts, first as stars around one member of each bucket, so a bucket of any size costs as many comparisons as it has
members; only members that the stars leave in different components are then compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import fresh_name, materialize, maybe_in, prepare, without

WORDS, BANDS, ROWS = 5, 32, 6
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Cells of a block of the signature that are computed together.
CELLS = 1 << 17
_U32, _U64 = np.uint32, np.uint64
_STEPS = [_U64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> _U64(32))
    values *= _U64(0xD6E8FEB86659FD93)
    values ^= values >> _U64(32)
    values *= _U64(0xD6E8FEB86659FD93)
    values ^= values >> _U64(32)
    return values


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; fewer words than ``size`` are one shingle, none are no shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    numbers = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    hashes = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : n + k] * _STEPS[k % 5] if k < 5 else _mixed(hashes[k : n + k] + _U64(k))
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit hashes."""
    first = (hashes >> _U64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    width = max(1, CELLS // coordinates)
    for at in range(0, len(first), width):
        block = first[None, at : at + width] - shifts  # the circular shift, modulo 2**32
        spare = block >> _U32(16)
        block ^= spare
        block *= _U32(0x85EBCA6B)
        np.right_shift(block, _U32(13), out=spare)
        block ^= spare
        block *= _U32(0xC2B2AE35)
        np.right_shift(block, _U32(16), out=spare)
        block ^= spare
        np.minimum(least, block.min(axis=1), out=least)
    return least


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    parts = sign.reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * _U64(0x9FB21C651E98DF25)
    for k in range(rows):
        total = _mixed(total + parts[:, k] * _STEPS[k % 5] + _U64(k))
    return total.view(np.int64)


def needed(a: int, b: int, threshold: int) -> int:
    """How many shingles sets of ``a`` and ``b`` members must share to be linked."""
    return -(-threshold * (a + b) // (100 + threshold))


def histogram(hashes: np.ndarray) -> bytes:
    """How many members fall in each of ``2 ** k`` bins, two or three a bin or fewer; empty if a count passes 127.

    Two sets share at most the sum of the lesser counts of each bin, so a pair that this bound rules out is not linked:
    the filter loses nothing. Bins are low bits, so a histogram folds to half as many bins.
    """
    bins = 1 << max(6, (len(hashes) // 3).bit_length())
    counts = np.bincount((hashes & _U64(bins - 1)).astype(np.int64), minlength=bins)
    return b"" if counts.max(initial=0) > 127 else counts.astype(np.uint8).tobytes()


def shared_at_most(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The bound for ``one`` histogram and each row of ``many`` with as many bins."""
    return np.minimum(one, many).sum(axis=-1, dtype=np.int64)


def may_link(a: bytes, b: bytes, size_a: int, size_b: int, threshold: int) -> bool:
    """False only for sets that are surely not linked."""
    small, large = sorted((size_a, size_b))
    if small * 100 < threshold * large:
        return False
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    bins = min(len(x), len(y))
    x, y = (h.reshape(-1, bins).sum(axis=0, dtype=np.uint16) for h in (x, y))
    return int(shared_at_most(x, y)) >= needed(size_a, size_b, threshold)


def shingle_set(text: str, size: int = WORDS) -> set:
    """The distinct word shingles themselves."""
    words = text.encode().translate(_LOWER).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def linked(a: set, b: set, threshold: int = THRESHOLD) -> bool:
    """Whether two sets reach the threshold."""
    small, large = sorted((a, b), key=len)
    if len(small) * 100 < threshold * len(large):
        return False
    common = len(small & large)
    return 100 * common >= threshold * (len(a) + len(b) - common)


def candidates(histograms: list[bytes], buckets: list[set], sizes: np.ndarray, components: np.ndarray, bucket: int, left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, np.ndarray]]:
    """Pairs of one bucket that may be linked, as ``(position in left, positions in right)``.

    Left out are pairs of one component, of sizes too far apart, that share too little by the bound of their histograms,
    and pairs that are in a bucket of smaller key together: they are compared there.
    """
    bins = np.array([len(h) for h in histograms])
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(n):
        """Rows with ``n`` bins or more in ``right``, and their histograms with ``n`` bins."""
        if n not in folded:
            rows = right[bins[right] >= n]
            folded[n] = rows, np.array([np.frombuffer(histograms[j], np.uint8).reshape(-1, n).sum(axis=0, dtype=np.uint16) for j in rows], np.uint16).reshape(len(rows), n)
        return folded[n]

    found, same_block = [], bool(len(left) and len(right) and np.isin(left[0], right))
    for i in left:
        small, large = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
        hit = (components[right] != components[i]) & (small * 100 >= large * threshold)
        if same_block:
            hit &= right > i
        if not hit.any():
            continue
        least = -(-threshold * (sizes[right] + sizes[i]) // (100 + threshold))
        for n in np.unique(np.minimum(bins[right[hit]], bins[i])).tolist():
            if n:  # a set without a histogram is compared with all
                rows, counts = at(n)
                own = np.frombuffer(histograms[i], np.uint8).reshape(-1, n).sum(axis=0, dtype=np.uint16)
                here = hit & (np.minimum(bins[right], bins[i]) == n)
                bound = shared_at_most(own, counts[here[bins[right] >= n]])
                hit[here] = bound >= least[here]
        chosen = np.array([j for j in right[hit] if min(buckets[i] & buckets[j]) == bucket], np.int64)
        if len(chosen):
            found.append((int(i), chosen))
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its least connected node, of every node of ``edges (a, b)``.

    Large and small stars by turns until the edges stay as they are: each turn links neighbours to the least of them.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grouped(batches, columns):
    """Runs of equal ``group`` values of sorted batches, as lists of rows."""
    name, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)):
            if row[0] != name and rows:
                yield rows
                rows = []
            name = row[0]
            rows.append(row)
    if rows:
        yield rows


def _links(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=_LINK)


def _promising(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The rows of ``pairs (center, cid)`` that the sizes and histograms of both don't rule out."""
    heads = sketches.select(F.col("cid").alias("center"), F.col("size").alias("size_a"), F.col("histogram").alias("histogram_a"))

    def check(batches):
        for batch in batches:
            keep = [may_link(a.as_py(), b.as_py(), m.as_py(), n.as_py(), threshold) for a, m, b, n in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("histogram_a", "size_a", "histogram", "size")))]
            yield batch.select(["center", "cid"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(heads, "center").join(sketches, "cid").mapInArrow(check, "center bigint, cid bigint")


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``cid`` and ``body`` of the texts that ``ids (cid)`` name; few others come along."""
    return maybe_in(texts.select("cid", "body"), [F.col("cid")], ids.select("cid").distinct(), [F.col("cid")])


def _stars(pairs: DataFrame, texts: DataFrame, words: int, threshold: int, salts: int = 64) -> DataFrame:
    """The links among ``pairs (center, cid)``; a center's text goes once to each of its salts, a member's to one."""
    salted = pairs.select("center", "cid", F.pmod(F.xxhash64("cid"), F.lit(salts)).alias("salt"))
    bodies = _only(texts, pairs.select("cid").unionByName(pairs.select(F.col("center").alias("cid"))))
    members = salted.join(bodies, "cid").select("center", "salt", F.lit(1).alias("turn"), "cid", "body")
    heads = salted.select("center", "salt").distinct().join(bodies.withColumnRenamed("cid", "center"), "center").select("center", "salt", F.lit(0).alias("turn"), F.col("center").alias("cid"), "body")

    def check(batches):
        for batch in batches:
            out = []
            for center, turn, cid, body in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("center", "turn", "cid", "body"))):
                found = shingle_set(body.as_py(), words)
                if turn.as_py() == 0:
                    check.at, check.head = center.as_py(), found
                elif check.at == center.as_py() and linked(check.head, found, threshold):
                    out.append((cid.as_py(), check.at))
            yield _links(out)

    check.at = check.head = None
    together = heads.unionByName(members)
    return together.repartition("center", "salt").sortWithinPartitions("center", "salt", "turn").mapInArrow(check, "a bigint, b bigint")


def _blocks(buckets: DataFrame, texts: DataFrame, words: int, threshold: int, block: int) -> DataFrame:
    """The links between members of one bucket that are in different components.

    Buckets are dealt out as pairs of blocks of about ``block`` members. A first pass compares histograms and names the
    documents of each block pair that have candidates there; a second gets their texts and confirms on the shingles.
    Only links leave.
    """
    counts = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi")
    active = buckets.join(counts.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key")
    sketches = maybe_in(texts.select("cid", "size", "histogram"), [F.col("cid")], active.select("cid").distinct(), [F.col("cid")])
    of = active.groupBy("cid").agg(F.collect_list("key").alias("buckets")).join(sketches, "cid")
    active = active.join(of, "cid").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = active.withColumn("other", other).select(
        F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "key", "cid", "component", "size", "histogram", "buckets", (F.col("own") <= F.col("other")).alias("low"), (F.col("own") >= F.col("other")).alias("high")
    )

    def compare(batches):
        for found in _grouped(batches, ("group", "key", "cid", "component", "size", "histogram", "buckets", "low", "high")):
            group, key, cid, component, size, histograms, of, low, high = zip(*found)
            cid = np.array(cid)
            pairs = dict(candidates(histograms, [set(b) for b in of], np.array(size), np.array(component), key[0], np.flatnonzero(low), np.flatnonzero(high), threshold))
            if pairs:  # a row for every document that has a pair here, on whichever side
                some = sorted({*pairs, *np.unique(np.concatenate(list(pairs.values()))).tolist()})
                others = [cid[pairs[i]] if i in pairs else cid[:0] for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([group[0]] * len(some)), pa.array(cid[some]), pa.array(others, pa.list_(pa.int64()))], names=["group", "cid", "others"])

    found = materialize(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "group string, cid bigint, others array<bigint>"), "candidates")
    bodies = found.select("group", "cid").join(_only(texts, found), "cid").select("group", F.lit(0).alias("turn"), "cid", "body", F.lit(None).cast("array<bigint>").alias("others"))
    asked = found.filter(F.size("others") > 0).select("group", F.lit(1).alias("turn"), "cid", F.lit(None).cast("string").alias("body"), "others")

    def confirm(batches):
        for found in _grouped(batches, ("group", "turn", "cid", "body", "others")):
            known = {cid: shingle_set(body, words) for _, turn, cid, body, _ in found if turn == 0}
            top = {c: c for c in known}

            def find(c):
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            out = []
            for _, turn, cid, _, others in found:
                for b in others or ():
                    if turn and find(cid) != find(b) and linked(known[cid], known[b], threshold):
                        top[find(cid)] = find(b)
                        out.append((cid, b))
            if out:
                yield _links(out)

    return bodies.unionByName(asked).repartition("group").sortWithinPartitions("group", "turn").mapInArrow(confirm, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = 256) -> DataFrame:
    """Components of documents whose shingle sets are similar; one row per row of ``documents``.

    Columns: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``. Links need
    ``100 * intersection >= threshold * union`` of the sets of distinct ``words``-word shingles of the text in which A-Z
    are lower case. Fewer words are one shingle; a null or empty text has none and is linked with nothing. A null id is
    larger than any other; a component of null ids only has a null ``component_id`` and its rows stay; of repeated ids
    all rows stay or go together. Texts of any length are read whole. An empty table gives an empty result; other columns
    are ignored, so clashing names do no harm.
    """
    return _judged(documents, id_col, text_col, words, threshold, bands, rows, block).drop("text_id")


def _judged(documents: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = 256) -> DataFrame:
    """What ``near_duplicates`` returns, with ``text_id``, the digest of each row's text."""
    prepare(documents.sparkSession)
    source = documents.select(documents[id_col].alias("doc_id"), F.coalesce(documents[text_col], F.lit("")).alias("body"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            sizes, ids, keys = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                sizes.append(len(found))
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(signature(found, bands * rows), bands, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_id", "n_shingles", "set_id", "keys"])

    with_digest = lambda df: df.select("doc_id", F.unhex(F.md5("body")).alias("text_id"), "body")
    made = with_digest(source).mapInArrow(read, f"doc_id {kind}, text_id binary, n_shingles bigint, set_id binary, keys array<bigint>")
    read_rows = materialize(made.withColumn("cid", F.monotonically_increasing_id()), "shingled")

    # Of rows with equal sets the first stands for all; the others are known by it.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "cid")
    whole = read_rows.filter("n_shingles > 0")
    repeated = whole.groupBy("set_id").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_id", F.col("first.cid").alias("head"))
    repeated = materialize(repeated, "repeated")
    set_id = [F.col("set_id")]
    copies = maybe_in(whole.select("set_id", "cid"), set_id, repeated, set_id).join(repeated, "set_id").select("cid", "head")
    copies = materialize(copies, "copies")
    lower = copies.filter("cid <> head").select(F.col("cid").alias("_copy"))
    classes = without(whole.select("cid", "keys"), [F.col("cid")], lower, [F.col("_copy")], F.col("cid") == F.col("_copy"))

    # Few keys are found twice: those alone are counted first, and the others don't leave their tasks.
    entries = classes.select("cid", F.explode("keys").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    met = materialize(maybe_in(entries, [F.col("key")], shared, [F.col("key")]), "met")
    centers = met.groupBy("key").agg(F.min("cid").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    buckets = materialize(met.join(centers, "key"), "buckets")
    in_buckets = buckets.select("cid").distinct()
    cid = [F.col("cid")]
    wanted = maybe_in(read_rows.select("cid", "text_id", F.col("doc_id").alias("_id")), cid, in_buckets, cid).join(in_buckets, "cid")
    wanted = materialize(wanted, "wanted")
    name = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit(""))]
    texts = with_digest(maybe_in(source, name("doc_id"), wanted, name("_id"))).join(wanted, "text_id").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = texts.dropDuplicates(["text_id", "cid"]).select("cid", "body")

    def measure(batches):
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(map(histogram, found), pa.binary()), batch.column(1)], names=["cid", "size", "histogram", "body"])

    texts = materialize(texts.mapInArrow(measure, "cid bigint, size bigint, histogram binary, body string"), "texts")
    stars = _promising(buckets.filter("cid <> center").select("center", "cid").distinct(), texts.select("cid", "size", "histogram"), threshold)
    links = materialize(_stars(materialize(stars, "stars"), texts, words, threshold), "links")
    parts = components(links)
    marked = buckets.drop("center").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    more = materialize(_blocks(materialize(marked, "marked"), texts, words, threshold, block), "links")
    parts = components(links.unionByName(more))

    # What is in a component with another row: copies by their head, heads and linked documents by themselves.
    linked_rows = parts.select(F.col("node").alias("cid"), "component")
    moved = copies.join(linked_rows.withColumnRenamed("cid", "head"), "head", "left").select("cid", F.coalesce("component", "head").alias("component"))
    moved = moved.unionByName(linked_rows.join(copies.select("cid"), "cid", "left_anti"))
    moved = materialize(moved.join(maybe_in(read_rows.select("cid", "doc_id"), cid, moved, cid), "cid"), "members")
    smallest = moved.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = moved.select("cid", "component").join(smallest, "component").select("cid", "component_id", F.lit(True).alias("known"))
    out = read_rows.select("cid", "doc_id", "text_id", "n_shingles").join(named, "cid", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, with all their columns and under the same rules.

    Rows without words stay; of repeated rows all stay or go together; an empty table stays empty.
    """
    lost = _judged(documents, id_col, text_col, threshold=threshold).filter(~F.col("kept")).select("doc_id", "text_id").distinct()
    ids, texts = fresh_name(documents.columns, "_lost_id"), fresh_name(documents.columns, "_lost_text")
    lost = lost.select(F.col("doc_id").alias(ids), F.col("text_id").alias(texts))
    lost = materialize(lost, "lost")
    name = lambda c: [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))]
    text = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(ids)) & (text == F.col(texts))
    return without(documents, name(id_col), lost, name(ids), same)
