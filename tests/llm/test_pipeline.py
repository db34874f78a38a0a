import random
import zlib

import numpy as np
from test_near_dedup import brute as near
from test_quality_rules import brute as measures
from test_secrets import RANKS, WORD

import corpus_pipeline
from rankflow.llm.encoding import load
from rankflow.llm.secrets import masked


def corpus():
    rng = random.Random(5)
    rows = [(None, None, "en", "a", None), (0, "", "en", "a", 0)]
    base = " ".join(f"w{rng.randint(0, 900)}" for _ in range(150))
    texts = [base, base.upper(), base + " more", base, "short text", "x " * 80, base + " token=" + "Zk3" * 9, "w " * 3 + base]
    texts += [" ".join(f"v{rng.randint(0, 9000)}" for _ in range(rng.randint(60, 6000))) + rng.choice(["", " password: hunter22", " AKIA" + "Q" * 18]) for _ in range(25)]
    bad = [" ".join(f"u{rng.randint(0, 9000)}###" for _ in range(90)) for _ in range(40)]
    rows += [(i, t, "en", "good", len(t)) for i, t in enumerate(texts, 1)] + [(1000 + i, t, "en", "bad", len(t)) for i, t in enumerate(bad)]
    return rows


def expected(rows):
    """Each stage by hand; returns the packed documents ``id -> text``."""
    kept = []
    for row in rows:
        n, _, _, _, repeated = measures(row[1] or "")
        if n >= 50 and repeated * 100 <= n * 50 and row[3] != "bad":
            kept.append(row)
    best = {}
    for row in kept:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
        if key not in best or best[key][0] < row[0]:
            best[key] = row
    kept = list(best.values())
    found = near([(r[0], r[1]) for r in kept], 80)
    return {r[0]: masked(r[1], RANKS) for r, (_, c) in zip(kept, found) if r[0] == c}


def test_equal_to_brute_force(spark, tmp_path):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library, capacity = load(WORD), 4096
    pieces = {}
    for doc, text in expected(rows).items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            pieces[doc, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= capacity


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "word " * 3, "en", "a", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and docs.count() == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
