import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rankflow.llm import exact_dedup
from rankflow.llm.common import materialize, release, table_path, tracked, work_path
from rankflow.llm.exact_dedup import dedup_table, keep_one, run_stream, states

ROWS = [(1, "Hello"), (2, "hELLO"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100000), (8, "X" * 100000), (8, "X" * 100000), (None, "hello"), (None, "lone")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def table(spark, path, rows, parts=3):
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string").repartition(parts).write.parquet(str(path))
    return str(path)


def check(got, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in m)
        best = max(members, key=lambda i: (i is not None, i or 0))
        assert (r.keep_id, r.group_size) == (best, len(members)) and (not r.kept or r.doc_id == best)
    assert sum(r.kept for r in got) == len(groups)


def test_rows(spark, tmp_path):
    check(dedup_table(spark, table(spark, tmp_path / "t", ROWS)).collect(), ROWS)


def test_many_micro_batches(spark, tmp_path):
    rows = [(i, f"Text {i % 7}") for i in range(60)]
    check(dedup_table(spark, table(spark, tmp_path / "t", rows, 6), batch={"maxFilesPerTrigger": "1"}).collect(), rows)


def test_state_lives_on(spark, tmp_path):
    path = table(spark, tmp_path / "t", [(1, "a"), (2, "b")], 1)
    schema = spark.read.parquet(path).schema
    go = lambda: run_stream(spark, path, schema, "doc_id", "text", str(tmp_path / "w"))
    go()
    spark.createDataFrame([(3, "A", "")], "doc_id long, text string, digest string").write.mode("append").parquet(path)
    go()
    assert sorted((r.n, r.kept.id) for r in states(spark, str(tmp_path / "w")).collect()) == [(1, 2), (2, 3)]


def test_bytes_are_checked(spark, tmp_path, monkeypatch):
    """With a digest of two letters, texts that only share it stay apart."""
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 2) if n == 256 else real(c, n))
    rows = [(i, f"t{i % 40}") for i in range(300)]
    got = dedup_table(spark, table(spark, tmp_path / "t", rows)).collect()
    assert len(got) == 300 and sum(r.kept for r in got) == 40
    assert all(r.keep_id == max(i for i, _ in rows if i % 40 == r.doc_id % 40) and r.group_size == len([i for i, _ in rows if i % 40 == r.doc_id % 40]) for r in got)


def test_keep_one_and_empty(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "c") for r in ROWS], "doc_id long, text string, _locator string")
    kept = keep_one(frame)
    assert kept.columns == frame.columns and sorted(lower(r.text) for r in kept.collect()) == sorted({lower(t) for _, t in ROWS})
    assert keep_one(frame.limit(0)).count() == 0


def test_single_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["A", "a"]}), path)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in dedup_table(spark, path).collect()) == [(1, 2, False), (2, 2, True)]


def test_any_names_and_paths(spark, tmp_path):
    """A column named like Spark's own, paths with spaces or a closing slash, filtered frames."""
    frame = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "b", "z")], "doc_id long, text string, _metadata string")
    kept = keep_one(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == [(2, "a", "y"), (3, "b", "z")]
    for name in ("with space%41", "plain)", "x=1"):
        path = tmp_path / name
        frame.drop("_metadata").write.parquet(str(path))
        assert sorted((r.doc_id, r.kept) for r in dedup_table(spark, f"{path}/").collect()) == [(1, False), (2, True), (3, True)]
        table = spark.read.parquet(str(path))
        assert table_path(table).endswith(name) and table_path(table.filter("doc_id < 3")) is None and table_path(frame) is None
        assert [r.doc_id for r in keep_one(table.filter("doc_id = 1"), written=table_path(table.filter("doc_id = 1"))).collect()] == [1]
        assert sorted(r.doc_id for r in keep_one(table, written=table_path(table)).collect()) == [2, 3]


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work_path(session, "x")
    session.sparkContext.master = "local[2]"
    assert work_path(session, "x").startswith("file://")


def test_work_tables_of_two_pipelines_are_apart(spark, tmp_path):
    mine, other = [], []
    with tracked(mine):
        one = materialize(spark.range(3), "one")
    with tracked(other):
        two = materialize(spark.range(4), "two")
    release(spark, mine, table_path(two))
    assert mine == [] and two.count() == 4
    release(spark, other, table_path(two))
    assert len(other) == 1 and two.count() == 4 and table_path(one) is not None
