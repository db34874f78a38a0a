import random
import re
from collections import Counter

import duckdb

from rankflow.llm import quality_rules
from rankflow.llm.common import site
from rankflow.llm.quality_rules import host_rates, judge, keep_good, measure, measured


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", "漢", " ", " ", "\n", "\t", "\x85", "#", "<", "\x0b", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert measure(text) == brute(text)


def docs(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, None, None), (1, "", "a"), (2, "x " * 60, "a"), (2, "x " * 60, "a")]
    for i in range(3, 200):
        host = "bad" if i % 4 == 0 else "good"
        source = [f"https://www.{host}.Example:8080/{i}/page?x", f"http://me@{host}.example/{i}", f"{host.upper()}.example"][i % 3]
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        rows.append((i, " ".join(w + "###" * (host == "bad") for w in words), source))
    rows.append((999, " ".join(f"v{i}" for i in range(70)), "https:///no/host"))
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, n_words string")
    frame.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return frame


def test_hosts_and_sql(spark, tmp_path):
    frame = docs(spark, tmp_path)
    got = judge(frame)
    rows = got.collect()
    assert {r.kept for r in rows if r.doc_id and r.doc_id > 2 and (r.doc_id % 4 or r.doc_id == 999)} == {True}
    assert {(r.host_rejected, r.kept) for r in rows if r.doc_id and r.doc_id > 2 and r.doc_id % 4 == 0} == {(True, False)}
    assert [r.kept for r in rows if r.doc_id is None or r.doc_id <= 2] == [False] * 4
    rates = {r.host: r.documents for r in host_rates(measured(frame, [site(frame["source"])[0].alias("host")]), "host").collect()}
    assert rates["bad.example"] == 49 and rates["good.example"] == 148
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * EXCLUDE (n_words) FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.execute(quality_rules.ORACLE_SQL).fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(key, sql)) == sorted(map(key, map(tuple, rows)))
    assert judge(frame.limit(0)).count() == 0
    kept = keep_good(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
