"""Text, hashes, numbers and features against plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rankflow.functions import hashing as H
from rankflow.functions import numeric as N
from rankflow.functions import text as X
from rankflow.operators import features
from rankflow.sources import tables


def one(spark, column, *values, names=None):
    names = names or [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], names).select(column.alias("x")).first().x


def test_normalization(spark):
    value = "Ёлка,  café — ﬁne №5!"
    assert one(spark, X.normalize(F.col("c0"), True), value) == "елка caf fine no5"
    assert one(spark, X.normalize(F.col("c0")), "A-b  C") == "a b c"
    assert one(spark, X.canonical(F.col("c0")), "b a b") == "a b b"
    assert one(spark, X.squeeze(F.col("c0")), " A,  b\t") == "a, b"
    assert one(spark, X.first_tokens(F.col("c0"), 2, "w:"), "b a b c") == ["w:b", "w:a"]


def test_trigrams_and_jaccard(spark):
    def grams(t):
        p = f"  {t} "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    a, b = "abc", "abd"
    assert set(one(spark, X.trigrams(F.col("c0")), a)) == grams(a)
    assert one(spark, X.jaccard(X.trigrams(F.col("c0")), X.trigrams(F.col("c1"))), a, b) == pytest.approx(len(grams(a) & grams(b)) / len(grams(a) | grams(b)))
    assert one(spark, X.jaccard(X.trigrams(F.col("c0")), X.trigrams(F.col("c0"))), "") == 0


@pytest.mark.parametrize("url,domain", [("https://www.Shop.example/x?q", "shop.example"), ("m.example.com/a", "m.example.com"), ("http://u:p@h.example:8080", "h.example"), ("", ""), (" //x.example/ ", "x.example")])
def test_url_domain(spark, url, domain):
    assert one(spark, X.url_domain(F.col("c0")), url) == domain


@pytest.mark.parametrize("text", ["abc", "ё", "", "x" * 50])
def test_hashes(spark, text):
    sha, md5 = hashlib.sha1(text.encode()).digest(), hashlib.md5(text.encode()).digest()
    c = F.col("c0")
    assert int(one(spark, H.sha1_64(c), text)) == int.from_bytes(sha[:8], "little")
    assert one(spark, H.partition(c), text) == int.from_bytes(sha[:8], "little") % 32
    assert one(spark, H.bucket(c), text) == (int.from_bytes(sha[:8], "little") % 1_000_003 + 1 if text else 0)
    assert one(spark, H.md5_16(c), text) == int.from_bytes(md5[:2], "little")
    assert one(spark, H.query_key(c), text) == sha.hex()[:20]


def test_namespaced_hash_keeps_a_bucket_for_missing(spark):
    df = spark.createDataFrame([(None,), ("",), ("7",)], "u string").select(H.namespaced("user", F.col("u"), 10).alias("h"))
    got = [r.h for r in df.collect()]
    assert got[:2] == [0, 0] and got[2] == int.from_bytes(hashlib.md5(b"user:7").digest()[:8], "little") % 9 + 1


@pytest.mark.parametrize("value,expected", [(-5.0, (0, 0, 1.0, 0.0)), (0.0, (0, 1, 1.0, 0.0)), (5.0, (0, 1, 0.5, 0.5)), (12.0, (1, 2, 0.8, 0.2)), (20.0, (2, 2, 1.0, 0.0)), (99.0, (2, 2, 1.0, 0.0))])
def test_piecewise_saturates(spark, value, expected):
    assert tuple(one(spark, N.piecewise(F.col("c0"), (0.0, 10.0, 20.0)), value)) == pytest.approx(expected)


def test_group_scales(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g long, x double")
    rows = df.select("g", N.min_max(F.col("x"), "g").alias("m"), N.z_score(F.col("x"), "g").alias("z")).orderBy("g", "m").collect()
    assert [(r.m, r.z) for r in rows] == [(0.0, -1.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_standardize_and_weights(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (500.0, 7.0)], "x double, flat double")
    rows = features.standardize(df, ["x", "flat"], clip=1.0).collect()
    assert {r.flat for r in rows} == {0.0} and max(r.x for r in rows) == 1.0
    weights = features.group_weights(spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 100.0), (3, 0.0)], "request long, cost double"), 0.5, 1.0, 1.0)
    got = {r.request: r.weight for r in weights.collect()}
    assert sum(got.values()) == pytest.approx(3) and got[1] == got[2] == pytest.approx(4 * got[3])
    examples = features.example_weights(spark.createDataFrame([(1, math.e - 1), (1, math.e**2 - 1), (1, 0.0)], "b long, cost double"), "b", 1.0, 0.5, 3.0)
    got = sorted(r.weight for r in examples.collect())
    assert got == pytest.approx([0.5 / (3.5 / 3), 1 / (3.5 / 3), 2 / (3.5 / 3)])


def test_feature_names_are_unique():
    assert features.check_names(["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        features.check_names(["a", "a"])


def test_patch_needs_every_row(spark):
    base = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "request long, item long, x double")
    donor = base.withColumn("x", F.lit(5.0))
    assert {r.x for r in features.patch_columns(base, donor, ["request", "item"], ["x"]).collect()} == {5.0}
    with pytest.raises(Exception, match="missing in the donor"):
        features.patch_columns(base, donor.limit(1), ["request", "item"], ["x"]).collect()


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(1, 60)], "item long, name string")
    out = tables.tolerant(df, {"item": "int", "absent": "string", "n": "long"}, {"n": F.lit(3)})
    assert out.dtypes == [("item", "int"), ("absent", "string"), ("n", "bigint")] and out.first().n == 3
    tables.write_partitioned(df, str(tmp_path / "p"), F.col("name"), 4)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 59
    tables.overwrite_sorted(df, str(tmp_path / "s"), "name")
    assert [r.name for r in spark.read.parquet(str(tmp_path / "s")).orderBy("name").limit(2).collect()] == ["n1", "n10"]
    tables.publish_ids(df, str(tmp_path / "ids"), 59)
    with pytest.raises(Exception):
        tables.publish_ids(df, str(tmp_path / "ids"), 59)
    with pytest.raises(ValueError):
        tables.publish_ids(df.union(df), str(tmp_path / "ids2"), 118)
    with pytest.raises(ValueError):
        tables.append_catalog(df, df, "item")
    df.createOrReplaceTempView("catalog_rows")
    assert tables.run_sql_to_parquet(spark, "SELECT item FROM catalog_rows WHERE item > :least", str(tmp_path / "q"), least=50) == 1
    assert spark.read.parquet(str(tmp_path / "q")).count() == 9
    assert [r["item"] for r in tables.chronological(df, "item").collect()] == list(range(1, 60))
    assert tables.key_range(df, "item", 5, 8).count() == 3
    wide = tables.to_wide(spark.createDataFrame([(1, 7, 2), (1, 8, 1)], "request long, item long, rank long"))
    assert wide.first()["items"] == [8, 7] and [(r["item"], r["rank"]) for r in tables.to_long(wide).collect()] == [(8, 1), (7, 2)]
