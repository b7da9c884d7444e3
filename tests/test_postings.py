"""Contains filters through trigram postings equal a full scan."""

import random
import re

from pyspark.sql import functions as F

from helpdeck.operators import postings as P
from helpdeck.operators.filters import contains_like


def test_indexed_filter_equals_scan(spark, tmp_path):
    rnd = random.Random(1)
    letters = "abAB é%_\\1日"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) if i % 9 else None, rnd.choice(["Tokopedia", "tokO É", "Shopee", ""])) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, a string, b string")
    path = str(tmp_path / "p")
    P.write_postings(P.postings(d, ["a", "b"]), path)
    index = spark.read.parquet(path)
    for needle in ["abA", "a", "", "b_A%ab", "éab", "\\\\1", "ab%", "%%", "日a", "aBaBa", "zzz", "a b A"]:
        want = sorted(r.id for r in (d.filter(contains_like("a", needle)) if needle else d).collect())
        assert sorted(r.id for r in P.contains_filter(d, index, {"a": needle, "b": None}).collect()) == want, needle
    both = P.contains_filter(d, index, {"a": "ab", "b": "TOKO"})
    assert sorted(r.id for r in both.collect()) == sorted(r.id for r in d.filter(contains_like("a", "ab") & contains_like("b", "TOKO")).collect())


def test_only_the_trigrams_folders_are_read(spark, tmp_path):
    d = spark.range(2000).select("id", F.concat(F.lit("name "), F.hex(F.xxhash64("id"))).alias("a"))
    path = str(tmp_path / "p")
    P.write_postings(P.postings(d, ["a"]), path)
    index = spark.read.parquet(path)
    some = P.candidates(index, "a", "3F7A")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert 0 < some.count() < 50 and P.candidates(index, "a", "3_F") is None
    assert P.trigrams("aB%cdE_fGhi") == ["cde", "fgh", "ghi"] and P.bucket("cde") == d.select((F.crc32(F.lit("cde").cast("binary")) % P.BUCKETS).alias("b")).first().b


def test_a_trigram_has_lists_of_ids(spark):
    """A text that all rows have makes one list per trigram, not one row per trigram and id."""
    d = spark.range(0, 3000, 1, 1).select("id", F.lit("Tokopedia").alias("a"), F.when(F.col("id") % 2 == 0, "aaaaa").alias("b"))
    got = P.postings(d, ["a", "b"]).collect()
    assert len(got) == 7 + 1
    assert all(sorted(r.ids) == (list(range(3000)) if r.field == "a" else list(range(0, 3000, 2))) for r in got)
    assert sorted(r.gram for r in got if r.field == "a") == P.trigrams("tokopedia")
