"""Substring search by postings against the scan."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope.operators import overview as ov
from merchantscope.sources.substrings import SubstringIndex, cover, indexed_search, write_index

NAMES = ["Alpha Traders", "alphalpha", "aaaaaa", "aaaa", "aa", "a", "", None, "Ünïcode Café", "ab", "x" * 400 + "needle", "50%_off [x]",
         "banana bandana", "bandanab", "Supplier#000000012", "supplier#000000120", "naïve\ttab"]
NEEDLES = ["a", "aa", "aaa", "aaaaa", "aaaaaa", "aaaaaaa", "ALPHA", "alphalpha", "bandana", "banana b", "é", "Üni", "needle", "%_", "[x]", "#00000012", "zz", "1", "10", "x" * 50, "ab", "ï"]


@pytest.fixture(scope="module")
def merchants(spark):
    rows = [(i, n, n[::-1] if n else None, float(i % 3)) for i, n in enumerate(NAMES)] + [(i, n, None, 9.0) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "merchant_id long, name string, other string, score double")


@pytest.fixture(scope="module")
def index(spark, merchants, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('grams')}/index"
    write_index(merchants, "merchant_id", ["merchant_id", "name", "other"], path)
    return SubstringIndex(spark, path, T.LongType())


def scan(merchants, needle):
    cols = ["merchant_id", "name", "other"]
    return sorted({r.merchant_id for r in ov.entity_search(merchants, needle, cols, "score", k=10_000).collect()})


def test_cover():
    assert [cover(n) for n in (3, 4, 6, 7)] == [[0], [0, 1], [0, 3], [0, 3, 4]]


def test_equals_the_scan(index, merchants):
    for needle in NEEDLES:
        assert sorted(r.key for r in index.find(needle).collect()) == scan(merchants, needle), needle


def test_many_needles_at_once(spark, index, merchants):
    asked = spark.createDataFrame([(n,) for n in [*NEEDLES, NEEDLES[0], "", "  ", None]], "needle string")
    got = sorted(map(tuple, index.find_all(asked).collect()))
    assert got == sorted((n, k) for n in NEEDLES for k in scan(merchants, n))


def test_top_k_and_blank_text(index, merchants):
    cols = ["merchant_id", "name", "other"]
    for text in ("alpha", "  ", "A"):
        got = indexed_search(index, merchants, "merchant_id", text, "score", k=5, when_blank=F.col("score") > 1)
        want = ov.entity_search(merchants, text, cols, "score", k=5, when_blank=F.col("score") > 1)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="blank"):
        index.find(" ")


def test_the_plan_reads_postings_only(index):
    for needle, pushed in (("banana", "In(gram, [ana,ban])"), ("ba", "StringStartsWith(gram,ba)")):
        plan = index.find(needle)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and pushed in plan, plan
        assert "text" not in plan


def test_empty_table(spark, merchants, tmp_path):
    write_index(merchants.filter("false"), "merchant_id", ["name"], f"{tmp_path}/none")
    assert SubstringIndex(spark, f"{tmp_path}/none", T.LongType()).find("abc").count() == 0
