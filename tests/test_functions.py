"""Text forms and similarities against pinned values."""

import math

import pytest
from pyspark.sql import functions as F

from tessarine.functions import similarity as S
from tessarine.functions import text as T


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.9611111), ("x", "x", 1.0), ("", "", 1.0), ("", "a", 0.0), ("a", "", 0.0), ("DWAYNE", "DUANE", 0.84)])
def test_jaro_winkler(a, b, want):
    assert S.jaro_winkler_value(a, b) == pytest.approx(want, abs=1e-6)


def test_half_transpositions_count():
    assert S.jaro_value("ABCDEFGH", "BCADEFGH") == pytest.approx(0.9375)


def test_levels(spark):
    rows = [("MARTHA", "MARTHA"), ("MARTHA", "MARHTA"), ("JELLYFISH", "SMELLYFISH"), ("DWAYNE", "DUANE"), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(S.level(S.jaro_winkler(F.col("a"), F.col("b")), [1.0, 0.92, 0.88]).alias("g")).collect()
    assert [r.g for r in got] == [3, 2, 1, 0, None]


def test_hangul_names():
    agree = lambda a, b: S.jaro_winkler_value(T.jamo(a), T.jamo(b)) >= 0.9
    assert agree("김민준", "김민중") and not agree("김민준", "이민준") and not agree("김철수", "김영희")


def test_token_jaccard(spark):
    rows = [("a b c", "c b a", 1.0), ("a b c", "a b d", 0.5), ("a a b", "a b", 1.0), ("a b", "c d", 0.0), ("--", "()", 1.0), ("a", "--", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double").coalesce(1)
    assert all(r.s == pytest.approx(r.want) for r in df.select("want", S.token_jaccard(F.col("a"), F.col("b")).alias("s")).collect())


def test_monge_elkan():
    assert S.monge_elkan_value("ann lee", "lee ann") == 1 and 0.97 <= S.monge_elkan_value("jonathan smith", "smith jonathen") < 1
    assert S.monge_elkan_value("--", "()") == 1 and S.monge_elkan_value("a", "--") == 0


def test_keys(spark):
    rows = [("Work Order", "work_order"), ("ＡＢＣ", "abc"), ("Café", "CAFÉ"), ("작업 지시", "작업지시"), ("  x　", "X")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select((T.name_key(F.col("a")) == T.name_key(F.col("b"))).alias("same"), T.compare_key(F.col("a")).alias("k")).collect()
    assert all(r.same for r in got) and got[4].k == "X"
    odd = spark.createDataFrame([("part", "item"), ("Café", "Cafe")], "a string, b string")
    assert odd.where(T.name_key(F.col("a")) == T.name_key(F.col("b"))).count() == 0
    assert spark.createDataFrame([(" \t",), (None,)], "a string").where(T.compare_key(F.col("a")).isNotNull()).count() == 0


def test_overlap_tokens(spark):
    df = spark.createDataFrame([("The pump leaks, the PUMP!",), ("펌프가 leaks",), ("if a",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(T.overlap_tokens(F.col("t"))).collect()] == [["pump", "leaks", "pump"], ["펌프", "프가", "leaks"], []]


def test_innate_and_values(spark):
    df = spark.createDataFrame([("PERSON", "Innate"), ("Per-son", "Innate"), ("Company", "Acquired"), ("Organisation", "Acquired")], "t string, want string")
    assert df.where(T.innate(F.col("t")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("a/b é", "a%2Fb%20é")], "t string, want string")
    assert df.where(T.local_name("t") == F.col("want")).count() == 1


def test_sql_names(spark):
    S.register(spark)
    row = spark.sql("SELECT jaro_winkler('MARTHA', 'MARHTA') AS j, monge_elkan('a b', 'b a') AS m").first()
    assert math.isclose(row.j, 0.9611111, abs_tol=1e-6) and row.m == 1.0
