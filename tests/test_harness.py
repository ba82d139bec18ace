"""Grounded respelling, ladders and source rewrites."""

import pytest
from pyspark.sql import functions as F

from tessarine.functions.text import compare_key
from tessarine.proposals import harness
from tessarine.sources import variants


def test_grounded_respelling(spark):
    rows = [(1, "Air Compresor", ["the compressor in hall 2"]), (2, "Air Compresor", ["a compresor and a compressor"]), (3, "Air Compresor", ["nothing"]), (4, "Pumq", ["pump"]), (5, "Air Compressor", ["compressor"]), (6, "Air Comprr", ["compressor"])]
    answers = spark.createDataFrame(rows, "answer_id int, name string, cited array<string>").coalesce(1)
    names = spark.createDataFrame([("Air Compressor",), ("Pump",)], "name string").coalesce(1)
    assert [tuple(r) for r in harness.grounded_respellings(answers, names).collect()] == [(1, "Air Compresor", "Air Compressor")]


def test_ladder(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "item string, ord int").coalesce(1)
    got = harness.ladder(items, 2).collect()
    assert sorted({(r.step, r.n_kept) for r in got}) == [(0, 0), (1, 2), (2, 3)]
    with pytest.raises(ValueError):
        harness.ladder(items, 0)


def test_rewrites_keep_the_key(spark):
    df = spark.createDataFrame([("Ab c",), (None,), ("",)], "x string").coalesce(1)
    want = [r[0] for r in df.select(compare_key(F.col("x"))).collect()]
    for v in ("as_is", "missing_empty", "missing_blank", "missing_null", "missing_tab", "padded", "upper", "lower"):
        assert [r[0] for r in variants.rewritten(df, ["x"], v).select(compare_key(F.col("x"))).collect()] == want, v
    dates = spark.createDataFrame([("19991231",)], "x string")
    assert dates.select(variants.rewrite(F.col("x"), "dates_slashed")).first()[0] == "31/12/1999"
    assert variants.renamed(df, ["x"]).columns == ["src_x"] and variants.prefixed_ids(df, "x").first()[0] == "x-Ab c"
