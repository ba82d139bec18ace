"""Review statistics against hand-worked numbers."""

import math

import pytest
from pyspark.sql import functions as F

from tessarine.operators import review as R


@pytest.mark.parametrize(
    "strata,budget,floor,want",
    [([(100, 0.5), (900, 0.3)], 100, 1, [16, 84]), ([(100, 0.5), (900, 0.1)], 100, 1, [20, 80]), ([(3, 0), (8, 0), (5, 0.14)], 12, 1, [2, 6, 4]), ([(3, 0.9), (100, 0.3)], 50, 1, [3, 47]), ([(3, 0.5), (4, 0.5)], 100, 1, [3, 4]), ([(100, 0), (300, 0)], 100, 1, [25, 75]), ([(1000, 0.5), (3, 0)], 100, 10, [97, 3])],
)
def test_neyman(strata, budget, floor, want):
    assert R.allocate_neyman(strata, budget, floor) == want


def estimate(spark, strata):
    scores = spark.createDataFrame([(n, float(x)) for n, (_, xs) in strata.items() for x in xs], "stratum string, score double").coalesce(1)
    return R.stratified_estimate(scores, spark.createDataFrame([(n, p) for n, (p, _) in strata.items()], "stratum string, population long")).first()


def test_stratified_estimate(spark):
    r = estimate(spark, {"A": (100, [1, 0.5]), "B": (100, [0.8, 0.6])})
    assert (r.estimate, r.standard_error) == pytest.approx((0.725, 0.1332760293526184)) and (r.low, r.high) == pytest.approx((0.4637789825, 0.9862210175))
    assert estimate(spark, {"A": (100, [0, 0]), "B": (300, [1, 1])}).estimate == pytest.approx(0.75)
    p = 1 - 0.025**0.25
    r = estimate(spark, {"A": (500, [1, 1, 1, 1])})
    assert r.standard_error == pytest.approx(math.sqrt((1 - 4 / 500) * p * (1 - p) / 4)) and r.no_variation == 1
    r = estimate(spark, {"A": (4, [1, 1, 1, 1])})
    assert r.standard_error == 0 and r.stratum_is_census == 1


def test_bound(spark):
    p = lambda n: 1 - 0.025 ** (1 / n)
    got = [r[0] for r in spark.createDataFrame([(1.0,), (30.0,), (300.0,)], "n double").coalesce(1).select(R.unobserved_bound(F.col("n"))).collect()]
    assert got == pytest.approx([p(n) * (1 - p(n)) for n in (1, 30, 300)]) and [p(1), round(p(30), 5), round(p(300), 5)] == [0.975, 0.1157, 0.01222]


def test_bootstrap():
    assert R.rescaling_bootstrap([(3, [1, 0.5, 0])]) == (0.5, 0.5)
    low, high = R.rescaling_bootstrap([(100, [1, 0, 1, 1]), (100, [0, 1, 0, 1])])
    assert low < 0.625 < high and R.rescaling_bootstrap([(100, [1, 0, 1, 1])], seed=3) == R.rescaling_bootstrap([(100, [1, 0, 1, 1])], seed=3)


def agreement(spark, counts):
    rows = []
    for k, ((x, y), n) in enumerate(counts.items()):
        for i in range(n):
            rows += [(k, i, "r1", x), (k, i, "r2", y)]
    return R.reviewer_agreement(spark.createDataFrame(rows, "record_id int, candidate_id int, reviewer_id string, outcome string").coalesce(1)).first()


def test_agreement(spark):
    s, d = "Same", "Different"
    r = agreement(spark, {(s, s): 5, (d, d): 3, (s, d): 2})
    assert (r.observed, r.kappa, r.ac1, r.specific_same, r.specific_different) == pytest.approx((0.8, 0.6, 0.56 / 0.76, 10 / 12, 6 / 8))
    r = agreement(spark, {(s, s): 48, (s, d): 1, (d, s): 1})
    assert r.observed == pytest.approx(0.96) and r.kappa < 0 and r.ac1 > 0.9
    r = agreement(spark, {(s, s): 4})
    assert r.kappa is None and r.ac1 == pytest.approx(1)


def test_strata_and_pilot(spark):
    clusters = spark.createDataFrame([(i, i // 3 if i < 9 else i) for i in range(16)], "record_id int, cluster_id int").coalesce(1).cache()
    strata = R.stratify(clusters, spark.createDataFrame([(0, 9), (3, 10)], "id_a int, id_b int")).cache()
    assert dict(strata.groupBy("stratum").count().collect()) == {"Contested": 4, "CleanMerge": 7, "Singleton": 5}
    pilot = R.draw_pilot(strata, 5, 3).collect()
    assert len(pilot) == 4 + 5 + 5 and sorted(map(tuple, pilot)) == sorted(map(tuple, R.draw_pilot(strata.repartition(3), 5, 3).collect()))
    R.check_strata(strata)
    with pytest.raises(ValueError):
        R.check_strata(strata.union(strata))


def test_record_scores(spark):
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3)], "record_id string, cluster_id int").coalesce(1)
    verdicts = spark.createDataFrame([("a", "b", "Same"), ("a", "c", "Different"), ("a", "d", "Same"), ("d", "e", "CannotTell")], "record_id string, candidate_id string, outcome string").coalesce(1)
    got = {r.record_id: r for r in R.score_records(verdicts, clusters).collect()}
    assert (got["a"].review_precision, got["a"].review_recall) == pytest.approx((2 / 3, 2 / 3))
    assert got["d"].excluded and got["d"].review_precision is None and (got["d"].recall_low, got["d"].recall_high) == (0.5, 1.0)
    sample = spark.createDataFrame([("a",), ("d",)], "record_id string")
    assert R.missing_verdicts(sample, clusters, verdicts).count() == 0


def test_bootstrap_draws_in_slices():
    import tracemalloc

    strata = [(90_000, [1.0, 0.0, 0.0] * 1_000), (50, [0.25, 1.0, 0.0]), (9_000, [0.5, 1.0] * 400)]
    whole = R.rescaling_bootstrap(strata, 400, most=10**9)
    assert all(R.rescaling_bootstrap(strata, 400, most=n) == whole for n in (1, 7_001, 1_000_000))
    tracemalloc.start()
    try:
        R.rescaling_bootstrap([(10**6, [1.0, 0.0] * 10_000)], 500)
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
