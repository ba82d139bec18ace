"""Blocking, estimation, scoring and the whole plan on small batches."""

import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessarine.operators import blocking, compare, estimate, metrics, records, score
from tessarine.plans import linkage

BATCH = [("a", "Kim", "1990", "east"), ("b", " kim", None, "east"), ("c", "Lee", "1990", "east"), ("d", "Park", "1991", "west"), ("e", "Choi", None, "west"), ("f", "CHOI", "1992", "south")]


@pytest.fixture(scope="module")
def batch(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(BATCH)], "record_id string, name string, birth string, school string, ord long")
    return records.prepared(df, ["name", "birth", "school"]).coalesce(1).cache()


def pairs_of(df):
    return sorted(r.a_record_id + r.b_record_id for r in df.collect())


@pytest.mark.parametrize("rules,want", [([["name"]], ["ab", "ef"]), ([["name"], ["birth", "school"]], ["ab", "ac", "ef"]), ([["birth", "school"]], ["ac"]), ([["name"], ["name", "school"], ["school"]], ["ab", "ac", "bc", "de", "ef"])])
def test_rules(batch, rules, want):
    assert pairs_of(blocking.blocked_pairs(batch, rules)) == want


@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_all_pairs_once(batch, buckets):
    assert pairs_of(blocking.all_pairs(batch, buckets=buckets)) == sorted(x + y for x, y in itertools.combinations("abcdef", 2))


def test_predicate(spark):
    rows = [(0, "s1", None, "k1"), (1, "s1", "o", "k2"), (2, None, "o", "k1"), (3, "s2", "p", None)]
    df = spark.createDataFrame(rows, "ord long, scope string, subject string, rkey string").coalesce(1)
    got = blocking.all_pairs(df, buckets=2, predicate=blocking.may_be_same("scope", "subject", "rkey")).collect()
    assert sorted((r.a_ord, r.b_ord) for r in got) == [(0, 1), (0, 2), (2, 3)]


def test_defaults_where_nothing_can_be_learned():
    p = estimate.estimate([((1, 0), 4)], {"x": 2, "y": 2})
    assert (p.status, p.m["x"], p.u["x"], p.prior) == (estimate.HEURISTIC, [0.1, 0.9], [0.9, 0.1], 0.5)
    assert estimate.estimate([((1, 1), 10)], {"x": 2, "y": 2}).status == estimate.HEURISTIC
    assert estimate.estimate([((None,), 10), ((None,), 3)], {"x": 2}).status == estimate.HEURISTIC


def brute_em(vectors, levels, rounds):
    """Pair by pair, in plain Python."""
    m, u = estimate.defaults(levels)
    prior = 0.5
    names = list(levels)
    for _ in range(rounds):
        r = []
        for v in vectors:
            x = math.log(prior) - math.log(1 - prior) + sum(math.log(m[f][k]) - math.log(u[f][k]) for f, k in zip(names, v, strict=True) if k is not None)
            r.append(1 / (1 + math.exp(-x)))
        for j, f in enumerate(names):
            for side, w in ((m, r), (u, [1 - x for x in r])):
                mass = sum(y for y, v in zip(w, vectors, strict=True) if v[j] is not None)
                side[f] = estimate.bounded([sum(y for y, v in zip(w, vectors, strict=True) if v[j] == k) / mass for k in range(levels[f])]).tolist()
        prior = (sum(r) + 0.5) / (len(vectors) + 1)
    return m, u, prior


def test_patterns_estimate_like_pairs():
    vectors = [(1, 1, 2)] * 6 + [(1, 0, 1), (0, 1, 0), (None, 0, 0)] + [(0, 0, 0)] * 20 + [(0, 1, 1)] * 3
    levels = {"x": 2, "y": 2, "z": 3}
    m, u, prior = brute_em(vectors, levels, 5)
    p = estimate.estimate(list(Counter(vectors).items()), levels, most_rounds=5, tolerance=1e-15)
    assert p.prior == pytest.approx(prior) and p.status == estimate.NOT_CONVERGED and not p.swapped
    for f in levels:
        assert p.m[f] == pytest.approx(m[f]) and p.u[f] == pytest.approx(u[f])
    done = estimate.estimate(list(Counter(vectors).items()), levels, most_rounds=200)
    assert done.status == estimate.CONVERGED and done.m["x"][1] > done.u["x"][1]
    assert estimate.Parameters.from_json(done.to_json()) == done


def test_fixed_u():
    rows = [((1, 1, 1), 20), ((0, 1, 0), 30), ((0, 0, 0), 150)]
    u = {"a": [0.95, 0.05], "b": [0.8, 0.2], "c": [0.9, 0.1]}
    p = estimate.estimate(rows, dict.fromkeys("abc", 2), fixed_u=u)
    assert p.u == u and all(p.m[f][1] > u[f][1] for f in "abc") and 0.05 <= p.prior <= 0.2


def test_closed_form_u_and_frequencies(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", f"n{i}") for i in range(240)], "ord long, school string, name string")
    u = {r.field: r.u for r in estimate.non_match_agreement(df, ["school", "name"]).collect()}
    assert u["school"] == pytest.approx(4 * (60 * 59 / 2) / (240 * 239 / 2)) and u["name"] == 0.01
    names = records.prepared(spark.createDataFrame([("Kim",), (" KIM ",), ("Lee",), (" ",)], "n string"), ["n"])
    assert {r.value: r.share for r in estimate.value_frequencies(names, ["n"]).collect()} == pytest.approx({"KIM": 2 / 3, "LEE": 1 / 3})


def test_rare_values_say_more(spark):
    df = spark.createDataFrame([("KIM", "KIM", 1), ("PAK", "PAK", 1), ("KIM", "PAK", 0)], "a_n string, b_n string, g_n int")
    p = estimate.from_non_match_agreement({"n": 0.3})
    shares = spark.createDataFrame([("n", "KIM", 0.5), ("n", "PAK", 0.1)], "field string, value string, share double")
    got = {(r.a_n, r.b_n): r.llr for r in score.frequency_adjusted(df.withColumn("llr", score.llr(p)), p, shares, ["n"]).collect()}
    assert got[("PAK", "PAK")] - got[("KIM", "KIM")] == pytest.approx(math.log(0.5 / 0.1), abs=1e-9)
    assert got[("KIM", "PAK")] == pytest.approx(math.log(0.08 / 0.7))


def test_classes(spark):
    df = spark.createDataFrame([(4.0, "Match"), (10.0, "Match"), (0.0, "GrayZone"), (3.99, "GrayZone"), (-3.99, "GrayZone"), (-4.0, "NonMatch"), (-10.0, "NonMatch")], "x double, want string")
    assert df.where(score.classify(F.col("x")) != F.col("want")).count() == 0


def test_error_rates(spark):
    df = spark.createDataFrame([(12.0, "Match")] * 10 + [(-12.0, "NonMatch")] * 10, "llr double, cls string")
    r = score.error_rates(df, 0.5).first()
    assert r.false_match_rate < 0.001 and r.false_non_match_rate < 0.001 and r.expected_match == pytest.approx(10, abs=0.01)
    p = estimate.Parameters({f: [0.1, 0.9] for f in "abc"}, {f: [0.9, 0.1] for f in "abc"})
    assert score.error_caveats(score.error_rates(df, 0.5), p).first().caveats == []


def test_options():
    with pytest.raises(ValueError):
        linkage.Options({})
    with pytest.raises(ValueError):
        linkage.Options({"x": compare.EXACT}, match=1, non_match=2)
    with pytest.raises(ValueError):
        compare.Comparison("jaro_winkler")
    with pytest.raises(ValueError):
        compare.Comparison("exact", (0.5,))
    with pytest.raises(ValueError):
        estimate.Parameters({"x": [0.5, 0.5]}, {"x": [1.0]})


def test_plan(spark):
    rows = [(f"r{i}", i, f"name{i // 2}", f"phone{i // 2}" if i % 5 else None, f"city{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, ord long, name string, phone string, city string").coalesce(2).cache()
    options = linkage.Options({f: compare.EXACT for f in ("name", "phone", "city")})
    known = spark.createDataFrame([("k1", 100, "name3", "phone3", "city9", "key3"), ("k2", 101, "other", "none", "city8", "key9")], "record_id string, ord long, name string, phone string, city string, known_key string")
    got = linkage.analyze(df, options, known)
    clusters = {r.record_id: r.cluster_id for r in got.clusters.collect()}
    assert len(clusters) == 40 and all(clusters[f"r{i}"] == clusters[f"r{i + 1}"] for i in range(0, 40, 2) if i % 5 and (i + 1) % 5)
    assert {(r.record_id, r.known_key) for r in got.known_candidates.where("cls = 'Match'").collect()} <= {("r6", "key3"), ("r7", "key3")}
    assert got.rates.first().n_pairs == 780 and got.parameters.status == estimate.CONVERGED
    off = linkage.analyze(df, linkage.Options(options.fields, records_denote=False))
    assert off.pairs is None and off.parameters is None and off.clusters.where("record_id <> cluster_id").count() == 0
    with pytest.raises(ValueError, match="r1"):
        linkage.analyze(df.union(df.where("ord = 1")), options)


def test_bcubed(spark):
    def of(pred, truth):
        df = spark.createDataFrame(list(zip("abcdef", pred, truth, strict=False)), "r string, p int, t int").coalesce(1)
        return metrics.bcubed(df, "p", "t").first(), metrics.pairwise(df, "p", "t").first()

    b, _ = of([1, 2, 3, 4], [1, 1, 1, 1])
    assert tuple(b) == pytest.approx((1, 0.25, 0.4))
    b, _ = of([1, 1, 1, 1], [1, 1, 2, 3])
    assert (b[0], b[1]) == pytest.approx((0.375, 1))
    b, w = of([1, 1, 2, 2], [1, 1, 2, 2])
    assert tuple(b) == tuple(w) == (1, 1, 1)


def test_spearman_permutation():
    assert metrics.permutation_p(list(range(30)), list(range(30)), 99) == pytest.approx(0.01)
    assert math.isnan(metrics.permutation_p([1, 1, 1], [1, 2, 3]))
    with pytest.raises(ValueError):
        metrics.permutation_p([1, 2], [1, 2])


def test_identity_view_and_folds(spark):
    bags = spark.createDataFrame([("a", "x", {"n": "1", "ref": "9", " ": " "}), ("b", None, {"ref": "9"})], "record_id string, subject string, fields map<string,string>")
    refs = records.reference_fields(spark.createDataFrame([("x", "y", "ref", "Reference"), ("y", "x", "kid", "Child"), ("x", "z", "no", None)], "subject string, target string, via_field string, kind string"), spark.createDataFrame([("x",)], "subject string"))
    assert refs.first().ref_fields == ["kid", "ref"]
    got = {r.record_id: sorted(r.fields) for r in records.identity_view(bags, refs).collect()}
    assert got == {"a": [" ", "n"], "b": ["ref"]}
    wide, names = records.to_wide(bags)
    assert names == {"f0": " ", "f1": "n", "f2": "ref"} and wide.orderBy("record_id").first().f0 is None
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, None), ("b", 3, False)], "k string, v int, gone boolean")
    assert [(r.k, r.v) for r in records.latest_versions(df, ["k"], ["v"], "gone").collect()] == [("b", 3)]
    j = records.flattened_json(spark.createDataFrame([('{"a":"x","b":null,"c":{"d":1}}',), ("[1]",), (None,)], "body string").coalesce(1), "body").collect()
    assert j[0].fields == {"a": "x", "b": None, "c": '{"d":1}'} and j[1].fields == j[2].fields == {}


def test_tables_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from tessarine.operators import storage

    conf = lambda **k: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: k.get(name.replace(".", "_"), default)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(conf(spark_master="spark://host:7077"))
    with pytest.raises(ValueError):
        storage.shared_folder(conf(spark_master="local-cluster[2,1,1000]"))
    assert storage.shared_folder(conf(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    table = storage.written(spark.range(5), "five")
    assert table.count() == 5
    storage.dropped(table)
    assert not spark._jvm.java.io.File(table._tessarine_at.removeprefix("file:")).exists()
