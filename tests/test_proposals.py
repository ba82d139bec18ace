"""Parsing, checks, merges, confidence, routing, Turtle, chains, the model port and the stream."""

import pytest
from pyspark.sql import functions as F

from tessarine.operators import compare, estimate, grounding
from tessarine.proposals import chain, checks, confidence, declared, model, turtle
from tessarine.streaming import score_stream

ENTITY = "entity_id string, name string, type string, claim string, confidence double, sources array<string>, denoted_by array<string>, known_key string, ord int"


def test_parse(spark):
    good = '{"entities":[{"id":"e1","name":"Pump","type":"Asset","claim":"c","sources":["r1"],"denotedBy":["r1"],"confidence":0.9},{"id":"e2","name":"x","confidence":"high","sources":["r1"]},{"id":"e3","name":"y","sources":"r1"}],"relations":[{"name":"partOf","from":"e1","to":"e2","claim":"c","sources":["r1"],"confidence":1}]}'
    e, r, bad = checks.parse(spark.createDataFrame([("1", good), ("2", "no json"), ("3", "[1]"), ("4", None)], "batch_id string, body string"))
    assert [x.entity_id for x in e.collect()] == ["e1"] and r.first().from_id == "e1"
    assert sorted((x.batch_id, x.reason, x.element_id) for x in bad.collect()) == [("1", "MalformedElement", "e2"), ("1", "MalformedElement", "e3"), ("2", "MalformedAnswer", None), ("3", "MalformedAnswer", None), ("4", "MalformedAnswer", None)]


def test_entities(spark):
    rows = [("e1", "a", "T", "c", 0.5, ["r"], [], None, 1), ("e2", "", "T", "c", 0.5, ["r"], [], None, 2), ("e3", "a", "T", "c", 1.5, ["r"], [], None, 3), ("e4", "a", "T", "c", 0.5, [], [], None, 4), ("e5", "a", "T", "c", 0.5, ["r"], [], None, 5), ("e5", "b", "T", "c", 0.5, ["r"], [], None, 6), ("e6", "a", "T", "c", 0.5, ["r"], [], "gone", 7), ("e7", "a", "T", "c", 0.5, ["r"], ["r", "q"], "here", 8)]
    df = spark.createDataFrame(rows, ENTITY).coalesce(1)
    ok, bad = checks.checked_entities(df, spark.createDataFrame([("here",)], "key string"))
    assert sorted(r.entity_id for r in ok.collect()) == ["e1", "e7"]
    assert sorted((r.element_id, r.reason) for r in bad.collect()) == [("e2", "MissingField"), ("e3", "ConfidenceOutOfRange"), ("e4", "NoSource"), ("e5", "DuplicateEntityId"), ("e5", "DuplicateEntityId"), ("e6", "UnknownKnownEntity")]
    done = checks.completed_sources(ok).where("entity_id = 'e7'").first()
    assert done.sources == ["r", "q"] and done.mentioned_in == []


def test_respelling(spark):
    words = spark.createDataFrame([("Compressr",), ("Compres",), ("Pumq",), ("Compressor",)], "word string")
    names = spark.createDataFrame([("Compressor",), ("Pump",)], "name string")
    assert [tuple(r) for r in checks.respellings(words, names).collect()] == [("Compressr", "Compressor")]


def test_demotion_needs_another_denotation(spark):
    denotes = spark.createDataFrame([("supplier", "Acme", "r1"), ("order", "W-1", "r1"), ("supplier", "Acme", "r2")], "entity_id string, name string, record_id string").coalesce(1)
    held = spark.createDataFrame([("r1", " acme "), ("r2", "ACME")], "record_id string, value string").coalesce(1)
    assert [tuple(r) for r in checks.demotions(denotes, held).collect()] == [("supplier", "r1")]


def test_closure_with_a_cycle(spark):
    got = declared.super_types(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")], "sub string, super string").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == sorted([(x, y) for x in "abc" for y in "abc" if x != y] + [("d", y) for y in "abc"])


def test_closure_of_a_long_chain(spark):
    got = declared.super_types(spark.createDataFrame([(f"k{i:03d}", f"k{i + 1:03d}") for i in range(120)], "sub string, super string").coalesce(1))
    assert got.count() == 121 * 120 // 2  # more links than rounds are allowed


def test_recovered_labels(spark):
    r = spark.createDataFrame([("placedBy (Order -> Customer)",), ("other",)], "name string").coalesce(1)
    lines = spark.createDataFrame([("placedBy (Order -> Customer)", "placedBy")], "line string, name string")
    assert [x.name for x in declared.recovered_labels(r, lines).collect()] == ["placedBy", "other"]


def test_fusion(spark):
    e = spark.createDataFrame([("one", 0.7, ["a"]), ("sure", 0.3, ["a", "b"]), ("gray", 0.6, ["a", "c"]), ("none", 0.4, ["a", "z"])], "entity_id string, confidence double, sources array<string>").coalesce(1)
    pairs = spark.createDataFrame([("a", "b", 5.0, "Match"), ("a", "c", 1.0, "GrayZone")], "id_a string, id_b string, llr double, cls string").coalesce(1)
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "record_id string, cluster_id int").coalesce(1)
    got = {r.entity_id: r.confidence for r in confidence.fused(e, pairs, clusters, 0.5).collect()}
    sig = lambda x: 1 / (1 + 2.718281828459045 ** -x)
    assert got["one"] == 0.7 and got["none"] == 0.4 and got["sure"] == pytest.approx(sig(5)) and got["gray"] == pytest.approx(sig(1 + 0.4054651081))


def test_routes(spark):
    t = confidence.Thresholds(0.8, 0.5)
    df = spark.createDataFrame([(1.0,), (0.8,), (0.79,), (0.5,), (0.49,), (0.0,)], "c double").coalesce(1)
    assert [r[0] for r in df.select(t.route(F.col("c"))).collect()] == ["AutoApply", "AutoApply", "Review", "Review", "DraftOnly", "DraftOnly"]
    with pytest.raises(ValueError):
        confidence.Thresholds(0.4, 0.5)


def test_turtle(spark, tmp_path):
    e = spark.createDataFrame([("http://x/1", 'A "b"\n\x01', "Work Order", "c\\", 0.5)], "iri string, name string, type string, claim string, confidence double")
    r = spark.createDataFrame([("part of", "http://x/1", "http://x/2")], "name string, from_iri string, to_iri string")
    lines = [x.line for x in turtle.lines(e, r, "http://b#").where("part > 0").orderBy("part").collect()]
    assert lines[0] == '<http://b#Work%20Order> a owl:Class ; rdfs:label "Work Order" .'
    assert '"A \\"b\\"\\n\\u0001"' in lines[2] and '"c\\\\"' in lines[2] and '"0.500000"^^xsd:decimal' in lines[2]
    turtle.write_turtle(e, r, "http://b#", f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").count() == 7
    with pytest.raises(ValueError):
        turtle.check_base("b")


def test_grounding(spark):
    claims = spark.createDataFrame([(1, "Pump seal leaks oil"), (2, "Valve broken today"), (3, "a")], "claim_id int, claim string").coalesce(1)
    sources = spark.createDataFrame([(1, "oil found, pump"), (1, "seal"), (2, "nothing here"), (3, "a")], "claim_id int, text string").coalesce(1)
    got = {r.claim_id: (r.overlap, r.is_supported) for r in grounding.check_claims(claims, sources).collect()}
    assert got == {1: (0.75, True), 2: (0.0, False), 3: (None, False)}


def test_chain(spark):
    t = spark.createDataFrame([("e1", "Pump"), ("e2", "Plant")], "entity_id string, name string").coalesce(1)
    r = spark.createDataFrame([("in", "e1", "e2", ["s1", "s2"]), ("in", "e1", "e2", ["s1"])], "name string, from_id string, to_id string, sources array<string>").coalesce(1)
    assert sorted(map(tuple, chain.triples(r, t).collect())) == [("s1", "Pump", "in", "Plant"), ("s2", "Pump", "in", "Plant")]


def test_model(spark):
    requests = spark.createDataFrame([("1", "p", "s"), ("2", "q", "s")], "batch_id string, prompt string, schema string").coalesce(1)
    responses = requests.where("batch_id = '1'").select(model.request_key(F.col("prompt"), F.col("schema")).alias("key"), F.lit("yes").alias("body"))
    assert {r.batch_id: r.body for r in model.replayed(requests, responses).collect()} == {"1": "yes", "2": None}
    assert {r.body for r in model.completed(requests, lambda: str.upper).collect()} == {"P", "Q"}
    waits, left = [], [TimeoutError(), ConnectionError()]

    def call(t):
        if left:
            raise left.pop()
        return t

    assert model.with_retries(call, sleep=waits.append)("x") == "x" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        model.with_retries(lambda t: int("x"), sleep=waits.append)("x")
    assert len({str(model.schema(a, b, c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)}) == 8
    assert model.prompt(["b", "a"], [("r", {"x": 1})]) == model.prompt(["a", "b"], [("r", {"x": 1})])


def test_stream(spark, tmp_path):
    p = estimate.from_non_match_agreement({"name": 0.05, "city": 0.1})
    known = spark.createDataFrame([("k1", "ANN", "X"), ("k2", "BOB", "Y")], "known_key string, name string, city string")
    spark.createDataFrame([("n1", "ANN", "X"), ("n2", "BOB", "Z"), ("n3", "EVE", "X")], "record_id string, name string, city string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("record_id string, name string, city string").parquet(f"{tmp_path}/in")
    scored = score_stream.scored_stream(stream, known, [["name"]], {f: compare.EXACT for f in ("name", "city")}, p)
    q = scored.writeStream.foreachBatch(score_stream.upsert_candidates(f"{tmp_path}/out", "a_record_id", "b_known_key")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.record_id, r.known_key): r.cls for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("n1", "k1"): "Match", ("n2", "k2"): "GrayZone"}
