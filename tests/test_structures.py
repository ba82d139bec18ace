"""Structures, validation, set joins, review scoring, export and the model's client on small cases."""

import http.server
import json
import random
import threading
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessarine.operators import blocking, cluster, compare, estimate, records, review, score, setjoin, structures
from tessarine.plans import linkage
from tessarine.proposals import chain, model, turtle
from tessarine.sources import readers


def test_set_joins_are_brute_force(spark):
    r = random.Random(4)
    common, rows = [f"w{k}" for k in range(12)], []
    for i in range(90):
        w = [x for x in common if r.random() < 0.6] + [f"own{i}x{k}" for k in range(r.choice([0, 1, 3, 8]))]
        rows.append((i, r.choice(["a", "b", None]), w if r.random() > 0.1 else r.choice([[], None])))
    rows += [(100 + k, "a", rows[k][2]) for k in range(10)]
    df = spark.createDataFrame(rows, "ord long, block string, toks array<string>").repartition(3)
    want = {}
    for (i, p, x), (j, q, y) in combinations(sorted(rows, key=lambda t: t[0]), 2):
        if p is not None and p == q:
            a, b = set(x or []), set(y or [])
            want[i, j] = len(a & b) / len(a | b) if a | b else 1.0
    got = {(x.id_a, x.id_b): x.jaccard for x in setjoin.all_jaccards(df, ["block"], "toks", side=16).collect()}
    assert got == pytest.approx(want)
    for share in (0.3, 0.5, 0.8, 1.0):
        got = {(x.id_a, x.id_b): x.jaccard for x in setjoin.jaccard_at_least(df, ["block"], "toks", share).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= share})


def test_tiles_lose_no_pair(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", None if i % 7 == 0 else i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "ord long, a string, b int").repartition(3)
    of = lambda d: sorted((x.a_ord, x.b_ord) for x in d.collect())
    rules = [["a"], ["b"]]
    assert of(blocking.blocked_pairs(df, rules, most=7)) == of(blocking.blocked_pairs(df, rules))
    known = spark.createDataFrame([(i,) for i in range(20)], "ord long")
    assert of(blocking.all_cross(df.select("ord"), known, buckets=3)) == sorted((i, j) for i in range(120) for j in range(20))


def test_u_per_level(spark):
    values = ["anna maria", "anna", "maria anna", "bert", None, "bert", "anna"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord long, n string")
    how = {"n": compare.Comparison("token_jaccard", (0.5, 1.0))}
    held, counts = [v for v in values if v], [0, 0, 0]
    for a, b in combinations(held, 2):
        x, y = set(a.split()), set(b.split())
        s = len(x & y) / len(x | y)
        counts[(s >= 0.5) + (s >= 1)] += 1
    assert estimate.level_agreement(df, how)["n"] == pytest.approx(estimate.bounded([c / sum(counts) for c in counts]).tolist())
    many = spark.createDataFrame([(i, f"v{i}") for i in range(300)], "ord long, n string")  # beyond the budget: groups stand for all
    assert estimate.level_agreement(many, how, most_pairs=1000)["n"][0] == pytest.approx(0.98)
    p = estimate.from_non_match_agreement({"x": 0.1, "y": [0.7, 0.2, 0.1]}, 0.9)
    assert p.m["y"] == pytest.approx([0.05, 0.05, 0.9]) and p.u["x"] == [0.9, 0.1]


def test_plan_with_supplied_parameters(spark):
    rows = [(f"r{i}", i, ["kim", "lee", "pak"][i % 3], f"t{i // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "record_id string, ord long, name string, town string")
    options = linkage.Options(["name", "town"], default=compare.EXACT)
    assert options.comparisons == {"name": compare.EXACT, "town": compare.EXACT}
    own = linkage.Options({"name": compare.Comparison("jaro_winkler", (0.9,)), "town": compare.EXACT})
    assert own.comparisons["name"].levels == 2
    p = estimate.from_non_match_agreement({"name": 0.3, "town": 0.1})
    plain = linkage.analyze(df, options, parameters=p)
    rare = linkage.analyze(df, options, parameters=estimate.with_frequencies(p, {"name": {"kim": 0.01, "lee": 0.3}}))
    a, b = ({(x.id_a, x.id_b): x.llr for x in got.pairs.collect()} for got in (plain, rare))
    names = {r[0]: r[2] for r in rows}
    for k in a:
        same = names[k[0]] == names[k[1]]
        gain = 3.4011973816621555 if same and names[k[0]] == "kim" else 0.0
        assert b[k] == pytest.approx(a[k] + gain)
    assert plain.parameters.status == estimate.SUPPLIED and plain.rates.first().n_pairs == 66 == rare.rates.first().n_pairs
    fixed = linkage.analyze(df, options, fixed_u={"town": [0.95, 0.05]})
    assert fixed.parameters.u["town"] == [0.95, 0.05] and not fixed.parameters.swapped
    one = linkage.analyze(df.limit(1), options, parameters=p)
    assert one.pairs is None and one.parameters is None and one.clusters.count() == 1
    jw = linkage.analyze(df, own)
    assert jw.pairs.count() == 66
    path = jw.tables[0]._tessarine_at.removeprefix("file:")
    jw.close()
    assert not spark._jvm.java.io.File(path).exists()


def test_swapped_components():
    rows = [((1, 1), 500), ((0, 0), 20), ((1, 0), 6), ((0, 1), 4)]
    p = estimate.estimate(rows, {"x": 2, "y": 2}, most_rounds=100)
    assert sum(p.weight(f, 1) for f in ("x", "y")) >= 0


def test_structures_are_checked(spark):
    schema = "subject string, key_field string, super_types array<string>"
    good = spark.createDataFrame([("Work Order", "id", ["Thing"]), ("Part", None, [])], schema)
    structures.check_declarations(good)
    for bad, text in ((("work_order", None, []), "RepeatedSubject"), (("A", " ", []), "BlankKeyField"), (("B", None, ["?"]), "SuperTypeWithoutName"), (("B", None, [None]), "SuperTypeWithoutName"), (("B c", None, ["b-C"]), "SuperTypeIsItself")):
        with pytest.raises(ValueError, match=text):
            structures.check_declarations(good.union(spark.createDataFrame([bad], schema)))
    fields = spark.createDataFrame([("s", "f", "Text", True, None, "t", None), ("s", "g", "Odd", False, "G", None, None)], "subject string, name string, column_type string, nullable boolean, business_name string, bound_to string, via_field string")
    relations = spark.createDataFrame([("s", "r", "u", "f", "Reference")], "subject string, name string, target string, via_field string, kind string")
    none = spark.createDataFrame([], "subject string, parent string, relation string, key_field string")
    with pytest.raises(Exception, match="unknown column type"):
        structures.structures(fields, relations, none).collect()
    got = structures.structures(fields.where("name = 'f'"), relations, none, spark.createDataFrame([("s", 3, "S")], "subject string, version int, business_name string")).first()
    assert [tuple(x) for x in got.fields] == [("f", "Text", False, None)] and (got.version, got.business_name) == ("3", "S")
    # another target over the same field doesn't count
    assert sorted(tuple(x) for x in got.relations) == [("f", "t", "f", "Reference"), ("r", "u", "f", "Reference")]
    with pytest.raises(Exception, match="unknown relation kind"):
        structures.structures(fields.where("name = 'f'"), relations.withColumn("kind", F.lit("Parent")), none).collect()


def test_prior_defects(spark):
    e, t, i = "key string, name string, type string", "name string", "record_id string"
    df = lambda rows, s: spark.createDataFrame(rows, s)
    known, mentioned = df([("a", "n", "t"), ("a", "n", "t"), (None, "n", "t")], e), df([("a", "n", "t"), ("m", " ", "t")], e)
    got = records.prior_defects(known, mentioned, df([("Part",), ("part ",), ("-",)], t), df([("r1",)], i), df([("r1",), ("r2",)], i))
    assert sorted(map(tuple, got.collect())) == [("BlankKnown", ""), ("BlankMentioned", "m"), ("BlankType", "-"), ("KnownAndMentioned", "a"), ("RecordSeenBefore", "r1"), ("RepeatedKey", "a"), ("RepeatedType", "part")]


def test_identity_and_splits(spark):
    got = cluster.confirmed_identity(spark.createDataFrame([("m2", "i1"), ("i1", "m9"), ("x", "x")], "a string, b string"), spark.createDataFrame([("m2",), ("m9",), ("i1",), ("x",), ("z",)], "key string"))
    assert {r.key: r.identity for r in got.collect()} == {"m2": "i1", "m9": "i1", "i1": "i1", "x": "x", "z": "z"}
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "record_id string, cluster_id int")
    denoted = spark.createDataFrame([("e1", "a"), ("e2", "b"), ("e1", "c"), ("e3", "c")], "entity_id string, record_id string")
    assert [tuple(r) for r in cluster.split_clusters(clusters, denoted).collect()] == [(1, 2)]


def test_scored_sample(spark):
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3)], "record_id string, cluster_id int")
    sample = spark.createDataFrame([("S", "a", 4), ("S", "d", 4), ("T", "c", 1)], "stratum string, record_id string, population int")
    shown = review.candidates_of(spark.createDataFrame([("a", "c")], "id_a string, id_b string"))
    said = "reviewer_id string, record_id string, candidate_id string, outcome string"
    rows = [("r", "a", "b", "Different"), ("r", "a", "c", "Same"), ("r", "c", "a", "CannotTell"), ("q", "a", "d", "Same")]
    verdicts = spark.createDataFrame(rows, said)
    got = {r.record_id: r for r in review.scored_sample(sample, clusters, verdicts, "r", shown).collect()}
    assert (got["a"].review_precision, got["a"].review_recall) == (0.5, 0.5) and got["c"].excluded and got["c"].review_precision is None
    assert (got["d"].excluded, got["d"].review_precision, got["d"].recall_low) == (False, 1.0, 1.0)
    per = {r.stratum: r for r in review.scores_by_stratum(review.scored_sample(sample, clusters, verdicts, "r", shown)).collect()}
    assert (per["S"].n_sampled, per["S"].n_excluded, per["S"].review_precision, per["T"].n_excluded) == (2, 0, 0.75, 1)
    for bad, text in (([("r", "a", "d", "Same")], "never shown"), ([("r", "a", "b", "Same")], "judged twice")):
        with pytest.raises(ValueError, match=text):
            review.scored_sample(sample, clusters, verdicts.union(spark.createDataFrame(bad, said)), "r", shown)
    with pytest.raises(ValueError, match="not judged"):
        review.scored_sample(sample, clusters, verdicts.where("candidate_id <> 'b'"), "r", shown)
    with pytest.raises(ValueError, match="no verdicts"):
        review.scored_sample(sample, clusters, verdicts, "nobody", shown)
    with pytest.raises(ValueError, match="in no cluster"):
        review.scored_sample(sample.union(spark.createDataFrame([("S", "zz", 4)], sample.schema)), clusters, verdicts, "r", shown)


def test_containing(spark):
    texts, parts = ["abcd", "bc", "", "xab", "äöü"], ["bc", "abcd", "x", "", "zz", "öü"]
    a = spark.createDataFrame([(t,) for t in texts], "t string")
    b = spark.createDataFrame([(p,) for p in parts], "p string")
    got = sorted((r.t, r.p) for r in chain.containing(a, "t", b, "p").collect())
    assert got == sorted((t, p) for t in texts for p in parts if p and p in t)


def test_document(spark):
    cited = "sources array<struct<record_id:string,field_name:string>>, confidence double, basis string"
    e = spark.createDataFrame([("urn:a", 'A "x"', "Work Order", ["r2", "r1"], "it says so", [("r1", "f"), ("r2", None)], 0.5, "Declared"), ("urn:b", "B", "work-order", [], "too", [], 1.0, "Inferred")], f"iri string, name string, type string, denoted_by array<string>, claim string, {cited}")
    r = spark.createDataFrame([("made by", "urn:a", "urn:b", "c", [("r1", None)], 0.25, "Inferred")], f"name string, from_iri string, to_iri string, claim string, {cited}")
    k = spark.createDataFrame([("Work Order", "Order", "d", [], 1.0, "Declared")], f"sub string, super string, claim string, {cited}")
    old = spark.createDataFrame([("workorder", "http://old/wo"), ("gone", "http://old/gone")], "term_key string, iri string")
    innate = spark.createDataFrame([("order",)], "name string")
    by: dict[int, list[str]] = {}
    for x in turtle.document(e, r, k, "http://b#", innate, old).orderBy("part").collect():
        by.setdefault(x.part, []).append(x.line)
    assert len(by[2]) == len(turtle.ANNOTATIONS) and "@prefix : <http://b#> ." in by[0]
    classes = sorted(by[3])
    assert len(classes) == 2 and any('"innate"' in c for c in classes) and any('rdfs:label "Work Order" ; ev:origin "acquired"' in c for c in classes)
    assert sorted(by[6])[1].endswith("isReplacedBy> <http://b#Work%20Order> .") and sorted(by[6])[0].endswith("owl:deprecated true .")
    a = next(x for x in by[7] if x.startswith("<urn:a>"))
    assert a == '<urn:a> a owl:NamedIndividual, <http://b#Work%20Order> ; rdfs:label "A \\"x\\"" ; ev:denotedBy "r1" ; ev:denotedBy "r2" ; ev:claim "it says so" ; ev:cites [ ev:recordId "r1" ; ev:fieldName "f" ] ; ev:cites [ ev:recordId "r2" ] ; ev:confidence "0.500000"^^xsd:decimal ; ev:basis "declared" .'
    assert "<urn:a> <http://b#made%20by> <urn:b> ." in by[8] and any(x.startswith("[] a owl:Axiom ; owl:annotatedSource <urn:a>") for x in by[8])
    assert "<http://b#Work%20Order> rdfs:subClassOf <http://b#Order> ." in by[9]


class _Endpoint(http.server.BaseHTTPRequestHandler):
    answers: list = []

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status, headers, body = self.answers.pop(0)
        self.send_response(status)
        for name, value in headers.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write((body(asked) if callable(body) else body).encode())

    def log_message(self, *_):
        pass


def test_http_client():
    server = http.server.HTTPServer(("127.0.0.1", 0), _Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
        whole = lambda asked: json.dumps({"choices": [{"message": {"content": "re: " + asked["messages"][0]["content"]}, "finish_reason": "stop"}]})
        events = "".join(f"data: {json.dumps({'choices': [{'delta': {'content': c}}]})}\n\n" for c in "abc") + "data: [DONE]\n\n"
        waits: list[float] = []
        _Endpoint.answers = [(429, {"Retry-After": "7"}, "slow"), (503, {}, "no"), (200, {}, whole)]
        assert model.with_retries(model.http_client(url, "m", {"type": "object"}), sleep=waits.append)("hello") == "re: hello" and waits == [7.0, 2.0]
        _Endpoint.answers = [(200, {}, events)]
        assert model.http_client(url, "m", stream=True)("x") == "abc"
        _Endpoint.answers = [(400, {}, "bad")]
        with pytest.raises(model.EndpointError, match="400"):
            model.with_retries(model.http_client(url, "m"), sleep=waits.append)("x")
        for cut in ({"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}, {"choices": []}):
            _Endpoint.answers = [(200, {}, json.dumps(cut))]
            with pytest.raises(ValueError):
                model.http_client(url, "m")("x")
    finally:
        server.shutdown()
    with pytest.raises(ConnectionError):
        model.http_client("http://127.0.0.1:9/", "m", timeout=2)("x")


def test_prompt_sections():
    text = model.prompt(["D"], [("r1", {"b": "2", "a": "1"})], [("k", "K")], [("r1", "r2")], types=[("Part", ["r9"])], mentioned=[("m", "M")], groups=[["r1", "r3"], ["r4"]], candidates=[("r1", "k")], left_out=3, type_relations=True)
    titles = [x.split(":")[0] for x in text.split("\n\n")[2:]]
    assert titles == ["Declared", "Types in use", "Known", "Mentioned before", "One thing each", "Undecided pairs", "Perhaps known", "Records"]
    assert "and 3 more" in text and "r4" not in text and model.prompt([], [("r", {})]).count("\n\n") == 1


def test_recorded_answers_are_replayed(spark):
    requests = spark.createDataFrame([("1", "p", "s"), ("2", "p", "s"), ("3", "q", "s")], "batch_id string, prompt string, schema string")
    answers = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None)], "batch_id string, body string")
    got = {r.batch_id: r.body for r in model.replayed(requests, model.recorded(requests, answers)).collect()}
    assert got == {"1": "A", "2": "A", "3": None}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id, name ,note\nrec-1-org, Ann ,"says ""hi""\nthen, goes"\nrec-1-dup-0,  ,x\nrec-2-org,Bo,\n')
    df = readers.csv_records(spark, f"file://{tmp_path}/a.csv", "id")
    got = {r.record_id: r for r in df.collect()}
    assert got["rec-1-org"].note == 'says "hi"\nthen, goes' and got["rec-1-dup-0"].name is None and got["rec-2-org"].note is None
    named = readers.labelled_pairs_id(df)
    assert {r.record_id for r in readers.every_nth_entity(named, 2).collect()} == {"rec-2-org"} and named.where("is_original").count() == 2
    readers.write_json_lines(df.select("record_id", "name").coalesce(1), f"file://{tmp_path}/j")
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["record_id"]: x.get("name") for x in lines} == {"rec-1-org": "Ann", "rec-1-dup-0": None, "rec-2-org": "Bo"}
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "p string, q string")
    ids = lambda d: sorted((r.p, r.record_id) for r in readers.table_records(d, "t").collect())
    assert ids(rows.repartition(1)) == ids(rows.repartition(3)) and len(set(ids(rows))) == 3


def test_kinds_and_rates(spark):
    df = spark.createDataFrame([(12.0, "Match", 10), (-12.0, "NonMatch", 30), (0.0, "GrayZone", 2)], "llr double, cls string, n long")
    rows = df.select("llr", "cls", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    assert list(score.error_rates(df, 0.3, "n").first()) == pytest.approx(list(score.error_rates(rows, 0.3).first()))
    assert score.error_rates(df.limit(0), 0.3).first().n_pairs == 0
