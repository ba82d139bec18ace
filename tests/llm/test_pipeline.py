"""The pipeline's stages on a small corpus: each one's decisions, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline", reason="goes with the subpackage")

import corpus_pipeline  # noqa: E402
from tessarine.llm import mixing  # noqa: E402

from .test_first_six import brute_counts, brute_lines, ids_of  # noqa: E402
from .test_media_and_minhash import brute_components, brute_sets  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 8)))
    shared = " ".join(word() for _ in range(12))
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.choice([20, 80, 150, 400]))]
        t = " ".join(w[: len(w) // 2]) + "\n" + " ".join(w[len(w) // 2 :])
        if i % 4 == 0:
            t += "\n" + shared
        rows.append(t)
        if i % 9 == 0:
            rows.append(t)
            w[5] = word()
            rows.append(" ".join(w))
    rows += [None, "", "a b c " * 60]
    data = [(i, t, "en", ["s1", "s2", None][i % 3], None if t is None else len(t)) for i, t in enumerate(rows)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(0, 60, 2)], "doc_id long, quality int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, corpus), "test")
        steps[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "source mix", "packing"]
    kept = {r.doc_id: r.text for r in steps["quality rules"].collect()}
    fails = {i for i, t in before.items() if (c := brute_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert set(kept) <= set(before) - fails and all(before[i] == t for i, t in kept.items()) and len(kept) > 20
    lined = {r.doc_id: (r.text, r.n_chars) for r in steps["line dedup"].collect()}
    assert lined == {i: (t, len(t)) for i, _, _, t in brute_lines(list(kept.items()))}
    home = brute_components(brute_sets([(i, t) for i, (t, _) in lined.items()], 5))
    one = {r.doc_id for r in steps["near-duplicates"].collect()}
    assert one == set(home.values()) and len(one) < len(lined)
    mixed = Counter(r.doc_id for r in steps["source mix"].collect())
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(steps["near-duplicates"]).collect()}
    assert mixed == Counter({i: c for i, c in plan.items() if c})
    held = defaultdict(int)
    for r in steps["packing"].collect():
        held[r.doc_id] += r.length
    assert held == {i: n * (len(ids_of(lined[i][0])) + 1) for i, n in mixed.items()}
    assert steps["packing"].agg(F.sum("length")).first()[0] == sum(held.values())
