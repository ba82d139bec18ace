"""The conditional random field against enumeration, and held-out accuracy on planted rubbish."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from tessarine.llm import crf_quality as Q


def test_forward_backward_is_enumeration():
    r = np.random.default_rng(1)
    sizes = np.array([1, 4, 2, 5])
    unary, trans = r.normal(size=sizes.sum()), r.normal(size=(2, 2))
    good, pairs, z = Q.forward_backward(unary, sizes, trans)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for k, n in enumerate(sizes):
        p, mass = np.zeros(n), 0
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            p += w * np.array(y)
            for i in range(n - 1):
                own[y[i], y[i + 1]] += w
        want.append(p / mass)
        want_pairs += own / mass
        assert np.isclose(z[k], np.log(mass))
        at += n
    assert np.allclose(good, np.concatenate(want)) and np.allclose(pairs, want_pairs)


def test_lines_are_those_of_split(texts_list):
    texts = [*[t or "" for t in texts_list], "\n", "a\n", "\nb\n\n", "é\n中"]
    data, starts, ends, doc = Q._lines(pa.array(texts))
    got = [[] for _ in texts]
    for a, b, d in zip(starts, ends, doc, strict=True):
        got[d].append(data[a:b].tobytes().decode())
    assert got == [t.split("\n") for t in texts]


def planted(n=900):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    for i in range(n):
        bad = r.random() < 0.4
        lines = []
        for _ in range(r.randint(1, 8)):
            w = [word() for _ in range(r.randint(4, 12))]
            lines.append("!! ".join(w).upper() if bad and r.random() < 0.8 else " ".join(w).capitalize() + ".")
        yield i, "\n".join(lines), 0 if bad else 1


def test_held_out_accuracy(spark, none):
    rows = list(planted())
    docs = spark.createDataFrame([(i, t, q) for i, t, q in rows] + [(5000, None, 0), (5001, "", 1), (None, rows[0][1], 1), (0, rows[0][1], 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    for i in by:
        assert by[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= by[i].score <= 1 and by[i].predicted == (by[i].score >= 0.7)
    out = [(by[i], q) for i, _, q in rows if by[i].held_out]
    assert np.mean([r.predicted == q for r, q in out]) > 0.9
    assert by[None].score == by[0].score and by[5000].score == by[5001].score
    again = {r.doc_id: r.score for r in Q.quality(docs, labels).collect()}
    assert all(abs(again[i] - by[i].score) < 1e-12 for i in by)
    one = Q.quality(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert [r[0] for r in one] == [1.0]
    assert Q.quality(none, labels).count() == 0


def test_training_reads_whole_texts(spark):
    """Junk after line 60 is all that tells the labels apart."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(6)).capitalize() + "."
    rows = []
    for i in range(80):
        q = i % 2
        rows.append((i, "\n".join([clean() for _ in range(61)] + [clean() if q else "!! ".join(word() for _ in range(6)).upper() for _ in range(40)]), q))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality")
    assert {(t["doc_id"], t["text"]) for t in Q.training_rows(docs, labels).collect()} == {(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    got = {x.doc_id: x for x in Q.quality(docs, labels).collect()}
    out = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert {q for _, q in out} == {0, 1} and all(p == q for p, q in out)


def random_model(seed=0):
    r = np.random.default_rng(seed)
    return {"mean": r.random(39), "scale": r.random(39) + 0.5, "weights": r.normal(size=40), "trans": r.normal(size=(2, 2))}


def test_scores_do_not_depend_on_the_batch(texts_list):
    r, model = np.random.default_rng(3), random_model()
    texts = [*[t or "" for t in texts_list], "a\n" * 700, "\n" * 513]  # chains of more than 512 lines go alone
    alone = np.array([Q.raw_quality(pa.array([t]), model)[0] for t in texts])
    for _ in range(60):
        some = r.permutation(len(texts))[: r.integers(1, len(texts))]
        assert (Q.raw_quality(pa.array([texts[i] for i in some]), model) == alone[some]).all()


def test_counts_do_not_depend_on_the_step(texts_list):
    data, starts, ends, _ = Q._lines(pa.array([t or "" for t in texts_list]))
    whole, hashes = Q.line_counts(data, starts, ends)
    for step in (1, 7, 100):
        counts, h = Q.line_counts(data, starts, ends, step)
        assert (counts == whole).all() and (h == hashes).all()
    lines = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert whole[:, 8].tolist() == [len([w for w in x.translate(bytes.maketrans(b"\t\r\x0b\x0c", b"    ")).split(b" ") if w]) for x in lines]
    assert whole[:, 2].tolist() == [sum(65 <= c <= 90 for c in x) for x in lines]


def test_gradient_is_the_slope_of_the_likelihood():
    r = np.random.default_rng(8)
    sizes, quality = np.array([4, 1, 6]), np.array([1, 0, 0])
    own = r.random((11, 13)).astype(np.float32)
    length = r.integers(1, 50, 11)
    doc = np.repeat(np.arange(3), sizes)
    model = random_model(2)
    share = {0: 0.25, 1: 0.5}

    def likelihood(model):
        unary = Q.unary_scores([own], doc, model)
        _, _, z = Q.forward_backward(unary, sizes, model["trans"])
        y = quality[doc]
        same = doc[1:] == doc[:-1]
        out = 0
        for d in range(3):
            mine = doc == d
            inner = mine[1:] & same
            out += share[quality[d]] / sizes[d] * ((unary * y)[mine].sum() + sum(model["trans"][a, b] for a, b in zip(y[:-1][inner], y[1:][inner], strict=True)) - z[d])
        return out

    g = np.array(Q._gradient(model, share)(own, length, sizes, quality)["g"]) / 2.0**40
    grad = np.concatenate([(g[:39] - model["mean"] * g[39]) / model["scale"], [g[39]], g[40:]])
    for k in range(44):
        up = []
        for by in (1e-5, -1e-5):
            w, t = model["weights"].copy(), model["trans"].copy()
            if k < 40:
                w[k] += by
            else:
                t[divmod(k - 40, 2)] += by
            up.append(likelihood(model | {"weights": w, "trans": t}))
        assert abs((up[0] - up[1]) / 2e-5 - grad[k]) < 1e-6


def test_a_text_of_many_megabytes_stays_small():
    """A text of 20 MB needs less than ten times its size, most of it held at once."""
    import resource

    text = "\n".join(f"some words here and there, {i}." for i in range(600_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (got,) = Q.raw_quality(pa.array([text]), random_model())
    assert 0 <= got <= 1
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 10 * len(text)
