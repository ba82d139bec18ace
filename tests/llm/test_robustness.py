"""Null and repeated ids, equal rows, empty tables, clashing columns and long texts, for every operator."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessarine.llm import decision_list, feistel_shards, length_histogram, line_dedup, minhash, mixing, mpeg_audio, packing, suffix_dedup, tokens

from .test_first_six import WORD, brute_counts, ids_of
from .test_media_and_minhash import brute_sets


def odd_rows() -> list:
    """(doc_id, text, source): null and repeated ids, equal rows, null and empty texts."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b = text(80), text(120)
    rows = [(None, a, "x"), (None, a, "x"), (None, b, "y"), (None, None, None), (None, None, None), (3, a, "x"), (3, b, "y"), (3, a, "x"), (3, None, "x"), (4, "", "y"), (4, "", "y"), (5, a + " tail", "x")]
    return rows + [(None, text(40), "z") for _ in range(300)] + [(100 + i, text(60), "y") for i in range(20)]


#: Names that operators use on their own.
CLASHING = ("row", "curve", "n", "position", "_at", "_range", "_own", "_start", "_gone", "_row", "_rank", "_words", "_lines", "_windows", "_starts", "_barrier", "_mix_source", "_mix_rate", "_mix_copy", "_source", "size", "target", "taken", "copies", "set_key", "keys", "class_id", "component_id", "media", "place", "route", "shard", "slot", "row_number", "_lines_id", "_lines_bits", "range_id", "h1", "kept", "base_failed")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, source string").repartition(4)
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING]).cache()


def test_packing(odd):
    pieces, held = packing.pack(odd).collect(), defaultdict(int)
    for r in pieces:
        held[r.doc_id] += r.length
    want = defaultdict(int)
    for i, t, _ in odd_rows():
        want[i] += len(ids_of(t)) + 1
    assert held == want
    at = defaultdict(list)
    for r in pieces:
        at[r.sequence_id].append((r.offset, r.length))
    assert sorted(at) == list(range(len(at)))
    for k, parts in at.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and parts[0][0] == 0
        assert sum(n for _, n in parts) == 1024 or k == max(at)


def test_suffix_and_lines(odd):
    assert suffix_dedup.remove_repeats(odd).count() == line_dedup.drop_repeated_lines(odd).count() == len(odd_rows())


def test_minhash(odd):
    rows = odd_rows()
    got = minhash.near_duplicates(odd).collect()
    sets = [s for _, s in brute_sets([(i, t) for i, t, _ in rows], 4)]
    # rows of one id are one node with the links of each; null is the smallest id
    key = lambda i: -(10**9) if i is None else i
    root = {key(i): key(i) for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, s), (y, t) in itertools.combinations([(key(i), s) for (i, _, _), s in zip(rows, sets, strict=True)], 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            p, q = sorted((find(x), find(y)))
            root[q] = p
    by_set = Counter((key(i), len(s), find(key(i)) if s else key(i)) for (i, _, _), s in zip(rows, sets, strict=True))
    assert Counter((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == by_set
    kept = minhash.keep_one_each(odd)
    assert kept.columns == odd.columns and all(r._gone == "mine" and r._row == "mine" for r in kept.collect())
    unique = odd.where("doc_id >= 100")
    assert minhash.keep_one_each(unique).count() == 20  # the way without repeated ids


def test_audio(odd):
    got = Counter((r.doc_id, r.n_bytes, r.media_sha256) for r in mpeg_audio.media_digests(mpeg_audio.to_media(odd)).collect())
    want = Counter()
    for i, t, _ in odd_rows():
        raw = (t or "").encode()
        want[i, len(raw), hashlib.sha256(mpeg_audio.write_stream(mpeg_audio.pad(raw), len(raw))).hexdigest()] += 1
    assert got == want


def test_rules(spark, odd):
    counted = decision_list.with_counts(odd)
    assert {"_words", "_lines", "_windows", "_starts", "_barrier"} <= set(counted.columns)
    got = Counter((r.doc_id, tuple(r[k] for k in decision_list.BASE), r._words, r._barrier) for r in counted.collect())
    assert got == Counter((i, brute_counts(t), "mine", "mine") for i, t, _ in odd_rows())
    labels = spark.createDataFrame([(3, 0), (3, 1), (None, 0), (100, 1), (4, None)], "doc_id long, quality int")
    kept = decision_list.reject_documents(odd, labels)
    assert kept.columns == odd.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t, _ in odd_rows() if brute_counts(t)[0] >= 50)


def test_histogram(odd):
    got = {r.n_tokens: r.n_docs for r in length_histogram.length_histogram(odd).collect()}
    assert got == Counter(len(ids_of(t)) for _, t, _ in odd_rows())


def test_shards(odd):
    rows = feistel_shards.shard_rows(odd, 7).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows())
    assert sorted(r.place for r in rows) == list(range(len(rows)))
    again = feistel_shards.shard_rows(odd.repartition(2), 7).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mixing(odd):
    rows = mixing.plan_mix(odd).collect()
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    n = Counter()
    for _, t, s in odd_rows():
        n[s] += len(WORD.findall(t or ""))
    assert {k: v for k, v in size.items() if v} == {k: v for k, v in n.items() if v}
    # rows without an id draw by their texts: a source of them comes near its target
    assert abs(taken["z"] - target["z"]) < 0.15 * target["z"] and 0 < target["z"] / size["z"] % 1 < 1
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    by = Counter()
    for r in rows:
        by[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == Counter({k: v for k, v in by.items() if v})
    assert all(r._mix_copy == "mine" and r.taken == "mine" for r in mixed.collect())


def test_empty_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline", reason="goes with the subpackage")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_are_encoded_in_pieces(monkeypatch, texts_list):
    r = random.Random(17)
    text = "".join(r.choice(["a", "bc", " ", " ", "  ", "\n", "é", "中", "12", "'s", "'ll", "!", "?!", "　", "　"]) for _ in range(4000))
    odd = [text, text.replace(" ", ""), text[:2000] + tokens.MARK + text[2000:], tokens.MARK + text, *texts_list]
    for step in (7, 64, 1000):
        monkeypatch.setattr(tokens, "SLICE", step)
        got = list(tokens.Encoder(tokens.vocabulary_path()).encode(pa.array(odd)))
        ids = np.split(np.concatenate([x[2] for x in got]), np.cumsum(np.concatenate([x[1] for x in got]))[:-1])
        assert [x.tolist() for x in ids] == [ids_of(t) for t in odd]
        assert [int(c) for x in tokens.Encoder(tokens.vocabulary_path()).encode(pa.array(odd), with_ids=False) for c in x[1]] == [len(x) for x in ids]
    raw = text.encode()
    cuts = list(tokens.pieces(raw, 50))
    assert len(cuts) > 20 and b"".join(raw[a:b] for a, b in cuts) == raw


def test_a_long_text_is_packed_whole(spark):
    text = " ".join(f"word{i % 977}" for i in range(900_000))  # 6.9 MB, beyond one slice
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).drop("ids").collect()
    n = sum(r.length for r in rows if r.doc_id == 1)
    assert {r.doc_tokens for r in rows if r.doc_id == 1} == {n} and n == len(ids_of(text)) + 1


def test_grown_rules_are_brute_force(spark):
    """The first rule's first condition has the largest gain of all; covering sets its rows aside."""
    r = random.Random(23)
    rows = []
    for i in range(900):
        x, y = r.randrange(40), r.randrange(25)
        rows.append((x, y, int(x > 30 or (y < 4 and r.random() < 0.9)), i % 3 == 0))
    labelled = spark.createDataFrame(rows, "symbols long, words long, bad int, prune boolean").coalesce(1).cache()
    rules = decision_list.learn(labelled, most_rules=2)
    grow = [t for t in rows if not t[3]]
    base = np.log2(sum(t[2] for t in grow) / len(grow))
    best = []
    for f, k in (("symbols", 0), ("words", 1)):
        for cut in range(40):
            for op in (">", "<="):
                held = [t for t in grow if (t[k] > cut) == (op == ">")]
                bad = sum(t[2] for t in held)
                if len(held) >= decision_list.LEAST_ROWS and bad and len(held) < len(grow):
                    best.append((bad * (np.log2(bad / len(held)) - base), (f, op, cut)))
    cuts = {c for rule in rules for c in rule}
    gains = dict((c, g) for g, c in best)
    first = rules[0][0]
    # the learner looks at quantiles of the values only: no threshold of its own choice does better
    assert gains[first] >= 0.98 * max(best)[0] and len(cuts) >= 2
    columns = {f: F.col(f) for f in ("symbols", "words")}
    wrong = labelled.where((F.col("bad") == 1) == decision_list.verdict(rules, columns)).count()
    assert wrong < 0.05 * len(rows)
