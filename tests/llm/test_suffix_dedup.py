"""Suffix order and removal of repeats against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tessarine.llm import suffix_dedup as S


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("packed", [True, False])
def test_suffix_order(seed, packed, monkeypatch):
    if not packed:
        monkeypatch.setattr(S, "_packed_keys", lambda columns: columns)
    r = random.Random(seed)
    letters = [b"ab", b"a", bytes(range(256)), b"\0a", b"abc", b"\0\xff"][seed]
    texts = [bytes(r.choice(letters) for _ in range(r.choice([0, 1, 3, 8, 23, 24, 25, 70, 150]))) for _ in range(40)]
    ends = np.cumsum([len(t) for t in texts])
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = S.suffix_order(data, ends[of])
    assert sorted(order) == list(range(len(data)))
    whole = [data[i : min(ends[of[i]], i + S.DEPTH)].tobytes() for i in range(len(data))]
    assert [whole[i] for i in order] == sorted(whole)


def brute(rows, length):
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w not in least or (least[w] is not None and (i is None or i < least[w])):
                least[w] = i
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            m = least[raw[p : p + length]]
            if i is not None and (m is None or m < i):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        yield i, len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0, kept


def repeats():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß ") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(5)] + ["ab" * 60, "x" * 200]
    out = [None, "", "x" * 49, "x" * 50, "x" * 51]
    for k in range(60):
        parts = [text(r.randint(1, 25)) for _ in range(3)]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 20)
            parts.insert(r.randint(0, len(parts)), s[a : len(s) - r.randint(0, 40)])
        t = "".join(parts)
        out.append(t)
        if k % 6 == 0:
            out.append(t)
        if k % 7 == 0:
            v = list(t)
            v[len(v) // 2] = "#"
            out.append("".join(v))
    return out


@pytest.mark.parametrize("hot", [1, 50_000])
def test_removal(spark, none, hot):
    texts = repeats()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = [(i, t) for i, t in zip(order, texts, strict=True)] + [(None, texts[20]), (7, texts[20]), (7, texts[20])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, place int").repartition(3)
    got = Counter(tuple(x if not isinstance(x, bytearray) else bytes(x) for x in r) for r in S.remove_repeats(df, hot=hot).collect())
    assert got == Counter(brute(rows, 50))
    assert sum(x[2] > 0 for x in got) > 20
    if hot > 1:
        assert S.remove_repeats(none).count() == 0


def test_anchors_of_pieces_are_those_of_the_whole():
    r = np.random.default_rng(1)
    data, offsets = r.integers(97, 103, 5000).astype(np.uint8), np.array([0, 0, 40, 100, 3000, 3000, 5000])
    want = S.anchors(data, offsets)
    order = np.lexsort((want[2], want[1]))
    for step in (10, 64, 300, 1000, 10_000):
        got = [np.concatenate(x) for x in zip(*S.all_anchors(data, offsets, step=step), strict=True)]
        other = np.lexsort((got[2], got[1]))
        assert all((a[order] == b[other]).all() for a, b in zip(want, got, strict=True))


def test_packed_anchors_come_back():
    r = np.random.default_rng(2)
    g, doc = np.sort(r.integers(0, 2**40, 1000).astype(np.uint64)), r.integers(0, 20, 1000)
    ids, keys = r.integers(-(2**63), 2**63 - 1, 20), r.integers(-(2**31), 2**31 - 1, 20).astype(np.int32)
    for top in (1, 200, 70_000, 2**33):
        number = r.integers(0, top, 1000)
        kind, bucket, *got = S._unpacked(S._packed(1, 7, g, doc, number, ids, keys))
        assert (kind, bucket) == (1, 7) and all((a == b).all() for a, b in zip(got, (g, ids[doc], keys[doc], number), strict=True))


def test_kept_bytes_is_brute_force():
    r = np.random.default_rng(3)
    for _ in range(300):
        n, m = r.integers(1, 200), r.integers(1, 6)
        raw, begin = bytes(r.integers(0, 256, n).astype(np.uint8)), r.integers(0, n, m)
        size = np.minimum(r.integers(1, 60, m), n - begin)
        gone = np.zeros(n, bool)
        for a, k in zip(begin, size, strict=True):
            gone[a : a + k] = True
        assert S.kept_bytes(raw, begin, size) == (gone.sum(), (gone & ~np.concatenate([[False], gone[:-1]])).sum(), np.frombuffer(raw, np.uint8)[~gone].tobytes())


def test_copies_within_a_block_travel_once(spark):
    """A passage in many documents of a block sends one context for each of its anchors, and their spans without bytes."""
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(400))
    rows = [(i, passage) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in S.remove_repeats(df).collect()}
    assert got == {0: (0, 0)} | {i: (400, 1) for i in range(1, 200)}


def test_runs_within_a_text_travel_once(spark):
    """Periodic text: each distinct context of a row is sent once, and the result is that of brute force."""
    r = random.Random(9)
    words = ["the ", "of of ", "x", "an an and "]
    rows = [(i, "".join(r.choice(words) * r.choice([1, 20, 60]) for _ in range(6))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for hot in (1, 50, 50_000):
        got = Counter(tuple(x if not isinstance(x, bytearray) else bytes(x) for x in t) for t in S.remove_repeats(df, hot=hot).collect())
        assert got == Counter(brute(rows, 50))


def test_copies_do_not_make_a_gram_hot(spark):
    """HOT counts the contexts that travel: a passage in many documents, whose contexts are all alike, is not cut to windows."""
    r = random.Random(7)
    passage, rows = "".join(r.choice("abcdefgh ") for _ in range(300)), []
    for i in range(120):
        own = "".join(r.choice("ijklmnop ") for _ in range(80))
        rows.append((i, 1, own + passage))
    own = spark.createDataFrame(rows, "doc_id long, row_key int, text string").repartition(3)
    found = S._repeated_grams(S._anchor_blobs(own, 4, 50, 24).coalesce(1), 50).collect()
    assert len(found) > 120 * 10
    hot = {x.route for x in found if x.place < 0}
    alike = {x.route for x in found if x.place >= 80 + 26}  # their contexts lie within the passage
    assert alike and not alike & hot
    assert hot  # those over its start differ from document to document


def test_contexts_sent_is_brute_force():
    r = np.random.default_rng(4)
    for n in (0, 1, 500):
        group, row, ids = np.sort(r.integers(0, 9, n)), r.integers(0, 40, n), r.integers(0, 12, 40)
        marks = np.array([3, 2**63, 2**64 - 1], np.uint64)[r.integers(0, 3, n)]
        want = [0] * 9
        for g in range(9):
            for m in set(marks[group == g].tolist()):
                rows = set(row[(group == g) & (marks == m)].tolist())
                want[g] += sum(ids[x] == min(ids[list(rows)]) for x in rows)
        assert S.contexts_sent(group, marks, row, ids[row], 9).tolist() == want


def test_equal_contexts_of_hot_grams_travel_once(spark):
    """Only contexts left over are cut to windows; each window of a document goes once."""
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(400))
    todo = "todo array<struct<place: long, route: long, hot: boolean>>"
    rows = [(i, 1, passage, [(p, p, True) for p in (100, 110, 120)]) for i in range(50)]
    df = spark.createDataFrame(rows, f"doc_id long, row_key int, text string, {todo}").coalesce(1)
    got = S._contexts(df, 50, 24).collect()
    bare = [x for x in got if x.context is None]
    assert len(bare) == 49 * 3 and all(x.doc_id > 0 and x.size == 76 for x in bare)
    sent = sorted(x.begin for x in got if x.context is not None)
    assert sent == list(range(74, 121)) and all(bytes(x.context) == passage[x.begin : x.begin + 50].encode() for x in got if x.context is not None)
