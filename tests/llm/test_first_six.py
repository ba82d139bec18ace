"""Packing, line dedup, quality rules, histogram, sharding and mixing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessarine.llm import decision_list, feistel_shards, length_histogram, line_dedup, mixing, packing, tokens

BLANK = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(text):
    return tokens._library(tokens.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(texts_list):
    odd = [*texts_list, "'s't'll 're'", "a  b   \n\n c\t\td ", "\x85　x​", "'x", "  'S", "½١2", "<|endoftext|>" * 2 + " x"]
    got = list(tokens.Encoder(tokens.vocabulary_path()).encode(pa.array(odd)))
    counts = np.concatenate([x[1] for x in got])
    ids = np.split(np.concatenate([x[2] for x in got]), np.cumsum(counts)[:-1])
    assert [x.tolist() for x in ids] == [ids_of(t) for t in odd]


def test_pieces_hold_every_id_once(docs, none, texts_list):
    rows = packing.pack(docs).collect()
    whole, taken = {i: [*ids_of(t), 0] for i, t in enumerate(texts_list)}, defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(whole[r.doc_id]) and len(part) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert np.frombuffer(r.ids, "<u4").tolist() == part
        taken[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(taken[i]) == list(range(len(x))) for i, x in whole.items())
    for k, parts in sequences.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or k == max(sequences) and end < 1024
    assert packing.pack(none).count() == 0


def test_sequences_are_whole(docs):
    pieces = packing.pack(docs).cache()
    want = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += np.frombuffer(r.ids, "<u4").tolist()
    got = {r.sequence_id: r for r in packing.sequences(pieces, padding=7).collect()}
    assert sorted(got) == sorted(want)
    for k, ids in want.items():
        assert got[k].n_tokens == len(ids) and np.frombuffer(got[k].ids, "<u4").tolist() == ids + [7] * (1024 - len(ids))


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), ())) < min_docs or i == max(h)]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("ranges", ["1", "4", "23"])
def test_line_dedup(spark, docs, none, texts_list, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == set(brute_lines(list(enumerate(texts_list))))
    assert sum(x[2] for x in got) > 20
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert set(docs.columns) <= set(line_dedup.drop_repeated_lines(docs).columns)


def test_hot_lines_across_ranges_and_batches(spark):
    hot = ["h" * 45, "i" * 45, "j" * 45]
    rows = [(i, "\n".join([hot[k] for k in range(3) if i % (k + 1) == 0] * (1 + i % 3))) for i in range(400)] + [(None, hot[0]), (7, hot[0]), (7, hot[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = Counter((None if i == -1 else i, *x) for i, *x in brute_lines([(-1 if i is None else i, t) for i, t in rows]))
    assert got == want


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, none, texts_list):
    repeated = "a b c a b c a b c d e f g\nx x x x x"
    got = {r.doc_id: tuple(r[k] for k in decision_list.BASE) for r in decision_list.with_counts(docs).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts_list)}
    one = docs.sparkSession.createDataFrame([(1, repeated)], "doc_id long, text string")
    assert tuple(decision_list.with_counts(one).first()[k] for k in decision_list.BASE) == brute_counts(repeated)
    assert decision_list.with_counts(none).count() == 0


def test_rules_find_planted_conjunctions(spark):
    rows = [(i % 100, i * 7 % 100, i * 13 % 50, int(i % 100 > 80 and i * 7 % 100 > 50 or i * 13 % 50 < 5), i % 3 == 0) for i in range(3000)]
    labelled = spark.createDataFrame(rows, "symbols long, repeats long, words long, bad int, prune boolean").coalesce(1).cache()
    rules = decision_list.learn(labelled, most_rules=4)
    columns = {f: F.col(f) for f in ("symbols", "repeats", "words")}
    judged = labelled.select("bad", decision_list.verdict(rules, columns).alias("kept"))
    right = judged.where((F.col("bad") == 0) == F.col("kept")).count()
    assert 2 <= len(rules) and right > 0.93 * 3000
    assert decision_list.learn(labelled.where("bad = 0")) == [] and decision_list.learn(labelled.limit(0)) == []


def test_rejection_keeps_columns(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 0), (9, 1)], "doc_id long, quality int")
    kept = decision_list.reject_documents(docs, labels)
    assert kept.columns == docs.columns
    judged = decision_list.judged(decision_list.with_counts(docs), [])
    assert kept.count() == judged.where("kept").count() == judged.where("not base_failed").count() > 0


def test_histogram(docs, none, texts_list):
    lengths = [len(ids_of(t)) for t in texts_list]
    summed = length_histogram.with_suffix_sums(length_histogram.length_histogram(docs)).cache()
    for r in summed.collect():
        x = r.n_tokens
        assert r.n_docs == lengths.count(x)
        assert (r.docs_within, r.docs_beyond) == (sum(n <= x for n in lengths), sum(n > x for n in lengths))
        assert (r.tokens_within, r.tokens_beyond) == (sum(n for n in lengths if n <= x), sum(n for n in lengths if n > x))
        assert r.truncated_total == sum(min(n, x) for n in lengths)
    for r in length_histogram.at_limits(summed, [0, 3, 50, 10**6]).collect():
        assert r.truncated_total == sum(min(n, r.context_limit) for n in lengths)
        assert r.docs_within == sum(n <= r.context_limit for n in lengths)
    assert length_histogram.quantile(summed, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    empty = length_histogram.with_suffix_sums(length_histogram.length_histogram(none))
    assert empty.count() == 0 and length_histogram.quantile(empty, 0.5) is None


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4099])
def test_feistel_is_a_permutation(n):
    rows = np.arange(n)
    places = feistel_shards.permute(rows, n, 3)
    assert sorted(places) == list(range(n))
    assert (feistel_shards.unpermute(places, n, 3) == rows).all()
    if n > 900:
        assert (places != feistel_shards.permute(rows, n, 4)).mean() > 0.9


def test_shards(docs, none, texts_list):
    rows = feistel_shards.shard_rows(docs, 5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts_list)))
    by = defaultdict(list)
    for r in rows:
        raw = (texts_list[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert r.row_number == r.doc_id  # ids ascend
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {tuple(r) for r in rows} == {tuple(r) for r in feistel_shards.shard_rows(docs, 5).collect()}
    assert feistel_shards.shard_rows(none).count() == 0


def brute_targets(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), share * sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(cap * size[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level >= cap * size[s]}
        if not more:
            return {s: cap * size[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_mixing(docs, none, texts_list):
    rows = mixing.plan_mix(docs).collect()
    source = {i: [None, "b", "a", "é"][i % 4] for i in range(len(texts_list))}
    size = Counter()
    for i, t in enumerate(texts_list):
        size[source[i]] += len(WORD.findall(t or ""))
    targets = brute_targets(size)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts_list)))
    for r in rows:
        n = len(WORD.findall(texts_list[r.doc_id] or ""))
        rate = r.target / r.source_size
        u = int(hashlib.md5(f"{mixing.SEED}/{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert (r["size"], r.source_size) == (n, size[r.source]) and r.target == pytest.approx(targets[r.source])
        assert r.copies == int(rate) + (u < rate - int(rate)) <= 2 and r.taken == r.copies * n
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.plan_mix(none).count() == mixing.mix(none).count() == 0


def test_targets_reshare(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 40, "d": 0}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes)) and sum(got.values()) == pytest.approx(1.5 * 1055)
