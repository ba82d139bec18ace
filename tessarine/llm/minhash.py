"""Near-duplicate documents by MinHash with tensored banding, every link verified.

A document is its set of distinct k-word shingles (64-bit hashes). Two small collections of `slots` keys each are formed
from `rows` minhashes a key; the table keys are the pairs (a key of the one, a key of the other), so slots * slots tables
come from 2 * slots * rows minhashes. Two sets of similarity s meet in a table with probability (1 - (1 - s^rows)^slots)^2:
at 0.8, with 3 rows and 24 slots, all but 7e-8 of the links are found; without tensoring, as many tables of as many rows
would need 3456 minhashes instead of 144.

Work never goes over all pairs of a table's bucket:
1. Equal sets become one class; its copies never reach the tables.
2. Keys that one class alone holds are left out before tables are formed.
3. In every bucket, the classes are compared with the bucket's leader only, and what links is joined into components.
4. Classes of buckets that still hold several components are compared across components only where they share one of their
   rarest shingles (an exact condition of the similarity), so a family of documents that share a template but stay below the
   limit, each with enough of its own, is never compared pair by pair. What stays quadratic is a family whose members
   share all their shingles with many others each, and yet not with one another.
Whatever is compared is compared on the whole sets. Steps 3 and 4 give the components that all links would give.

A text needs some ten times its bytes in one worker. Tables in the shared folder are deleted but for two that the result reads.

Nulls: a null or blank text has no shingles, is linked with nothing and is its own component. Fewer words than k make one
shingle of the whole sequence. A null id is treated as the smallest long and comes back as null. Rows that share an id are
one node with the links of each. Equal rows get equal results. Extra columns are kept by keep_one_each().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import components
from .common import dropped, span_hashes, unused, whole_text, written

K, SHARE, ROWS, SLOTS = 4, 80, 3, 24
_NULL_ID = -(2**63)
_SLICE = 2_000_000
_U = np.uint64
_BASE = 0x5851F42D4C957F2D | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of the texts data[offsets[i]:offsets[i + 1]], in order, and how many each text has."""
    n = len(data)
    texts = len(offsets) - 1
    if not n:
        return np.zeros(0, _U), np.zeros(texts, np.int64)
    word = ~_BLANK[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    start[edges] |= word[edges]
    end = word.copy()
    end[:-1] &= ~word[1:] | start[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    del word, start, end
    with np.errstate(over="ignore"):
        words = _mix(span_hashes(data, first, last + 1, _BYTES, _BASE) + (last - first + 1).astype(_U) * _U(0xD6E8FEB86659FD93))
    per = np.diff(np.searchsorted(first, offsets))
    counts = np.where(per >= k, per - k + 1, (per > 0).astype(np.int64))
    w = np.cumsum(per) - per  # the first word of each text
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if texts else 0, _U)
    for f in range(0, len(out), 200_000):
        here = np.arange(f, min(f + 200_000, len(out)))
        of = np.searchsorted(ends, here, side="right")
        at, size = w[of] + here - (ends - counts)[of], np.minimum(per, k)[of]
        h = size.astype(_U) * _U(0xA24BAED4963EE407)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = np.where(j < size, _mix(h + words[np.minimum(at + j, len(words) - 1)] + _U(0x9E3779B97F4A7C15)), h)
        out[here] = h
    return out, counts


def _sets(texts: pa.Array, k: int):
    """Yields (index, sorted distinct hashes) of every text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, len(texts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _SLICE, side="right"))))
        part = texts.slice(i, j - i)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + j - i + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        hashes, counts = shingle_hashes(data, offsets - offsets[0], k)
        ends = np.cumsum(counts)
        for t in range(j - i):
            yield i + t, np.unique(hashes[ends[t] - counts[t] : ends[t]])
        i = j


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    return (x[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> _U(32)).astype(np.uint32)


def slot_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """The keys of both collections: rows minhashes of a set each, mixed to 64 bits."""
    low = (hashes >> _U(17)).astype(np.uint32)
    best = np.full(len(a), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for f in range(0, len(low), 4096):
            x = low[f : f + 4096][None, :] * a[:, None] + b[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(best, x.min(axis=1), out=best)
        best = best.reshape(-1, rows)
        key = np.arange(1, len(best) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = _mix(key + best[:, r].astype(np.uint64))
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int = K, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """doc_id (the smallest long for null), n_shingles, set_key (128 bits of the set) and the 2 * slots keys."""

    def run(batches):
        a, b = _coefficients(2 * slots * rows)
        none = np.zeros(2 * slots, np.int64)
        for batch in batches:
            n = batch.num_rows
            size, keys, sig = np.zeros(n, np.int64), np.zeros((n, 2), _U), np.zeros((n, 2 * slots), np.int64)
            for i, s in _sets(batch.column(1), k):
                size[i] = len(s)
                with np.errstate(over="ignore"):
                    keys[i] = s.sum(dtype=_U), _mix(s).sum(dtype=_U)
                sig[i] = slot_keys(s, a, b, rows) if len(s) else none
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2 * slots, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array([x.tobytes() for x in keys], pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "keys"])

    light = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), whole_text().alias("text"))
    return light.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, keys array<long>")


def shingle_sets(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, set (sorted 64-bit hashes as bytes)."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets = [s.tobytes() for _, s in _sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["class_id", "set"])

    return docs.mapInArrow(run, "class_id long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= share * union."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            u, v = np.frombuffer(p, _U), np.frombuffer(q, _U)
            if 100 * min(len(u), len(v)) < share * max(len(u), len(v)):
                return False
            both = len(u) + len(v) - len(np.union1d(u, v))
            return 100 * both >= share * (len(u) + len(v) - both)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    of_a = sets.select(F.col("class_id").alias("a"), F.col("set").alias("_a"))
    of_b = sets.select(F.col("class_id").alias("b"), F.col("set").alias("_b"))
    # many pairs may share their a, few their b: the skewed join comes last, where its rows are wide enough to be split
    return pairs.join(of_b, "b").join(of_a, "a").where(linked("_a", "_b")).select("a", "b")


def _rare_prefixes(open_: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """token, class_id, label, n (set size), place: the rarest shingles of every class of open_ (class_id, label).

    With all shingles in one order, the rarest first, two sets of the wanted similarity share one of their first
    n - ceil(share * n / 100) + 1. Shingles that one class alone holds come first and meet nothing, so they only count.
    """

    def tokens(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                for f in range(0, len(s), 100_000):
                    part = s[f : f + 100_000]
                    same = lambda x: pa.array(np.full(len(part), x.as_py(), np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(batch.column(0)[i]), same(batch.column(1)[i]), pa.array(np.full(len(part), len(s), np.int64)), pa.array(part)], names=["class_id", "label", "n", "token"])

    every = open_.join(sets, "class_id").select("class_id", "label", "set").mapInArrow(tokens, "class_id long, label long, n long, token long")
    often = every.groupBy("token").agg(F.count("*").alias("_df")).where("_df > 1")
    held = every.join(often, "token").groupBy("class_id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("_df", "token"))).alias("_shared"))
    alone = F.col("n") - F.size("_shared")
    length = F.col("n") - F.expr(f"({share} * n + 99) div 100") + 1
    first = held.withColumn("_take", (length - alone).cast("int")).where("_take > 0").select("class_id", "label", "n", alone.alias("_alone"), F.posexplode(F.slice("_shared", F.lit(1), F.col("_take"))).alias("_at", "_x"))
    return first.select(F.col("_x.token").alias("token"), "class_id", "label", "n", (F.col("_alone") + F.col("_at")).alias("place"))


def _across(prefixes: DataFrame, share: int) -> DataFrame:
    """a, b: the classes of different labels that share a rare shingle and whose sizes and places allow the similarity."""
    side = lambda s: prefixes.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("class_id", "label", "n", "place")])
    met = side("a").join(side("b"), "token").where((F.col("a_class_id") < F.col("b_class_id")) & (F.col("a_label") != F.col("b_label")))
    sized = met.where((100 * F.col("a_n") >= share * F.col("b_n")) & (100 * F.col("b_n") >= share * F.col("a_n")))
    # before the first shared shingle nothing is shared
    most = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    return sized.where((100 + share) * most >= share * (F.col("a_n") + F.col("b_n"))).select(F.col("a_class_id").alias("a"), F.col("b_class_id").alias("b")).distinct()


def _labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("class_id"), F.col("component").alias("label"))


def classes_and_labels(docs: DataFrame, k: int = K, share: int = SHARE, rows: int = ROWS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows (written), and for each class in a link its label: class_id, label."""
    signed = written(signatures(docs, k, rows, slots), "minhash-signatures")
    classes = written(signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys")).select("class_id", "keys"), "minhash-classes")
    slot = classes.select("class_id", F.posexplode("keys").alias("slot", "key"))
    shared = slot.groupBy("slot", "key").agg(F.min("class_id").alias("_low"), F.max("class_id").alias("_high")).where("_low <> _high").select("slot", "key")
    # per class, the keys of each collection that other classes hold too
    meets = slot.join(shared, ["slot", "key"]).groupBy("class_id").agg(F.array_sort(F.collect_list(F.when(F.col("slot") < slots, F.struct("slot", "key")))).alias("left"), F.array_sort(F.collect_list(F.when(F.col("slot") >= slots, F.struct("slot", "key")))).alias("right"))
    meets = written(meets.where((F.size("left") > 0) & (F.size("right") > 0)), "minhash-meets")
    pair_of = meets.select("class_id", F.explode("left").alias("l"), "right").select("class_id", "l", F.explode("right").alias("r"))
    tables = pair_of.select("class_id", F.xxhash64("l.slot", "l.key", "r.slot", "r.key").alias("table_key"))
    leaders = tables.groupBy("table_key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("_high")).where("a <> _high").select("table_key", "a")
    members = written(tables.join(leaders, "table_key").select("table_key", "a", F.col("class_id").alias("b")), "minhash-members")
    ids = members.select(F.col("b").alias("class_id")).distinct()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("class_id"), whole_text().alias("text")).join(ids, "class_id", "left_semi")
    sets = written(shingle_sets(texts, k), "minhash-sets")
    stars = written(_verified(members.where("a <> b").select("a", "b").distinct(), sets, share), "minhash-stars")
    label = written(_labels(stars), "minhash-labels")
    # classes of the buckets whose members are not all in one component yet
    named = members.join(label.withColumnRenamed("class_id", "b"), "b", "left").select("table_key", "b", F.coalesce("label", "b").alias("label"))
    split = named.groupBy("table_key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("table_key")
    open_ = named.join(split, "table_key").select(F.col("b").alias("class_id"), "label").distinct()
    prefixes = written(_rare_prefixes(open_, sets, share), "minhash-prefixes")
    across = written(_across(prefixes, share), "minhash-across")
    tried = members.select("a", "b").distinct()
    more = _verified(across.join(tried, ["a", "b"], "left_anti"), sets, share)
    links = written(stars.union(more), "minhash-links")
    dropped(classes, meets, members, sets, stars, label, prefixes, across)
    return signed, links


def near_duplicates(docs: DataFrame, k: int = K, share: int = SHARE, rows: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and class_id (the smallest id with the same set)."""
    signed, links = classes_and_labels(docs, k, share, rows, slots)
    label = _labels(links)
    by_set = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    of_set = by_set.join(label, "class_id", "left").select("set_key", "class_id", F.coalesce("label", "class_id").alias("component_id"))
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    linked = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(of_set, "set_key").select("doc_id", "n_shingles", "class_id", "component_id")
    out = linked.union(alone)
    back = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return out.select(back("doc_id"), "n_shingles", back("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"), back("class_id"))


def keep_one_each(docs: DataFrame, k: int = K, share: int = SHARE) -> DataFrame:
    """One row of each group of near-duplicate rows, that with the smallest id (null is the smallest); columns as in docs.

    Rows are decided one by one, also if they share an id or have none: of rows that share the smallest id, one stays. Blank
    texts are in no group, but of those that share an id (or have none) one stays.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    if docs.select(ids.alias("_id")).groupBy("_id").count().where("count > 1").isEmpty():
        name = unused("_gone", docs.columns)
        gone = near_duplicates(docs, k, share).where("not kept").select(F.col("doc_id").alias(name)).distinct()
        return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
    # the rows get ids of their own; equal rows are interchangeable, so which of them stays makes no difference
    rank = F.struct(ids.alias("id"), F.xxhash64(F.to_json(F.struct(*docs.columns))).alias("hash"))
    row, place = unused("_row", docs.columns), unused("_rank", docs.columns)
    keyed = written(docs.select("*", F.monotonically_increasing_id().alias(row), rank.alias(place)), "minhash-rows")
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), k, share).select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
    found = found.join(keyed.select(F.col(row).alias("_row"), F.col(place).alias("_rank")), "_row")
    blank = F.col("n_shingles") == 0
    stay = found.groupBy(F.when(~blank, F.col("component_id")), F.when(blank, F.col("_rank.id"))).agg(F.min(F.struct("_rank", "_row")).alias("_least"))
    return keyed.join(stay.select(F.col("_least._row").alias(row)), row, "left_semi").select(*docs.columns)


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("class_id")
