"""Line dedup across documents.

Every line of at least min_chars code points gets a 128-bit hash of its key (blanks stripped at both ends, A-Z lowered).
The hashes, with the document and the position, are range-partitioned by (hash, document from the largest on, position)
and sorted so; one pass streams each range and sees a key's documents in order: the first one keeps its lines, the lines of
the next ones go once the key has been met in min_docs documents. Undecided lines are held back only until then, so the
state is a few documents' lines. A hot key spreads over many ranges: runs at a range's edge are left open by the pass and
settled with a table of at most two rows per range. Out come zlib-compressed keep bitmaps per document, never text.

A bitmap holds a bit per line, 1 for keep, in numpy's packbits order; lines past its end are kept. Documents without a
dropped line have none.

Nulls: a null text is one empty line; a null id counts as the smallest one. Rows that share an id are one document when
documents are counted, and each of them keeps its own bitmap (rows are told apart by a hash of their text). Equal rows get
equal results. Extra columns are kept by drop_repeated_lines() whatever their names, but for the added ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, dropped, unused, whole_text, written

MIN_CHARS, MIN_DOCS = 40, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = ("h1", "h2", "doc_id", "row_key", "pos")
_OUT = "kind int, h1 long, h2 long, doc_id long, row_key long, pos int, n_docs long, last_doc long, range_id int"
_GONE, _OPEN, _EDGE = 0, 1, 2
_NULL_ID = -(2**63)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough to count: h1, h2, doc_id, row_key, pos."""
    text = whole_text()
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("row_key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    long_enough = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= min_chars)
    lowered = F.translate("line", UPPER, LOWER)
    return long_enough.select(F.xxhash64(lowered).alias("h1"), F.xxhash64(F.lit(7), lowered).alias("h2"), "doc_id", "row_key", "pos")


def _lines(kind: int, part: dict, pid: int) -> pa.RecordBatch:
    n = len(part["pos"])
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(part[k]) for k in _NAMES], none, none, pa.array(np.full(n, pid, np.int32))], names=["kind", *_NAMES, "n_docs", "last_doc", "range_id"])


def _edge(key: tuple, top: int, n_docs: int, last: int, pid: int) -> pa.RecordBatch:
    one = lambda x: pa.array([x], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([_EDGE], pa.int32()), one(key[0]), one(key[1]), one(top), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), one(n_docs), one(last), pa.array([pid], pa.int32())], names=["kind", *_NAMES, "n_docs", "last_doc", "range_id"])


def _pass_over_range(min_docs: int):
    """The pass over one sorted range. Out come lines that go, open lines of the edge runs, and the edge runs' totals.

    A line's rank is the number of its key's documents met so far, its own included. From min_docs on it goes at once;
    lines of lower rank are held until their run ends.
    """

    def settled(held: dict, key: tuple, top: int, seen: int, last: int, at_edge: bool, pid: int):
        if at_edge:
            if len(held["pos"]):
                yield _lines(_OPEN, held, pid)
            yield _edge(key, top, seen, last, pid)
        elif seen >= min_docs and (gone := held["rank"] > 1).any():
            yield _lines(_GONE, {k: v[gone] for k, v in held.items()}, pid)

    def run(batches):
        key, top, seen, last, first, held, pid = None, 0, 0, 0, True, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pid = batch.column("range_id")[0].as_py()
            part = {k: batch.column(k).to_numpy() for k in _NAMES}
            h1, h2, doc = part["h1"], part["h2"], part["doc_id"]
            new_key = np.ones(n, bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            goes_on = key is not None and (int(h1[0]), int(h2[0])) == key
            new_doc = new_key.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            if goes_on:
                new_doc[0] = doc[0] != last
            elif key is not None:
                yield from settled(held, key, top, seen, last, first, pid)
                first, held = False, None
            starts = np.flatnonzero(new_key)
            ends = np.append(starts[1:], n)
            run_of = np.cumsum(new_key) - 1
            counted = np.cumsum(new_doc)
            before = counted[starts] - new_doc[starts]
            if goes_on:
                before[0] -= seen
            rank = counted - before[run_of]
            total = rank[ends - 1]
            if (gone := rank >= min_docs).any():
                yield _lines(_GONE, {k: v[gone] for k, v in part.items()}, pid)
            part["rank"] = rank
            low = ~gone
            final = len(starts) - 1
            pieces = {k: v[low & (run_of == 0)] for k, v in part.items()}
            if goes_on:
                pieces = {k: np.concatenate([held[k], v]) for k, v in pieces.items()}
            else:
                key, top = (int(h1[0]), int(h2[0])), int(doc[0])
            if final > 0:
                yield from settled(pieces, key, top, int(total[0]), int(doc[ends[0] - 1]), first, pid)
                first = False
                inner = low & (run_of > 0) & (run_of < final) & (total[run_of] >= min_docs) & (rank > 1)
                if inner.any():
                    yield _lines(_GONE, {k: v[inner] for k, v in part.items()}, pid)
                pieces = {k: v[low & (run_of == final)] for k, v in part.items()}
                key, top = (int(h1[-1]), int(h2[-1])), int(doc[starts[final]])
            held, seen, last = pieces, int(total[-1]), int(doc[-1])
        if key is not None:
            yield from settled(held, key, top, seen, last, True, pid)

    return run


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id (the smallest long for null), row_key and pos of the lines that go; equal rows of docs give equal rows here."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    spark = docs.sparkSession
    hashed = written(line_hashes(docs, min_chars), "line-hashes")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("row_key"), F.col("pos")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = hashed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range_id", F.spark_partition_id())
    decided = written(ranged.mapInArrow(_pass_over_range(min_docs), _OUT), "line-decisions")
    dropped(hashed)
    # one or two rows a range; a document whose lines lie on both sides of a border was counted on both
    edges = decided.where(F.col("kind") == _EDGE)
    in_order = Window.partitionBy("h1", "h2").orderBy("range_id")
    twice = F.when(F.lag("last_doc").over(in_order) == F.col("doc_id"), 1).otherwise(0)
    keys = edges.withColumn("_twice", twice).groupBy("h1", "h2").agg((F.sum("n_docs") - F.sum("_twice")).alias("_docs"), F.max("doc_id").alias("_top")).where(F.col("_docs") >= min_docs)
    left_open = decided.where(F.col("kind") == _OPEN).join(F.broadcast(keys), ["h1", "h2"]).where(F.col("doc_id") < F.col("_top"))
    return decided.where(F.col("kind") == _GONE).select("doc_id", "row_key", "pos").unionByName(left_open.select("doc_id", "row_key", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row_key, n_dropped and keep_bitmap of the documents that lose lines."""

    @F.pandas_udf("binary")
    def bitmap(gone: pd.Series) -> pd.Series:
        def one(at: np.ndarray) -> bytes:
            keep = np.ones(int(max(at)) // 8 * 8 + 8, bool)  # whole bytes, padded with keep
            keep[np.asarray(at)] = False
            return zlib.compress(np.packbits(keep).tobytes())

        return gone.map(one)

    gone = lines_to_drop(docs, min_chars, min_docs).groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("_gone"))
    return gone.select("doc_id", "row_key", F.size("_gone").cast("long").alias("n_dropped"), bitmap("_gone").alias("keep_bitmap"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with `text` reduced to the kept lines, and with n_lines and n_dropped."""

    @F.pandas_udf("string")
    def applied(text: pd.Series, bits: pd.Series) -> pd.Series:
        def one(t, b):
            if t is None or b is None:
                return None
            keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i >= len(keep) or keep[i])

        return pd.Series([one(t, b) for t, b in zip(text, bits, strict=True)], dtype=object)

    row_id, row_key, gone, bits = (unused(c, docs.columns) for c in ("_lines_id", "_lines_row", "_lines_gone", "_lines_bits"))
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(row_id), F.col("row_key").alias(row_key), F.col("n_dropped").alias(gone), F.col("keep_bitmap").alias(bits))
    whole = docs.withColumn("text", whole_text())
    met = (F.coalesce(whole["doc_id"].cast("long"), F.lit(_NULL_ID)) == bitmaps[row_id]) & (F.xxhash64(whole["text"]) == bitmaps[row_key])
    joined = whole.join(bitmaps, met, "left").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    # only texts that lose lines travel to Python
    kept = F.coalesce(applied(F.when(F.col(bits).isNotNull(), F.col("text")), F.col(bits)), F.col("text"))
    return joined.withColumns({"text": kept, "n_dropped": F.coalesce(gone, F.lit(0).cast("long"))}).drop(row_id, row_key, gone, bits)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more found in 5 documents stay only in the one with the largest id."""
    kept = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), decided AS (
  SELECT k.doc_id, k.line, k.pos, r.top IS NULL OR k.doc_id = r.top AS keep FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE NOT keep))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""
