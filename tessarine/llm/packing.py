"""Packing along a space-filling curve.

Documents are tokenised once; their ids, hashed with random signs, are projected to a few dimensions, and the vector's
place on a Hilbert curve orders the documents, so that neighbours on the curve share much vocabulary. The documents are
laid end to end in that order and cut every `length` tokens: only the last sequence is padded.

The order needs no text: keys and lengths alone are range-sorted, running sums give every document's position in the
stream, and the positions are joined back to the written ids by row. A document longer than a sequence is cut into pieces;
each id lies in exactly one piece.

Nulls: a null text is empty and holds the closing id alone; a null id is kept as such. Equal rows are packed one after the
other. An empty table gives no pieces. Extra columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import in_global_order, written

LENGTH, CLOSING, DIMENSIONS, BITS = 1024, 0, 4, 15
_IDS = "row long, doc_id long, curve long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def signs(dimensions: int = DIMENSIONS, ids: int = 65536) -> np.ndarray:
    """A +-1 for each id and dimension, hashed from the id."""
    x = np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return np.stack([((x >> np.uint64(7 + 5 * d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dimensions)])


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places on the Hilbert curve of integer vectors (a row each) whose entries have so many bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The curve keys of the documents whose ids follow each other; each dimension is the mean sign times sqrt(n), squashed."""
    ends = np.cumsum(counts)
    scale = np.sqrt(np.maximum(counts, 1))
    cells = []
    for row in table:
        upto = np.concatenate([[0.0], np.cumsum(row[ids], dtype=np.float64)])
        z = (upto[ends] - upto[ends - counts]) / scale
        cells.append(np.clip((1 / (1 + np.exp(-z / 4)) * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1))
    return hilbert_keys(np.stack(cells, axis=1), bits)


def tokenised(docs: DataFrame, path: str | None = None, closing: int = CLOSING, dimensions: int = DIMENSIONS) -> DataFrame:
    """row, doc_id, curve, n and ids (little-endian 16 bit, the closing id at the end) of every document, written."""
    at = path or tokens.vocabulary_path()

    def run(batches):
        enc, table = tokens.encoder(at), signs(dimensions)
        for batch in batches:
            first = 0
            for n, counts, ids in enc.encode(batch.column("text")):
                keys = curve_keys(ids, counts, table)
                ends = np.cumsum(counts)
                closed = np.insert(ids, ends, closing)
                bounds = np.concatenate([[0], ends + np.arange(1, n + 1)]) * 2
                blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(closed.astype("<u2").tobytes())])
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(keys), pa.array((counts + 1).astype(np.int64)), blob], names=["row", "doc_id", "curve", "n", "ids"])
                first += n

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, _IDS), "packing-ids")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, closing: int = CLOSING, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the piece's ids."""
    if length < 1:
        raise ValueError("length must be positive")
    coded = tokenised(docs, path, closing, dimensions)
    placed = in_global_order(coded.select("row", "doc_id", "curve", "n"), ["curve", "doc_id", "row"], "n", "position")

    def cut(batches):
        for batch in batches:
            doc, n, position = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "n", "position"))
            blob = batch.column("ids")
            first, last = position // length, (position + n - 1) // length
            pieces = last - first + 1
            of = np.repeat(np.arange(len(n)), pieces)
            sequence = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[of]
            begin = np.maximum(position[of], sequence * length)
            end = np.minimum((position + n)[of], (sequence + 1) * length)
            start = begin - position[of]
            crc, out, held = np.empty(len(of), np.int64), [], -1
            for k, (i, a, b) in enumerate(zip(of.tolist(), start.tolist(), (start + end - begin).tolist(), strict=True)):
                if i != held:
                    held, ids = i, np.frombuffer(blob[i].as_buffer(), "<u2").astype("<u4")
                crc[k] = zlib.crc32(ids[a:b])
                out.append(ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(end - begin), pa.array(crc), pa.array(n[of]), pa.array(sequence), pa.array(begin - sequence * length), pa.array(out, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    joined = coded.select("row", "ids").join(placed.select("row", "doc_id", "n", "position"), "row").select("doc_id", "n", "position", "ids")
    return joined.mapInArrow(cut, PIECES + ", ids binary")


def sequences(pieces: DataFrame, length: int = LENGTH, padding: int = CLOSING) -> DataFrame:
    """sequence_id, n_tokens and ids (length of them, 32 bits each) of the pieces of pack(), padded at the end."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("_parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return parts.select("sequence_id", "n_tokens", F.rpad(joined, 4 * length, F.lit(int(padding).to_bytes(4, "little"))).alias("ids"))


def op1_curve_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
