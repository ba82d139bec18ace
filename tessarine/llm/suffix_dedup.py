"""Removal of long repeated byte strings, by a distributed difference-cover suffix sort.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

Sorting every suffix of a corpus would move many times its size, though most can't repeat. So places are first thinned
without losing a repeat. In each window of `length` bytes the smallest hash of its GRAM-grams is an anchor; equal windows
have equal anchors at equal places, so every repeat shows as an anchor whose gram several documents hold. Grams that one
document alone holds go; the hashes decide no more than that. For every other anchor its context (the bytes of all windows
over it) is sent to the sort, routed by gram, so that equal windows meet; what the sort finds equal, byte for byte, goes.

The sort, first in every block before contexts travel and then in the tasks where they meet, has two steps:
* contexts are sorted as a whole, and adjacent ones compared: of equal ones those of the smallest id go on, the others are
  repeats from end to end;
* the suffixes of the contexts left are sorted by the difference-cover algorithm for triples, on letters of 7 bytes: the text
  is read as 7 strings of letters, one for each offset; the triples at places 1 and 2 modulo 3 are sorted and named; the
  recursion sorts triples of names, which spell 63 bytes and so end it, as only `length` bytes matter; the places 0 modulo 3
  are merged in by their letter and the name after it. Adjacent suffixes are compared on `length` bytes, and each run of
  equal ones knows its smallest id.

Skew: a block sends an entry for a gram that several of its documents hold, not one for each of them, so a hot gram costs its
bucket one entry a block, and a hot passage its task one context a block. What repeats within a row (the the the the) sends
one context too; the others fare as that one does. Grams with more contexts than HOT are split: each window of the contexts
that would travel goes on its own, routed by a hash of all its bytes; results are the same. As a split context costs many
rows, HOT counts contexts that blocks would send, not the anchors, whose number grows with the corpus for every passage.

Nulls: a null text is empty; a null id counts as smaller than any other. Rows that share an id don't remove bytes of each
other; each keeps its own result (they are told apart by a hash of the text). Texts shorter than `length` lose nothing. What
is removed is judged on the input and joined bytewise, so it may cut a character; `kept` is bytes. Extra columns aren't read.

Long texts are read in pieces: one needs some ten times its bytes in a worker.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, whole_text, written

LENGTH, GRAM = 50, 24
#: Contexts of one gram, copies within a block not counted, beyond which its windows are routed one by one.
HOT = 50_000
_NULL_ID = -(2**63)
_SLICE = 1_000_000
#: Bytes of text whose anchors are sorted and sent at once.
BLOCK = 20_000_000
_U = np.uint64
_BASE = 0x5851F42D4C957F2D | 1
_ONE, _MANY, _PAST = 0, 1, 2
#: In place of the source of a span: it goes by itself.
_GOES = -1
#: Contexts that are sorted as a whole at once.
RUN = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k-gram, by doubling."""
    n = len(data) - k + 1
    doubled = {1: _BYTES[data]}
    size = 1
    while size * 2 <= k:
        a = doubled[size]
        doubled[size * 2] = a[: len(a) - size] * _U(pow(_BASE, size, 2**64)) + a[size:]
        size *= 2
    out, at = np.zeros(n, _U), 0
    for size in sorted(doubled, reverse=True):
        if k & size:
            out = out * _U(pow(_BASE, size, 2**64)) + doubled[size][at : at + n]
            at += size
    return _mix(out)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + w] for every i."""
    n, size, cur = len(x) - w + 1, 1, x
    while size * 2 <= w:
        cur = pick(cur[: len(cur) - size], cur[size:])
        size *= 2
    return pick(cur[:n], cur[w - size : w - size + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, text, place in the text) of the anchors of the texts data[offsets[i]:offsets[i + 1]]."""
    none = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return none
    w = length - gram + 1
    with np.errstate(over="ignore"):
        h = gram_hashes(data, gram) | _U(1)
        least = _sliding(h, w, np.minimum)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        least[text[: len(least)] != text[length - 1 :]] = 0  # windows over a border don't count
        edge = np.zeros(w - 1, _U)
        most = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
        at = np.flatnonzero(most == h)
        if not len(at):
            return none
        of = text[at]
        # an anchor is the least of many hashes; mixed once more, grams spread evenly over the buckets
        return _mix(h[at]), of, at - offsets[of]


def all_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, step: int = _SLICE):
    """The anchors of the texts, some step bytes at a time; a piece of a longer text sees the bytes around it that matter."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1))
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * step:
            g, of, at = anchors(data[a:b], offsets[i : j + 1] - a, length, gram)
            yield g, of + i, at
        else:
            for f in range(a, b, step):
                low, high = max(a, f - 2 * length), min(b, f + step + 2 * length)
                g, of, at = anchors(data[low:high], np.array([0, high - low]), length, gram)
                own = (at + low >= f) & (at + low < f + step)
                yield g[own], of[own] + i, at[own] + low - a
        i = j


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of whole numbers, those of like weight together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:size]).tobytes()


def _from_planes(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(size, -1).T
    return out.reshape(-1).view("<u8")


def _packed(kind: int, bucket: int, gram: np.ndarray, doc: np.ndarray, number: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bytes:
    """Anchors of one bucket (number: their places), or grams (number: how many contexts), as compressed columns.

    gram has 40 bits and ascends; doc points into ids and keys.
    """
    used, doc = np.unique(doc, return_inverse=True)
    size = max(1, (int(number.max(initial=0)).bit_length() + 7) // 8)
    wide = 2 if len(used) < 65536 else 4
    head = np.array([kind, bucket, len(gram), len(used), wide, size], "<i8").tobytes()
    parts = [_planes(np.diff(gram, prepend=gram[:1] * 0), 5), _planes(doc, wide), _planes(number, size), ids[used].astype("<i8").tobytes(), keys[used].astype("<i4").tobytes()]
    return zlib.compress(b"".join([head, *parts]), 1)


def _unpacked(blob: bytes) -> tuple:
    """(kind, bucket, gram, id, row key, number)."""
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    kind, bucket, n, docs, wide, size = raw[:48].view("<i8").tolist()
    cuts = np.cumsum([48, 5 * n, wide * n, size * n, 8 * docs, 4 * docs])
    gram, doc, number, ids, keys = (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    doc = _from_planes(doc, wide).astype(np.int64)
    ids, keys = np.frombuffer(ids.tobytes(), "<i8"), np.frombuffer(keys.tobytes(), "<i4")
    return kind, bucket, np.cumsum(_from_planes(gram, 5), dtype=_U), ids[doc], keys[doc], _from_planes(number, size).astype(np.int64)


def _row_key(text):
    return F.hash(text)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and ends."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _span_marks(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of every data[begin : begin + size], by words of 8 bytes; the last one ends with its span."""
    out = size.astype(_U)
    if len(out):
        words = np.lib.stride_tricks.sliding_window_view(data, 8)
        with np.errstate(over="ignore"):
            for k in range(0, int(size.max()), 8):
                out = _mix(out + words[begin + np.minimum(k, size - 8)].view("<u8")[:, 0])
    return out


def contexts_sent(group: np.ndarray, marks: np.ndarray, row: np.ndarray, own: np.ndarray, groups: int) -> np.ndarray:
    """How many contexts each group sends: of equal ones (equal marks) those of the smallest id, once a row.

    It only decides how grams are routed, so marks that clash do no harm.
    """
    bits = _U(64 - int(groups).bit_length())
    key = group.astype(_U) << bits | marks >> (_U(64) - bits)
    order = np.lexsort((row, key))
    key, row, own = key[order], row[order], own[order]
    starts, same = _groups(key)
    if not len(starts):
        return np.zeros(groups, np.int64)
    goes = own == np.minimum.reduceat(own, starts)[same]
    goes[1:] &= (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return np.bincount((key[goes] >> bits).astype(np.int64), minlength=groups)


def _anchor_blobs(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, blob: the anchors of every block of rows by bucket.

    Of grams that several documents of the block hold, the bucket gets one entry (_MANY) with the number of contexts that the
    block would send for it; their anchors need no decision and travel elsewhere (_PAST).
    """
    w = length - gram + 1

    def blocks(batches):
        """The batches, cut so that a block holds some BLOCK bytes of text."""
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK, side="right"))))
                yield batch.slice(i, j - i)
                i = j

    def run(batches):
        for block, batch in enumerate(blocks(batches)):
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = _text_bytes(batch.column(2))
            found = list(all_anchors(data, offsets, length, gram))
            if not found:
                continue
            g, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            if not len(g):
                continue
            bucket = ((g >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            g &= _U(2**40 - 1)
            order = np.lexsort((g, bucket))
            g, doc, at, bucket = g[order], doc[order], at[order], bucket[order]
            starts, group = _groups(bucket, g)
            own = ids[doc]
            many = np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts)
            past = many[group]
            of, begin = doc[past], np.maximum(0, at[past] - w + 1)
            size = np.minimum(np.diff(offsets)[of], at[past] + length) - begin
            sent = contexts_sent(group[past], _span_marks(data, offsets[of] + begin, size), of, own[past], len(starts))
            edges, firsts = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[starts], np.arange(buckets + 1))
            out_b, out = [], []
            for b in range(buckets):
                s, f = slice(edges[b], edges[b + 1]), slice(firsts[b], firsts[b + 1])
                k, m = past[s], many[f]
                if not k.all():
                    out_b.append(b)
                    out.append(_packed(_ONE, b, g[s][~k], doc[s][~k], at[s][~k], ids, keys))
                if m.any():
                    head = starts[f][m]
                    out_b.append(b)
                    out.append(_packed(_MANY, b, g[head], doc[head], sent[f][m], ids, keys))
                    out_b.append((b + block * 7919 + int(head[0])) % buckets)
                    out.append(_packed(_PAST, b, g[s][k], doc[s][k], at[s][k], ids, keys))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    return docs.mapInArrow(run, "bucket int, blob binary")


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows start in sorted columns, and each row's run."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


_FOUND = "doc_id long, row_key int, place long, route long"


def _repeated_grams(blobs: DataFrame, hot: int) -> DataFrame:
    """The anchors whose gram several documents hold, with their route; and the routes of hot grams, with place -1."""

    def rows(doc, key, place, route) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(place), pa.array(route)], names=["doc_id", "row_key", "place", "route"])

    def route(g: np.ndarray, bucket: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix(g + _U(bucket) * _U(0x9E3779B97F4A7C15)).view(np.int64)

    def run(batches):
        by: dict[int, list[bytes]] = {}  # compressed until their bucket's turn
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(b, []).append(blob.as_py())
        for b in sorted(by):
            parts = []
            for blob in by.pop(b):
                kind, bucket, g, doc, key, number = _unpacked(blob)
                if kind == _PAST:
                    yield rows(doc, key, number, route(g, bucket))
                else:
                    parts.append((g, doc, key, number, np.full(len(g), kind == _MANY)))
            if not parts:
                continue
            g, doc, key, number, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.argsort(g, kind="stable")
            g, doc, key, number, many = g[order], doc[order], key[order], number[order], many[order]
            starts, group = _groups(g)
            several = (np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts)) | np.logical_or.reduceat(many, starts)
            count = np.add.reduceat(np.where(many, number, 1), starts)
            mine = several[group] & ~many
            if mine.any():
                yield rows(doc[mine], key[mine], number[mine], route(g[mine], b))
            if (many_more := several & (count > hot)).any():
                at = starts[many_more]
                yield rows(doc[at], key[at], np.full(len(at), -1), route(g[at], b))

    return blobs.mapInArrow(run, _FOUND)


_CONTEXT = "route long, doc_id long, row_key int, begin long, size int, source long, context binary"


def _rows(route, doc, key, begin, size, source, context: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc), pa.array(key), pa.array(begin), pa.array(size.astype(np.int32)), pa.array(np.broadcast_to(source, len(route)).astype(np.int64)), context], names=["route", "doc_id", "row_key", "begin", "size", "source", "context"])


def _copies(route: np.ndarray, doc: np.ndarray, key: np.ndarray, size: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts whole contexts (rows of padded bytes) and compares adjacent ones: which equal one of a smaller id of their route,
    which contexts of a route with several different ones are left (both as masks), and for each context the first equal one of
    its own row."""
    n = len(route)
    copy, left, first_own = np.zeros(n, bool), np.zeros(n, bool), np.arange(n)
    order = np.argsort(route, kind="stable")
    starts, group = _groups(route[order])
    some = order[(np.diff(np.append(starts, n)) > 1)[group]]  # routes with one context have nothing to compare
    if not len(some):
        return copy, left, first_own
    some = some[np.lexsort((key[some], doc[some], size[some], _text_ranks(padded[some]), route[some]))]
    same = np.zeros(len(some), bool)
    for f in range(1, len(some), 100_000):
        b = some[f : f + 100_000]
        a = some[f - 1 : f - 1 + len(b)]
        same[f : f + len(b)] = (route[a] == route[b]) & (size[a] == size[b]) & (padded[a] == padded[b]).all(1)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))
    copy[some] = doc[some] > doc[some[first]]
    starts, group = _groups(route[some])
    different = np.add.reduceat((~same).astype(np.int64), starts) > 1
    left[some] = different[group]
    again = same.copy()  # as the one before, in the same row
    again[1:] &= (doc[some[1:]] == doc[some[:-1]]) & (key[some[1:]] == key[some[:-1]])
    first_own[some] = some[np.maximum.accumulate(np.where(again, 0, np.arange(len(some))))]
    return copy, left & ~copy, first_own


def _text_ranks(rows: np.ndarray) -> np.ndarray:
    """The rank of every row of bytes among the distinct ones, by words of 8 bytes."""
    wide = -(-rows.shape[1] // 8)
    words = np.zeros((len(rows), wide * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(_U)
    order = np.lexsort(words.T[::-1])
    new = np.zeros(len(rows), np.int64)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new)
    return out


def _padded(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """data[begin : begin + size] as rows of width bytes."""
    out, at = np.zeros((len(begin), width), np.uint8), np.arange(width)
    for f in range(0, len(begin), 50_000):  # the places take 8 bytes for each byte
        inside = at < size[f : f + 50_000, None]
        out[f : f + 50_000] = np.where(inside, data[np.where(inside, begin[f : f + 50_000, None] + at, 0)], 0)
    return out


def _binary(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    inside = np.arange(rows.shape[1]) < size[:, None]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows[inside]))])


def _contexts(joined: DataFrame, length: int, gram: int) -> DataFrame:
    """The contexts of the anchors; copies within a run of contexts come without bytes, and only what is left of those of hot
    grams is cut to windows."""
    w = length - gram + 1
    width = length + w - 1

    def pieces(offsets, doc, key, todo):
        """(route, hot, doc, key, place in data, begin, size) of the contexts of some anchors."""
        of = np.repeat(np.arange(len(doc)), np.diff(todo.offsets.to_numpy()))
        first = todo.offsets[0].as_py()
        flat = todo.values.slice(first, len(of))
        place, route, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("place", "route", "hot"))
        for f in range(0, len(of), RUN):
            o, p = of[f : f + RUN], place[f : f + RUN]
            begin = np.maximum(0, p - w + 1)
            size = np.minimum(offsets[o + 1] - offsets[o], p + length) - begin
            yield route[f : f + RUN], hot[f : f + RUN], doc[o], key[o], offsets[o] + begin, begin, size

    def told(doc, key, begin, size, source) -> pa.RecordBatch:
        """Spans with nothing to compare any more, spread over the tasks by document and place."""
        with np.errstate(over="ignore"):
            spread = _mix(_mix(doc.astype(_U)) + begin.astype(_U))
        return _rows(spread.view(np.int64), doc, key, begin, size, source, pa.nulls(len(doc), pa.binary()))

    def windows(data, doc, key, where, begin, size):
        """Each window of the contexts, routed by its bytes. A window of two contexts goes once; those that a smaller id of
        the run has too go by themselves. None is told to fare as another: a context may be told to fare as these."""
        n = size - length + 1
        at = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        _, once = np.unique(where[at] + step, return_index=True)
        at, step = at[once], step[once]
        for f in range(0, len(at), RUN):
            a, s = at[f : f + RUN], step[f : f + RUN]
            sizes = np.full(len(a), length, np.int64)
            rows = _padded(data, where[a] + s, sizes, -(-length // 8) * 8)
            words, whole = rows.view("<u8"), np.zeros(len(a), _U)
            with np.errstate(over="ignore"):
                for c in range(words.shape[1]):
                    whole = _mix(whole + words[:, c] + _U(0x9E3779B97F4A7C15))
            route, d, k, start = whole.view(np.int64), doc[a], key[a], begin[a] + s
            copy, _, _ = _copies(route, d, k, sizes, rows)
            if copy.any():
                yield told(d[copy], k[copy], start[copy], sizes[copy], _GOES)
            go = ~copy
            yield _rows(route[go], d[go], k[go], start[go], sizes[go], _GOES, _binary(rows[go], sizes[go]))

    def run(batches):
        for batch in batches:
            data, offsets = _text_bytes(batch.column(batch.schema.names.index("text")))
            doc, key = (batch.column(batch.schema.names.index(k)).to_numpy() for k in ("doc_id", "row_key"))
            todo = batch.column(batch.schema.names.index("todo"))
            for route, hot, d, k, where, begin, size in pieces(offsets, doc, key, todo):
                rows = _padded(data, where, size, width)
                copy, _, first = _copies(route, d, k, size, rows)
                done = copy | (first != np.arange(len(first)))
                if done.any():  # a span that goes, or one that fares as the first equal one of its row does
                    yield told(d[done], k[done], begin[done], size[done], np.where(copy, _GOES, begin[first])[done])
                if (go := ~done & ~hot).any():
                    yield _rows(route[go], d[go], k[go], begin[go], size[go], _GOES, _binary(rows[go], size[go]))
                if (cut := ~done & hot).any():
                    yield from windows(data, d[cut], k[cut], where[cut], begin[cut], size[cut])

    return joined.mapInArrow(run, _CONTEXT)


def _packed_keys(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of whole numbers that order rows like the given ones: a single one if three fields of 21 bits hold them."""
    if len(columns) > 1 and len(columns) <= 3 and all(len(c) == 0 or int(c.max()) < 2**21 for c in columns):
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key << 21 | c
        return [key]
    return columns


def _order(columns: list[np.ndarray]) -> np.ndarray:
    return np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])


def _names(columns: list[np.ndarray]) -> np.ndarray:
    """The rows' names: equal rows, equal names, from 1 on in order."""
    columns = _packed_keys(columns)
    order = _order(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


LETTER = 7
DEPTH = 9 * LETTER


def suffix_order(data: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The order of all suffixes by their first bytes, depth at least (DEPTH at most); a suffix ends with its text.

    ends[i] is where the text of position i ends. Difference cover {1, 2} modulo 3 over letters of 7 bytes.
    """
    if depth > DEPTH:
        raise ValueError(f"names of two levels spell {DEPTH} bytes")
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    padded = np.concatenate([data, np.zeros(LETTER, np.uint8)])
    left = ends - at
    letter = np.zeros(n, _U)
    for j in range(LETTER):  # bytes past the end are 0, and how many are there breaks the tie
        letter = letter << _U(8) | np.where(left > j, padded[j : j + n], 0).astype(_U)
    letter = np.append(_names([letter << _U(8) | np.minimum(left, LETTER).astype(_U)]), 0)

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        """values at the place so many letters on, 0 past the text's end; values has a 0 at its own end."""
        return values[np.where(left > LETTER * by, at + LETTER * by, n)]

    # the place of a position in its string of letters, counted within its text
    start = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1])
    residue = (at - np.repeat(start, np.diff(np.append(start, n)))) // LETTER % 3
    sampled = residue != 0
    first, second = shifted(letter, 1), shifted(letter, 2)
    level = np.zeros(n + 1, np.int64)
    level[:-1][sampled] = _names([letter[:-1][sampled], first[sampled], second[sampled]])
    # recursion on names: three letters on, a sampled place is sampled again; triples of names spell DEPTH bytes
    rank = np.zeros(n + 1, np.int64)
    rank[:-1][sampled] = _names([level[:-1][sampled], shifted(level, 3)[sampled], shifted(level, 6)[sampled]])
    # the places 0 modulo 3: their letter, then the rank one letter on
    one, two = shifted(rank, 1), shifted(rank, 2)
    # merge: against a place 1 mod 3 both are (letter, rank one on); against 2 mod 3 (letter, letter, rank two on)
    order_s = np.flatnonzero(sampled)
    order_s = order_s[np.argsort(rank[:-1][sampled])]
    order_r = np.flatnonzero(~sampled)
    order_r = order_r[_order(_packed_keys([letter[:-1][order_r], one[order_r]]))]
    return _merged(order_s, order_r, residue, letter[:-1], first, one, two)


def _merged(order_s, order_r, residue, letter, first, one, two) -> np.ndarray:
    """One order from those of the sampled places and of the others."""
    s1, s2 = order_s[residue[order_s] == 1], order_s[residue[order_s] == 2]

    def below(s: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """How many of the sampled places s come before each of the others; both are sorted."""
        both = np.concatenate([s, order_r])
        keys = _packed_keys([c[both] for c in columns])
        if len(keys) == 1:
            return np.searchsorted(np.sort(keys[0][: len(s)]), keys[0][len(s) :])
        tie = np.concatenate([np.zeros(len(s), np.int8), np.ones(len(order_r), np.int8)])
        order = np.lexsort((tie, *keys[::-1]))
        is_s = order < len(s)
        out = np.empty(len(order_r), np.int64)
        out[order[~is_s] - len(s)] = np.cumsum(is_s)[~is_s]
        return out

    # beyond DEPTH bytes the keys may disagree on ties; any order of these will do, so the counts are made to ascend
    place = np.maximum.accumulate(below(s1, [letter, one]) + below(s2, [letter, first, two])) + np.arange(len(order_r))
    out = np.empty(len(order_s) + len(order_r), np.int64)
    is_r = np.zeros(len(out), bool)
    is_r[place] = True
    out[is_r], out[~is_r] = order_r, order_s
    return out


def repeated_windows(texts: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, where windows start that also start in a text of a smaller id."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), sizes)
    order = suffix_order(data, ends[of], length)
    at = order[ends[of[order]] - order >= length]  # suffixes that are long enough, still in order
    hits = np.zeros(len(data), bool)
    if len(at) > 1:
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        same = np.empty(len(at), bool)
        same[0] = False
        for f in range(1, len(at), 200_000):  # adjacent prefixes
            b = at[f : f + 200_000]
            a = at[f - 1 : f - 1 + len(b)]
            same[f : f + len(b)] = (view[a] == view[b]).all(1)
        starts = np.flatnonzero(~same)
        least = np.minimum.reduceat(ids[of[at]], starts)
        hits[at] = ids[of[at]] > least[np.cumsum(~same) - 1]
    begin = ends - sizes
    found = np.flatnonzero(hits)
    cut = np.searchsorted(found, begin[1:])
    return [x - b for x, b in zip(np.split(found, cut), begin, strict=True)]


SPAN = "doc_id long, row_key int, begin long, size int, source long"


def _sorted_repeats(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The spans of bytes that the sort finds repeated, and those (source set) that fare as equal bytes of their row from source
    on do; contexts are sorted by route within their task."""
    width = 2 * length - gram

    def spans(doc, key, begin, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(begin), pa.array(np.asarray(size).astype(np.int32)), pa.array(np.full(len(doc), _GOES, np.int64))], names=["doc_id", "row_key", "begin", "size", "source"])

    def settled(whole: pa.Table):
        doc, key, begin, size, route = (whole.column(k).to_numpy() for k in ("doc_id", "row_key", "begin", "size", "route"))
        size = size.astype(np.int64)
        context = whole.column("context").combine_chunks()
        data = np.frombuffer(context.buffers()[2], np.uint8) if context.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
        copy, left, _ = _copies(route, doc, key, size, _padded(data, offsets[:-1], size, width))
        if copy.any():
            yield spans(doc[copy], key[copy], begin[copy], size[copy])
        at = np.flatnonzero(left)
        upto = np.cumsum(size[at])
        i = 0
        while i < len(at):  # the suffixes of some million bytes at once; a route stays together
            j = min(len(at), max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _SLICE, side="right"))))
            while j < len(at) and route[at[j]] == route[at[j - 1]]:
                j += 1
            part = at[i:j]
            found = repeated_windows([data[offsets[x] : offsets[x + 1]].tobytes() for x in part], doc[part], length)
            runs = [(part[k], *run) for k, hits in enumerate(found) if len(hits) for run in _runs(hits, length)]
            if runs:
                x, a, n = (np.array(c) for c in zip(*runs, strict=True))
                yield spans(doc[x], key[x], begin[x] + a, n)
            i = j

    def run(batches):
        held, size = [], 0
        for batch in batches:
            gone = pc.is_null(batch.column(6))
            done = batch.filter(gone)
            if done.num_rows:
                yield done.select(["doc_id", "row_key", "begin", "size", "source"])
            batch = batch.filter(pc.invert(gone))
            while batch.num_rows:
                # whole routes, as soon as some million bytes are at hand
                route = batch.column(0).to_numpy()
                if held and size >= 4 * _SLICE:
                    last = held[-1].column(0)[-1].as_py()
                    cut = int((route != last).argmax()) if (route != last).any() else batch.num_rows
                    held.append(batch.slice(0, cut))
                    batch = batch.slice(cut)
                    if batch.num_rows:
                        yield from settled(pa.Table.from_batches(held))
                        held, size = [], 0
                    continue
                held.append(batch.slice(0, 50_000))
                size += held[-1].column(6).nbytes
                batch = batch.slice(50_000)
        if held:
            yield from settled(pa.Table.from_batches(held))

    return contexts.mapInArrow(run, SPAN)


def _runs(hits: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of the windows that start at hits, joined where one starts right after another."""
    cut = np.flatnonzero(np.diff(hits) > 1) + 1
    return [(int(x[0]), int(x[-1] - x[0] + length)) for x in np.split(hits, cut)]


def told_spans(begin: np.ndarray, size: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the spans that go: those that go by themselves, and for every other one what goes within the equal
    bytes from its source on."""
    own = source == _GOES
    order = np.argsort(begin[own], kind="stable")
    b, z = begin[own][order], size[own][order]
    out_b, out_z = [b], [z]
    rest = np.flatnonzero(~own)
    rest = rest[np.lexsort((size[rest], source[rest]))]
    starts, _ = _groups(source[rest], size[rest])
    for f, to in itertools.pairwise([*starts.tolist(), len(rest)]):
        at, low, n = begin[rest[f:to]], int(source[rest[f]]), int(size[rest[f]])
        i, j = np.searchsorted(b, [low, low + n])
        inside = b[i:j] + z[i:j] <= low + n
        for x, k in np.unique(np.stack([b[i:j][inside] - low, z[i:j][inside]], axis=1), axis=0).tolist():
            out_b.append(at + x)
            out_z.append(np.full(len(at), k, np.int64))
    return np.concatenate(out_b), np.concatenate(out_z)


def kept_bytes(raw: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and what is left when the spans go."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + size)[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    starts, stops = begin[first], reach[np.append(first[1:] - 1, len(begin) - 1)]
    kept = b"".join(raw[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(raw)], strict=True))
    return int((stops - starts).sum()), len(first), kept


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and the kept bytes."""
    if not 8 <= gram <= length <= DEPTH:
        raise ValueError(f"grams need 8 bytes, windows those of a gram at least and {DEPTH} at most")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = whole_text()
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), _row_key(text).alias("row_key"), text.alias("text"))
    found = written(_repeated_grams(_anchor_blobs(own, n, length, gram).repartitionById(n, "bucket"), hot), "repeat-anchors")
    hot_routes = written(found.where("place < 0").select("route"), "repeat-hot")
    todo = found.where("place >= 0").join(hot_routes.withColumn("hot", F.lit(True)), "route", "left")
    todo = todo.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("place", "route", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("todo"))
    # written before contexts are cut, so that the texts' shuffle is gone when those travel
    texts = written(own.join(todo, ["doc_id", "row_key"]), "repeat-texts")
    dropped(found, hot_routes)
    contexts = _contexts(texts, length, gram).repartition(n, "route").sortWithinPartitions("route")
    spans = written(_sorted_repeats(contexts, length, gram), "repeat-spans")
    dropped(texts)
    gone = spans.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("begin", "size", "source")).alias("spans"))
    joined = own.join(gone, ["doc_id", "row_key"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for f in range(0, batch.num_rows, 512):
                part = batch.slice(f, 512)
                rows = [[] for _ in range(5)]
                for doc, t, gaps in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    raw = t.as_py().encode()
                    removed, runs, kept = 0, 0, raw
                    if gaps.is_valid:
                        begin, size = told_spans(*(gaps.values.field(k).to_numpy().astype(np.int64) for k in ("begin", "size", "source")))
                        if len(begin):
                            removed, runs, kept = kept_bytes(raw, begin, size)
                    for c, x in zip(rows, (None if doc == _NULL_ID else doc, len(raw), removed, runs, kept), strict=True):
                        c.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, REMOVED)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by 50-byte strings that also start in a document with a smaller id."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
