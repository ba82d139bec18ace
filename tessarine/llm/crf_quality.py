"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its bytes (shares of capitals, symbols, digits, marks, accents; lengths; repetition) and of the
lines before and after it. Two labels, bad and good, form the chain's states. Training lines carry their document's label, so
the weights come from maximising the conditional likelihood of labelled documents (resilient gradient steps on
forward-backward expectations). A document's raw quality is the mean of its lines' marginals of "good", weighted by length,
and two numbers fitted on the training documents map that to a probability of the label 1.

The model is fitted on a sample of labelled documents, drawn by hash and bounded by SAMPLE documents a label (a parameter; it
bounds the training only). Training and scoring read every line of the texts they take. Executors compute the features once,
keep them as a table in the shared folder, and every round sum the gradient over it; a round brings some 50 numbers a task to
the driver, and no text. These are whole multiples of 2^-40, so their sums don't depend on the order: runs agree to the bit.

Nulls: a null or empty text is one empty line and gets a score like any other. Labels that are null are ignored; a document
with several labels takes the lowest. Without labels of both kinds every score is the share of label 1 (0.5 if there are
none). Equal texts get equal scores, whatever is scored beside them: nothing in a text's arithmetic depends on its
neighbours. Extra columns aren't read.

Long texts: bytes are read in steps of STEP, so a text needs some 2 times its bytes and 150 bytes a line in one worker.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, span_hashes, whole_text, written

SAMPLE, ROUNDS, PENALTY, CUT = 2000, 50, 1e-3, 0.7
_SLICE = STEP = 1_000_000
_BLOCK = 50_000
#: Chains longer than this advance on their own, shorter ones together.
_LONG = 512
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[128:192] = 7  # continuation bytes
_BASE = 0x5851F42D4C957F2D
_MARKS = np.arange(256, dtype=np.uint64) + np.uint64(0x9E37)
OWN = ("capitals", "digits", "symbols", "marks", "other", "accents", "blanks", "word_length", "log_length", "short", "empty", "repeated", "ends_in_stop")
_N = len(OWN)
#: Sums travel as whole multiples of these.
_FINE, _COARSE = 2.0**40, 2.0**30


def line_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Per line its bytes of each class, its words (the last column) and a hash; the bytes are read step by step."""
    n, kinds = len(starts), 8
    counts = np.zeros((n, kinds + 1), np.uint32)
    for c0 in range(0, len(data), step):
        c1 = min(c0 + step, len(data))
        i, j = int(np.searchsorted(ends, c0, side="right")), int(np.searchsorted(starts, c1, side="left"))
        if i >= j:
            continue
        s, e = np.clip(starts[i:j], c0, c1) - c0, np.clip(ends[i:j], c0, c1) - c0
        part = data[c0:c1]
        kind = _CLASS[part]
        for k in range(1, kinds):
            upto = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
            counts[i:j, k] += (upto[e] - upto[s]).astype(np.uint32)
        blank = kind == 6
        begins = ~blank
        begins[1:] &= blank[:-1]
        if c0:
            begins[0] &= _CLASS[data[c0 - 1]] == 6
        first = s[(s < e) & (starts[i:j] >= c0)]
        begins[first] = ~blank[first]
        upto = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        counts[i:j, kinds] += (upto[e] - upto[s]).astype(np.uint32)
    counts[:, 0] = (ends - starts).astype(np.uint32) - counts[:, 1:kinds].sum(1, dtype=np.uint32)
    return counts, span_hashes(data, starts, ends, _MARKS, _BASE, step)


def _repeated(hashes: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a line equals an earlier one of its document."""
    order = np.lexsort((np.arange(len(hashes)), hashes, doc))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order] = again & (length[order] > 0)
    return out


def own_features(counts: np.ndarray, length: np.ndarray, repeated: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The features of lines from their counts, a row a line."""
    counts, length = counts.astype(float), length.astype(float)
    solid, words = np.maximum(length - counts[:, 6], 1), counts[:, 8]
    some = np.maximum(words, 1)
    columns = [
        counts[:, 2] / solid,
        counts[:, 3] / solid,
        np.minimum(counts[:, 4] / some, 1.5),
        np.minimum(counts[:, 5] / some, 1.5),
        np.minimum(counts[:, 0] / some, 1.5),
        counts[:, 7] / solid,
        counts[:, 6] / np.maximum(length, 1),
        np.minimum(solid / some, 20) / 10,
        np.log1p(length) / 8,
        length < 30,
        length == 0,
        repeated,
        (last == 46) & (length > 0),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


class Lines:
    """The lines of some texts: sizes (lines a text), doc (of each line), length, and own features by blocks of lines."""

    def __init__(self, texts: pa.Array):
        self.data, self.starts, self.ends, self.doc = _lines(texts)
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        self.length = self.ends - self.starts
        self.counts, hashes = line_counts(self.data, self.starts, self.ends)
        self.again = _repeated(hashes, self.length, self.doc)

    def own(self, i: int, j: int) -> np.ndarray:
        last = self.data[np.maximum(self.ends[i:j] - 1, 0)] if len(self.data) else np.zeros(j - i, np.uint8)
        return own_features(self.counts[i:j], self.length[i:j], self.again[i:j], last)


def _weighted(own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """own @ w, summed in the order of the features for every line alike."""
    out = np.zeros(len(own))
    for f in range(_N):
        out += own[:, f] * w[f]
    return out


def _shifted(values: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """values of the line before (by 1) or after (by -1) in the same document, else 0."""
    out = np.zeros_like(values)
    same = doc[1:] == doc[:-1]
    if by > 0:
        out[1:][same] = values[:-1][same]
    else:
        out[:-1][same] = values[1:][same]
    return out


def unary_scores(blocks, doc: np.ndarray, model: dict) -> np.ndarray:
    """The log score of good against bad per line; blocks are the own features in order."""
    w = model["weights"][: 3 * _N] / model["scale"]
    base = float(model["weights"][3 * _N]) - float((w * model["mean"]).sum())
    here, before, after = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*[[_weighted(b, w[k * _N : (k + 1) * _N]) for k in range(3)] for b in blocks], strict=True))
    return base + here + _shifted(before, doc, 1) + _shifted(after, doc, -1)


def _step(x, a: float, b: float, c: float, d: float):
    """log((a + b e^x) / (c + d e^x))."""
    e = np.exp(-np.abs(x))
    up = x >= 0
    return np.log(np.where(up, a * e + b, a + b * e) / np.where(up, c * e + d, c + d * e))


def _serial(steps: list, added: list, a: float, b: float, c: float, d: float) -> list:
    """The same along one chain: out[t] = added[t] + step(out[t - 1] + steps[t - 1])."""
    exp, log, out = math.exp, math.log, []
    x = None
    for plus, more in zip(steps, added, strict=True):
        if x is None:
            x = more
        else:
            x = x + before
            if x >= 0:
                e = exp(-x)
                x = more + log((a * e + b) / (c * e + d))
            else:
                e = exp(x)
                x = more + log((a + b * e) / (c + d * e))
        before = plus
        out.append(x)
    return out


def messages(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line the log odds of good against bad from the lines up to it, and from those after it."""
    begin = np.cumsum(sizes) - sizes
    t = np.exp(trans)
    ahead, back = np.zeros(len(unary)), np.zeros(len(unary))
    short = np.flatnonzero(sizes <= _LONG)
    order = short[np.argsort(-sizes[short], kind="stable")]
    b, s = begin[order], sizes[order]
    alive = np.searchsorted(-s, -np.arange(1, (s[0] if len(s) else 0) + 1), side="right")
    for k, m in enumerate(alive):
        at = b[:m] + k
        ahead[at] = unary[at] if k == 0 else unary[at] + _step(ahead[at - 1], t[0, 1], t[1, 1], t[0, 0], t[1, 0])
    for k in range(len(alive) - 2, -1, -1):
        at = b[: alive[k + 1]] + k
        back[at] = _step(back[at + 1] + unary[at + 1], t[1, 0], t[1, 1], t[0, 0], t[0, 1])
    for i in np.flatnonzero(sizes > _LONG):
        u = unary[begin[i] : begin[i] + sizes[i]].tolist()
        none = [0.0] * len(u)
        ahead[begin[i] : begin[i] + sizes[i]] = _serial(none, u, t[0, 1], t[1, 1], t[0, 0], t[1, 0])
        u.reverse()
        back[begin[i] : begin[i] + sizes[i]] = _serial(u, none, t[1, 0], t[1, 1], t[0, 0], t[0, 1])[::-1]
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1, e) / (1 + e)


def _pair_marginals(unary, sizes, trans, ahead, back) -> tuple[np.ndarray, np.ndarray]:
    """(lines that have a next one in their chain, the marginals of (bad, bad), (bad, good), (good, bad), (good, good))."""
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inner)
    left, right = ahead[at], unary[at + 1] + back[at + 1]
    logs = np.stack([trans[p, q] + p * left + q * right for p in (0, 1) for q in (0, 1)])
    logs -= logs.max(axis=0)
    e = np.exp(logs)
    return at, e / (e[0] + e[1] + e[2] + e[3])


def forward_backward(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good per line, the summed pair marginals (2 x 2), and each chain's log partition.

    unary is the log score of good against bad per line; sizes are the chains' lengths; trans the log scores of label pairs.
    """
    ahead, back = messages(unary, sizes, trans)
    at, pairs = _pair_marginals(unary, sizes, trans, ahead, back)
    t = np.exp(trans)
    grows = np.zeros(len(unary))
    grows[at] = np.log(t[0, 0] + t[1, 0] * np.exp(ahead[at]))
    z = np.add.reduceat(grows, np.cumsum(sizes) - sizes) + np.logaddexp(0, ahead[np.cumsum(sizes) - 1])
    return _sigmoid(ahead + back), pairs.sum(axis=1).reshape(2, 2), z


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, starts, ends and document of all lines of non-null texts; each text has one line at least."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    cut = np.flatnonzero(data == 10)
    of_cut = np.searchsorted(offsets, cut, side="right") - 1
    starts = np.concatenate([offsets[:-1], cut + 1])
    doc = np.concatenate([np.arange(len(texts)), of_cut])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:] - 1, len(data))
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = offsets[1:][doc[last]]
    return data, starts, ends, doc


def _slices(texts: pa.Array):
    """The texts in slices of some _SLICE bytes."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, len(texts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _SLICE, side="right"))))
        yield texts.slice(i, j - i)
        i = j


def _mean_marginal(unary: np.ndarray, sizes: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    ahead, back = messages(unary, sizes, trans)
    good = _sigmoid(ahead + back)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(doc, (length + 1) * good, len(sizes)) / np.bincount(doc, length + 1, len(sizes))


def raw_quality(texts: pa.Array, model: dict) -> np.ndarray:
    """The length-weighted mean marginal of good of every text."""
    lines = Lines(texts)
    n = len(lines.doc)
    unary = unary_scores((lines.own(i, min(n, i + _BLOCK)) for i in range(0, n, _BLOCK)), lines.doc, model)
    return _mean_marginal(unary, lines.sizes, lines.length, model["trans"])


# ---------------------------------------------------------------- training


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and quality of at most `sample` labelled documents of each label, the first by hash; the texts are whole."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out()).withColumn("_order", F.xxhash64(F.lit(5), "doc_id"))
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy("_order", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen.drop("_order")), "doc_id")  # sample rows a label


def _feature_table(rows: DataFrame, partitions: int) -> DataFrame:
    """Per training document: quality, the lines' own features and lengths as bytes."""

    def run(batches):
        for batch in batches:
            quality, first = batch.column(1), 0
            for part in _slices(batch.column(0)):
                lines = Lines(part)
                ends = np.cumsum(lines.sizes)
                for k, (a, b) in enumerate(zip((ends - lines.sizes).tolist(), ends.tolist(), strict=True)):
                    columns = [pa.array([quality[first + k].as_py()], pa.int32()), pa.array([lines.own(a, b).tobytes()], pa.binary()), pa.array([lines.length[a:b].astype("<i8").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["quality", "own", "length"])
                first += len(part)

    made = rows.select("text", F.col("quality").cast("int")).mapInArrow(run, "quality int, own binary, length binary")
    return written(made.repartition(partitions, F.xxhash64("own")), "crf-features")


def _gathered(table: DataFrame, f) -> list[dict]:
    """What f makes of (own, length, sizes, quality) of a few documents at a time, summed by key in every task."""

    def run(batches):
        total: dict[str, list[int]] = {}
        for batch in batches:
            i, n = 0, batch.num_rows
            size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            upto = np.cumsum(size)
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 8_000_000, side="right"))))
                own = np.concatenate([np.frombuffer(batch.column(1)[k].as_buffer(), "<f4").reshape(-1, _N) for k in range(i, j)])
                length = np.concatenate([np.frombuffer(batch.column(2)[k].as_buffer(), "<i8") for k in range(i, j)])
                for key, values in f(own, length, size[i:j] // (4 * _N), batch.column(0).to_numpy()[i:j]).items():
                    held = total.setdefault(key, [0] * len(values))
                    total[key] = [a + int(b) for a, b in zip(held, values, strict=True)]
                i = j
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)])], names=["sums"])

    return [json.loads(r[0]) for r in table.mapInArrow(run, "sums string").collect()]


def _summed(parts: list[dict]) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for part in parts:
        for key, values in part.items():
            out[key] = [a + b for a, b in zip(out.get(key, [0] * len(values)), values, strict=True)]
    return {k: np.array([float(x) for x in v]) for k, v in out.items()}


def _three(own: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    return [own, _shifted(own, doc, 1), _shifted(own, doc, -1)]


def _moments(own, length, sizes, quality) -> dict:
    """Per label: documents, and over them the sums of their lines' mean features and squares."""
    doc, out = np.repeat(np.arange(len(sizes)), sizes), {}
    starts = np.cumsum(sizes) - sizes
    x = np.concatenate(_three(own.astype(float), doc), axis=1)
    both = np.concatenate([np.add.reduceat(x, starts), np.add.reduceat(x * x, starts)], axis=1) / sizes[:, None]
    fixed = np.rint(both * _COARSE).astype(np.int64)
    for q in (0, 1):
        mine = quality == q
        out[str(q)] = [int(mine.sum()), *fixed[mine].sum(axis=0).tolist()]
    return out


def _gradient(model: dict, share: dict[int, float]):
    """The gradient's sums: features times residuals, residuals, observed less expected pairs."""

    def run(own, length, sizes, quality) -> dict:
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        unary = unary_scores([own], doc, model)
        ahead, back = messages(unary, sizes, model["trans"])
        of = np.where(quality == 1, share[1], share[0]) / sizes
        left = (quality[doc] - _sigmoid(ahead + back)) * of[doc]
        x = np.concatenate([v * left[:, None] for v in _three(own.astype(float), doc)] + [left[:, None]], axis=1)
        per = np.add.reduceat(x, starts)
        at, pairs = _pair_marginals(unary, sizes, model["trans"], ahead, back)
        moved = np.stack([-np.bincount(doc[at], p, len(sizes)) for p in pairs], axis=1)
        moved[np.arange(len(sizes)), np.where(quality == 1, 3, 0)] += sizes - 1
        return {"g": np.rint(np.concatenate([per, moved * of[:, None]], axis=1) * _FINE).astype(np.int64).sum(axis=0).tolist()}

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[dict | None, float]:
    """The model and the share of label 1; no model unless both labels occur."""
    table = _feature_table(training_rows(docs, labels, sample), 8)
    sums = _summed(_gathered(table, _moments))
    n = {q: int(sums[str(q)][0]) if str(q) in sums else 0 for q in (0, 1)}
    prior = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if not n[0] or not n[1]:
        dropped(table)
        return None, prior
    moments = (sums["0"][1:] / n[0] + sums["1"][1:] / n[1]) / 2 / _COARSE
    mean = moments[: 3 * _N]
    scale = np.sqrt(np.maximum(moments[3 * _N :] - mean**2, 0))
    scale[scale < 1e-6] = 1
    share = {q: 0.5 / n[q] for q in (0, 1)}  # each label weighs as much, each of its documents as much
    model = {"mean": mean, "scale": scale, "weights": np.zeros(3 * _N + 1), "trans": np.zeros((2, 2))}
    theta = np.zeros(3 * _N + 5)
    step, old = np.full(len(theta), 0.1), np.zeros(len(theta))
    for _ in range(rounds):
        g = _summed(_gathered(table, _gradient(model, share)))["g"] / _FINE
        left = g[3 * _N]
        grad = np.concatenate([(g[: 3 * _N] - mean * left) / scale, [left], g[3 * _N + 1 :]]) - penalty * theta
        turn = np.sign(grad) * np.sign(old)
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-4, 0.5)
        grad = np.where(turn < 0, 0, grad)
        theta = theta + np.sign(grad) * step
        theta[-4:] = np.clip(theta[-4:], -3, 3)
        old = grad
        model = model | {"weights": theta[: 3 * _N + 1], "trans": theta[3 * _N + 1 :].reshape(2, 2)}

    def raw(own, length, sizes, quality) -> dict:
        doc = np.repeat(np.arange(len(sizes)), sizes)
        r = _mean_marginal(unary_scores([own], doc, model), sizes, length, model["trans"])
        found, counts = np.unique(np.stack([np.rint(r * _FINE).astype(np.int64), quality.astype(np.int64)]), axis=1, return_counts=True)
        return {f"{q},{v}": [int(c)] for (v, q), c in zip(found.T.tolist(), counts, strict=True)}

    # one number a training document: the bounded sample's raw qualities
    seen = sorted((int(v), int(q)) for part in _gathered(table, raw) for key, (c,) in part.items() for q, v in [key.split(",")] for _ in range(c))
    dropped(table)
    r = np.clip(np.array([v for v, _ in seen]) / _FINE, 1e-6, 1 - 1e-6)
    model["slope"], model["shift"] = _calibrated(np.log(r / (1 - r)), np.array([q for _, q in seen]))
    return model, prior


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small penalty."""
    a, b = 0.5, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((y - p) * x).sum() - 0.1 * a, (y - p).sum() - 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    return max(a, 0.0), b


def held_out():
    """True for the rows that never teach: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: dict | None, prior: float = 0.5) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches):
        for batch in batches:
            i = 0
            for part in _slices(batch.column(1)):
                if model is None:
                    p = np.full(len(part), prior)
                else:
                    raw = np.clip(raw_quality(part, model), 1e-6, 1 - 1e-6)
                    p = 1 / (1 + np.exp(-(model["slope"] * np.log(raw / (1 - raw)) + model["shift"])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(p)], names=["doc_id", "score"])
                i += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model, prior = fit(docs, labels, sample)
    return score(docs, model, prior).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_crf_quality(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
