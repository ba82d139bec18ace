"""Byte-level BPE over whole Arrow columns.

The words that the vocabulary's pattern cuts are found with array operations on the code points of a whole batch; each
distinct word is encoded once and the ids are gathered. The ids are those of the tokenizers file (the tests compare them);
the end-of-text mark written as characters is one id, as that library reads it, and parts a text in two. Texts of more than
SLICE bytes are encoded piece by piece, cut where a word is sure to begin, so a text needs some fifty times SLICE and four
times its own size (a text without blanks can't be cut, and needs some fifty times its size).
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "<|endoftext|>"
#: Bytes of a batch that are cut at once.
SLICE = 4_000_000
_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 4, 0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _pieces(path: str):
    """The function from a word's bytes to its ids: merges in rank order, as the vocabulary file lists them."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {}
    for word, number in model["vocab"].items():
        if word != MARK:
            ranks[bytes(byte_of[c] for c in word)] = number
    enc = tiktoken.Encoding("words", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    return enc._core_bpe.encode_single_piece if hasattr(enc._core_bpe, "encode_single_piece") else enc._encode_single_piece


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern's words start in code points; ends are the ends of the texts, ascending, the last one len(points)."""
    n = len(points)
    kind = _classes()[points]
    begins = np.zeros(n + 1, bool)  # of a text
    begins[0] = True
    begins[ends] = True
    begins = begins[:n]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= begins
    space = kind == _SPACE
    after = np.zeros(n, bool)  # something else than white space follows in the same text
    after[:-1] = ~space[1:] & ~begins[1:]
    tail = np.flatnonzero(space & after)  # the last one of a run of white space that a word follows
    start[tail] = True
    joined = tail[points[tail] == 32]
    start[joined + 1] = False
    # contractions: an apostrophe that starts a word on its own, then s t m d or re ve ll
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~begins[quote + 1]]
    if len(quote):
        c1 = points[quote + 1]
        one = np.isin(c1, [115, 116, 109, 100])
        two = np.zeros(len(quote), bool)
        far = quote + 2 < n
        q2 = quote[far]
        c2 = points[q2 + 2]
        same = ~begins[q2 + 2]
        a = points[q2 + 1]
        two[far] = same & (((a == 114) & (c2 == 101)) | ((a == 118) & (c2 == 101)) | ((a == 108) & (c2 == 108)))
        hit = one | two
        start[quote[hit] + 1] = False
        stop = quote[hit] + np.where(one[hit], 2, 3)
        stop = stop[stop < n]
        start[stop[kind[stop] == _LETTER]] = True
        # 'slt: only the letters past the contraction begin a word; anything else begins one by its class
    return np.flatnonzero(start)


class Encoder:
    """Encodes Arrow string arrays; keeps the ids of words met before, up to a bound."""

    def __init__(self, path: str, most_words: int = 300_000):
        self.path, self.most = path, most_words
        self.piece, self.known = _pieces(path), {}

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known, piece = self.known, self.piece
        if len(known) > self.most:
            known.clear()
        found = []
        for w in words.to_pylist():
            ids = known.get(w)
            if ids is None:
                ids = known[w] = tuple(piece(w))
            found.append(ids)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return lens, np.fromiter(chain.from_iterable(found), np.uint16, int(lens.sum()))

    def _slice(self, texts: pa.Array, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not len(data):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint16)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)  # the byte where each code point starts
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = np.searchsorted(at, offsets[1:])
        starts = word_starts(points, ends)
        bounds = np.append(at[starts], len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        lens, flat = self._word_ids(coded.dictionary)
        per_word = lens[codes]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        first = np.searchsorted(starts, np.concatenate([[0], ends]))
        counts = np.diff(upto[first])
        if not with_ids:
            return counts, None
        begin = np.cumsum(lens) - lens
        gather = np.repeat(begin[codes] - upto[:-1], per_word) + np.arange(upto[-1])
        return counts, flat[gather]

    def _one(self, text: str, with_ids: bool) -> tuple[int, np.ndarray | None]:
        """A text that holds the mark, or is long: its number of ids, and these."""
        total, found = 0, []
        for k, part in enumerate(text.split(MARK)):
            if k:
                total += 1
                found.append(np.array([_mark_id(self.path)], np.uint16))
            raw = part.encode()
            for a, b in pieces(raw):
                counts, ids = self._slice(pa.array([raw[a:b].decode()], pa.large_string()), with_ids)
                total += int(counts[0])
                found.append(ids)
        return total, np.concatenate(found) if with_ids else None

    def encode(self, texts: pa.Array, with_ids: bool = True):
        """Yields (number of texts, ids per text, all their ids one after the other or None) for slices of the texts.

        Null texts have no ids.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        alone = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) | (size > SLICE)
        i, n = 0, len(texts)
        upto = np.cumsum(size)
        while i < n:
            if alone[i]:
                count, ids = self._one(texts[i].as_py(), with_ids)
                yield 1, np.array([count]), ids
                i += 1
                continue
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE, side="right"))
            j = min(max(j, i + 1), n)
            if (m := alone[i:j]).any():
                j = i + int(m.argmax())
            counts, ids = self._slice(texts.slice(i, j - i), with_ids)
            yield j - i, counts, ids
            i = j


@cache
def _mark_id(path: str) -> int:
    return _library(path).token_to_id(MARK)


def pieces(raw: bytes, step: int | None = None):
    """(begin, end) of pieces of some step bytes each: a cut lies before a single blank between two visible ASCII characters,
    where the vocabulary's pattern always begins a word."""
    step = step or SLICE
    data = np.frombuffer(raw, np.uint8)
    begin = 0
    while len(data) - begin > step:
        at = begin + step
        cut = -1
        while at + 1 < len(data):
            part = data[at - 1 : at + 65_537]
            ok = (part[1:-1] == 32) & (part[:-2] > 32) & (part[:-2] < 127) & (part[2:] > 32) & (part[2:] < 127)
            if ok.any():
                cut = at + int(ok.argmax())
                break
            at += 65_536
        if cut < 0:
            break
        yield begin, cut
        begin = cut
    yield begin, len(data)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)
