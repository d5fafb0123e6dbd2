"""SentencePiece encoding and decoding by batched Viterbi over the words of a slice.

Every distinct word of a slice is segmented once. Words of equal length advance together: for each piece length the hashes
of all their substrings probe the sorted piece keys, and one maximum over the lengths per position gives the backpointers.
Texts are worked on as bytes with a blank as one byte, so a piece's length is its length in bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import BYTE, INVERSE, mix, picked, powers, prefix, slices, span_hash

#: Stand-ins that UTF-8 never holds: a blank (the vocabulary's U+2581) and a literal U+2581 of the text.
BLANK, MARK = 0xFE, 0xFF
META = "▁".encode()
#: Types of pieces in the model file; fixed values.
NORMAL, UNKNOWN, USER, BYTES = 1, 2, 4, 6
#: A run of bytes without a blank or line break is segmented in stretches of at most so many bytes.
LONGEST_WORD = 1 << 16
BUCKET_BITS = 20
#: Words whose pieces a task remembers.
REMEMBERED = 1 << 20
SLICE = 1 << 22


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def number():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + n]
            i += n


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model file; `keys` are sorted hashes of the pieces that text may match, `of_key` their ids."""

    pieces: tuple[bytes, ...]
    scores: np.ndarray
    keys: np.ndarray
    of_key: np.ndarray
    lengths: tuple[int, ...]
    byte_id: np.ndarray
    bucket: np.ndarray
    deepest: int
    unknown: float

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash; -1 where no piece has it. The first BUCKET_BITS bits say where in the sorted keys to look."""
        out = np.full(h.shape, -1, np.int32)
        at = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32).ravel()
        at = self.bucket[at]
        full = np.flatnonzero(at >= 0)
        x, at = h.ravel()[full], at[full]
        for j in range(self.deepest):
            k = np.minimum(at + j, len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[k] == x)
            out.ravel()[full[hit]] = self.of_key[k[hit]]
        return out


def hash_of(piece: bytes) -> int:
    p = prefix(BYTE[np.frombuffer(piece, np.uint8)])
    return int(span_hash(p, np.array([0]), np.array([len(piece)]))[0])


def load(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model file with byte fallback."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds = [], [], []
    for number, message in fields(data):
        if number == 1:
            m = dict(fields(message))
            pieces.append(m[1])
            scores.append(struct.unpack("<f", m[2])[0])
            kinds.append(m.get(3, NORMAL))
    byte_id = np.full(256, -1, np.int32)
    normal = []
    for i, (p, kind) in enumerate(zip(pieces, kinds)):
        if kind == BYTES:
            byte_id[int(p[1:-1], 16)] = i
        elif kind in (NORMAL, USER):
            normal.append((hash_of(p.replace(META, bytes([BLANK]))), i))
    normal.sort()
    if (byte_id < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    if any(bytes([BLANK]) in pieces[i].replace(META, bytes([BLANK])).lstrip(bytes([BLANK])) or b"\n" in pieces[i] for _, i in normal):
        raise ValueError("a piece holds a blank after other characters or a line break: words can't be cut there")
    keys = np.array([h for h, _ in normal], np.uint64)
    top = (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    bucket = np.full(1 << BUCKET_BITS, -1, np.int32)
    bucket[top[::-1]] = np.arange(len(keys))[::-1]
    own = [pieces[i] if kinds[i] != BYTES else bytes([int(pieces[i][1:-1], 16)]) for i in range(len(pieces))]
    own = [p.replace(META, b" ") if k in (NORMAL, USER) else p if k == BYTES else b"" for p, k in zip(own, kinds)]
    return Vocabulary(
        tuple(own), np.array(scores), keys, np.array([i for _, i in normal], np.int32), tuple(sorted({len(pieces[i].replace(META, b" ")) for _, i in normal})),
        byte_id, bucket, int(np.bincount(top).max()), min(scores[i] for _, i in normal) - 10)


class Flat:
    """The words of some encoded texts: where they start and end in `buf`, their hashes and how many each text has."""

    def __init__(self, texts: list[bytes], longest: int = LONGEST_WORD):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        size = len(self.buf)
        offset = np.concatenate(([0], np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))))
        first = np.zeros(size + 1, bool)
        if size:
            blank, line = self.buf == BLANK, self.buf == 10
            first[1:size] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
        first[offset] = True
        start = np.flatnonzero(first[:size])
        start = self._cut(start, np.append(start[1:], size), longest)
        self.start, self.end = start, np.append(start[1:], size)
        self.count = np.diff(np.searchsorted(start, offset))
        self.prefix = prefix(BYTE[self.buf])
        self.hash = mix(span_hash(self.prefix, self.start, self.end)) if len(start) else np.zeros(0, np.uint64)

    def _cut(self, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
        """Further starts inside words of more than `longest` bytes, at beginnings of characters."""
        more = [start]
        for i in np.flatnonzero(end - start > longest):
            at = int(start[i]) + longest
            while at < end[i]:
                while self.buf[at] & 0xC0 == 0x80:
                    at -= 1
                more.append([at])
                at += longest
        return np.unique(np.concatenate(more)) if len(more) > 1 else start


def lattice(flat: Flat, words: np.ndarray, v: Vocabulary, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]]:
    """Groups of equally long words: (words, bytes W x L, [(length, ids W x (L - length + 1))], length of an unknown character W x L).

    The last is 0 inside characters and where a piece of one character stands.
    """
    length = flat.end[words] - flat.start[words]
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(length[order]) > 0, [True])))
    for a, z in zip(edges[:-1], edges[1:]):
        n = int(length[order[a]])
        step = max(1, cells // n)
        for b in range(a, z, step):
            group = words[order[b : min(z, b + step)]]
            at = flat.start[group][:, None] + np.arange(n)
            chars = flat.buf[at]
            sums = np.concatenate((flat.prefix[at], flat.prefix[at[:, -1:] + 1]), axis=1)
            scale = powers(len(flat.prefix), INVERSE)[at]
            found = [(k, v.find((sums[:, k:] - sums[:, :-k]) * scale[:, : n - k + 1])) for k in v.lengths if k <= n]
            # characters by their first byte; the stand-ins are characters of one byte
            width = np.where(chars < 0x80, 1, np.where(chars < 0xC0, 0, np.where(chars < 0xE0, 2, np.where(chars < 0xF0, 3, np.where(chars < 0xF8, 4, 1)))))
            width = np.minimum(width, n - np.arange(n))
            for k, ids in found:
                if k <= 4:
                    hit = (ids >= 0) & (width[:, : n - k + 1] == k)
                    width[:, : n - k + 1][hit] = 0
            yield group, chars, found, width


def viterbi(chars: np.ndarray, found: list[tuple[int, np.ndarray]], unknown: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, id) of the best pieces of each word, -length for an unknown character; of equal paths the longer last piece wins."""
    w, n = chars.shape
    best = np.full((n + 1, w), -np.inf)
    best[0] = 0
    back = np.zeros((n + 1, w), np.int32)  # piece length, negative for unknown
    known = [(k, np.where(ids >= 0, v.scores[ids], -np.inf)) for k, ids in reversed(found) if (ids >= 0).any()]
    odd = [k for k in (4, 3, 2, 1) if (unknown == k).any()]
    for t in range(1, n + 1):
        top, choice = best[t], back[t]
        for k, s in known:
            if k <= t:
                x = best[t - k] + s[:, t - k]
                better = x > top
                top[better] = x[better]
                choice[better] = k
        for k in odd:
            if k <= t:
                x = np.where(unknown[:, t - k] == k, best[t - k] + v.unknown, -np.inf)
                better = x > top
                top[better] = x[better]
                choice[better] = -k
    by_length = dict(found)
    rows, starts, ids = [], [], []
    pos, live = np.full(w, n), np.arange(w)
    while len(live):
        k = back[pos[live], live]
        pos[live] -= np.abs(k)
        rows.append(live)
        starts.append(pos[live].copy())
        piece = k.copy()
        for size in np.flatnonzero(np.bincount(k[k > 0])):
            m = k == size
            piece[m] = by_length[int(size)][live[m], pos[live[m]]]
        ids.append(piece)
        live = live[pos[live] > 0]
    rows, starts, ids = (np.concatenate(x) for x in (rows, starts, ids))
    order = np.lexsort((starts, rows))
    return rows[order], starts[order], ids[order]


def repeat_spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + count[0] - 1, begin[1] .. and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def marked(text: bytes) -> bytes:
    """A text as the vocabulary sees it: a blank before it, blanks and a literal U+2581 as stand-ins; '' stays empty."""
    return bytes([BLANK]) + text.replace(META, bytes([MARK])).replace(b" ", bytes([BLANK])) if text else b""


def segment(flat: Flat, words: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words one after another, number of ids of each word)."""
    rank = np.zeros(len(flat.start), np.int64)
    rank[words] = np.arange(len(words))
    word, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for group, chars, found, unknown in lattice(flat, words, v):
        r, s, i = viterbi(chars, found, unknown, v)
        if (i < 0).any():  # unknown characters become their bytes, the stand-in for U+2581 its three bytes
            size = np.where(i < 0, -i, 1)
            at = repeat_spans(s, size)
            r, i = np.repeat(r, size), np.repeat(i, size)
            b = chars[r, at]
            size = np.where((i < 0) & (b == MARK), 3, 1)
            k = repeat_spans(np.zeros(len(size), np.int64), size)
            r, i, b = np.repeat(r, size), np.repeat(i, size), np.repeat(b, size)
            i = np.where(i >= 0, i, np.where(b == MARK, v.byte_id[np.frombuffer(META, np.uint8)[k]], v.byte_id[b]))
        word.append(rank[group][r])
        ids.append(i)
    word, ids = np.concatenate(word), np.concatenate(ids)
    by_word = np.argsort(word, kind="stable")  # the pieces of a word already follow each other
    return ids[by_word].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes slices and remembers the pieces of the words it has met, up to REMEMBERED of them."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self):
        self.hash, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        flat = Flat([marked(t) for t in texts])
        if not len(flat.start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        u, first, inverse = np.unique(flat.hash, return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > REMEMBERED:
            self._forget()
        known = np.zeros(len(u), bool)
        if len(self.hash):
            known = self.hash[np.minimum(np.searchsorted(self.hash, u), len(self.hash) - 1)] == u
        ids, size = segment(flat, first[~known], self.v)
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))
        self.hash = np.concatenate((self.hash, u[~known]))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.begin, self.size = self.hash[order], self.begin[order], self.size[order]
        at = np.searchsorted(self.hash, u)[inverse]
        size = self.size[at]
        out = self.ids[repeat_spans(self.begin[at], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        return out, np.diff(ends[np.concatenate(([0], np.cumsum(flat.count)))])


class Decoder:
    """Bytes of the pieces as one array, for joining the pieces of many ids at once."""

    def __init__(self, v: Vocabulary):
        self.size = np.fromiter((len(p) for p in v.pieces), np.int64, len(v.pieces))
        self.begin = np.cumsum(self.size) - self.size
        self.buf = np.frombuffer(b"".join(v.pieces), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, without the blank that encoding puts first."""
        size = self.size[ids]
        joined = self.buf[repeat_spans(self.begin[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return [joined[a + 1 : z] if z > a and joined[a] == 32 else joined[a:z] for a, z in zip(ends.tolist(), ends[1:].tolist())]


ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded_bytes long, decoded_sha256 string, lossless boolean"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and what decoding them gives: doc_id, n_tokens, ids, decoded_bytes, decoded_sha256, lossless.

    NULL and empty texts have no ids and decode to ''. A literal U+2581 is kept by its bytes, so every text comes back. Of
    equally good segmentations the one with the longer last piece counts; a run without blank and line break beyond
    LONGEST_WORD bytes is segmented in stretches. Repeated rows give repeated rows; other columns are not read.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))  # some MB, whatever the input

    def run(batches):
        v = vocabulary.value
        decoder, encoder = Decoder(v), Encoder(v)
        for b in batches:
            for first, texts in slices(b.column(1), SLICE):
                ids, counts = encoder.encode(texts)
                back = decoder.decode(ids, counts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.array([len(t) for t in back], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array([t == o for t, o in zip(back, texts)]),
                ], names=["doc_id", "n_tokens", "ids", "decoded_bytes", "decoded_sha256", "lossless"])

    return picked(docs, doc_id=docs[id_col].cast("long"), text=text_col).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; NULL ids give NULL, bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary fail."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        decoder = Decoder(vocabulary.value)
        for b in batches:
            lists = b.column(1)
            counts = np.fromiter((len(x) if x is not None else 0 for x in lists.to_pylist()), np.int64, len(lists))
            texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            text = [t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return picked(encoded, doc_id=encoded[id_col].cast("long"), ids=encoded[ids_col].cast("array<int>")).mapInArrow(run, "doc_id long, text string")
