"""Language model scores from a log-frequency Bloom filter.

Spark counts all words and all pairs of words over all training texts. The filter holds each n-gram with the levels 1 .. q
of its quantised count; a reader probes level after level until one is missing. Its part for the commonest words has a
bounded size and goes to the workers by broadcast, as do their exact counts. The part for pairs lies in buckets, which grow in
number with the text; slices of text send their pairs, and their words beyond the commonest, to the buckets and get levels and counts back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.sources.scratch import free_shuffles, scratch_dir

from .text import SPACED, Words, distinct, held_out, mix, picked, slices

#: Hash of the end of a text, which is a token.
END = np.uint64(1)
#: Segments of the words' filter, by the first bits of a word's hash; levels of a doubling of counts; bits set for a level.
SEGMENTS, PER_DOUBLING, PROBES = 1 << 12, 2, 4
DISCOUNT = 0.5
SLICE = 1 << 21
#: Tokens a task counts before it hands its counts on, and pairs.
HELD, HELD_PAIRS = 2_000_000, 500_000
#: log2 of the pairs of words in a bucket, about, and of the number of buckets at least; pieces of a bucket that common first words are cut into.
BUCKET, BUCKETS, PIECES = 20, 8, 8
#: Bits of a bucket for a level.
BITS = 10


@dataclass(frozen=True)
class Sizes:
    """Bounds of what is broadcast: commonest words with exact counts, those with what their pairs add up to, log2 of the bits for words at most."""

    common: int = 1 << 20
    vocabulary: int = 1 << 16
    filter_bits: int = 28


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts with an end after each text, number of tokens of each text)."""
    w = Words(texts, SPACED)
    out = np.empty(len(w.hash) + len(texts), np.uint64)
    out[np.arange(len(w.hash)) + w.row] = w.hash
    out[w.bounds[1:] + np.arange(len(texts))] = END
    return out, w.count + 1


def levels(count: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, PER_DOUBLING more for each doubling."""
    return 1 + np.floor(PER_DOUBLING * np.log2(np.maximum(count, 1)) + 1e-9).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """Smallest count of a level; 0 for level 0."""
    return np.where(q > 0, np.ceil(2.0 ** ((np.maximum(q, 1) - 1) / PER_DOUBLING) - 1e-9), 0.0)


def pair_hash(key: np.ndarray) -> np.ndarray:
    return mix(key + np.uint64(0x5851F42D4C957F2D))


def bits_of(h: np.ndarray, level: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(segment, the PROBES bits within the segment) of a level of an n-gram; a segment has 2^width bits, width at most 16."""
    x = mix(h + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64((1 << width) - 1)
    return (h >> np.uint64(52)).astype(np.int64), [((x >> np.uint64(16 * i)) & mask).astype(np.int64) for i in range(PROBES)]


class Filter:
    """Packed bits, SEGMENTS x 2^width; no n-gram has more than `deepest` levels."""

    def __init__(self, data: np.ndarray, width: int, deepest: int):
        self.data, self.width, self.deepest = data, width, deepest

    def places(self, h: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        segment, bits = bits_of(h, level, self.width)
        return [(segment << self.width) + b for b in bits]

    def has(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        live = np.arange(len(h))
        for place in self.places(h, level):
            at = place[live]
            live = live[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[live] = True
        return out

    def quantised(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram: probes 1, 2, .. until one is missing."""
        q, live = np.zeros(len(h), np.int64), np.arange(len(h))
        for level in range(1, self.deepest + 1):
            live = live[self.has(h[live], np.full(len(live), level))]
            if not len(live):
                break
            q[live] = level
        return q


class Bucket(Filter):
    """Packed bits of one bucket, as many as its levels need."""

    def __init__(self, data: np.ndarray, deepest: int):
        self.data, self.deepest = data, deepest

    @classmethod
    def of(cls, h: np.ndarray, q: np.ndarray) -> Bucket:
        """The bucket with all levels of n-grams by their hashes and highest levels."""
        new = cls(np.zeros(max(8, int(q.sum()) * BITS // 8), np.uint8), int(q.max(initial=0)))
        bits = np.zeros(len(new.data) * 8, bool)
        for level in range(1, new.deepest + 1):
            h, q = h[q >= level], q[q >= level]
            for at in new.places(h, np.full(len(h), level)):
                bits[at] = True
        new.data = np.packbits(bits, bitorder="little")
        return new

    def places(self, h: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
        x = mix(h + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        low, step, size = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1), np.uint64(len(self.data) * 8)
        return [((low + np.uint64(i) * step) % size).astype(np.int64) for i in range(PROBES)]


@dataclass(frozen=True)
class Model:
    """What the workers get, all of bounded size, and the folders of the pairs' buckets and of the counts of all words."""

    n: int
    v: int
    total: float
    common_hash: np.ndarray
    common_count: np.ndarray
    words: np.ndarray
    followers: np.ndarray
    seen: np.ndarray
    bits: np.ndarray
    width: int
    deepest: int
    buckets: int
    pairs: str
    counts: str

    def dealer(self) -> Dealer:
        return Dealer.of(self.words, self.followers, self.n, self.buckets)


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def gathered(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(arrays), return_counts=True)


def emit(keys: np.ndarray, hashes: np.ndarray, n: np.ndarray):
    for i in range(0, len(keys), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array((hashes[s] >> np.uint64(52)).astype(np.int32)), as_long(keys[s]), pa.array(n[s], pa.int64())], names=["segment", "key", "n"])


def count_words(batches):
    held, size = [], 0
    for b in batches:
        for _, texts in slices(b.column(0), SLICE):
            t, _ = tokens(texts)
            held.append(t)
            size += len(t)
            if size >= HELD:
                u, n = gathered(held)
                yield from emit(u, u, n)
                held, size = [], 0
    if held:
        u, n = gathered(held)
        yield from emit(u, u, n)


def summed(rows: DataFrame, folder: str) -> DataFrame:
    """Counts over all tasks, by segment, written once: a segment lies in one file of the table."""
    rows.repartition("segment").groupBy("segment", "key").agg(F.sum("n").alias("n")).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def histogram(counts: DataFrame) -> dict[int, int]:
    """Number of n-grams by the bit length of their counts, less one."""
    return {r.b: r.n for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("b")).agg(F.count("*").alias("n")).collect()}


def least_count(by_length: dict[int, int], room: int, weight=lambda b: 1) -> int:
    """Smallest power of two such that the n-grams of that count or more fit in the room."""
    used, least = 0, 1 << 62
    for b in sorted(by_length, reverse=True):
        used += by_length[b] * weight(b)
        if used > room:
            break
        least = 1 << b
    return least


def build_filter(counts: DataFrame, width: int) -> np.ndarray:
    """Bits of all levels of the words of a table of counts."""
    size = 1 << width - 3

    def run(batches):
        data, touched, held = np.zeros(SEGMENTS * size, np.uint8), np.zeros(SEGMENTS, bool), []

        def apply():
            at = distinct(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], at[1:] >> 3 != at[:-1] >> 3)))
            data[at[first] >> 3] |= np.add.reduceat(np.left_shift(1, at & 7), first).astype(np.uint8)
            touched[distinct(at >> width)] = True
            held.clear()

        for b in batches:
            h, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            q = levels(n)
            for level in range(1, int(q.max(initial=0)) + 1):
                h, q = h[q >= level], q[q >= level]
                segment, bits = bits_of(h, np.full(len(h), level), width)
                held += [(segment << width) + x for x in bits]
            if sum(map(len, held)) > 4_000_000:
                apply()
        if held:
            apply()
        for s in np.flatnonzero(touched):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data[s * size : (s + 1) * size].tobytes()], pa.binary())], names=["segment", "bits"])

    out = np.zeros(SEGMENTS * size, np.uint8)
    for r in counts.select("key", "n").mapInArrow(run, "segment int, bits binary").collect():
        out[r.segment * size : (r.segment + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return out


def places(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places in the sorted `words`, -1 if absent."""
    if not len(words):
        return np.full(len(x), -1)
    k = np.minimum(np.searchsorted(words, x), len(words) - 1)
    return np.where(words[k] == x, k, -1)


@dataclass(frozen=True)
class Dealer:
    """Deals pairs to 2^buckets buckets: by the first word, and the commonest first words in parts, so that no word fills a bucket."""

    words: np.ndarray
    parts: np.ndarray
    buckets: int

    @classmethod
    def of(cls, words: np.ndarray, followers: np.ndarray, n: int, buckets: int) -> Dealer:
        return cls(words, (1 + followers // max(1, (n >> buckets) // PIECES)).astype(np.uint64), buckets)

    @property
    def shift(self) -> int:
        """The place of a first word stands above so many bits of a key, below its highest."""
        return 63 - max(1, len(self.words).bit_length())

    def keys(self, place: np.ndarray, u: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, twice the bucket, plus 1 where the first word is none of `words`) of pairs of the words u at `place`.

        A key has the places of both words, or its highest bit, a place and a hash of the second, or a hash of both; with the first word it stands for the pair.
        """
        own, shift, w = place[first] >= 0, np.uint64(self.shift), u[second]
        spread = mix(w)
        code = np.where(place[second] >= 0, place[second].astype(np.uint64), spread >> np.uint64(64) - shift | np.uint64(1 << 63))
        key = np.where(own, place[first].astype(np.uint64) << shift | code, mix(mix(u[first]) + w * np.uint64(0x9E3779B97F4A7C15)))
        at = np.maximum(place[first], 0)
        if len(self.words):
            dealt = mix(at.astype(np.uint64) << np.uint64(32) | spread % self.parts[at])
        else:
            dealt = np.zeros(len(first), np.uint64)
        return key, (np.where(own, dealt, u[first]) >> np.uint64(64 - self.buckets)).astype(np.int64) * 2 + ~own


class Pairs:
    """The different pairs of a slice, by bucket, kind and key: key, deal, places in `u` of both words, number; `back` is the pair of each token."""

    def __init__(self, u: np.ndarray, at: np.ndarray, count: np.ndarray, dealer: Dealer):
        before = np.empty(len(at), np.int64)
        before[1:] = at[:-1]
        before[np.cumsum(count) - count] = np.searchsorted(u, END)
        pair, back, n = np.unique(before << 32 | at, return_inverse=True, return_counts=True)
        first, second = pair >> 32, pair & 0xFFFFFFFF
        self.place = places(u, dealer.words)
        key, deal = dealer.keys(self.place, u, first, second)
        order = by_deal(key, deal)
        self.key, self.deal, self.first, self.second, self.n = key[order], deal[order], first[order], second[order], n[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.back = rank[back]


def by_deal(key: np.ndarray, deal: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    return order[np.argsort(deal[order].astype(np.uint16 if deal.max(initial=0) < 1 << 16 else np.int64), kind="stable")]


def planes(x: np.ndarray) -> bytes:
    """Eight bytes a value, all first ones first, and the number of values behind them compressed: what waits in a shuffle is small."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) + len(x).to_bytes(4, "little")


def unpacked(b: bytes) -> np.ndarray:
    plain = pa.decompress(b[:-4], 8 * int.from_bytes(b[-4:], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(8, -1).T)


def values_of(column: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    parts = [unpacked(x.as_py()).view(kind).ravel() for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def in_runs(deal: np.ndarray, buckets: int) -> np.ndarray:
    """Where the common and the other first words of each bucket start in sorted deals, and the end."""
    return np.searchsorted(deal, np.arange(2 << buckets | 1))


def binaries(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([planes(x[i:j]) for i, j in zip(start, end)], pa.binary())


DEALT = "bucket int, own binary, own_n binary, rare binary, rare_n binary, firsts binary"
COUNTED = "bucket int, bits binary, deepest int, places binary, place_sums binary, firsts binary, sums binary"


def counted_pairs(texts: DataFrame, dealer: Dealer, folder: str) -> DataFrame:
    """One row a bucket, written once: the bits of its pairs, and what the levels of the pairs add up to for each first word."""
    bc, buckets = texts.sparkSession.sparkContext.broadcast(dealer), dealer.buckets

    def deal(batches):
        held, size = [], 0

        def out():
            key, dealt, first, n = (np.concatenate(x) for x in zip(*held))
            order = by_deal(key, dealt)
            key, dealt, first, n = key[order], dealt[order], first[order], n[order]
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (dealt[1:] != dealt[:-1]))))
            key, dealt, first, n = key[start], dealt[start], first[start], np.add.reduceat(n, start)
            run = in_runs(dealt, buckets)
            live = np.flatnonzero(run[2::2] > run[:-1:2])
            a, b, c = run[2 * live], run[2 * live + 1], run[2 * live + 2]
            for i in range(0, len(live), 256):
                s = slice(i, i + 256)
                yield pa.RecordBatch.from_arrays([pa.array(live[s], pa.int32()), binaries(key, a[s], b[s]), binaries(n, a[s], b[s]), binaries(key, b[s], c[s]), binaries(n, b[s], c[s]), binaries(first, b[s], c[s])], names=[x.split()[0] for x in DEALT.split(", ")])

        for b in batches:
            for _, texts in slices(b.column(0), SLICE):
                t, count = tokens(texts)
                u, at = np.unique(t, return_inverse=True)
                p = Pairs(u, at, count, bc.value)
                held.append((p.key, p.deal, u[p.first], p.n))
                size += len(p.key)
                if size >= HELD_PAIRS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def count(rows):
        found, sums = [], []
        for kind in ("own", "rare"):
            key, start, back = np.unique(values_of(rows[kind]), return_index=True, return_inverse=True)
            q = levels(np.bincount(back, values_of(rows[f"{kind}_n"]), len(key)))
            first = (key & np.uint64((1 << 63) - 1)) >> shift if kind == "own" else values_of(rows["firsts"])[start]
            first, back = np.unique(first, return_inverse=True)
            found.append((pair_hash(key), q))
            sums += [planes(first), planes(np.bincount(back, value(q) - DISCOUNT, len(first)))]
        f = Bucket.of(*(np.concatenate(x) for x in zip(*found)))
        return pa.table([rows["bucket"].slice(0, 1), *[pa.array([x], t) for x, t in ((f.data.tobytes(), pa.binary()), (f.deepest, pa.int32()), *((x, pa.binary()) for x in sums))]], names=[x.split()[0] for x in COUNTED.split(", ")])

    shift = np.uint64(dealer.shift)
    texts.mapInArrow(deal, DEALT).groupBy("bucket").applyInArrow(count, COUNTED).write.parquet(folder)
    return texts.sparkSession.read.schema(COUNTED).parquet(folder)


def train(docs: DataFrame, folder: str | None = None, sizes: Sizes = Sizes(), folds: int = 7, fold: int = 2) -> Model:
    """Counts over every whole text outside the held-out fold, and the filter of all words and pairs.

    The broadcast part of the filter takes words while they fit at about eight bits for a level; the rarest beyond that are looked
    up in their counts. A bucket of pairs has BITS bits for each of its levels.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    own = picked(docs, doc_id="doc_id", text="text").where(~held_out("doc_id", folds, fold)).select("text")
    one = summed(own.mapInArrow(count_words, "segment int, key long, n long"), f"{folder}/words")
    n, v = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    by_length = histogram(one)
    least = least_count(by_length, sizes.common)
    common = one.where(F.col("n") >= least).select("key", "n").toArrow()
    h, c = common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy().astype(np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    words = np.sort(h[np.lexsort((h, -c))[: sizes.vocabulary]])
    followers = c[np.searchsorted(h, words)] if len(words) else np.zeros(0, np.int64)
    buckets = max(BUCKETS, (n >> BUCKET).bit_length())
    pairs = counted_pairs(own, Dealer.of(words, followers, n, buckets), f"{folder}/pairs")
    free_shuffles(spark)
    seen = np.zeros(len(words))
    for r in pairs.select("places", "place_sums").toLocalIterator(prefetchPartitions=True):
        k = values_of([pa.scalar(r.places)]).astype(np.int64)
        seen[k] += values_of([pa.scalar(r.place_sums)], np.float64)
    weight = lambda b: PER_DOUBLING * b + PER_DOUBLING  # noqa: E731  levels of the largest count of that length
    least = least_count(by_length, (1 << sizes.filter_bits) // 8, weight)
    used = sum(m * weight(b) for b, m in by_length.items() if 1 << b >= least)
    width = min(sizes.filter_bits, max(21, int(np.ceil(np.log2(max(1, 8 * used)))))) - 12
    bits = build_filter(one.where(F.col("n") >= least), width)
    # the quantised counts' total, for the share left to single words
    q = 1 + F.floor(PER_DOUBLING * F.log2(F.col("n")) + 1e-9)
    low = F.ceil(F.pow(F.lit(2.0), (q - 1) / PER_DOUBLING) - 1e-9).cast("double")
    total = one.agg(F.coalesce(F.sum(low), F.lit(0.0))).first()[0] + v + 1
    return Model(n, v, total, h, c, words, followers, seen, bits, width, PER_DOUBLING * (max(by_length, default=0) + 1), buckets, f"{folder}/pairs", f"{folder}/words")


SLICED = "slice long, doc_ids array<long>, held_out array<boolean>, counts binary, tokens binary, words binary"
ASKED = "slice long, bucket int, words binary, own binary, rare binary"
ANSWERED = "slice long, bucket int, counts binary, sums binary, levels binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Slice:
    """A slice of texts by its row, with its pairs; `asked` are the places in `u` of the words whose figures don't come with the model."""

    def __init__(self, u: bytes, at: bytes, count: bytes, dealer: Dealer):
        self.u, self.count = np.frombuffer(u, np.uint64), np.frombuffer(count, np.int64)
        self.at = np.frombuffer(at, np.uint16 if len(self.u) <= 1 << 16 else np.uint32).astype(np.int64)
        self.pairs = Pairs(self.u, self.at, self.count, dealer)
        self.asked = np.flatnonzero(self.pairs.place < 0)


def score(docs: DataFrame, model: Model, folder: str | None = None, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row and whole text; NULL is empty.

    `score` is the sum over tokens of log10 of the discounted share of (word before, word), both counts from the filter,
    plus the share that is left times (count + 1) / (sum of counts + V + 1). `base_score` is exact. Each slice of texts asks the
    buckets for the levels of its pairs and for the figures of words that don't come with the model. Repeated rows give repeated
    rows; a NULL id is a training row.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    bc, dealt, buckets = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(model.dealer()), model.buckets
    own = picked(docs, doc_id=docs["doc_id"].cast("long"), held_out=held_out("doc_id", folds, fold), text="text", part=F.spark_partition_id())
    named = lambda schema, columns: pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    def cut(batches):
        number = None
        for b in batches:
            if number is None and b.num_rows:
                number = b.column(3)[0].as_py() << 40
            for start, texts in slices(b.column(2), SLICE):
                t, count = tokens(texts)
                u, at = np.unique(t, return_inverse=True)
                small = at.astype(np.uint16 if len(u) <= 1 << 16 else np.uint32)
                lists = [pa.array([b.column(i).slice(start, len(texts)).to_pylist()], pa.list_(kind)) for i, kind in ((0, pa.int64()), (1, pa.bool_()))]
                yield named(SLICED, [pa.array([number]), *lists, *[pa.array([x.tobytes()], pa.binary()) for x in (count.astype(np.int64), small, u)]])
                number += 1

    def ask(batches):
        for b in batches:
            for number, u, at, count in zip(*b.columns):
                s = Slice(u.as_py(), at.as_py(), count.as_py(), dealt.value)
                words = s.u[s.asked]
                w = np.append(np.searchsorted(words, np.arange(1 << buckets, dtype=np.uint64) << np.uint64(64 - buckets)), len(words))
                run = in_runs(s.pairs.deal, buckets)
                live = np.flatnonzero((run[2::2] > run[:-1:2]) | (w[1:] > w[:-1]))
                x, y, z = run[2 * live], run[2 * live + 1], run[2 * live + 2]
                yield named(ASKED, [pa.array(np.full(len(live), number.as_py())), pa.array(live, pa.int32()), binaries(words, w[live], w[live + 1]), binaries(s.pairs.key, x, y), binaries(s.pairs.key, y, z)])

    def answer(asked, known):
        if not asked.num_rows:
            return pa.table([asked["slice"], asked["bucket"], *[pa.array([], pa.binary())] * 3], names=[x.split()[0] for x in ANSWERED.split(", ")])
        bits, counts = known.filter(known["bits"].is_valid()), known.filter(known["key"].is_valid())
        f = Bucket(np.frombuffer(bits["bits"][0].as_py(), np.uint8), bits["deepest"][0].as_py()) if bits.num_rows else Bucket(np.zeros(8, np.uint8), 0)
        firsts, totals = values_of(bits["firsts"]), values_of(bits["sums"], np.float64)
        key, n = counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        of = lambda x, key, v: np.where((k := places(x, key)) >= 0, v[k], 0) if len(key) else np.zeros(len(x), v.dtype)
        size = {c: np.array([int.from_bytes(x.as_py()[-4:], "little") for x in asked[c]]) for c in ("words", "own", "rare")}
        split = lambda x, size: np.split(x, np.cumsum(size)[:-1])
        words = values_of(asked["words"])
        n, totals = (split(x, size["words"]) for x in (of(words, key, n), of(words, firsts, totals)))
        own, rare = (split(f.quantised(pair_hash(values_of(asked[c]))).astype(np.uint8), size[c]) for c in ("own", "rare"))
        out = [[planes(x) for x in n], [planes(x) for x in totals], [x.tobytes() + y.tobytes() for x, y in zip(own, rare)]]
        return pa.table([asked["slice"], asked["bucket"], *[pa.array(x, pa.binary()) for x in out]], names=[x.split()[0] for x in ANSWERED.split(", ")])

    def finish(texts, answers):
        m, row, answers = bc.value, texts.slice(0, 1).to_pylist()[0], answers.sort_by("bucket")
        s = Slice(row["words"], row["tokens"], row["counts"], m.dealer())
        q, count, text = s.pairs, s.count, np.repeat(np.arange(len(s.count)), s.count)
        # followers of each word, what its pairs add up to, and its level, which the filter has for the commonest
        followers, seen, has = np.zeros(len(s.u), np.int64), np.zeros(len(s.u)), np.flatnonzero(q.place >= 0)
        followers[has], seen[has] = m.followers[q.place[has]], m.seen[q.place[has]]
        followers[s.asked], seen[s.asked] = values_of(answers["counts"], np.int64), values_of(answers["sums"], np.float64)
        level = Filter(m.bits, m.width, m.deepest).quantised(s.u)
        level = np.where((level == 0) & (followers > 0), levels(followers), level)
        single = (value(level) + 1) / m.total
        f = followers[q.first]
        left = np.where(f > 0, 1 - np.minimum(seen[q.first] / np.maximum(f, 1), 1 - 1e-6), 1.0)
        c = value(np.frombuffer(b"".join(answers["levels"].to_pylist()), np.uint8).astype(np.int64))
        p = left * single[q.second] + np.where(f > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(f, 1), 0.0)
        total = np.bincount(text, np.log10(np.minimum(p, 1.0))[q.back], len(count))
        k = places(s.u, m.common_hash)
        exact = np.where(k >= 0, m.common_count[k], 0) if len(m.common_hash) else np.zeros(len(s.u), np.int64)
        exact[s.asked] = followers[s.asked]
        known = np.bincount(text, (exact > 0)[s.at], len(count)).astype(np.int64)
        base = np.bincount(text, np.log10(exact + 1.0)[s.at], len(count)) - count * np.log10(m.n + m.v + 1)
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(count), pa.array(known), pa.array(np.full(len(count), m.n)), pa.array(base), pa.array(total)], names=[x.split()[0] for x in SCORED.split(", ")])

    own.mapInArrow(cut, SLICED).write.parquet(f"{folder}/sliced")  # the numbers of the slices hold for this table
    sliced = spark.read.schema(SLICED).parquet(f"{folder}/sliced")
    asked = sliced.select("slice", "words", "tokens", "counts").mapInArrow(ask, ASKED)
    pairs = spark.read.schema(COUNTED).parquet(model.pairs).select("bucket", "bits", "deepest", "firsts", "sums")
    counts = spark.read.parquet(model.counts).select(F.shiftrightunsigned("key", 64 - buckets).cast("int").alias("bucket"), "key", "n")
    known = pairs.unionByName(counts, allowMissingColumns=True)
    asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, ANSWERED).write.parquet(f"{folder}/answers")
    free_shuffles(spark)
    answers = spark.read.schema(ANSWERED).parquet(f"{folder}/answers")
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, SCORED)
