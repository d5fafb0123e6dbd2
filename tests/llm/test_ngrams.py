import collections
import math
import re
import zlib

import numpy as np

from stagelight.llm import ngrams as G

from .helpers import odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(s):
    return [*re.findall("[^\\x20\\x09-\\x0D]+", (s or "").translate(LOWER)), None]


def check(rows, docs, sizes):
    m = G.train(docs, sizes=sizes)
    got = G.score(docs, m).collect()
    c = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, held(i), len(x := tokens(t)), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 4)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    return m, got


def test_base_score_is_exact_with_and_without_the_join(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for sizes in (G.Sizes(), G.Sizes(common=50, vocabulary=40, filter_bits=20)):
        m, got = check(rows, docs, sizes)
        assert len(m.common_hash) <= sizes.common and len(m.bits) * 8 <= 1 << sizes.filter_bits
    held = [r for r in G.score(docs, G.train(docs)).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd, empty):
    check([r[:2] for r in odd_rows()], odd, G.Sizes())
    m = G.train(empty)
    assert G.score(empty, m).count() == 0 and {r.n_known for r in G.score(odd, m).collect()} == {0}


def test_filter_gives_the_levels_back():
    h = np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    n = np.arange(4000) % 60 + 1
    f = G.Filter(np.zeros(G.SEGMENTS << 6, np.uint8), 9, 20)
    for level in range(1, int(G.levels(n).max()) + 1):
        s, bits = G.bits_of(h[G.levels(n) >= level], np.full((G.levels(n) >= level).sum(), level), 9)
        for b in bits:
            at = (s << 9) + b
            np.bitwise_or.at(f.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    q = f.quantised(h)
    assert (q >= G.levels(n)).all() and (q == G.levels(n)).mean() > 0.9
    assert (G.value(G.levels(n)) <= n).all() and (G.value(G.levels(n)) * 1.5 >= n).all()


def test_the_score_is_a_distribution_over_known_words(spark):
    """Shares of all words after one history, and the rest for unseen words, add up to about one."""
    docs = spark.createDataFrame([(i, f"a b{i % 9} c d{i % 5} a b{i % 3}") for i in range(80)], "doc_id long, text string")
    m = G.train(docs)
    vocabulary = [w.encode() for w in ["a", "c", *(f"b{i}" for i in range(9)), *(f"d{i}" for i in range(5))]]
    probe = spark.createDataFrame([(i, w.decode()) for i, w in enumerate(vocabulary)] + [(99, "")], "doc_id long, text string")
    one = {r.doc_id: r.score for r in G.score(probe, m).collect()}
    f = G.Filter(m.bits, m.width, m.deepest)
    h = np.array([G.Words([w], G.SPACED).hash[0] for w in vocabulary] + [G.END])
    single = (G.value(f.quantised(h)) + 1) / m.total
    assert abs(single.sum() + 1 / m.total - 1) < 0.02
    assert all(s < 0 for s in one.values())


def test_every_pair_and_word_counts_whatever_the_bounds(spark):
    """Scores against a model with all counts at hand; a filter loses nothing and rarely gives a level too many, but for tiny segments."""
    rows = [*enumerate(prose(60)), (60, None), (None, "a b c"), (61, "never seen before")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, two = collections.Counter(), collections.Counter()
    pairs = lambda t: [*zip([None, *t[:-1]], t)]
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(tokens(t))
            two.update(pairs(tokens(t)))
    low = lambda n: float(G.value(G.levels(np.array([n])))[0]) if n else 0.0
    total, seen = sum(map(low, one.values())) + len(one) + 1, collections.Counter()
    for (b, _), n in two.items():
        seen[b] += low(n) - G.DISCOUNT

    def share(b, w):
        p = (low(one[w]) + 1) / total
        return p if not one[b] else (1 - min(seen[b] / one[b], 1 - 1e-6)) * p + max(low(two[b, w]) - G.DISCOUNT, 0) / one[b]

    want = sorted(sum(math.log10(min(share(*x), 1)) for x in pairs(tokens(t))) for _, t in rows)
    for sizes in (G.Sizes(), G.Sizes(common=50, vocabulary=40, filter_bits=20), G.Sizes(common=1, vocabulary=1, filter_bits=16)):
        got = sorted(r.score for r in G.score(docs, G.train(docs, sizes=sizes)).collect())
        off = np.array(got) - want
        assert len(got) == len(want) and off.min() > -1e-6 and (sizes.filter_bits < 20 or off.mean() < -0.005 * np.mean(want))
