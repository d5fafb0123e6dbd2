import random
from collections import Counter
from itertools import product

import numpy as np

from stagelight.llm import darts as D

from .helpers import prose


def shingle_counts(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(docs, weighted=False):
    """Components of pairs with similarity 0.8 or more, by all pairs."""
    sets = {i: shingle_counts(t or "") for i, t in docs}
    if not weighted:
        sets = {i: Counter(dict.fromkeys(s, 1)) for i, s in sets.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                    a, b = sorted((top(i), top(j)))
                    up[b] = a
    return {i: top(i) for i in sets}


def copies(base, n, edits, r):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_classes_equal_all_pairs(spark):
    r = random.Random(5)
    base = prose(6, 3, 150)
    docs = list(enumerate([t for b in base for t in [*copies(b, 9, 3, r), b, b]] + prose(30, 8, 60) + ["one two", "one two", "one three", "", None, "a b c d e"]))
    r.shuffle(docs)
    got = {x.doc_id: x.class_id for x in D.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == classes(docs)


def test_a_large_group_of_near_copies_is_whole(spark):
    r = random.Random(6)
    base = prose(1, 4, 160)[0]
    docs = list(enumerate([*copies(base, 160, 4, r), *prose(20, 12, 80)]))
    got = {x.doc_id: x.class_id for x in D.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == classes(docs)


def test_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    row = np.repeat([0, 1], 300)
    s = D.signatures(2, row, np.concatenate((h, h)), np.concatenate((a, b)), 2000)
    assert (s != 0).all() and abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    # a text's signature does not depend on the texts beside it
    assert (D.signatures(1, row[:300], h, a, 2000)[0] == s[0]).all()


def test_odd_rows(odd, empty):
    got = D.near_groups(odd).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add(x.class_id)
    assert len(got) == odd.count() and by[20] == by[21] == {20} and by[8] == {8} and by[None] == {8, None} and by[0] == {0} and by[1] == {1}
    kept = D.keep_one(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.select("doc_id").collect() if x.doc_id is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 20]
    assert D.near_groups(empty).count() == 0


def test_rows_with_one_id_or_none_go_for_their_own_text_only(spark):
    same, a, b, c = prose(4, 31, 40)
    docs = [(1, same), (2, same), (2, a), (None, same), (None, b), (None, c), (None, None), (None, "")]
    got = D.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, same), *docs[2:3], *docs[4:]], key=str)


def family(n, template, own, shared, seed):
    """n texts around a template of words; texts 2k and 2k + 1 have `shared` of their `own` further words in common."""
    r = random.Random(seed)
    base = [f"t{i}" for i in range(template)]
    out = []
    for _ in range(n // 2):
        both = [f"b{r.randrange(10**9)}" for _ in range(shared)]
        out += [" ".join(base + both + [f"o{r.randrange(10**9)}" for _ in range(own - shared)]) for _ in range(2)]
    return list(enumerate(out))


def test_no_pair_of_a_family_just_below_the_threshold_is_lost(spark):
    # 196 shingles of the template, 28 own ones: 196 / 252 = 0.78; a pair with 4 of them in common has 200 / 248 = 0.81
    docs = family(1200, 200, 28, 4, 7)
    got = {x.doc_id: x.class_id for x in D.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i] == i - i % 2 for i in got) >= 0.995 * len(got) and all(got[i] in (i, i - 1) for i in got)


def test_texts_of_common_shingles_only_are_compared(spark):
    # every passage stands in more than BUCKET texts, so no shingle is rare
    r = random.Random(8)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(24)]
    docs = [(i, " ".join(passages[k] for k in sorted(r.sample(range(24), 11)))) for i in range(260)]
    got = {x.doc_id: x.class_id for x in D.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == classes(docs)


def test_weighted_classes_equal_all_pairs(spark):
    r = random.Random(9)
    base = [f"{a} {' '.join(['again and again the same words'] * r.randint(1, 9))}" for a in prose(8, 10, 60)]
    docs = list(enumerate([t for b in base for t in copies(b, 6, 3, r)]))
    got = {x.doc_id: x.class_id for x in D.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), weighted=True).collect()}
    assert got == classes(docs, True)


def test_a_family_of_common_shingles_is_put_together_before_all_pairs(spark, monkeypatch):
    """512 texts of 20 blocks, 9 of which have two wordings: one class by texts that differ in one block; 4,596 pairs were left to compare at last."""
    block = lambda i, v: " ".join(f"w{v}x{i}x{j}" for j in range(10))
    docs = list(enumerate(" ".join(block(i, v[i // 2] if i < 18 and i % 2 == 0 else 0) for i in range(20)) for v in product((0, 1), repeat=9)))
    compared, verified = [], D.verified
    monkeypatch.setattr(D, "verified", lambda pairs, *a: (compared.append(pairs.count()), verified(pairs, *a))[1])
    got = D.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x.class_id for x in got} == {0} and max(compared) <= 2 * len(docs) and compared[-1] <= len(docs)


def test_turns_end_when_they_put_nothing_together(spark, monkeypatch):
    """A family below the threshold: no turn links its texts to a node of their bucket, so the first of each kind is the last (there were 4 to 6)."""
    docs, turns, heads = family(200, 200, 28, 4, 7), [], D.heads
    monkeypatch.setattr(D, "heads", lambda placed, turn: (turns.append(turn), heads(placed, turn))[1])
    got = {x.doc_id: x.class_id for x in D.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert len(turns) <= 2 and got == classes(docs)


def test_signing_a_slice_takes_little_memory():
    """The arrays beside a slice of texts, in each Python worker."""
    import tracemalloc

    import pyarrow as pa

    r, peak = random.Random(3), 0
    texts = pa.array([" ".join(f"w{r.randrange(10**4)}" for _ in range(200)) for _ in range(2000)])
    for _, held in D.slices(texts, D.SLICE):
        tracemalloc.start()
        row, h, weight = D.elements(held, False)
        D.signed(len(held), row, h, weight, 120)
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak < 35e6, peak
