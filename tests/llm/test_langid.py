import os

import numpy as np
import pytest

from stagelight.llm import langid as L
from stagelight.llm.pieces import lattice, load
from stagelight.llm.queries import PIECES, op3

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no vocabulary file")


def test_forward_and_counts_equal_sums_over_all_segmentations():
    v = load(PIECES)
    p = L.first_guess(v)
    ids = {v.pieces[i]: i for i in v.of_key.tolist()}

    def paths(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest in paths(s[k:]):
                    yield [ids[s[:k]], *rest]

    for word in (b" the", b" abel", b" t"):
        flat = L.words_of([word[1:]])
        all_paths = list(paths(word))
        want = sum(np.prod([p[i] for i in x]) for x in all_paths)
        ((_, _, found, unknown),) = lattice(flat, np.array([0]), v)
        assert np.isclose(L.forward(found, unknown, p[:, None])[-1, 0, 0], want)
        counts = np.zeros(len(v.pieces))
        for i, c in L.expected(found, unknown, p, np.array([[2.0]])):
            np.add.at(counts, i, c[:, 0])
        by_hand = np.zeros(len(v.pieces))
        for x in all_paths:
            for i in x:
                by_hand[i] += 2 * np.prod([p[j] for j in x]) / want
        assert np.allclose(counts, by_hand)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op3(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, empty):
    model = L.train(odd, PIECES)
    by = {r.doc_id: r for r in L.predict(odd, model).collect()}
    assert by[0].lang_pred == by[1].lang_pred == by[3].lang_pred == "und" and by[5].lang_pred == "en" and L.predict(odd, model).count() == odd.count()
    none = L.train(empty, PIECES)
    assert {r.lang_pred for r in L.predict(odd, none).collect()} == {"und"} and L.predict(empty, none).count() == 0
