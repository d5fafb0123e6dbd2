import re

import pytest

from stagelight.llm import licenses as L


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    places = [(k, label) for p, label in L.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = ["CC BY cc by-nc", "the GNU General Public License, all rights reserved", "all rights reserved all rights reserved", "", None, "occ by", "cc\nby é cc", "a " * 9 + "cc by " * 5]


def test_places_equal_brute_force(spark):
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(("expression", "want"), [
    ("MIT", ({"mit"}, 0)), ("GPL-3.0-only OR MIT", ({"gpl-3.0-only", "mit"}, 0)), ("GPL-3.0-only AND MIT", ({"gpl-3.0-only", "mit"}, 2)),
    ("MIT OR GPL-2.0 AND AGPL-3.0", ({"mit", "gpl-2.0", "agpl-3.0"}, 0)), ("(MIT OR GPL-2.0) AND MPL-2.0", ({"mit", "gpl-2.0", "mpl-2.0"}, 1)),
    ("GPL-2.0 WITH Classpath-exception-2.0", ({"gpl-2.0-with-classpath-exception-2.0"}, 1)), ("", None), ("OR", None), ("MIT OR", None), ("((MIT", ({"mit"}, 0)), ("MIT and some words", ({"mit", "some"}, 2)),
])
def test_expressions(expression, want):
    assert L.evaluate(expression) == want


def test_tags_and_odd_rows(spark, odd, empty):
    d = spark.createDataFrame([(0, "x\n// SPDX-License-Identifier: (MIT OR Apache-2.0)\ny")], "doc_id long, text string")
    r = L.scan_licenses(d).first()
    assert r.labels == "apache-2.0,mit" and r.n_tags == 1 and r.strictness == 0 and r.base_labels == ""
    assert L.scan_licenses(odd).count() == odd.count() and L.scan_licenses(empty).count() == 0
