import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stagelight.llm.text import ALNUM, SPACED, Words, distinct, prefix, slices, span_hash, word_hash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_equal_the_patterns(texts):
    for table, pattern in ((ALNUM, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), (SPACED, "[^\\x20\\x09-\\x0D]+")):
        w = Words([t.encode() for t in texts], table)
        want = [re.findall(pattern, t.translate(LOWER)) for t in texts]
        assert w.count.tolist() == [len(x) for x in want]
        assert [w.word(i).decode() for i in range(len(w.start))] == [x for y in want for x in y]
        assert [int(h) for h in w.hash] == [word_hash(x.encode()) for y in want for x in y]


def test_equal_spans_have_equal_hashes():
    v = np.array([3, 5, 7, 3, 5, 7, 9], np.uint64)
    p = prefix(v)
    a, b = span_hash(p, np.array([0, 3, 1]), np.array([3, 6, 4]))[:2]
    assert a == b and len(set(span_hash(p, np.array([0, 1, 3]), np.array([3, 4, 7])).tolist())) == 3


def test_slices_cover_all_rows_once():
    col = pa.array(["a" * 10, None, "", "b" * 50, "c"])
    got = list(slices(col, 12))
    assert [t for _, x in got for t in x] == [b"a" * 10, b"", b"", b"b" * 50, b"c"] and [f for f, _ in got][0] == 0
    assert distinct(np.array([3, 1, 3])).tolist() == [1, 3] and not len(distinct(np.array([])))
