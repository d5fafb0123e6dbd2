import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagelight.llm import fim as M

from .helpers import odd_rows


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by plain string operations."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, z = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.output_sha256, r.restored_sha256) for r in df.collect()), key=repr)
    want = [(i, *brute(i, t), t or "") for i, t in rows]
    assert got == sorted(((*w, sha(w[5]), sha(w[6])) for w in want), key=repr)


def test_odd_rows(odd, empty):
    check(M.fill_in_middle_texts(odd), [r[:2] for r in odd_rows()])
    assert M.fill_in_middle_texts(empty).count() == 0


@pytest.mark.parametrize("frame, shard", [(3, 500), (17, 1), (1 << 14, 1 << 24)])
def test_frames_of_any_size(spark, tmp_path, frame, shard):
    """Tasks see other constants through a module that is changed there; small frames cut words, characters and marks."""
    r = random.Random(frame)
    texts = ["".join(r.choice(["word", "A", "é", "𝒳", " ", "<", "P", "S>", ">", "\n", "\0", "1"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "x" * 400, "<M>", "<P", "é" * 50, "<<P>>"]
    rows = list(enumerate(texts, -3))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def small(batches_of):
        def run(batches):
            from stagelight.llm import fim  # the worker's own module, set back for its next task

            was = fim.FRAME, fim.SHARD, fim.AHEAD
            fim.FRAME, fim.SHARD, fim.AHEAD = frame, shard, 5
            try:
                yield from batches_of(batches)
            finally:
                fim.FRAME, fim.SHARD, fim.AHEAD = was

        return run

    was = type(d).mapInArrow
    try:
        type(d).mapInArrow = lambda self, fn, schema, *a: was(self, small(fn), schema, *a)
        check(M.fill_in_middle_texts(d), rows)
    finally:
        type(d).mapInArrow = was


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB<>PSM é𝒳1", max_size=40), st.integers(1, 9))
def test_counts_and_marks_in_pieces(text, size):
    data = text.encode()
    pieces = [data[i : i + size] for i in range(0, len(data), size)]
    units, chars, inside, n, c = M.counted(pieces)
    assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and c == len(text) and len(units) == len(chars) == len(inside) == len(pieces)
    found = list(M.marks_in(pieces, (M.PREFIX, M.SUFFIX, M.MIDDLE)))
    assert found == [(m.start(), m.group()) for m in re.finditer(b"<[PSM]>", data)]
    assert b"".join(M.reframed(pieces)) == data


def test_text_ids(spark):
    rows = [("a", "some words here"), ("007", "x y z " * 9), (None, "nothing known")]
    check(M.fill_in_middle_texts(spark.createDataFrame(rows, "doc_id string, text string")), rows)


def test_a_wrong_form_is_found():
    with pytest.raises(ValueError):
        M.restored_ranges("psm", 9, [(0, M.SUFFIX), (3, M.PREFIX), (6, M.MIDDLE)])
