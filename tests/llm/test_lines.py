import random
import re

import numpy as np
import pyarrow as pa

from stagelight.llm import lines as L
from stagelight.llm.lines import dedup_lines

from .helpers import prose


def words(line):
    return [w for w in re.split("[\\x09-\\x0D ]+", line.lower()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(docs, min_words=5, near_words=10):
    lines = [(i, k, words(x)) for i, t in docs for k, x in enumerate((t or "").split("\n"))]
    gone = set()
    for i, k, w in lines:
        for j, m, v in lines:
            if (j, m) < (i, k) and len(w) >= min_words and (w == v or (len(w) >= near_words <= len(v) and distance(w, v) <= 1)):
                gone.add((i, k))
                break
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def edited(line, r):
    w = line.split()
    i = r.randrange(len(w))
    return " ".join(r.choice([w[:i] + w[i + 1 :], w[:i] + ["new"] + w[i:], w[:i] + ["other"] + w[i + 1 :], [*w, "last"], w[1:]]))


def test_equals_brute_force(spark):
    r = random.Random(3)
    base = prose(8, 1, 12) + prose(4, 2, 9) + prose(3, 4, 11) + ["a a a a a a a a a a a", "a a a a a a a a a a"]
    docs = []
    for i in range(60):
        lines = [r.choice([x, x.upper(), edited(x, r), edited(edited(x, r), r), "", "short line"]) for x in r.choices(base, k=6)]
        docs.append((i, "\n".join(lines)))
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(docs)


def test_many_copies_keep_one(spark):
    line = " ".join(f"w{i}" for i in range(20))
    docs = [(i, line.replace("w7", f"x{i}")) for i in range(500)] + [(i, line) for i in range(500, 900)]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=True).where("text <> ''").collect()
    assert [(x.doc_id, x.n_lines, x.n_dropped) for x in got] == [(0, 1, 0)]


def test_odd_rows(odd, empty):
    got = dedup_lines(odd)
    assert got.columns == odd.columns and dedup_lines(empty).count() == 0
    by = {}
    for x in got.collect():
        by.setdefault(x.doc_id, []).append(x.text)
    assert len(got.collect()) == odd.count()
    assert by[0] == [None] and by[1] == [""] and by[8] == ["", "", ""] and sorted(by[None], key=str)[0] is None
    assert by[20] == ["same text here for all of us to see"] and by[21] == [""] and len(by[5][0]) > 200_000
    left = dedup_lines(odd, drop_emptied=True).collect()
    assert sum(x.doc_id == 8 for x in left) == 0 and sum(x.doc_id == 1 for x in left) == 1 and not any(x.doc_id == 21 for x in left)


def test_rows_with_one_id_or_none_lose_lines_of_their_own_text_only(spark):
    again, alone = "one two three four five six", ["a b c d e f g", "h i j k l m n"]
    docs = [(1, again), (2, again), (2, alone[0]), (None, "u v w x y z\n" + alone[1]), (None, "p q r s t u\nu v w x y z")]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(1, again), (2, ""), (2, alone[0]), (None, "u v w x y z\n" + alone[1]), (None, "p q r s t u")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_memory_of_a_task_stays_small():
    """A task's arrays over texts of 8 MB, slice by slice, as line_rows holds them; 200 MB and more with slices of 4 MB."""
    import tracemalloc

    texts = pa.array([f"{i} " + "a few words of a line and some more\n" * 500 for i in range(450)], pa.binary())
    tracemalloc.start()
    lines = 0
    for _, part in L.slices(texts, L.SLICE):
        x = L.Lines(part)
        lines += len(x.halves(np.flatnonzero(x.count >= 5))[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 450 * 500 and peak < 120e6
