import random

from stagelight.llm import toxicity as X

from .helpers import prose


def sample(n, seed):
    r = random.Random(seed)
    rows = []
    for i, t in enumerate(prose(n, 9 + seed, 60)):
        w = t.split()
        if i % 3 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vexgrum", "qozzlewump", "yurkblath"]))
        rows.append((" ".join(w), int(i % 3 == 0)))
    return rows


def test_planted_words_are_found():
    m = X.fit(sample(400, 0))
    a, b = X.compressor(m.ordinary), X.compressor(m.toxic)
    right = sum((sum(f * w for f, w in zip(X.features(X.normal(t), a, b, m.window), m.weights)) >= 0) == bool(y) for t, y in sample(90, 1))
    assert right >= 82


def test_words_that_ordinary_rows_hold_too_but_less_often_are_found():
    """A stem in a tenth of the ordinary rows once, in the toxic rows of one language several times."""

    def rows(n, seed):
        r, out = random.Random(seed), []
        for i, t in enumerate(prose(n, 20 + seed, 80)):
            w = t.split()
            for _ in range(4 if i % 5 == 0 else i % 10 == 1):
                w.insert(r.randrange(len(w)), "achlich" + r.choice(w))
            out.append((" ".join(w), int(i % 5 == 0)))
        return out

    m = X.fit(rows(800, 0))
    a, b = X.compressor(m.ordinary), X.compressor(m.toxic)
    said = [(y, sum(f * w for f, w in zip(X.features(X.normal(t), a, b, m.window), m.weights)) >= 0) for t, y in rows(200, 1)]
    assert sum(p for y, p in said if y) >= 32 and sum(p for y, p in said if not y) <= 8


def test_windows_cover_the_text():
    for t in (b"", b"abc", b"a" * 500, b" some words and then " * 9):
        assert b"".join(X.windows(t, 48)) == t


def test_odd_rows(spark, odd, empty):
    rows = sample(60, 0)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (7, 0, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    m = X.train(docs, labels)
    got = X.score_toxicity(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and X.score_toxicity(empty, m).count() == 0
    assert X.keep_civil(odd, m).columns == odd.columns
    none = X.train(empty, labels)
    assert {r.predicted for r in X.score_toxicity(odd, none).collect()} == {0}
