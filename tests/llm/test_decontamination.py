import hashlib
import random
import re

from stagelight.llm import decontamination as C

from .helpers import prose


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def brute(docs, items, n=13):
    windows = [(str(i), tuple(w[k : k + n])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - n + 1))]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
        ids = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_equals_brute_force_whatever_the_blocks(spark):
    r = random.Random(2)
    lexicon = ["a", "b", "ab", "Ab", "c9", "é"]
    make = lambda k: " ".join(r.choice(lexicon) for _ in range(k))
    items = [(i, make(r.choice([1, 3, 5, 12, 13, 14, 30]))) for i in range(12)] + [(12, "a a a a a a a a a a a a a a a a"), (13, ""), (14, None), (14, "b b b b")]
    docs = [(i, f"{make(r.randint(0, 40))}. {r.choice(items)[1]}, {make(r.randint(0, 40))}") for i in range(80)] + [(80, None), (81, ""), (82, "a " * 60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 20):
        assert sorted(map(tuple, C.contamination(d, b, block_words=block).collect())) == sorted(brute(docs, items))


def test_removal(spark):
    item = prose(1, 1, 20)[0]
    other = prose(1, 2, 30)[0]
    d = spark.createDataFrame([(0, f"{other}\n{item}. {other}", "x"), (1, other, "y"), (2, None, "z")], "doc_id long, text string, keep0 string")
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in C.decontaminate(d, b).collect()) == [1, 2] and C.decontaminate(d, b).columns == d.columns
    got = {r.doc_id: r.text for r in C.decontaminate(d, b, remove="spans").collect()}
    assert got[1] == other and got[2] is None and item not in got[0] and got[0].startswith(other) and got[0].endswith(other)


def test_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven twelve thirteen"), (1, "same text here")], "item_id long, text string")
    got = C.contamination(odd, b).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.contaminated} == {20, 21}
    assert C.contamination(empty, b).count() == 0 and C.decontaminate(odd, b).columns == odd.columns
    assert not any(r.n_hit for r in C.contamination(odd, b.limit(0)).collect())
