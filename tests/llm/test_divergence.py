import random
import re
from collections import Counter, defaultdict

import pytest

from stagelight.llm import divergence as D

from .helpers import odd_rows


def brute(rows, min_docs, top):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, in plain loops."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(of.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in of.items()}
        for s, c in of.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in of if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdé𝒳") for _ in range(r.randint(1, 3))) for _ in range(90)]
    rows = [(" ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words[: 5 + 17 * (i % 6)]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), f"s{min(int(r.expovariate(0.3)), 6)}") for i in range(300)]
    return rows + [(None, "en", None), ("", "fr", "a"), ("", "fr", "b"), ("once", "only", "x"), *[("same words here", "en", "s0")] * 40]


@pytest.mark.parametrize("side, bucket, top", [(256, 1 << 16, 50), (2, 40, 7), (3, 11, 1)])
def test_parts_equal_brute_force(spark, monkeypatch, texts, side, bucket, top):
    monkeypatch.setattr(D, "SIDE", side)
    monkeypatch.setattr(D, "BUCKET", bucket)
    d = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in texts], "text string, lang string, source string, n long, term string")
    assert result(D.divergence(d, min_docs=4, top=top)) == brute(texts, 4, top)


def test_odd_rows_and_an_empty_table(odd, empty):
    want = brute([(t, lang, source) for _, t, lang, source, *_ in odd_rows()], 2, 50)
    assert result(D.divergence(odd, min_docs=2)) == want and D.divergence(empty).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    rows = [(c, t) for c in (0, 7, 10**11 + 3, 4 * 10**14 + 1) for t in (c + 5, c + 6, 3 * (c + 5) + 1, 8_999_999_999_999_999)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", D.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // r.t for r in got)
