import corpus_pipeline as P

from . import test_darts
from .test_decontamination import words

FOLDER = "/root/testdata/sf0.001"


def contaminated(docs, items):
    grams = {(len(g := tuple(w[k : k + 13])), g) for _, t in items if (w := words(t)) for k in range(max(1, len(w) - 12))}
    out = set()
    for i, t in docs.items():
        w = words(t)
        hit = {p for n in {n for n, _ in grams} for k in range(len(w) - n + 1) if (n, tuple(w[k : k + n])) in grams for p in range(k, k + n)}
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def test_stages_keep_what_they_should(spark, tmp_path):
    """Every stage against its rule on its own input: columns stay, classes by all pairs, contamination by brute force."""
    assert len(P.STAGES) == 5
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, states = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, states[-1], FOLDER).write.parquet(f"{tmp_path}/{k}")
        states.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == columns for s in states[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in states]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))
    assert len(rows[1]) > 0.8 * len(rows[0]) and all(rows[1][i] == rows[0][i] for i in rows[1])
    assert all(r.n_chars == len(r.text) and r.text.strip() for r in rows[2].values())
    assert all(set(r.text.split("\n")) <= set(rows[1][i].text.split("\n")) for i, r in rows[2].items())
    same = test_darts.classes([(i, " ".join(words(r.text))) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, c in same.items() if i == c} and all(rows[3][i] == rows[2][i] for i in rows[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = contaminated({i: r.text for i, r in rows[3].items()}, items)
    assert dirty and set(rows[4]) == set(rows[3]) - dirty and all(rows[4][i] == rows[3][i] for i in rows[4])
    assert set(rows[5]) == set(rows[4]) and all(r.lossless and r.decoded_bytes == len(rows[4][i].text.encode()) for i, r in rows[5].items())
