"""Rows that every operator of the subpackage must take, and small texts."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, key long, h long, row long, items string, held_out string, _gone string, spans int"
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(40_000)) + "\n" + "x" * 150_000


def odd_rows():
    """NULLs in any column, empty and very long texts, repeated rows, characters beyond ASCII, clashing column names."""
    rest = ("en", "s", 1, 0.5, 1, 1, 1, 1, "i", "h", "g", 1)
    texts = [None, "", " ", "\n\n", "a", LONG, "▁ ▁▁x  y", "日本語テキスト 𝒳 naïve\u0000é", "one two three four five six seven eight nine ten eleven"]
    rows = [(i, t, *rest) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, texts[8], *rest), (None, None, *[None] * 12), (20, "same text here for all of us to see", *rest), (21, "same text here for all of us to see", *rest)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def prose(n, seed=0, words=120, vocabulary=400):
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(lexicon) for _ in range(words)) for _ in range(n)]
