"""Toxicity by compression distance: windows of a text are compressed with an ordinary and with a toxic zstandard dictionary.

The ordinary dictionary is trained on windows of ordinary text. The toxic one has the same content after the fragments
that stand in toxic rows, once or several times, oftener than chance allows, so both compress ordinary words alike and the
difference in length is what toxic fragments save. A logistic fit over the counts of windows above several differences
calibrates the score, so a fragment that ordinary rows hold once and toxic rows several times still tells.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import picked, record_batch, remainder

#: Savings in bytes from which a window counts; each gives one feature.
SAVINGS = (1, 2, 3, 4, 5, 6)
GAP = re.compile(rb"[\x00-\x20]+")
#: Ends both dictionaries and every window; without it short windows are stored raw, which hides what is saved.
TAIL = bytes(range(1, 32))
#: Numbers of occurrences in a row from which the row counts for a fragment.
LEVELS = (1, 2, 3)


@dataclass(frozen=True)
class Model:
    """Dictionary contents, window length and the weights of 1, log(1 + windows), log(1 + windows above each saving)."""

    ordinary: bytes
    toxic: bytes
    window: int
    weights: tuple[float, ...]


def normal(text: str | None) -> bytes:
    return GAP.sub(b" ", b" " + (text or "").lower().encode() + b" ")


def windows(text: bytes, n: int) -> list[bytes]:
    """Whole words in windows of n bytes and the rest of the last word; a word beyond n more bytes is cut."""
    out, i, size = [], 0, len(text)
    while i < size:
        j = min(size, i + n)
        if j < size and (k := text.find(b" ", j, j + n)) >= 0:
            j = k
        out.append(text[i:j])
        i = j
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters.from_level(
        3, window_log=17, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def features(text: bytes, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, n: int) -> list[float]:
    a, b, parts = ordinary.compress, toxic.compress, windows(text, n)
    saved = np.fromiter((len(a(w + TAIL)) - len(b(w + TAIL)) for w in parts), np.int64, len(parts))
    return [1.0, np.log1p(len(parts)), *(np.log1p((saved >= k).sum()) for k in SAVINGS)]


def pieces_of(word: bytes, k: int) -> list[bytes]:
    return [word[i : i + k] for i in range(len(word) - k + 1)]


def framed(text: bytes) -> list[bytes]:
    return [b" " + w.strip(b".,;:!?") + b" " for w in text.split()]


def rows_with(texts: list[bytes], parts) -> list[Counter]:
    """For each of LEVELS, how many texts hold a part in so many of their words; parts: distinct parts of a word."""
    out = [Counter() for _ in LEVELS]
    for t in texts:
        n = Counter(p for w in framed(t) for p in parts(w))
        for c, level in zip(out, LEVELS):
            c.update(p for p, v in n.items() if v >= level)
    return out


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """Twice the log likelihood ratio of shares a / n and b / m against one common share."""
    p = (a + b) / (n + m)
    return 2 * sum(x * np.log(x / q) for x, q in ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p))) if x)


def evidence(toxic: list[bytes], ordinary: list[bytes], parts, least: float, ratio: float, sure: float, share: float) -> dict[bytes, float]:
    """The likelihood ratio of the parts that mark toxic texts, at the level where it is largest.

    A part does at `least` and `ratio` times as large a share of toxic texts, or at `sure` times with `share` of them.
    """
    found = rows_with(toxic, parts)
    names = {p for p, v in found[0].items() if v >= 3}
    other = rows_with(ordinary, lambda w: [p for p in parts(w) if p in names])
    n, m, out = len(toxic), len(ordinary), {}
    for k, (x, y) in enumerate(zip(found, other)):
        for p, a in x.items():
            times = a * (m + 1) / ((y[p] + 1) * n)
            if a >= 3 and times >= ratio:
                g = likelihood_ratio(a, n, y[p], m)
                if g >= least or (k == 0 and times >= sure and a >= share * n):
                    out[p] = max(g, out.get(p, 0.0))
    return out


def toxic_fragments(toxic: list[bytes], ordinary: list[bytes], size: int, k: int = 5, least: float = 25, ratio: float = 6, sure: float = 30, share: float = 0.01) -> tuple[bytes, set[bytes]]:
    """The commonest fragments of words with k-byte pieces that mark toxic texts, and these pieces.

    A fragment spans a word's pieces and goes on as long as what it spans keeps half of its evidence.
    """
    rich = evidence(toxic, ordinary, lambda w: set(pieces_of(w, k)), least, ratio, sure, share)

    def spans(w):
        ok = [i for i, p in enumerate(pieces_of(w, k)) if p in rich]
        return [w[ok[0] : j] for j in range(ok[-1] + k, len(w) + 1)] if ok else []

    longer = evidence(toxic, ordinary, spans, least, ratio, sure, share)
    found: Counter = Counter()
    for t in toxic:
        for w in framed(t):
            if choice := spans(w):
                f = choice[0]
                for x in choice:
                    if x in longer and longer[x] >= 0.5 * longer.get(f, 0.0):
                        f = x
                found[f] += 1
    out = b""
    for f, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if len(out) + len(f) > size:
            break
        if f not in out:
            out = f + out
    return out, set(rich)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[str, int]], window: int = 48, ordinary_size: int = 32768, toxic_size: int = 2048) -> Model:
    """Dictionaries from half of the distinct texts, weights from the other half; without both labels every score is the toxic share."""
    rows = list(dict.fromkeys(rows))
    texts = [[normal(t) for t, y in rows if y == label] for label in (0, 1)]
    if not texts[0] or not texts[1]:
        p = min(max(len(texts[1]) / max(1, len(rows)), 1e-6), 1 - 1e-6)
        return Model(b"", b"", window, (float(np.log(p / (1 - p))), 0.0, *[0.0] * len(SAVINGS)))
    build = [t[::2] or t for t in texts]
    calibrate = [t[1::2] or t for t in texts]
    fragments, rich = toxic_fragments(build[1], build[0], toxic_size)
    samples = [w for t in build[0] for w in windows(t, window)]
    samples = [w for w in samples if rich.isdisjoint(pieces_of(w, 5))] or samples  # what marks toxic text is no ordinary content
    step = max(1, len(samples) // 60000)
    try:
        ordinary = zstandard.train_dictionary(ordinary_size, samples[::step], k=64, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text for training: the text itself
        ordinary = b"".join(samples)[:ordinary_size]
    ordinary += TAIL
    toxic = fragments + ordinary  # what both share lies equally near to a window
    a, b = compressor(ordinary), compressor(toxic)
    x = np.array([features(t, a, b, window) for label in (0, 1) for t in calibrate[label]])
    y = np.array([label for label in (0, 1) for _ in calibrate[label]], float)
    return Model(ordinary, toxic, window, tuple(logistic(x, y).tolist()))


def labelled(docs: DataFrame, labels: DataFrame, n_toxic: int, n_ordinary: int, max_chars: int, folds: int, fold: int) -> list[tuple[str, int]]:
    """A bounded sample, the same at every run: of each label the rows outside the held-out fold with the smallest id hashes."""
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder("doc_id", folds) != fold)
    rank = F.xxhash64(F.col("doc_id"), F.lit(41))
    own = picked(docs, doc_id="doc_id", text="text").where(F.length("text").between(1, max_chars))
    rows: list[tuple[str, int]] = []
    for label, n in ((0, n_ordinary), (1, n_toxic)):
        # ids are chosen before texts are fetched, so no shuffle carries texts; labels may name absent rows
        chosen = y.where(F.col("toxic") == label).withColumn("rank", rank).orderBy("rank", "doc_id").limit(n).select("doc_id")
        found = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(n)
        rows += [(r.text, label) for r in found.collect()]
    return rows


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = 2000, n_ordinary: int = 4000, max_chars: int = 8000, folds: int = 5, fold: int = 0) -> Model:
    """Fit on at most n_toxic + n_ordinary labelled rows of at most max_chars characters, none of the held-out fold."""
    return fit(labelled(docs, labels, n_toxic, n_ordinary, max_chars, folds, fold))


def score_udf(model):
    """Column function from text to score; `model` is a broadcast Model, so the dictionaries (bounded) go to each worker once."""

    @F.pandas_udf("double")
    def score(texts):
        m = model.value
        if not m.ordinary:
            return texts.map(lambda t: 1 / (1 + np.exp(-m.weights[0])))
        a, b, w = compressor(m.ordinary), compressor(m.toxic), np.array(m.weights)
        z = np.array([features(normal(t), a, b, m.window) @ w for t in texts])
        return texts.__class__(1 / (1 + np.exp(-np.clip(z, -30, 30))), index=texts.index)

    return score


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score in 0 to 1 and predicted (1 from 0.5) for every row and whole text.

    NULL and empty texts are scored as one empty window. Repeated rows give repeated rows; a NULL id is never held out;
    only doc_id and text are read.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)
    out = picked(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce(remainder("doc_id", folds) == fold, F.lit(False)).alias("held_out"), score_udf(bc)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The input's rows and columns without texts that score 0.5 or more."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return docs.where(score_udf(bc)(docs["text"]) < 0.5)
