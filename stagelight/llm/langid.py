"""Language ID by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

Each language has a probability for every piece. A word's probability is the sum over all its segmentations, computed by
the forward algorithm for all languages at once; the probabilities are expected piece counts of training words, weighted by
forward-backward over all segmentations. Words of equal length advance together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import BLANK, Flat, Vocabulary, lattice, load
from .text import held_out, picked, slices

#: Words are cut to stretches of so many bytes, which keeps the products of probabilities in range.
LONGEST = 32
#: Probability of a character that is no piece.
ODD = 1e-9


def _letters() -> bytes:
    return bytes(b if 97 <= b <= 122 or b >= 128 else BLANK for b in range(256))


#: Lower-case text to words: everything in ASCII that is no letter becomes the blank's stand-in.
LETTERS = _letters()
SLICE = 1 << 21


def words_of(texts: list[bytes]) -> Flat:
    return Flat([(b" " + t).translate(LETTERS) for t in texts], LONGEST)


def forward(found, unknown: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of each prefix of each word for each language: (length + 1) x W x languages. p: pieces x languages, last row for odd characters."""
    w, n = unknown.shape
    alpha = np.zeros((n + 1, w, p.shape[1]))
    alpha[0] = 1
    used = [(k, ids) for k, ids in found if (ids >= 0).any()]
    odd = [k for k in (1, 2, 3, 4) if (unknown == k).any()]
    for t in range(1, n + 1):
        for k, ids in used:
            if k <= t:
                at = np.flatnonzero(ids[:, t - k] >= 0)
                if len(at):
                    alpha[t][at] += alpha[t - k][at] * p[ids[at, t - k]]
        for k in odd:
            if k <= t:
                at = np.flatnonzero(unknown[:, t - k] == k)
                alpha[t][at] += alpha[t - k][at] * ODD
    return alpha


def expected(found, unknown: np.ndarray, p: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(piece ids, expected counts x languages) of words under one distribution p, weighted by their counts per language."""
    alpha = forward(found, unknown, p[:, None])[:, :, 0]
    w, n = unknown.shape
    beta = np.zeros((n + 1, w))
    beta[n] = 1
    odd = [k for k in (1, 2, 3, 4) if (unknown == k).any()]
    for t in range(n - 1, -1, -1):
        for k, ids in found:
            if t + k <= n:
                i = ids[:, t]
                beta[t] += np.where(i >= 0, p[i], 0) * beta[t + k]
        for k in odd:
            if t + k <= n:
                beta[t] += np.where(unknown[:, t] == k, ODD, 0) * beta[t + k]
    total = np.maximum(alpha[n], 1e-300)
    out = []
    for k, ids in found:
        r, s = np.nonzero(ids >= 0)
        if len(r):
            i = ids[r, s]
            share = alpha[s, r] * p[i] * beta[s + k, r] / total[r]
            out.append((i, share[:, None] * weight[r]))
    return out


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    languages: tuple[str, ...]
    log_prior: np.ndarray
    probability: np.ndarray


def first_guess(v: Vocabulary) -> np.ndarray:
    """Piece probabilities that fall with the rank in the vocabulary, for the first expectation."""
    p = 1 / (np.arange(len(v.pieces)) + 50.0)
    return p / p.sum()


def train(docs: DataFrame, path: str, sample_rows: int = 20000, folds: int = 3, fold: int = 1) -> Model:
    """Piece probabilities per language from about sample_rows texts with a language, none of the held-out fold.

    The sample takes ids by hash, so it is the same at every run; without any row the model has no language. Expected counts
    are summed in tasks and then by Spark; what comes to the driver is one number for each piece and language.
    """
    spark = docs.sparkSession
    v = load(path)
    bc = spark.sparkContext.broadcast(v)
    own = picked(docs, doc_id="doc_id", text=F.lower(docs["text"]), lang="lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", folds, fold))
    per_language = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    n = sum(per_language.values())
    if n == 0:
        return Model(v, (), np.zeros(0), np.zeros((len(v.pieces), 0)))
    languages = tuple(sorted(per_language))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1_000_000))
    sample = own.where(bucket < max(1, min(1_000_000, round(1_000_000 * sample_rows / n)))).select("text", "lang")

    def run(batches):
        v = bc.value
        p, total = first_guess(v), np.zeros((len(v.pieces), len(languages)))
        number = {x: i for i, x in enumerate(languages)}
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for first, texts in slices(b.column(0), SLICE):
                flat = words_of(texts)
                if not len(flat.start):
                    continue
                row = np.repeat(lang[first : first + len(texts)], flat.count)
                _, at, inverse = np.unique(flat.hash, return_index=True, return_inverse=True)
                weight = np.bincount(inverse * len(languages) + row, minlength=len(at) * len(languages)).reshape(-1, len(languages)).astype(float)
                place = np.zeros(len(flat.start), np.int64)
                place[at] = np.arange(len(at))
                for group, _, found, unknown in lattice(flat, at, v, 1 << 18):
                    for ids, c in expected(found, unknown, p, weight[place[group]]):
                        for j in range(len(languages)):
                            total[:, j] += np.bincount(ids, c[:, j], len(v.pieces))
        piece, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(j, pa.int32()), pa.array(total[piece, j])], names=["piece", "language", "n"])

    counts = np.zeros((len(v.pieces), len(languages)))
    for r in sample.mapInArrow(run, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).collect():
        counts[r.piece, r.language] = r.n
    counts += 0.05
    prior = np.array([per_language[x] for x in languages], float)
    return Model(v, languages, np.log(prior / prior.sum()), counts / counts.sum(axis=0))


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, words_for_sure: int = 20) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text alone.

    The language with the largest probability of text and prior; the score is its posterior, with the text's weight reduced
    beyond words_for_sure words so that it doesn't saturate. 'und' and score 0 for a NULL text, one without a letter, or a
    model without languages. Ties go to the first language by name. Repeated rows give repeated rows.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)
    own = picked(docs, doc_id=docs["doc_id"].cast("long"), held_out=held_out("doc_id", folds, fold), letter=F.coalesce(docs["text"].rlike("\\p{L}"), F.lit(False)), text=F.lower(docs["text"]))

    def run(batches):
        m = bc.value
        p = np.ascontiguousarray(m.probability)
        known_hash, known_value = np.zeros(0, np.uint64), np.zeros((0, len(m.languages)))
        for b in batches:
            letter = np.array(b.column(2).to_pylist(), bool)
            for first, texts in slices(b.column(3), SLICE):
                flat = words_of(texts)
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if len(m.languages):
                    u, at, inverse = np.unique(flat.hash, return_index=True, return_inverse=True)
                    if len(known_hash) + len(u) > 1 << 19:
                        known_hash, known_value = np.zeros(0, np.uint64), np.zeros((0, len(m.languages)))
                    old = known_hash[np.minimum(np.searchsorted(known_hash, u), len(known_hash) - 1)] == u if len(known_hash) else np.zeros(len(u), bool)
                    place = np.zeros(len(flat.start), np.int64)
                    new = at[~old]
                    place[new] = np.arange(len(new))
                    value = np.zeros((len(new), len(m.languages)))
                    for group, chars, found, unknown in lattice(flat, new, m.vocabulary, 1 << 18):
                        value[place[group]] = np.log(np.maximum(forward(found, unknown, p)[-1], 1e-300))
                        value[place[group[(chars == BLANK).all(axis=1)]]] = 0
                    known_hash, known_value = np.concatenate((known_hash, u[~old])), np.concatenate((known_value, value))
                    order = np.argsort(known_hash, kind="stable")
                    known_hash, known_value = known_hash[order], known_value[order]
                    of_word = known_value[np.searchsorted(known_hash, u)][inverse]
                    sums = np.concatenate((np.zeros((1, len(m.languages))), np.cumsum(of_word, axis=0)))
                    bounds = np.concatenate(([0], np.cumsum(flat.count)))
                    total = np.diff(sums[bounds], axis=0)
                    full = total + m.log_prior
                    best = full.argmax(axis=1)
                    soft = total / np.maximum(1, flat.count / words_for_sure)[:, None] + m.log_prior
                    soft = np.exp(soft - soft.max(axis=1, keepdims=True))
                    score = (soft / soft.sum(axis=1, keepdims=True))[np.arange(len(texts)), best]
                sure = letter[first : first + len(texts)] & bool(len(m.languages))
                names = [m.languages[i] if ok else "und" for i, ok in zip(best, sure)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(names), pa.array(np.where(sure, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return own.mapInArrow(run, PREDICTED)
