"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton is built once per block of items; documents stream through it word by word. Only runs of words that all
occur in the items can hold a window, so only those runs are walked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ALNUM, Words, picked, record_batch, slices

#: Words of the test items that one automaton may hold; more items make more automata, each built and freed in turn.
BLOCK_WORDS = 400_000


class Automaton:
    """States hold transitions, the longest length and the suffix link; window states hold the items they occur in."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.window = window
        ends: list[list[int]] = []
        for item in items:
            last, path = 0, []
            for c in item:
                last = self._extend(last, c)
                path.append(last)
            ends.append(path)
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, set[int]] = {}
        for k, item in enumerate(items):
            if 0 < len(item) < window:
                self.whole.setdefault(ends[k][-1], set()).add(k)
                continue
            for s in ends[k]:
                if (w := self._at_window(s)) >= 0:
                    self.items.setdefault(w, set()).add(k)
        # the nearest state up the links whose string is a whole short item
        self.short = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.short[s] = up if up in self.whole else (self.short[up] if up > 0 else -1)
        self.shortest = min([window, *(len(i) for i in items if i)])

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = self._new(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(-1)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        k = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[k] = self.link[q]
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _at_window(self, s: int) -> int:
        """The state of the last `window` words of a match that ends in s; -1 if it is shorter."""
        if self.length[s] < self.window:
            return -1
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def walk(self, words: list[int], at: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        """Adds the hit spans [start, end) of the words, which begin at word `at`, and the items with occurring windows."""
        s = n = 0
        for i, c in enumerate(words, at + 1):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if (t := self.next[s].get(c)) is None:
                continue
            s, n = t, n + 1
            if n >= self.window:
                # the match may be shorter than the state's longest string, so the window's state is searched from s
                w = s
                while self.length[self.link[w]] >= self.window:
                    w = self.link[w]
                spans.append((i - self.window, i))
                items |= self.items.get(w, set())
            w = s if s in self.whole and n >= self.length[s] else self.short[s]
            while w > 0:
                spans.append((i - self.length[w], i))
                items |= self.whole[w]
                w = self.short[w]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[list[tuple[str, bytes]]]:
    """(item id as text, text) in blocks of bounded length; the test items are a small fixed set, read once."""
    blocks, size = [[]], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).orderBy(item_col, text_col).toLocalIterator():
        b = (text or "").encode()
        if blocks[-1] and size + len(b) > 6 * block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((item if item is not None else "", b))
        size += len(b)
    return blocks


def match_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, hit spans in words and in bytes, items with occurring windows, columns of `keep`.

    Words are those of ALNUM. A window is `window` consecutive words of an item, or a whole item that has fewer but not
    none. NULL and empty texts have no words and no hits; items without words never occur; items may share their id, which
    then counts once; repeated rows give repeated rows. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in item_blocks(benchmark, item_col, text_col, block_words)]
    own = picked(docs, doc_id=id_col, text=text_col, **{f"keep{i}": c for i, c in enumerate(keep)})
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("byte_spans", span), T.StructField("items", T.ArrayType(T.StringType()))])

    def machines():
        for b in blocks:
            ids, w = [i for i, _ in b.value], Words([t for _, t in b.value], ALNUM)
            vocabulary, inverse = np.unique(w.hash, return_inverse=True)
            lists = [inverse[a:z].tolist() for a, z in zip(w.bounds, w.bounds[1:])]
            yield ids, vocabulary, Automaton(lists, window)

    def run(batches):
        held = list(machines()) if len(blocks) == 1 else None
        for b in batches:
            for first, texts in slices(b.column(1)):
                w = Words(texts, ALNUM)
                spans: list[list] = [[] for _ in texts]
                items: list[set] = [set() for _ in texts]
                for ids, vocabulary, machine in held or machines():
                    if not len(vocabulary) or not len(w.hash):
                        continue
                    k = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                    known = vocabulary[k] == w.hash
                    fresh = np.concatenate(([True], (known[1:] != known[:-1]) | (w.row[1:] != w.row[:-1]), [True]))
                    edges = np.flatnonzero(fresh)
                    ok = known[edges[:-1]] & (np.diff(edges) >= machine.shortest)
                    for a, z in zip(edges[:-1][ok].tolist(), edges[1:][ok].tolist()):
                        r = int(w.row[a])
                        found: set[int] = set()
                        machine.walk(k[a:z].tolist(), a - int(w.bounds[r]), spans[r], found)
                        items[r] |= {ids[i] for i in found}
                spans = [merged(s) for s in spans]
                byte = [[(int(w.start[w.bounds[r] + a] - w.offset[r]), int(w.end[w.bounds[r] + z - 1] - w.offset[r])) for a, z in s] for r, s in enumerate(spans)]
                rows = b.slice(first, len(texts))
                pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                as_rows = lambda x: pa.array([[{"start": a, "end": z} for a, z in s] for s in x], pairs)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(w.count, pa.int64()), as_rows(spans), as_rows(byte), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                    names=[*rows.schema.names, "n_words", "spans", "byte_spans", "items"])

    return own.mapInArrow(run, out)


def judged(matches: DataFrame, share: int = 20) -> DataFrame:
    """The columns of `matches` with n_hit, n_items, items_sha256 and contaminated (a hit, and 1 / share of the words or more)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return matches.select("*", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids) and contaminated for every row."""
    return judged(match_items(docs, benchmark, **options)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def without_spans(text, spans):
    """The text without its byte spans; a cut leaves a line break."""
    if not text or spans is None or not len(spans):
        return text
    b, at, parts = text.encode(), 0, []
    for s in spans:
        parts.append(b[at : s["start"]].decode().rstrip())
        at = s["end"]
    return "\n".join([*parts, b[at:].decode().lstrip()]).strip("\n")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", share: int = 20, text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns without contamination.

    remove="documents" drops contaminated rows and leaves all others as they are; remove="spans" keeps all rows and cuts
    the hit spans out of contaminated ones. Rows are judged as in `contamination`; columns may have any name.
    """
    found = judged(match_items(docs, benchmark, text_col=text_col, keep=tuple(docs.columns), **options), share)
    kept = {c: F.col(f"keep{i}") for i, c in enumerate(docs.columns)}
    if remove == "documents":
        found = found.where(~F.col("contaminated"))
    else:
        cut = F.udf(without_spans, "string")
        kept[text_col] = F.when(F.col("contaminated"), cut(kept[text_col], F.col("byte_spans"))).otherwise(kept[text_col])
    return found.select(*[c.alias(k) for k, c in kept.items()])
