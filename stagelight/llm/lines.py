"""Line deduplication across all documents by a deletion-neighbourhood join over the words of lines.

A line is dropped if an earlier line has the same words, or differs by one inserted, deleted or replaced word. Lines of
an edit distance of one share a variant: deleting one word of each, or of the longer, leaves the same words. Every variant is
a hashed key that comes from prefix sums, so all variants of a line cost time in proportion to its length.

Two lines within the bound share their first or their last half, so only lines that share a half with another line have
variants, and only variants that two lines share are joined; bit tables of the shared halves and variants (bounded, false
hits only add work) tell the tasks which. In a group of equal
variants all lines are within the bound of its earliest line, so a group needs its minimum, not its pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from stagelight.sources.scratch import scratch_dir

from .text import BASE, INVERSE, SPACED, Words, mix, picked, powers, prefix, slices

#: Bytes of text at once: a task holds some 70 MB beside them, with 1 << 22 some 290 MB.
SLICE = 1 << 20
#: log2 of the bits of the tables of shared halves and variants.
TABLE_BITS = 25


class Lines:
    """The lines of some texts that have words: text, number within the text, words [first, last), hash."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, SPACED)
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        line = np.cumsum(raw == 10)[w.start] + w.row if len(w.start) else np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.words = w.hash
        self.first, self.last = new, np.append(new[1:], len(line))
        self.text = w.row[new]
        breaks = np.concatenate(([0], np.cumsum(raw == 10)))[w.offset[:-1]] + np.arange(len(texts))
        self.number = line[new] - breaks[self.text]
        self.prefix = prefix(w.hash)
        self.hash = self.key(self.first, self.last)
        self.count = self.last - self.first

    def key(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hash of the words [a, z)."""
        return sealed((self.prefix[z] - self.prefix[a]) * powers(len(self.prefix), INVERSE)[a], z - a)

    def halves(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the halves of lines, four columns, and which count: a line meets lines of its own length and of one word more."""
        a, z, n = self.first[use], self.last[use], self.count[use]
        sizes = (n // 2, (n + 1) // 2)
        keys = np.stack([self.key(a, a + h) ^ np.uint64(1) for h in sizes] + [self.key(z - h, z) for h in sizes], axis=1)
        odd = n % 2 == 1
        return keys, np.stack([np.ones(len(n), bool), odd, np.ones(len(n), bool), odd], axis=1)

    def variants(self, i: int) -> np.ndarray:
        """Hashes of line i without its first, second, .. word, equal to those of lines that have these words."""
        a, z = int(self.first[i]), int(self.last[i])
        at = np.arange(a, z)
        scale = powers(len(self.prefix), INVERSE)
        left = (self.prefix[at] - self.prefix[a]) * scale[a]
        right = (self.prefix[z] - self.prefix[at + 1]) * scale[at + 1] * powers(len(self.prefix), BASE)[at - a]
        return sealed(left + right, np.full(z - a, z - a - 1))


def sealed(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(raw + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def line_rows(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """doc_id, row, number, h and halves (keys of halves, none below near_words) of every line of min_words or more; docs: (doc_id, text, row)."""

    def run(batches):
        for b in batches:
            for first, texts in slices(b.column(1), SLICE):
                x = Lines(texts)
                use = np.flatnonzero(x.count >= min_words)
                keys, chosen = x.halves(use)
                chosen &= (x.count[use] >= near_words)[:, None]
                halves = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))), pa.int32()), longs(keys[chosen]))
                ids, keys_of_rows = (b.column(k).slice(first, len(texts)).take(pa.array(x.text[use])) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, keys_of_rows, pa.array(x.number[use], pa.int32()), longs(x.hash[use]), halves], names=["doc_id", "row", "number", "h", "halves"])

    return docs.mapInArrow(run, "doc_id long, row long, number int, h long, halves array<long>")


def bit_table(keys: DataFrame, column: str, bits: int = TABLE_BITS) -> np.ndarray:
    """Bits set at the first `bits` bits of the keys, packed in int64; summed by Spark, at most 2^(bits - 6) rows."""
    top = F.shiftrightunsigned(column, 64 - bits)
    word = F.shiftright(top, 6)
    rows = keys.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def in_table(table: np.ndarray, keys: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (table[top >> 6] >> (top & 63)) & 1 == 1


def variant_rows(docs: DataFrame, halves, near_words: int, shared=None) -> DataFrame:
    """Variants of the lines with a shared half: key, place of the deleted word (-1: the line itself, with its words), h, doc_id, number.

    Without `shared` only key and h, of all variants; with it only the variants in that table, and the lines themselves.
    """

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, texts in slices(b.column(1), SLICE):
                x = Lines(texts)
                use = np.flatnonzero(x.count >= near_words)
                keys, chosen = x.halves(use)
                use = use[(in_table(halves.value, keys) & chosen).any(axis=1)]
                rank = np.where(valid[first + x.text[use]], ids[first + x.text[use]], np.iinfo(np.int64).min)
                use = use[np.lexsort((x.number[use], rank, x.hash[use]))]
                use = use[np.concatenate(([True], x.hash[use][1:] != x.hash[use][:-1]))] if len(use) else use
                for part in np.array_split(use, max(1, int(x.count[use].sum()) // 200_000)):
                    if not len(part):
                        continue
                    n = x.count[part] + 1
                    keys = np.concatenate([np.concatenate((x.variants(i), x.hash[i : i + 1])) for i in part])
                    line = np.repeat(part, n)
                    if shared is None:
                        yield pa.RecordBatch.from_arrays([longs(keys), longs(x.hash[line])], names=["key", "h"])
                        continue
                    at = np.concatenate([np.append(np.arange(k - 1), -1) for k in n])
                    keep = np.flatnonzero(in_table(shared.value, keys) | (at < 0))
                    keys, line, at = keys[keep], line[keep], at[keep]
                    size = np.where(at < 0, x.count[line], 0)
                    words = np.concatenate([x.words[a:z] for a, z in zip(x.first[part], x.last[part])])
                    seq = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), longs(words))
                    yield pa.RecordBatch.from_arrays([
                        longs(keys), pa.array(at, pa.int32()), longs(x.hash[line]), b.column(0).take(pa.array(first + x.text[line])),
                        pa.array(x.number[line], pa.int32()), seq], names=["key", "at", "h", "doc_id", "number", "words"])

    return docs.mapInArrow(run, "key long, h long" if shared is None else "key long, at int, h long, doc_id long, number int, words array<long>")


@F.pandas_udf(BooleanType())
def within_one(a, b):
    """Whether word sequences differ by one inserted, deleted or replaced word at most."""

    def near(x, y):
        n = min(len(x), len(y))
        if abs(len(x) - len(y)) > 1:
            return False
        same = x[:n] == y[:n]
        head = n if same.all() else int(same.argmin())
        same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
        return head + tail >= max(len(x), len(y)) - 1

    return a.__class__([near(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)], index=a.index)


def near_earlier(docs: DataFrame, rows: DataFrame, near_words: int, folder: str) -> DataFrame:
    """h of the lines that have an earlier line within one word, and the hash of the earliest such line that was found."""
    spark = docs.sparkSession
    several = lambda df: df.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("key")
    send = lambda df: spark.sparkContext.broadcast(bit_table(several(df), "key"))
    halves = send(rows.select("h", F.explode("halves").alias("key")))
    shared = send(variant_rows(docs, halves, near_words))
    variant_rows(docs, halves, near_words, shared).write.parquet(f"{folder}/variants")
    v = spark.read.parquet(f"{folder}/variants")
    place = F.struct("doc_id", "number", "h")
    cut, whole = v.where("at >= 0"), v.where("at < 0")
    own = lambda name: F.min(place).alias(name)
    lines = whole.groupBy(F.col("h")).agg(own("own"))  # earliest place of each line that emits variants
    # lines that lack a word at the same place of the same rest: all within one replaced word of the earliest
    same = cut.groupBy("key", "at").agg(own("best"), F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("key", "at", "best")
    replaced = cut.join(same, ["key", "at"]).select("h", "best")
    # a line and those that become it by losing a word
    shorter = cut.join(lines.select(F.col("h").alias("key"), F.col("own").alias("best")), "key").select("h", "best", "key", place.alias("mine"))
    longer = shorter.groupBy(F.col("key").alias("h")).agg(F.min("mine").alias("best"))
    found = reduce(DataFrame.unionByName, [replaced, shorter.select("h", "best"), longer]).groupBy("h").agg(F.min("best").alias("best"))
    late = found.join(lines, "h").where(earlier("best", "own")).select("h", F.col("best.h").alias("kept"))
    words = whole.groupBy("h").agg(F.first("words").alias("words"))
    pairs = late.join(words, "h").join(words.select(F.col("h").alias("kept"), F.col("words").alias("kept_words")), "kept")
    return pairs.where(within_one("words", "kept_words")).select("h", "kept")


def earlier(a: str, b: str):
    """Whether place a comes before place b; a NULL id comes first and numbers count within an id."""
    before = F.coalesce(F.col(f"{a}.doc_id") < F.col(f"{b}.doc_id"), F.col(f"{a}.doc_id").isNull() & F.col(f"{b}.doc_id").isNotNull())
    return before | (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.number") < F.col(f"{b}.number")))


def dropped_lines(docs: DataFrame, min_words: int, near_words: int, folder: str) -> DataFrame:
    """doc_id, row, number and near (false: the same words came before) of every line to drop; docs: (doc_id, text).

    row is a hash of the text: rows with one id (or none) and different texts are told apart by it.
    """
    spark = docs.sparkSession
    line_rows(docs.withColumn("row", F.xxhash64("text")), min_words, near_words).write.parquet(f"{folder}/lines")
    rows = spark.read.parquet(f"{folder}/lines")
    near = near_earlier(docs, rows, near_words, folder).select("h", F.lit(True).alias("near"))
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "number")).alias("best"), F.count("*").alias("n"))
    first = first.join(near, "h", "left").where("n > 1 or near").select("h", "best", F.coalesce("near", F.lit(False)).alias("near"))
    late = rows.select("h", "row", F.struct("doc_id", "number").alias("mine")).join(first, "h").where(F.col("near") | earlier("best", "mine"))
    return late.select("mine.doc_id", "row", "mine.number", "near")


def dedup_lines(docs: DataFrame, min_words: int = 5, near_words: int = 10, folder: str | None = None, counts: bool = False, drop_emptied: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, texts without the lines that an earlier line repeats.

    Words are runs of non-blank bytes, A-Z lower-cased; lines end at line feeds. A line of min_words words or more is dropped
    if a line with the same words stands earlier, in order of id (NULL first) and line; one of near_words or more also if an
    earlier line of near_words or more is within one word, whether or not that one is kept itself. Shorter and blank lines
    stay. Rows that share an id share its places: equal lines at the same place stay in all of them, and each row
    loses lines of its own text only. NULL stays NULL; a text
    whose lines all go is ''; with drop_emptied, rows that lose lines and have no word left go. With counts, columns n_lines, n_dropped and n_near follow; other columns may have any name.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)
    own = picked(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    gone = dropped_lines(own, min_words, near_words, folder)
    lists = gone.distinct().groupBy("doc_id", "row").agg(F.collect_list("number").alias("_gone"), F.sum(F.col("near").cast("int")).cast("long").alias("_near")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_gone", "_near")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[docs[c].alias(k) for c, k in names.items()])
    joined = plain.join(lists, F.col(names[id_col]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(names[text_col]) == F.col("_row")), "left")
    text = F.col(names[text_col])
    out = {c: F.col(k) for c, k in names.items()}
    out[text_col] = F.when(F.col("_gone").isNull(), text).otherwise(without_lines(text, F.col("_gone")))
    if counts:
        out["n_lines"] = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long")
        out["n_dropped"] = F.coalesce(F.when(text.isNotNull(), F.size("_gone").cast("long")), F.lit(0).cast("long"))
        out["n_near"] = F.coalesce("_near", F.lit(0).cast("long"))
    if drop_emptied:
        blank = F.length(F.regexp_replace(F.coalesce(out[text_col], F.lit("x")), "[\\x09-\\x0D ]+", "")) == 0
        joined = joined.where(F.col("_gone").isNull() | ~blank)
    return joined.select(*[c.alias(k) for k, c in out.items()])


@F.pandas_udf(StringType())
def without_lines(texts, gone):
    def one(text, numbers):
        if text is None or numbers is None:
            return text
        drop = set(numbers)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

    return texts.__class__([one(t, g) for t, g in zip(texts, gone)], index=texts.index, dtype=object)
