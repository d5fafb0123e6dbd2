"""Source divergence audit: how each source of a language differs from the other sources and from the language.

Terms are counted per (lang, source) with combining before the shuffle; a window over (lang, term) gives the language's counts
and drops terms of too few documents. Terms of a group with equal counts (in the group, in the language) have equal values, so
the ranking runs over these count cells: f is evaluated once a cell, cells of equal value are merged, cumulative multiplicities
tell where each value's ranks start, and only the values that reach the wanted ranks are expanded to terms, in UTF-8 order.

A pair of sources is summed over blocks of terms: a block holds about `BUCKET` counts of at most 2 x `SIDE` sources and
starts with one row for each of these sources, so that terms without a count there, and sources without terms, take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.sources.scratch import scratch_dir

from .text import LETTERS, Words, mix, picked, record_batch, slices, spans

#: Added to every count.
SMOOTHING = 5
#: Counts in a block of terms, on average.
BUCKET = 1 << 16
#: Sources on each side of a block.
SIDE = 256
#: Entries of the dense part of a block that is worked on at once.
DENSE = 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def slice_counts(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(group, occurrences, documents, term) of every (group, term) of some texts; group is the texts' group number."""
    w = Words(texts, LETTERS)
    key = mix(w.hash + group[w.row].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    key, row = key[order], w.row[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    doc = new.copy()
    doc[1:] |= row[1:] != row[:-1]
    n = np.diff(np.append(start, len(key)))
    d = np.add.reduceat(doc.astype(np.int64), start) if len(start) else n
    first = order[start]
    return group[w.row[first]], n, d, spans(w.buf, w.start[first], w.end[first])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        kinds = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * kinds + source.indices.to_numpy()
        for first, texts in slices(b.column(2)):
            g, n, d, term = slice_counts(texts, group[first : first + len(texts)])
            if len(g):
                yield record_batch(_COUNTS, lang=lang.dictionary.take(pa.array(g // kinds)), source=source.dictionary.take(pa.array(g % kinds)), term=term, n=n, d=d)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 5) / total) in whole numbers; exact for totals below 9 * 10^15, NULL for a total of 0."""
    total = F.nullif(total, F.lit(0))
    left, out = count + SMOOTHING, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + F.call_function("div", left, total)
        left = left % total
    return out + 1


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, n_lang, head) of the terms in min_docs documents of their language; head is 1 once a (lang, term)."""
    by_term = Window.partitionBy("lang", "term")
    counts = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    all_of = counts.withColumns({"n_lang": F.sum("n").over(by_term), "docs": F.sum("d").over(by_term), "head": (F.row_number().over(by_term.orderBy("source")) == 1).cast("long")})
    return all_of.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "head")


def group_table(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per (lang, source): smoothed totals of the group and of its language, number of the source and of term blocks."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("head").alias("v"), F.count("*").alias("rows"))
    by_lang = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    return (
        groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
        .withColumn("no", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1)
        .select("lang", "source", "v", (F.col("n") + SMOOTHING * F.col("v")).alias("total"), (F.col("n_lang") + SMOOTHING * F.col("v")).alias("total_lang"),
                F.call_function("div", F.col("no"), F.lit(SIDE).cast("long")).alias("side"), F.call_function("div", F.max("no").over(by_lang), F.lit(SIDE).cast("long")).alias("last_side"),
                F.greatest(zero, F.call_function("div", F.col("rows") - 1, F.lit(BUCKET).cast("long"))).alias("last_bucket"))
    )


def ranked_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Part `term`: the terms of ranks to `top` of every group that exceed their share in the language, by count cells."""
    group = ["lang", "source"]
    p, q = share(F.col("n"), F.col("total")), share(F.col("n_lang"), F.col("total_lang"))
    cells = (
        kept.groupBy(*group, "n", "n_lang").agg(F.count("*").alias("m"))
        .join(groups.select(*group, "total", "total_lang"), group)
        .select(*group, "n", "n_lang", "m", (p - q).alias("value")).where("value > 0")
    )
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = (
        cells.groupBy(*group, "value").agg(F.sum("m").alias("m"))
        .withColumn("place", F.row_number().over(falling)).where(F.col("place") <= top)
        .withColumn("before", F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < top)
        .select(*group, "value", "before")
    )
    wanted = cells.join(values, [*group, "value"]).select(*group, "n", "n_lang", "value", "before")
    inside = Window.partitionBy(*group, "value").orderBy("term")
    rows = kept.join(wanted, [*group, "n", "n_lang"]).withColumn("place", F.row_number().over(inside)).where(F.col("place") <= top)
    rank = (F.col("before") + F.col("place")).cast("int")
    return rows.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= top)


_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def block_differences(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of absolute differences over one block of terms, for each pair of its sources that belongs to it.

    Rows without a term list the sources with the share of a count of 0; the others hold shares of counts above 0. Bucket 0 also
    adds the differences of counts of 0 for all terms of the language, and each bucket takes them off for its own.
    """
    side_a, side_b = key[1].as_py(), key[2].as_py()
    head = pc.is_null(table.column("term"))
    listed, rows = table.filter(head).sort_by("source"), table.filter(pc.invert(head))
    names = listed.column("source").combine_chunks()
    side, low = listed.column("side").to_numpy(), listed.column("p").to_numpy()
    left, right = np.flatnonzero(side == side_a), np.flatnonzero(side == side_b)
    at = pc.index_in(rows.column("source"), value_set=names).to_numpy()
    term = rows.column("term").combine_chunks().dictionary_encode()
    term, p = term.indices.to_numpy(), rows.column("p").to_numpy()
    n_terms = int(term.max()) + 1 if len(term) else 0
    order = np.argsort(term, kind="stable")
    term, p, at = term[order], p[order], at[order]
    terms_left = (int(listed.column("v")[0].as_py()) if key[3].as_py() == 0 else 0) - n_terms
    out = np.abs(low[left][:, None] - low[right][None, :]) * terms_left
    step = max(1, DENSE // max(1, len(names)))
    for first in range(0, n_terms, step):
        lo, hi = np.searchsorted(term, [first, first + step])
        dense = np.repeat(low[None, :], min(step, n_terms - first), axis=0)
        dense[term[lo:hi] - first, at[lo:hi]] = p[lo:hi]
        there = np.ascontiguousarray(dense[:, right].T)
        for i, a in enumerate(left):
            out[i] += np.abs(there - dense[:, a]).sum(axis=1)
    i, j = np.nonzero(np.ones(out.shape, bool) if side_a != side_b else np.triu(np.ones(out.shape, bool), 1))
    n = len(i)
    return pa.table([pa.repeat(key[0], n).cast(pa.string()), names.take(pa.array(left[i])), names.take(pa.array(right[j])), pa.array(out[i, j])], schema=_PAIRS)


def ranked_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Part `pair`: every other source of the language with the summed difference of all kept terms."""
    known = groups.select("lang", "source", "v", "total", "side", "last_side", "last_bucket")
    listed = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last_bucket")).alias("bucket"), F.lit(None).cast("string").alias("term"), F.coalesce(share(F.lit(0).cast("long"), F.col("total")), F.lit(0).cast("long")).alias("p"))
    counted = kept.join(known, ["lang", "source"]).select("lang", "source", "v", "total", "side", "last_side", "last_bucket", F.pmod(F.xxhash64("term"), F.col("last_bucket") + 1).alias("bucket"), "term", share(F.col("n"), F.col("total")).alias("p"))
    blocks = (
        listed.unionByName(counted)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last_side")))
        .select("lang", "source", "v", "side", "bucket", "term", "p", F.least("side", "other").alias("side_a"), F.greatest("side", "other").alias("side_b"))
    )
    parts = blocks.groupBy("lang", "side_a", "side_b", "bucket").applyInArrow(block_differences, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    order = Window.partitionBy("lang", "x.source").orderBy(F.desc("value"), "x.item")
    return both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", folder: str | None = None) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts.

    NULL text, lang and source are ''. Every row is a document, repeated rows too. Groups without terms (empty texts) have pairs but no
    term rows; a language of one source has no pairs, a language without kept terms has pairs of value 0; an empty table gives no row. Values that tie
    are ranked by the item's UTF-8 bytes. A very long text is a slice of its own. Other columns of `docs` are not read. `folder` is shared.
    """
    folder = folder or scratch_dir(docs.sparkSession)
    read = docs.sparkSession.read.parquet
    given = picked(docs, **{k: F.coalesce(docs[c].cast("string"), F.lit("")) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))})
    kept_terms(given, min_docs).write.parquet(f"{folder}/kept")
    kept = read(f"{folder}/kept")
    group_table(given.select("lang", "source").distinct(), kept).write.parquet(f"{folder}/groups")
    groups = read(f"{folder}/groups")
    return ranked_pairs(kept, groups).unionByName(ranked_terms(kept, groups, top))
