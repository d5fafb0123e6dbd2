"""Exact quantiles of unbounded groups from a mergeable sketch and one refinement.

``percentile`` keeps every distinct value of a group in one aggregation buffer: right for pixels (at most 65,536
values) but not for doubles. `exact_quantiles` lets a sketch with a bounded rank error give two values that enclose each wanted
rank, counts what lies below them and sorts only the values between: rows are combined where they are read and never shuffled
as a whole. The sketch is the one job at plan time; a table of brackets that is measured small is broadcast, a larger one is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.operators.scan import bucket_by_splits, default_buckets, null_safe_join, split_points
from stagelight.session import cut_lineage

#: Inverse of the sketch's rank error, as a share of a group's rows.
ACCURACY = 10_000
#: Shares of a group by which brackets reach to each side; the first that covers the sketch's error for a group's size is taken.
REACH = [8 / ACCURACY * 4**k for k in range(6)] + [1.0]
#: Steps of the sketch that is folded around a median.
FOLDED = 1024
#: Rows of a bracket table that may be broadcast: well under ten megabytes.
SMALL = 20_000


def wanted_ranks(probs: dict[str, float], n: Column, method: str) -> list[tuple[Column, Column, Column]]:
    """(lower rank, upper rank, share of the upper) per probability; ranks from 0."""
    out = []
    for p in probs.values():
        at = F.lit(float(p)) * (n - 1) if method == "linear" else F.greatest(F.ceil(F.lit(float(p)) * n) - 1, F.lit(0)).cast("double")
        out.append((F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)))
    return out


def brackets(given: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """keys, _n and an array _in of (lo, hi) per probability; one row per group with a value."""
    at = [sorted((max(0.0, p - r), min(1.0, p + r))) for p in probs.values() for r in REACH]
    both = [F.percentile_approx("_v", [p for lo, hi in at for p in (lo, hi)], ACCURACY).alias("_q"), F.count("*").alias("_n")]
    step = F.lit(len(REACH) - 1)
    for k in range(len(REACH) - 2, -1, -1):
        step = F.when(F.lit(REACH[k] - 4 / ACCURACY) * F.col("_n") >= 2, k).otherwise(step)
    pick = lambda i: F.struct(*[F.element_at("_q", (2 * (i * len(REACH) + F.col("_k")) + 1 + s).cast("int")).alias(c) for s, c in ((0, "lo"), (1, "hi"))])
    sketch = given.groupBy(*keys).agg(*both).where("_n > 0").withColumn("_k", step)
    return sketch.select(*keys, "_n", F.array(*[pick(i) for i in range(len(probs))]).alias("_in"))


def shared(stats: DataFrame) -> DataFrame:
    """A checkpointed table of groups, to be sent to the rows where its size is measured small."""
    return F.broadcast(stats) if stats.limit(SMALL + 1).count() <= SMALL else stats


def with_group(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group, rows of other groups left out."""
    if keys:
        return null_safe_join(df, stats, keys, "inner")
    return attach(df, stats, keys).where("_n IS NOT NULL")


def refine(given: DataFrame, stats: DataFrame, keys: list[str], probs: dict[str, float], method: str) -> DataFrame:
    """Exact quantiles of ``_v`` from the brackets of stats(keys, _n, _in): values inside one are counted and ranked, others only counted."""
    slots = range(len(probs))
    inside = lambda i: (F.col("_v") >= F.col("_in")[i]["lo"]) & (F.col("_v") <= F.col("_in")[i]["hi"])
    any_in = inside(0)
    for i in slots[1:]:
        any_in = any_in | inside(i)
    counted = with_group(given, stats, keys).groupBy(*keys, F.when(any_in, F.col("_v")).alias("_v")).agg(
        F.count("*").alias("_c"), *[F.count_if(F.col("_v") < F.col("_in")[i]["lo"]).alias(f"_b{i}") for i in slots])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    below = counted.withColumns({f"_b{i}": F.sum(f"_b{i}").over(group) for i in slots}).where("_v IS NOT NULL")
    bounded = with_group(below, stats, keys)
    each = bounded.withColumn("_s", F.explode(F.array(*[F.when(inside(i), F.struct(F.lit(i).alias("slot"), F.col(f"_b{i}").alias("start"))) for i in slots]))).where("_s IS NOT NULL")
    order = Window.partitionBy(*keys, "_s.slot").orderBy("_v")
    ranked = each.withColumn("_end", F.col("_s.start") + F.sum("_c").over(order)).withColumn("_beg", F.col("_end") - F.col("_c"))
    at = lambda r: (r >= F.col("_beg")) & (r < F.col("_end"))
    out = []
    for i, (name, (low, high, share)) in enumerate(zip(probs, wanted_ranks(probs, F.col("_n"), method))):
        mine = F.col("_s.slot") == i
        a, b = (F.max(F.when(mine & at(r), F.col("_v"))) for r in (low, high))
        found = F.count_if(mine & at(low)) + F.count_if(mine & at(high)) == 2
        missed = F.raise_error(F.lit(f"quantile {name}: the sketch missed its rank")).cast("double")
        out.append(F.when(F.count("*") == 0, F.lit(None).cast("double")).when(found, a + (b - a) * F.max(F.when(mine, share))).otherwise(missed).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    *,
    weight: str | None = None,
    method: str = "linear",
    n_bins: int | None = None,
) -> DataFrame:
    """One row per group with a column per probability; ``linear`` interpolates, ``discrete`` does not.

    NULL values are ignored; a NULL key is a group like any other; groups without any value give no row (without keys: one row of NULLs). ``weight`` is an integer repeat count.
    """
    if method not in ("linear", "discrete"):
        raise ValueError(f"unknown quantile method: {method}")
    if weight is not None:
        return weighted_quantiles(df, keys, value, probs, weight, method, n_bins)
    given = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return refine(given, shared(cut_lineage(brackets(given, keys, probs))), keys, probs, method)


def median_and_mad(df: DataFrame, keys: list[str], value: str, median: str = "_med", mad: str = "_mad") -> DataFrame:
    """Median and median absolute deviation per group from one sketch.

    The sketch's quantiles, folded around the median, also enclose the rank of the deviations.
    """
    given = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = brackets(given, keys, {median: 0.5})
    grid = given.groupBy(*keys).agg(F.percentile_approx("_v", [i / FOLDED for i in range(FOLDED + 1)], ACCURACY).alias("_grid"))
    known = cut_lineage(null_safe_join(ends, grid, keys, "inner") if keys else attach(ends, grid, keys))
    known = shared(known)
    med = refine(given, known.select(*keys, "_n", "_in"), keys, {median: 0.5}, "linear")
    # half of the rows deviate less than the middle of the folded grid, give or take some of its steps (all of it where rows are few)
    folded = F.array_sort(F.transform("_grid", lambda q: F.abs(q - F.col(median))))
    few = F.col("_n") < 8 * FOLDED
    ends = F.struct(F.when(few, 0.0).otherwise(folded[FOLDED // 2 - 4]).alias("lo"), F.when(few, folded[FOLDED]).otherwise(folded[FOLDED // 2 + 5]).alias("hi"))
    centred = shared(cut_lineage(with_group(med, known.select(*keys, "_n", "_grid"), keys).select(*keys, median, "_n", F.array(ends).alias("_in"))))
    off = with_group(given, centred.select(*keys, median, "_n"), keys).select(*keys, F.abs(F.col("_v") - F.col(median)).alias("_v"))
    spread = refine(off, centred.select(*keys, "_n", "_in"), keys, {mad: 0.5}, "linear")
    return attach(centred.select(*keys, median), spread, keys)


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str, method: str, n_bins: int | None) -> DataFrame:
    """As :func:`exact_quantiles` for rows with repeat counts: distinct values are cut into bins, and the bins that hold wanted ranks are sorted."""
    given = df.where(F.col(value).isNotNull())
    counted = (
        given.groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(weight).cast("long").alias("_c"))
        .where("_c > 0")
    )
    bins_n = n_bins or default_buckets(df)
    binned = bucket_by_splits(counted, F.col("_v"), split_points(given, F.col(value).cast("double"), bins_n), "_b")
    by_group = Window.partitionBy(*(keys or [F.lit(0)]))
    hist = binned.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc")).withColumn("_n", F.sum("_bc").over(by_group))

    def position(p: float) -> Column:
        if method == "linear":
            return F.lit(float(p)) * (F.col("_n") - 1)
        return F.greatest(F.ceil(F.lit(float(p)) * F.col("_n")) - 1, F.lit(0)).cast("double")

    slots = []
    for i, p in enumerate(probs.values()):
        for j, r in ((0, F.floor(position(p))), (1, F.ceil(position(p)))):
            slots.append(F.struct(F.lit(2 * i + j).alias("slot"), r.cast("long").alias("r")))
    by_bin = by_group.orderBy("_b")
    bins = (
        hist
        .withColumn("_end", F.sum("_bc").over(by_bin))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
        .withColumn(
            "_want",
            F.filter(F.array(*slots), lambda s: (s["r"] >= F.col("_start")) & (s["r"] < F.col("_end"))),
        )
        .where(F.size("_want") > 0)
        .select(*keys, "_b", "_start", "_n", "_want")
    )
    in_bin = Window.partitionBy(*keys, "_b").orderBy("_v")
    hits = (
        null_safe_join(binned.select(*keys, "_b", "_v", "_c"), bins, [*keys, "_b"], "inner")
        .withColumn("_end", F.col("_start") + F.sum("_c").over(in_bin))
        .withColumn("_beg", F.col("_end") - F.col("_c"))
        .select(
            *keys, "_v", "_n",
            F.explode(
                F.filter("_want", lambda s: (s["r"] >= F.col("_beg")) & (s["r"] < F.col("_end")))
            ).alias("_w"),
        )
    )
    got = hits.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when(F.col("_w.slot") == s, F.col("_v"))).alias(f"_q{s}") for s in range(2 * len(probs))],
    )
    out = []
    for i, (name, p) in enumerate(probs.items()):
        frac = position(p) - F.floor(position(p))
        lo, hi = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        out.append((lo + (hi - lo) * frac).alias(name))
    return got.select(*keys, *out)


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Bring per-group (or, without keys, whole-table) one-row statistics to the rows, without a cross join."""
    if keys:
        return null_safe_join(df, stats, keys)
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in stats.columns])
