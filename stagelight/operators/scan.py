"""Ordered scans (lag, lead, running sums, forward fill, ranks) that do not need a whole group in one task.

A plain window sorts each group in one task, so a group holding a third of the rows would run alone. Here the
order axis is cut into buckets of about equal row counts; windows run per (group, bucket), and one summary row per
(group, bucket) carries the state across buckets. A group has at most as many summary rows as there are buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_ob"


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "timestamp_ntz")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of which NULL equals NULL; an equi join. Columns of the left, then those of the right without the keys."""
    own = [f"_key{i}_" for i in range(len(keys))]
    there = right.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)])
    return left.join(there, same, how).drop(*own)


def default_buckets(df: DataFrame) -> int:
    """Some buckets per shuffle partition, so that the largest group spreads over the whole cluster."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, value: Column, n: int) -> list[float]:
    """Approximate n-quantiles (with repeats for frequent values): at most n - 1 numbers come to the driver.

    They only decide how rows are spread; every result is exact whatever they are.
    """
    return sorted(df.select(value.alias("_x")).approxQuantile("_x", [i / n for i in range(1, n)], 1 / (2 * n)))


def bucket_by_splits(df: DataFrame, value: Column, splits: list[float], out: str) -> DataFrame:
    """Number of split points at or below the value, by the binary search of Spark's Bucketizer."""
    cuts = sorted(set(splits))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_split_in", outputCol="_split_out")
    return b.transform(df.withColumn("_split_in", value)).withColumn(out, F.col("_split_out").cast("int")).drop("_split_in", "_split_out")


def as_number(df: DataFrame, column: str) -> Column:
    """A number or timestamp column as a double (timestamps without zone are read in the session zone)."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    return (c.cast("timestamp") if kind == "timestamp_ntz" else c).cast("double")


def with_order_bucket(df: DataFrame, order: list[str], n_buckets: int) -> DataFrame:
    """Add a bucket number that rises with ``order``; ``order[0]`` is a number or timestamp and not NULL.

    A value of ``order[0]`` that alone fills several buckets gets its own, cut further by ``order[1]``.
    """
    first = as_number(df, order[0])
    cuts = split_points(df, first, n_buckets)
    heavy = sorted(v for v, n in Counter(cuts).items() if n >= 3)
    cuts += [math.nextafter(v, math.inf) for v in heavy]
    out = bucket_by_splits(df, first, cuts, BUCKET)
    if heavy and len(order) > 1 and dict(df.dtypes)[order[1]] in NUMERIC:
        second, same = as_number(df, order[1]), first.isin(heavy)
        inner = split_points(df.where(same), second, n_buckets)
        out = bucket_by_splits(out, second, inner, "_ob2").withColumn(
            BUCKET, F.col(BUCKET).cast("long") * (n_buckets + 1) + F.when(same, F.col("_ob2")).otherwise(0)).drop("_ob2")
    return out


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running_sum: dict[str, str] | None = None,
    forward_fill: dict[str, str] | None = None,
    backward_fill: dict[str, str] | None = None,
    row_number: str | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Add lag/lead (one row), inclusive running sums, last and next non-NULL value and 1-based row numbers.

    ``order[0]`` must be numeric or a timestamp and not NULL; ``order`` as a whole should be unique per group.
    Rows with a NULL key are a group like any other.
    """
    lag, lead = lag or {}, lead or {}
    running_sum, forward_fill, backward_fill = running_sum or {}, forward_fill or {}, backward_fill or {}
    rows = with_order_bucket(df, order, n_buckets or default_buckets(df))
    part = [*keys, BUCKET]
    pos = F.struct(*[F.col(c) for c in order])

    aggs = [F.count(F.lit(1)).alias("_n")]
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lag.items()]), pos).alias("_tail"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(o) for o, c in lead.items()]), pos).alias("_head"))
    for o, c in running_sum.items():
        aggs.append(F.sum(c).alias(f"_s_{o}"))
    for o, c in forward_fill.items():
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(f"_f_{o}"))
    for o, c in backward_fill.items():
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(f"_b_{o}"))
    summary = rows.groupBy(*part).agg(*aggs)

    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BUCKET)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(
        *part,
        *([F.lag("_tail").over(across).alias("_tail")] if lag else []),
        *([F.lead("_head").over(across).alias("_head")] if lead else []),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.sum(f"_s_{o}").over(before).alias(f"_s_{o}") for o in running_sum],
        *[F.last(f"_f_{o}", ignorenulls=True).over(before).alias(f"_f_{o}") for o in forward_fill],
        *[F.first(f"_b_{o}", ignorenulls=True).over(after).alias(f"_b_{o}") for o in backward_fill],
    )

    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_rn", F.row_number().over(inside))
    for o, c in lag.items():
        here = here.withColumn(f"_in_{o}", F.lag(c).over(inside))
    if lead:
        here = here.withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
        for o, c in lead.items():
            here = here.withColumn(f"_in_{o}", F.lead(c).over(inside))
    for o, c in running_sum.items():
        here = here.withColumn(f"_in_{o}", F.sum(c).over(upto))
    for o, c in forward_fill.items():
        here = here.withColumn(f"_in_{o}", F.last(c, ignorenulls=True).over(upto))
    for o, c in backward_fill.items():
        here = here.withColumn(f"_in_{o}", F.first(c, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)))

    joined = null_safe_join(here, carry, part)
    out = [F.col(c) for c in df.columns]
    out += [F.when(F.col("_rn") == 1, F.col(f"_tail.{o}")).otherwise(F.col(f"_in_{o}")).alias(o) for o in lag]
    out += [F.when(F.col("_last"), F.col(f"_head.{o}")).otherwise(F.col(f"_in_{o}")).alias(o) for o in lead]
    for o in running_sum:
        both = [F.col(f"_in_{o}"), F.col(f"_s_{o}")]
        total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in both])
        out.append(F.when(F.coalesce(*both).isNotNull(), total).alias(o))
    out += [F.coalesce(F.col(f"_in_{o}"), F.col(f"_f_{o}")).alias(o) for o in forward_fill]
    out += [F.coalesce(F.col(f"_in_{o}"), F.col(f"_b_{o}")).alias(o) for o in backward_fill]
    if row_number:
        out.append((F.col("_rn") + F.col("_n")).cast("long").alias(row_number))
    return joined.select(*out)


def dense_index(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """0-based dense rank of a numeric column: the distinct values are ranked by an ordered scan and joined back."""
    keys = keys or []
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    ranked = ordered_scan(distinct, keys, [value], row_number="_dr")
    return null_safe_join(df, ranked.select(*keys, value, (F.col("_dr") - 1).alias(out)), [*keys, value])
