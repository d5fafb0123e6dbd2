"""Top-k, sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagelight.operators.quantile import exact_quantiles
from stagelight.operators.scan import ordered_scan


def lowest_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` first rows by ``order``, which must end in a unique column; each task keeps only ``n`` rows."""
    return df.orderBy(*order).limit(n)


def brightest_per_group(df: DataFrame, keys: list[str], value: str, tie: list[str], n: int) -> DataFrame:
    """The ``n`` largest per group; Spark limits each group before the shuffle, so a hot group sends few rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def lexicographic_rank(df: DataFrame, metrics: list[str], tie: str) -> DataFrame:
    """Rank all candidates by the metrics in order, all minimised; range-bucketed on the first one."""
    return ordered_scan(df, [], [*metrics, tie], row_number="rank")


def seeded_order(id: str, seed: int):
    """A pseudo-random order of ids that other engines can repeat: md5 of the id and the seed as text."""
    return F.md5(F.concat_ws("|", F.col(id).cast("string"), F.lit(str(seed))).cast("binary"))


def near_percentile_sample(df: DataFrame, value: str, id: str, probs: list[float], seed: int, closest: int = 3) -> DataFrame:
    """For each probability a seeded pick among the ``closest`` rows to that percentile: (prob, id, value).

    All percentiles come from one pass; then one pass per table ranks the rows of every percentile, and Spark's limit on
    the rank keeps ``closest`` rows of each in every task before the shuffle.
    """
    q = exact_quantiles(df, [], value, {f"q{i}": p for i, p in enumerate(probs)})
    targets = q.select(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(f"q{i}").alias("t")) for i, p in enumerate(probs)]).alias("a")).scalar()
    wide = df.select(id, value).where(F.col(value).isNotNull()).withColumn("_t", F.explode(targets)).select(F.col("_t.prob").alias("prob"), id, value, F.abs(F.col(value) - F.col("_t.t")).alias("_d"))
    near = brightest_per_group(wide.withColumn("_d", -F.col("_d")), ["prob"], "_d", [id], closest)
    return near.groupBy("prob").agg(F.min(F.struct(seeded_order(id, seed).alias("h"), F.col(id).alias("i"), F.col(value).alias("v"))).alias("_m")).select(
        "prob", F.col("_m.i").alias(id), F.col("_m.v").alias(value))


def seeded_sample(df: DataFrame, id: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of ``n`` rows: the first by a seeded hash of the id."""
    return df.orderBy(seeded_order(id, seed), id).limit(n)


def outer_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; missing ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return all_rows.join(done.select(*keys), keys, "left_anti").distinct()


def both_ends(pairs: DataFrame, a: str, b: str, out: str = "id") -> DataFrame:
    return pairs.select(F.col(a).alias(out)).union(pairs.select(F.col(b))).distinct()


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of rows only in one of two tables, NULL equal to NULL: both zero when the tables are the same."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    right = b.exceptAll(a).agg(F.count(F.lit(1)))
    return left.withColumn("only_right", right.scalar())
