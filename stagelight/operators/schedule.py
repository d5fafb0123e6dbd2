"""Run-time estimates and plan comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actual_vs_plan(blocks: DataFrame) -> DataFrame:
    """Mean of actual over planned seconds per kind, over finished blocks with a plan; none gives 1.0."""
    use = F.col("measured") & (F.col("plan_s") > 0)
    return blocks.groupBy("kind").agg(
        F.coalesce(F.avg(F.when(use, F.col("actual_s") / F.col("plan_s"))), F.lit(1.0)).alias("ratio")
    )


def estimate_schedule(movies: DataFrame, fov_counts: DataFrame, steps: DataFrame, durations: DataFrame, *,
                      frame_bytes: int, overhead_s: float = 5.0, default_frame_s: float = 0.25) -> DataFrame:
    """Time, bytes and movies per round plus a total row (``label`` NULL).

    movies: label, positions_id, series, frames, frame_s; fov_counts: positions_id, n_fov;
    steps: label, protocol; durations: protocol, duration_s. An unknown protocol counts 0 s.
    """
    per_movie = F.col("frames") * F.coalesce(F.col("frame_s"), F.lit(default_frame_s)) + overhead_s
    n = F.coalesce(F.col("n_fov"), F.lit(0))
    m = movies.join(fov_counts, "positions_id", "left").select(
        "label", "series", per_movie.alias("fov_s"), (n * per_movie).alias("imaging_s"),
        (n * F.col("frames") * frame_bytes).cast("long").alias("bytes"), n.alias("movies"), F.lit(0.0).alias("fluidics_s"),
    )
    s = steps.join(durations, "protocol", "left").select(
        "label", F.lit(None).cast("string").alias("series"), F.lit(0.0).alias("fov_s"), F.lit(0.0).alias("imaging_s"),
        F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("movies"),
        F.coalesce(F.col("duration_s"), F.lit(0.0)).alias("fluidics_s"),
    )
    total = lambda c: F.sum(c).alias(c)
    return m.unionByName(s).rollup("label").agg(
        total("imaging_s"), total("fluidics_s"), total("bytes"), total("movies"), F.sum("fov_s").alias("per_fov_s"),
        F.count_distinct("series").alias("n_series"), F.grouping("label").cast("int").alias("is_total"),
    )


def unknown_protocols(steps: DataFrame, durations: DataFrame) -> DataFrame:
    return steps.join(durations, "protocol", "left_anti").groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


def report_order(label: str = "label"):
    """Sort columns of a report: cells first, numbered rounds ascending, the rest last."""
    hyb = F.try_to_number(F.regexp_extract(label, r"Hyb (\d+)", 1), F.lit("999999")).cast("int")
    return [F.when(F.col(label).startswith("Cells"), 0).when(hyb.isNotNull(), 1).otherwise(2), hyb, F.col(label)]


def trim_savings(needs: DataFrame, frame_table: DataFrame, *, margin_um: float, z_cap: float, frame_bytes: int,
                 frame_s: float) -> DataFrame:
    """Frames kept per FOV when each z-swept colour stops at the needed depth; NULL depth keeps only fixed frames.

    A colour (blank is one) is z-swept when its frames span more than one z. The sorted z values of all swept frames
    of one frame table are a camera plan (hundreds of numbers) and travel as one scalar array.
    """
    ft = frame_table.withColumn("_c", F.coalesce(F.bround("color"), F.lit(-1.0)))
    groups = ft.groupBy("_c").agg(
        (F.min("z") < F.max("z")).alias("swept"), F.count(F.lit(1)).alias("n"), F.collect_list("z").alias("zs")
    )
    plan = groups.agg(
        F.struct(
            F.flatten(F.collect_list(F.when(F.col("swept"), F.col("zs")))).alias("zs"),
            F.coalesce(F.sum(F.when(~F.col("swept"), F.col("n"))), F.lit(0)).alias("fixed"), F.sum("n").alias("total"),
        )
    ).scalar()
    needed = F.least(F.col("z_last") + margin_um, F.lit(float(z_cap)))
    out = needs.withColumn("_p", plan).withColumn("z_needed", F.when(F.col("z_last").isNotNull(), needed))
    below = F.size(F.filter("_p.zs", lambda z: z <= F.col("z_needed")))
    kept = (F.col("_p.fixed") + F.when(F.col("z_needed").isNull(), 0).otherwise(below)).cast("long")
    out = out.withColumn("n_kept", kept).withColumn("n_removed", F.col("_p.total") - F.col("n_kept"))
    return out.select(
        *needs.columns, "z_needed", F.col("_p.total").alias("n_frames"), "n_kept", "n_removed",
        (F.col("n_removed") * frame_bytes).alias("bytes_saved"), (F.col("n_removed") * float(frame_s)).alias("seconds_saved"),
        F.coalesce(F.col("z_last") + margin_um > z_cap, F.lit(False)).alias("capped"),
    )
