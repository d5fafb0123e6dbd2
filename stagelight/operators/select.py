"""Filters and picks on frame tables and result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions.scalar import round_even
from stagelight.operators.scan import ordered_scan


def data_frame_mask(columns: Iterable[str], bead_z: float | list[float] = 0.0) -> Column:
    """True for z-stack frames: segment ``data``; where the segment is missing, any z that is not a bead z."""
    beads = [float(b) for b in (bead_z if isinstance(bead_z, (list, tuple)) else [bead_z])]
    by_z = F.coalesce(~F.col("z").isin(beads), F.lit(True))
    if "segment" not in columns:
        return by_z
    return F.when(F.col("segment").isNotNull(), F.col("segment") == "data").otherwise(by_z)


def data_frames(frames: DataFrame, bead_z: float | list[float] = 0.0) -> DataFrame:
    return frames.where(data_frame_mask(frames.columns, bead_z))


def color_filter(frames: DataFrame, keep: list[int] | None = None, drop: list[int] = (), color: str = "color") -> DataFrame:
    """Match wavelengths by whole nm (half to even); blanks never match."""
    nm = round_even(color).cast("int")
    cond = F.col(color).isNotNull()
    if keep is not None:
        cond &= nm.isin([int(k) for k in keep])
    if drop:
        cond &= ~nm.isin([int(k) for k in drop])
    return frames.where(cond)


def mid_z_frames(frames: DataFrame, keys: list[str], bead_z: float = 0.0) -> DataFrame:
    """Per key and colour the first frame at the plane nearest the middle of the stack."""
    data = data_frames(frames, bead_z)
    mid = data.groupBy(*keys).agg(((F.min("z") + F.max("z")) / 2).alias("_mid"))
    best = data.join(mid, keys).groupBy(*keys).agg(
        F.min_by("z", F.struct(F.abs(F.col("z") - F.col("_mid")), F.col("frame"))).alias("z")
    )
    return (
        data.join(best, [*keys, "z"]).where(F.col("color").isNotNull())
        .groupBy(*keys, "color").agg(F.min("frame").alias("frame"))
    )


def frames_of_color(frames: DataFrame, keys: list[str], color: float, bead_z: float = 0.0) -> DataFrame:
    """Frame numbers of one colour in ascending z (a frame table has at most one camera run of frames per key)."""
    rows = color_filter(data_frames(frames, bead_z), [round(color)]).select(*keys, "z", "frame").distinct()
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("z", "frame")))["frame"].alias("frames"))


def bead_color(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Fiducial colour per key: rarest ``bead`` colour, or without segments the rarest single-plane colour."""
    lit = frames.where(F.col("color").isNotNull())
    if "segment" in frames.columns:
        counts = lit.where("segment = 'bead'").groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = (
            lit.groupBy(*keys, "color")
            .agg(F.count(F.lit(1)).alias("_n"), (F.min("z") == F.max("z")).alias("_one")).where("_one")
        )
    return counts.groupBy(*keys).agg(F.min_by("color", F.struct("_n", "color")).alias("color"))


def bead_frames(frames: DataFrame, keys: list[str], color: float | None = None) -> DataFrame:
    """First, last and middle fiducial frame per key, with their number."""
    rows = frames.where(F.col("segment").isin("bead", "end")) if "segment" in frames.columns else frames
    if color is not None:
        rows = rows.where(F.col("color") == float(color))
    else:
        rows = rows.join(bead_color(frames, keys), [*keys, "color"], "left_semi")
    got = rows.select(*keys, "frame").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("frame")).alias("_f"))
    return got.select(
        *keys, F.col("_f")[0].alias("first"), F.element_at("_f", -1).alias("last"),
        F.element_at("_f", (F.floor(F.size("_f") / 2) + 1).cast("int")).alias("middle"), F.size("_f").alias("n"),
    )


def fiducial_frame(frames: DataFrame, keys: list[str], color: float = 488.0) -> DataFrame:
    """Middle ``bead`` frame of the fiducial colour (without segments the first one at z = 0); none is an error."""
    mine = F.col("color") == float(color)
    seg = "segment" in frames.columns
    hit = mine & (F.col("segment") == "bead") if seg else mine & (F.col("z") == 0)
    got = frames.groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(hit, F.col("frame")))).alias("_f"))
    pick = F.element_at("_f", (F.floor(F.size("_f") / 2) + 1).cast("int")) if seg else F.col("_f")[0]
    return got.select(
        *keys, F.when(F.size("_f") > 0, pick).otherwise(
            F.raise_error(F.lit("no fiducial frame")).cast("int")).alias("frame")
    )


def blank_frames(channels: DataFrame, frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Blank frames of the movie that holds the first channel of the smallest colour, compared as text."""
    first = channels.groupBy(*keys).agg(
        F.min_by("movie", F.struct(F.col("color").cast("string"), F.col(order))).alias("movie")
    )
    return frames.where(F.col("color").isNull()).join(first, [*keys, "movie"], "left_semi")


def fov_subset(df: DataFrame, subset: DataFrame | None, key: str = "fov_id") -> DataFrame:
    """Keep the listed FOVs; no list keeps all."""
    return df if subset is None else df.join(subset.select(key).distinct(), key, "left_semi")


def series_at(files: Column, index: int) -> Column:
    """Element ``index`` of an array, clamped to the last one."""
    return F.try_element_at(files, F.least(F.lit(index + 1), F.size(files)))


def flag_incomplete(status: DataFrame) -> DataFrame:
    """Problem rows ordered by round and FOV."""
    return status.where(~F.col("status").isin("ok", "not_checked")).orderBy("round_id", "fov_id")


def keep_or_drop(fovs: DataFrame, max_damaged: float, drop_no_tissue: bool) -> DataFrame:
    """Flag FOVs to keep; unknown damage (NULL or NaN) never drops one."""
    damaged = F.nanvl(F.col("damaged_pct"), F.lit(None).cast("double"))
    bad = F.coalesce(damaged > float(max_damaged), F.lit(False))
    empty = F.coalesce(F.col("no_tissue"), F.lit(False)) & F.lit(drop_no_tissue)
    return fovs.withColumn("kept", ~bad & ~empty)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same rows; an error at run time when there are none."""
    n = df.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit(message)).cast("long")).otherwise(F.count(F.lit(1))))
    return df.where(n.scalar() > 0)


def shared_range(a: DataFrame, b: DataFrame, value: str, every: int) -> DataFrame:
    """Every n-th row of ``a`` (by value) inside the range that both tables cover."""
    def span(df):
        return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()

    inside = (
        a.withColumn("_a", span(a)).withColumn("_b", span(b))
        .where(F.col(value).between(F.greatest("_a.lo", "_b.lo"), F.least("_a.hi", "_b.hi"))).drop("_a", "_b")
    )
    return ordered_scan(inside, [], [value], row_number="_rn").where((F.col("_rn") - 1) % every == 0).drop("_rn")


def round_of_type(series: DataFrame, imaging_type: str) -> DataFrame:
    """First round having a series of the type (trimmed, any case); none is an error."""
    hit = F.lower(F.trim("imaging_type")) == imaging_type.strip().lower()
    m = F.min(F.when(hit, F.col("round_id")))
    return series.agg(
        F.when(m.isNotNull(), m).otherwise(F.raise_error(F.lit(f"no round of type {imaging_type}")).cast("int")).alias("round_id")
    )


def is_cells(imaging_type: str = "imaging_type", series: str = "series") -> Column:
    """A cells series: by its type, or by its name when the type is missing."""
    return F.coalesce(F.lower(F.trim(imaging_type)) == "cells", F.lower(F.col(series)).contains("cells"))
