"""Frames of headerless uint16 stacks as a table (path, frame, h, w, pixels), read where the stacks lie.

The table is planned by Spark: its own listing gives the stacks, sidecars are text that tasks parse, frame numbers are exploded
from them. `pixels` is a column computed from the other four by range reads in Arrow batches, so a filter on any of them is pushed below
the read and a query without `pixels` opens no stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelight.sources.scratch import open_path
from stagelight.sources.text import parse_sidecars, path_exists, read_lines

#: Bytes of pixels in one Arrow batch (or one frame).
BATCH = 16 << 20


def read_pixels(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The bytes of each (path, frame, h, w); a file stays open while its frames follow one another."""
    name = file = None
    for columns in batches:
        held, size = [], 0
        for path, frame, h, w in zip(*(c.to_pylist() for c in columns)):
            if path != name:
                if file is not None:
                    file.close()
                store, place = open_path(path)
                name, file = path, store.open_input_file(place)
            n = 2 * h * w
            file.seek(frame * n)
            data = file.read(n)
            if len(data) < n:
                raise ValueError(f"short read at frame {frame} of {path}: {len(data)} of {n} bytes")
            held.append(data)
            size += n
            if size >= BATCH:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.binary())
    if file is not None:
        file.close()


def stem(path: Column) -> Column:
    """A path without its extension; local paths are spelled alike."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "file:/"), r"\.[^./]*$", "")


def decoded(path: Column) -> Column:
    """The path that a file's percent-encoded metadata names."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def list_stacks(spark: SparkSession, path: str, suffix: str = ".dax", frame_height: int | None = None, frame_width: int | None = None) -> DataFrame:
    """(path, h, w, n) of every stack below a folder or of a glob: sizes as given, else from the sidecar; n from the sidecar, else from the length.

    A stack without a size raises an error when its row is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    beside = path.removesuffix(suffix) + ".inf" if path.endswith(suffix) else path
    files = files.withColumn("_stem", stem(F.col("path")))
    if path_exists(spark, beside):
        known = parse_sidecars(read_lines(spark, beside, "*.inf")).select(stem(decoded(F.col("file"))).alias("_stem"), "frame_height", "frame_width", "n_frames")
        files = files.join(known, "_stem", "left")
    else:
        files = files.withColumns({c: F.lit(None).cast("int") for c in ("frame_height", "frame_width", "n_frames")})
    missing = F.raise_error(F.concat(F.lit("no frame size for "), "path", F.lit(": give frame_height and frame_width or a sidecar"))).cast("int")
    size = lambda given, c: F.coalesce(F.lit(given).cast("int"), F.nullif(F.col(c), F.lit(0)), missing)
    sized = files.select("path", "length", size(frame_height, "frame_height").alias("h"), size(frame_width, "frame_width").alias("w"), "n_frames")
    return sized.select("path", "h", "w", F.coalesce("n_frames", F.floor(F.col("length") / (2 * F.col("h") * F.col("w")))).cast("int").alias("n"))


def with_pixels(listed: DataFrame) -> DataFrame:
    """Listed frames (path, frame, h, w) with their bytes, read when the column is used."""
    return listed.withColumn("pixels", F.arrow_udf(read_pixels, "binary")("path", "frame", "h", "w"))


def read_frames(spark: SparkSession, path: str, suffix: str = ".dax", frame_height: int | None = None, frame_width: int | None = None,
                frames: str | None = None, frames_per_partition: int = 64) -> DataFrame:
    """Frames of all stacks; ``frames="0,5"`` gives only those of each stack, in that order.

    Ranges of frames are dealt to as many partitions as their bytes need; the count that decides this is the one job at plan time.
    """
    stacks = list_stacks(spark, path, suffix, frame_height, frame_width)
    per = int(frames_per_partition)
    chosen = [int(x) for x in str(frames).split(",")] if frames is not None else None
    total = F.lit(len(chosen)) if chosen else F.col("n")
    ranges = stacks.where(total > 0).select("path", "h", "w", "n", F.explode(F.sequence(F.lit(0), (total - 1).cast("int"), F.lit(per))).alias("first"))
    count, size = ranges.agg(F.count("*"), F.sum(2.0 * per * F.col("h") * F.col("w"))).first()
    at_once = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = max(1, min(count, max(spark.sparkContext.defaultParallelism, math.ceil((size or 0) / at_once))))
    dealt = ranges.repartition(parts, "path", "first").sortWithinPartitions("path", "first")
    wanted = F.slice(F.array(*[F.lit(i) for i in chosen]), F.col("first") + 1, per) if chosen else F.sequence("first", F.least(F.col("first") + per, "n") - 1)
    listed = dealt.select("path", F.explode(wanted.cast("array<int>")).alias("frame"), "h", "w")
    return with_pixels(listed)


def in_chunks(batches: Iterator[pa.RecordBatch], keys: list[str], one: Callable[[np.ndarray, dict], dict[str, np.ndarray]], limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The arrays that ``one`` makes of each frame's pixels, with the frame's keys, in output batches of about ``limit`` rows."""
    for b in batches:
        pixels, rest = b.column("pixels"), b.select([c for c in b.schema.names if c != "pixels"])
        first, made, rows = 0, [], 0
        facts = rest.to_pylist()
        for i in range(b.num_rows):
            made.append(one(np.frombuffer(pixels[i].as_buffer(), "<u2"), facts[i]))
            rows += len(next(iter(made[-1].values())))
            if rows >= limit or i == b.num_rows - 1:
                at = pa.array(np.repeat(np.arange(first, i + 1), [len(next(iter(m.values()))) for m in made]))
                arrays = [b.column(k).take(at) for k in keys] + [pa.array(np.concatenate([m[c] for m in made])) for c in made[0]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *made[0]])
                first, made, rows = i + 1, [], 0


def explode_pixels(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Long pixels (keys, r, c, v) of binary frames, decoded inside tasks."""

    def cells(v: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        r, c = np.divmod(np.arange(v.size, dtype=np.int32), np.int32(row["w"]))
        return {"r": r, "c": c, "v": v.astype(np.int32)}

    kept = frames.select(*keys, *[c for c in ("w", "pixels") if c not in keys])
    fields = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInArrow(lambda batches: in_chunks(batches, keys, cells), f"{fields}, r INT, c INT, v INT")


def frame_counters(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Exact counters straight from binary frames: each frame is reduced to distinct values before any shuffle."""

    def levels(v: np.ndarray, row: dict) -> dict[str, np.ndarray]:
        if v.size < 4096:
            values, n = np.unique(v, return_counts=True)
        else:
            n = np.bincount(v)
            values = np.flatnonzero(n)
            n = n[values]
        return {"value": values.astype(np.int32), "count": n.astype(np.int64)}

    kept = frames.select(*keys, "pixels")
    fields = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    counted = kept.mapInArrow(lambda batches: in_chunks(batches, keys, levels), f"{fields}, value INT, count BIGINT")
    return counted.groupBy(*keys, "value").agg(F.sum("count").alias("count"))


def extract_frames(frames: DataFrame, keep: DataFrame, out: str) -> DataFrame:
    """Write only the listed frames (path, frame) of :func:`read_frames` as a compact table and return the renumbered frame list.

    The list is joined and numbered first, so no pixels are shuffled. A stack has a few hundred frames, so the window per stack is small.
    """
    listed = frames.drop("pixels").join(keep.select("path", "frame").distinct(), ["path", "frame"], "left_semi")
    w = Window.partitionBy("path").orderBy("frame")
    numbered = listed.withColumn("new_frame", (F.row_number().over(w) - 1).cast("int"))
    with_pixels(numbered).write.mode("overwrite").parquet(out)
    return frames.sparkSession.read.parquet(out).select("path", "frame", "new_frame")
