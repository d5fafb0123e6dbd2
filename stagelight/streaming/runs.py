"""Incremental operators: the stream checkpoint replaces marker files, result tables are written per batch.

Every ``foreachBatch`` sink writes its rows under a ``batch_id`` partition that a repeated batch overwrites, so a restart
never doubles rows. What earlier batches left is kept per key in the state store (``state.py``): no batch reads a result
table, so its work follows its own rows and not the length of the run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stagelight.operators.windows import first_per_key
from stagelight.sources.text import path_exists
from stagelight.streaming.state import CountUp, EnoughRows, FixedRange, StableSize, keyed_state, plainly_named, rows_of_new_keys, unfinished_rows


def read_arrivals(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as they arrive; each is taken exactly once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").format(fmt).load(folder)


def discover_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, length, modificationTime) of new files; contents are not read."""
    schema = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    return read_arrivals(spark, folder, schema, "binaryFile", files_per_batch).select("path", "length", "modificationTime")


def put_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of a result table; a repeated batch replaces its own rows only."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def get_table(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of a result table, of earlier batches only when ``before`` is given; a missing table is empty."""
    full = f"{schema}, batch_id LONG"
    df = spark.read.schema(full).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], full)
    return df if before is None else df.where(F.col("batch_id") < before)


def run_to_end(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take everything that is there now in batches, then stop; running again continues where it stopped. Returns the ended query."""
    with keyed_state(stream.sparkSession):
        q = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def start_polling(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """Keep polling; the returned query is stopped by the caller."""
    with keyed_state(stream.sparkSession):
        return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def analyse_arrivals(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], results: str, checkpoint: str) -> None:
    """Analyse every new input once and append its result rows."""
    run_to_end(stream, lambda df, n: put_batch(analyse(df), results, n), checkpoint)


def stable_paths(observations: DataFrame, keep_hours: float | None = None) -> DataFrame:
    """Paths whose size was equal and not zero in two successive observations (path, tick, size); each comes out once.

    State is the last size of a path. With ``keep_hours`` a path that was not seen for so long is forgotten; seen again, it starts anew.
    """
    ttl = None if keep_hours is None else int(keep_hours * 3_600_000)
    return observations.select("path", "tick", "size").groupBy("path").transformWithStateInPandas(
        StableSize(ttl), "path STRING, size LONG, tick LONG", "append", "none" if ttl is None else "processingTime")


def session_parts(arrivals: DataFrame, keys: list[str], ts: str = "ts", gap: str = "180 seconds") -> DataFrame:
    """Bursts (start, last, n) within the rows of one batch: gaps shorter than ``gap``."""
    g = arrivals.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return g.select(*keys, F.col("session_window.start").alias("start"), "last", "n")


def imaging_sessions(parts: DataFrame, keys: list[str], gap_s: float = 180.0) -> DataFrame:
    """Bursts (start, last, n) over all batches, the open ones too: parts that overlap or lie closer than the gap are one.

    A batch adds only its own bursts, however late its rows are, so nothing is dropped and no event-time limit is needed.
    """
    order = Window.partitionBy(*keys).orderBy("start", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start").cast("double") - reached.cast("double") < gap_s, 0).otherwise(1)
    numbered = parts.withColumn("_new", new).withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_k").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_k")


def phase_of(idle_s, t_min: float, t_max: float):
    """Phase from the seconds since the last file: imaging, fluidics (with room for work between the limits), waiting."""
    return (
        F.when(idle_s.isNull(), "waiting").when(idle_s < t_min, "imaging").when(idle_s <= t_max, "fluidics").otherwise("fluidics_late"))


def live_phase(last_file: DataFrame, now, t_min: float = 180.0, t_max: float = 6000.0) -> DataFrame:
    """Phase at ``now`` from a table with the time of the last file (NULL before the first)."""
    idle = (now.cast("double") - F.col("last").cast("double"))
    return last_file.withColumn("idle_s", idle).withColumn("phase", phase_of(F.col("idle_s"), t_min, t_max))


FIRED = "round_id LONG"


def round_trigger(stream: DataFrame, expected: DataFrame, fired: str, checkpoint: str) -> StreamingQuery:
    """Fire each round once, when all its expected FOVs (round_id, n_expected) have arrived; repeats of a FOV count once.

    Repeats are dropped by (round, FOV), which spreads a large round; a round's own state is one number.
    """
    new = stream.select("round_id", "fov_id").dropDuplicates(["round_id", "fov_id"])
    counted = new.join(expected.select("round_id", F.col("n_expected").cast("long").alias("n_expected")), "round_id").select("round_id", "n_expected")
    full = counted.groupBy("round_id").transformWithStateInPandas(CountUp("round_id", "n_expected"), FIRED, "append", "none")
    return run_to_end(full, lambda df, n: put_batch(df, fired, n), checkpoint)


def summary_cache(stream: DataFrame, keys: list[str], summarise: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str, old: DataFrame | None = None) -> StreamingQuery:
    """Append the summary of keys not in the cache yet. ``old`` has keys of an earlier cache, to be given at every start; a negative FOV id there counts as 0."""
    if old is not None and "fov_id" in keys:
        old = old.withColumn("fov_id", F.when(F.col("fov_id") == -1, 0).otherwise(F.col("fov_id")))
    return run_to_end(rows_of_new_keys(stream, keys, old), lambda df, n: put_batch(summarise(df), cache, n), checkpoint)


def compute_once(stream: DataFrame, key: str, min_samples: int, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Compute a key's result once, in the first batch after which it has enough samples; later samples change nothing.

    Samples wait in the key's state, which is emptied when the result is computed.
    """
    plain, back = plainly_named(stream)
    own = f"c{stream.columns.index(key)}"
    kept = [c for c in plain.columns if c != own]
    waiting = plain.groupBy(own).transformWithStateInPandas(EnoughRows(own, kept, plain.select(*kept).schema, min_samples), plain.schema, "append", "none")
    return run_to_end(waiting.select(*back), lambda df, n: put_batch(compute(df), out, n), checkpoint)


def live_tiles(stream: DataFrame, group: str, min_tiles: int, tiles: str, ranges: str, checkpoint: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Collect tiles (group, tile_id, v) and fix one contrast range per group once it has ``min_tiles`` tiles.

    Two streams over the same source: one appends the tiles, one keeps a group's range and fewer than ``min_tiles`` tile ids until
    the range is fixed. Read the mosaic with :func:`render_tiles`: tiles without a shared range are provisional until one
    exists, then all of the group render with it; no tile is written twice.
    """
    written = run_to_end(stream, lambda df, n: put_batch(df, tiles, n), f"{checkpoint}/tiles")
    kind = stream.schema[group].dataType
    named = stream.select(F.col(group).cast("string").alias(group), F.col("tile_id").cast("string").alias("tile_id"), F.col("v").cast("double").alias("v"))
    fixed = named.groupBy(group).transformWithStateInPandas(FixedRange(group, min_tiles), f"{group} STRING, lo DOUBLE, hi DOUBLE", "append", "none")
    return written, run_to_end(fixed.withColumn(group, F.col(group).cast(kind)), lambda df, n: put_batch(df, ranges, n), f"{checkpoint}/ranges")


def dict_of(schema: str) -> dict[str, str]:
    return dict(part.strip().split(" ", 1) for part in schema.split(","))


def render_tiles(spark: SparkSession, group: str, tiles: str, tile_schema: str, ranges: str) -> DataFrame:
    """Latest version of each tile, stretched by the shared range of its group, or by its own value (provisional)."""
    from stagelight.functions.scalar import contrast_stretch

    t = first_per_key(get_table(spark, tiles, tile_schema).withColumn("_neg", -F.col("batch_id")), [group, "tile_id"], ["_neg", "v"]).drop("_neg", "batch_id")
    r = get_table(spark, ranges, f"{group} {dict_of(tile_schema)[group]}, lo DOUBLE, hi DOUBLE").drop("batch_id")
    j = t.join(r, group, "left")
    return j.select(
        group, "tile_id", "v", F.col("lo").isNull().alias("provisional"),
        F.when(F.col("lo").isNull(), F.lit(0)).otherwise(contrast_stretch("v", F.col("lo"), F.col("hi"))).alias("v8"))


def take_late_and_partial(stream: DataFrame, keys: list[str], is_complete: Column, results: str, retry: str, checkpoint: str) -> StreamingQuery:
    """Accept complete rows whenever they come (no cut-off in event time); incomplete ones wait in a retry table.

    A key that was incomplete before and arrives complete later is accepted then; accepted keys are never taken again.
    """

    def on_batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        rows = [c for c in df.columns if c != "_done"]
        good = first_per_key(df.where("_done").select(*rows), keys, [c for c in rows if c not in keys])
        put_batch(good.select(*rows), results, n)
        put_batch(df.where("NOT _done").select(*rows).join(good.select(*keys), keys, "left_anti").select(*rows), retry, n)
        df.unpersist()

    return run_to_end(unfinished_rows(stream, keys, is_complete), on_batch, checkpoint)


def still_waiting(spark: SparkSession, keys: list[str], results: str, retry: str, schema: str) -> DataFrame:
    """Keys seen only incomplete so far."""
    return get_table(spark, retry, schema).select(*keys).distinct().join(get_table(spark, results, schema).select(*keys), keys, "left_anti")


def rate_parts(arrivals: DataFrame, keys: list[str], ts: str = "ts", width: str = "60 seconds", slide: str | None = None) -> DataFrame:
    """Arrivals of one batch per tumbling (or sliding) window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return arrivals.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def arrival_rate(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Arrivals per window over all batches, open windows and late rows included: counts of batches add up."""
    return parts.groupBy(*keys, "start").agg(F.sum("n").alias("n"))
