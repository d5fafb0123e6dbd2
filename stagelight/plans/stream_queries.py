"""Streaming queries: the events table arrives as one file per day, in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelight.operators.aggregate import stage_z_summary
from stagelight.plans.registry import query
from stagelight.plans.tables import table
from stagelight.sources.scratch import scratch_dir
from stagelight.streaming import runs as R

EVENT = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE"


def arrivals(spark, d, columns=("event_id", "ts", "user_id", "event_type", "value"), days: int = 8):
    """A folder of daily event files and the stream reading it."""
    folder = scratch_dir(spark)
    e = table(spark, d, "events").select(*columns)
    day = F.floor((F.col("ts").cast("double") - 1704067200) / 86400).cast("int")
    e.withColumn("day", day).repartition("day").write.partitionBy("day").parquet(folder + "/in")
    kinds = R.dict_of(EVENT)
    stream = R.read_arrivals(spark, folder + "/in", ", ".join(f"{c} {kinds[c]}" for c in columns), files_per_batch=days)
    return folder, stream


@query("X1_continuous_discovery", """SELECT CAST(floor((epoch(ts) - 1704067200) / 86400) AS INTEGER) AS day, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_id FROM events GROUP BY ALL""")
def _(spark, d):
    folder, stream = arrivals(spark, d)
    day = F.floor((F.col("ts").cast("double") - 1704067200) / 86400).cast("int").alias("day")
    R.analyse_arrivals(stream, lambda df: df.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")), folder + "/out", folder + "/cp")
    return R.get_table(spark, folder + "/out", "day INT, n LONG, last_id LONG").drop("batch_id")


@query("X2_stability_gate", """WITH o AS (SELECT user_id AS path, event_id AS tick, CAST(floor(value / 10) AS BIGINT) AS size, lag(CAST(floor(value / 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
  SELECT 'f' || path AS path, arg_min(size, tick) AS size, min(tick) AS tick FROM o WHERE size = p AND size > 0 GROUP BY path""")
def _(spark, d):
    folder = scratch_dir(spark)
    # observations arrive in tick order: the file name carries the batch
    o = table(spark, d, "events").select(
        F.concat(F.lit("f"), F.col("user_id")).alias("path"), F.col("event_id").alias("tick"), F.floor(F.col("value") / 10).alias("size"))
    last = o.agg(F.max("tick")).scalar()
    o = o.withColumn("_m", last).withColumn("part", F.floor(F.col("tick") * 4 / (F.col("_m") + 1)).cast("int")).drop("_m")
    for i in range(4):
        o.where(F.col("part") == i).drop("part").write.parquet(f"{folder}/in/p{i}")
        s = R.stable_paths(R.read_arrivals(spark, folder + "/in", "path STRING, tick LONG, size LONG"))
        R.run_to_end(s, lambda df, n: R.put_batch(df, folder + "/out", n), folder + "/cp")
    return R.get_table(spark, folder + "/out", "path STRING, size LONG, tick LONG").drop("batch_id")


@query("X3_phase_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), b AS (SELECT user_id, k, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY ALL)
  SELECT user_id, round(epoch(a), 3) AS start_s, round(epoch(z), 3) AS last_s, n FROM b""")
def _(spark, d):
    folder, stream = arrivals(spark, d, ("ts", "user_id"), days=100)
    R.run_to_end(stream, lambda df, n: R.put_batch(R.session_parts(df, ["user_id"], gap="6 hours"), folder + "/out", n), folder + "/cp")
    out = R.imaging_sessions(R.get_table(spark, folder + "/out", "user_id LONG, start TIMESTAMP, last TIMESTAMP, n LONG"), ["user_id"], 6 * 3600.0)
    sec = lambda c: F.round(F.col(c).cast("double"), 3)
    return out.select("user_id", sec("start").alias("start_s"), sec("last").alias("last_s"), "n")


@query("X3_live_phase", """WITH m AS (SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) AS idle FROM events GROUP BY ALL)
  SELECT user_id, CASE WHEN idle < 7200 THEN 'imaging' WHEN idle <= 86400 THEN 'fluidics' ELSE 'fluidics_late' END AS phase FROM m""")
def _(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return R.live_phase(last, F.lit("2024-01-31 00:00:00").cast("timestamp"), 7200, 86400).select("user_id", "phase")


@query("X4_round_completion_trigger", """WITH s AS (SELECT user_id AS round_id, count(DISTINCT event_id % 40) AS n FROM events GROUP BY ALL) SELECT round_id FROM s WHERE n >= 30 + round_id % 7""")
def _(spark, d):
    folder, stream = arrivals(spark, d)
    expected = table(spark, d, "events").select(F.col("user_id").alias("round_id")).distinct().withColumn("n_expected", 30 + F.col("round_id") % 7)
    s = stream.select(F.col("user_id").alias("round_id"), (F.col("event_id") % 40).alias("fov_id"))
    R.round_trigger(s, expected, folder + "/fired", folder + "/cp")
    return R.get_table(spark, folder + "/fired", R.FIRED).select("round_id")


@query("X5_incremental_summary_cache", """WITH e AS (SELECT user_id, CAST(floor((epoch(ts) - 1704067200) / 86400) AS BIGINT) AS day, event_id, value FROM events)
  SELECT user_id AS fov_id, day AS series, arg_min(value, event_id) AS first_stage_z, min(value) AS min_stage_z, max(value) AS max_stage_z, min(value) = max(value) AS all_same FROM e GROUP BY ALL""")
def _(spark, d):
    folder, stream = arrivals(spark, d)
    s = stream.select(F.col("user_id").alias("fov_id"), F.floor((F.col("ts").cast("double") - 1704067200) / 86400).alias("series"), F.col("event_id").alias("frame"), F.col("value").alias("stage_z"))
    schema = "fov_id LONG, series LONG, first_stage_z DOUBLE, min_stage_z DOUBLE, max_stage_z DOUBLE, all_same BOOLEAN"
    for _ in range(2):  # the second run finds nothing new
        R.summary_cache(s, ["fov_id", "series"], lambda df: stage_z_summary(df, ["fov_id", "series"]), folder + "/out", folder + "/cp")
    return R.get_table(spark, folder + "/out", schema).drop("batch_id")


@query("X6_compute_once_per_key", """SELECT user_id, true AS enough FROM events GROUP BY user_id HAVING count(*) >= 60""")
def _(spark, d):
    folder, stream = arrivals(spark, d, ("ts", "user_id", "value"))
    s = stream.select("user_id", "value")
    compute = lambda df: df.groupBy("user_id").agg(F.avg("value").alias("field"), F.count(F.lit(1)).alias("n_samples"))
    out_schema = "user_id LONG, field DOUBLE, n_samples LONG"
    R.compute_once(s, "user_id", 60, compute, folder + "/out", folder + "/cp")
    return R.get_table(spark, folder + "/out", out_schema).select("user_id", (F.col("n_samples") >= 60).alias("enough"))


@query("X7_live_tile_upsert", """WITH n AS (SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY ALL) SELECT user_id, event_id AS tile_id, value AS v, n < 65 AS provisional FROM events JOIN n USING (user_id)""")
def _(spark, d):
    folder, stream = arrivals(spark, d)
    s = stream.select("user_id", F.col("event_id").alias("tile_id"), F.col("value").alias("v"))
    schema = "user_id LONG, tile_id LONG, v DOUBLE"
    R.live_tiles(s, "user_id", 65, folder + "/tiles", folder + "/ranges", folder + "/cp")
    return R.render_tiles(spark, "user_id", folder + "/tiles", schema, folder + "/ranges").drop("v8")


LATE = """k AS (SELECT event_id % 3000 AS key, event_id, event_type <> 'error' AS ok FROM events)"""


def late_tables(spark, d):
    folder, stream = arrivals(spark, d)
    s = stream.select((F.col("event_id") % 3000).alias("key"), "event_type")
    schema = "key LONG, event_type STRING"
    R.take_late_and_partial(s, ["key"], F.col("event_type") != "error", folder + "/out", folder + "/retry", folder + "/cp")
    return folder, schema


@query("X8_late_data_accepted", f"WITH {LATE} SELECT DISTINCT key FROM k WHERE ok")
def _(spark, d):
    folder, schema = late_tables(spark, d)
    return R.get_table(spark, folder + "/out", schema).select("key")


@query("X8_still_waiting", f"WITH {LATE} SELECT key FROM k GROUP BY key HAVING NOT bool_or(ok)")
def _(spark, d):
    folder, schema = late_tables(spark, d)
    return R.still_waiting(spark, ["key"], folder + "/out", folder + "/retry", schema)


@query("X9_windowed_rate", """WITH w AS (SELECT event_type, floor(epoch(ts) / 3600) * 3600 AS start_s, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, start_s, n FROM w""")
def _(spark, d):
    folder, stream = arrivals(spark, d, ("ts", "event_type"), days=100)
    R.run_to_end(stream, lambda df, n: R.put_batch(R.rate_parts(df, ["event_type"], width="1 hour"), folder + "/out", n), folder + "/cp")
    out = R.arrival_rate(R.get_table(spark, folder + "/out", "event_type STRING, start TIMESTAMP, n LONG"), ["event_type"])
    return out.select("event_type", F.col("start").cast("double").alias("start_s"), "n")


@query("X9_sliding_rate", """WITH w AS (SELECT (floor(epoch(ts) / 1800) - i) * 1800 AS start_s, count(*) AS n FROM events, range(2) t(i) GROUP BY ALL) SELECT start_s, n FROM w""")
def _(spark, d):
    folder, stream = arrivals(spark, d, ("ts", "event_type"), days=100)
    R.run_to_end(stream, lambda df, n: R.put_batch(R.rate_parts(df, [], width="1 hour", slide="30 minutes"), folder + "/out", n), folder + "/cp")
    return R.arrival_rate(R.get_table(spark, folder + "/out", "start TIMESTAMP, n LONG"), []).select(F.col("start").cast("double").alias("start_s"), "n")
