"""Roles of the given tables (pixels, positions, clouds, ...) and the same mapping as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table; timestamps without zone become timestamps of the (UTC) session."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    plain = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def color_of(flag: str = "l_returnflag") -> Column:
    return F.when(F.col(flag) == "A", 405.0).when(F.col(flag) == "N", 560.0).otherwise(650.0)


def pixels(spark, folder) -> DataFrame:
    """lineitem as pixels of (fov, frame, color)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("fov_id"), F.col("l_linenumber").alias("frame"), color_of().alias("color"),
        F.col("l_quantity").cast("int").alias("value"),
    )


PX = """px AS (SELECT l_suppkey AS fov_id, l_linenumber AS frame,
  CASE l_returnflag WHEN 'A' THEN 405e0 WHEN 'N' THEN 560e0 ELSE 650e0 END AS color,
  CAST(l_quantity AS INTEGER) AS value FROM lineitem)"""
CT = PX + """, ct AS (SELECT fov_id, frame, color, value, count(*) AS count FROM px GROUP BY ALL)"""


def frame_table(spark, folder) -> DataFrame:
    """Distinct frames with z and segment."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("frame"), color_of().alias("color")
    ).distinct().withColumn("z", F.col("frame") * 0.5).withColumn(
        "segment", F.when(F.col("frame") == 1, "bead").otherwise("data")
    )


FT = """ft AS (SELECT DISTINCT l_linenumber AS frame,
  CASE l_returnflag WHEN 'A' THEN 405e0 WHEN 'N' THEN 560e0 ELSE 650e0 END AS color,
  l_linenumber * 0.5e0 AS z, CASE WHEN l_linenumber = 1 THEN 'bead' ELSE 'data' END AS segment FROM lineitem)"""


def positions(spark, folder) -> DataFrame:
    """supplier as stage positions on a 10-wide grid with holes."""
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").where(k % 17 != 0).select(
        k.alias("fov_id"), (200.0 * (k % 10)).alias("x"), (200.0 * F.floor(k / 10)).alias("y")
    )


PS = """ps AS (SELECT s_suppkey AS fov_id, 200e0 * (s_suppkey % 10) AS x, 200e0 * (s_suppkey // 10) AS y
  FROM supplier WHERE s_suppkey % 17 <> 0)"""


def cloud(spark, folder, name: str = "customer") -> DataFrame:
    """customer or part as a point cloud without coincident points in its first million rows."""
    key, vol = ("c_custkey", "c_acctbal") if name == "customer" else ("p_partkey", "p_retailprice")
    k = F.col(key)
    return table(spark, folder, name).select(
        k.alias("id"), (k * 37 % 997).cast("double").alias("x"), (k * 91 % 1009).cast("double").alias("y"),
        F.col(vol).alias("volume"),
    )


CLOUD = """cloud AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 997 AS DOUBLE) AS x,
  CAST(c_custkey * 91 % 1009 AS DOUBLE) AS y, c_acctbal AS volume FROM customer)"""
PCLOUD = """pcloud AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 997 AS DOUBLE) AS x,
  CAST(p_partkey * 91 % 1009 AS DOUBLE) AS y, p_retailprice AS volume FROM part)"""


def inventory(spark, folder) -> DataFrame:
    """orders as a file inventory."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("data/"), F.col("o_orderpriority"), F.lit("/hal_"), (F.col("o_orderkey") % 5 + 1).cast("string"),
                 F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".dax")).alias("path"),
        F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("owner"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("length"),
        F.col("o_orderdate").alias("modificationTime"),
    )


INV = """inv AS (SELECT 'data/' || o_orderpriority || '/hal_' || (o_orderkey % 5 + 1) || '_' || o_orderkey || '.dax' AS path,
  o_orderkey AS file_id, o_orderpriority AS owner, CAST(floor(o_totalprice * 100 + 0.5e0) AS BIGINT) AS length,
  o_orderdate AS modificationTime FROM orders)"""


def images(spark, folder) -> DataFrame:
    """embeddings as 8x8 frames in long form: frame, grp (label), r, c, v."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("label").alias("grp"), F.posexplode("embedding").alias("_p", "_e")
    ).select(
        "frame", "grp", F.floor(F.col("_p") / 8).cast("int").alias("r"), (F.col("_p") % 8).alias("c"),
        F.floor((F.col("_e").cast("double") + 1) * 1000).cast("int").alias("v"),
    )


IMG = """img AS (SELECT vec_id AS frame, label AS grp, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c,
  CAST(floor((CAST(e AS DOUBLE) + 1) * 1000) AS INTEGER) AS v FROM (
  SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def frames(spark, folder) -> DataFrame:
    """embeddings as binary frames: one row per frame, little-endian uint16 pixels."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("frame"), F.col("label").alias("grp"),
        F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 1000).cast("int")).alias("px"),
        F.lit(8).alias("h"), F.lit(8).alias("w"),
    )


def focus_log(spark, folder) -> DataFrame:
    """events as focus logs: one movie per user."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("movie"), F.col("event_id").alias("frame"), F.col("ts"),
        F.col("value").alias("stage_z"), (F.col("event_type") != "error").alias("good"),
    )


LOG = """log AS (SELECT user_id AS movie, event_id AS frame, ts, value AS stage_z, event_type <> 'error' AS good FROM events)"""


def mirrored_sql(i: str, n: int) -> str:
    """Index of a half-sample mirrored edge as SQL."""
    return f"(CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END)"


def blur_sql(src: str, key: str, n: int, sigma: float, name: str = "bl") -> str:
    """CTEs ending in ``name`` (key, r, c, v): the Gaussian blur, cut at four sigma, of n x n images ``src`` (key, r, c, v)."""
    reach, w = int(4 * sigma + 0.5), f"exp(-0.5e0 * pow(k / {sigma}e0, 2))"
    return f"""{name}_k AS (SELECT k, {w} / (SELECT sum({w}) FROM range({-reach}, {reach + 1}) t(k)) AS w FROM range({-reach}, {reach + 1}) t(k)),
  {name}_r AS (SELECT a.{key}, a.r, a.c, sum(w * b.v) AS v FROM {src} a CROSS JOIN {name}_k JOIN {src} b ON b.{key} = a.{key} AND b.c = a.c AND b.r = {mirrored_sql("a.r + k", n)} GROUP BY ALL),
  {name} AS (SELECT a.{key}, a.r, a.c, sum(w * b.v) AS v FROM {name}_r a CROSS JOIN {name}_k JOIN {name}_r b ON b.{key} = a.{key} AND b.r = a.r AND b.c = {mirrored_sql("a.c + k", n)} GROUP BY ALL)"""
