"""Source and sink queries: files are derived from the given tables by Spark, then read back."""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from stagelight.plans.registry import query
from stagelight.plans.select_queries import FTB, fov_frames
from stagelight.plans.tables import IMG, INV, frames, inventory, r6, table
from stagelight.sources import inventory as V
from stagelight.sources import raw_frames as R
from stagelight.sources import text as X
from stagelight.sources import xml as M
from stagelight.sources.scratch import open_path, scratch_dir


def write_docs(df, column: str, folder: str, by: str) -> str:
    """One text file ``by=value.txt`` per value of ``by``, its rows in order of their line number.

    Tasks stream files under a passing name and rename them when they are whole, so neither a commit nor a listing meets one folder per value.
    """
    def write(parts):
        number = TaskContext.get().partitionId()
        store, place = open_path(f"{folder}/{number:05d}")
        store.create_dir(place, recursive=True)
        name, out, n = None, None, 0

        def close():
            out.close()
            store.move(f"{place}/_{number}", f"{place}/{by}={quote(str(name), safe='')}.txt")

        for pdf in parts:
            values = pdf["by"].to_numpy()
            cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
            for i, j in zip(cuts, cuts[1:]):
                if out is None or values[i] != name:
                    if out is not None:
                        close()
                    name, out, n = values[i], store.open_output_stream(f"{place}/_{number}"), n + 1
                out.write(("\n".join(pdf["value"].iloc[i:j]) + "\n").encode())
        if out is not None:
            close()
        yield pd.DataFrame({"n": [n]})

    rows = df.repartition(by).sortWithinPartitions(by, "_line").select(F.col(by).cast("string").alias("by"), F.coalesce(column, F.lit("")).alias("value"))
    rows.mapInPandas(write, "n LONG").agg(F.sum("n")).collect()
    return folder


@query("S1_read_round_table", """SELECT CAST(c_custkey AS INTEGER) AS round_id, c_mktsegment AS series, CASE WHEN c_custkey % 2 = 0 THEN 'own/' || c_custkey ELSE 'old/' || c_custkey END AS data_dir, CAST(c_nationkey AS VARCHAR) AS extra FROM customer""")
def _(spark, d):
    k = F.col("c_custkey")
    out = scratch_dir(spark)
    table(spark, d, "customer").select(
        k.alias("imaging_round"), F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("series"),
        F.when(k % 2 == 0, F.concat(F.lit("own/"), k)).alias("data_dir"), F.concat(F.lit("old/"), k).alias("dir"), F.col("c_nationkey").alias("extra"),
    ).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(out)
    return X.read_round_table(spark, out).select("round_id", "series", "data_dir", "extra")


@query("S2_read_positions", """WITH p AS (SELECT s_nationkey AS tissue, s_suppkey, s_suppkey * 1.5e0 AS x, s_acctbal AS y FROM supplier WHERE s_suppkey % 7 <> 0)
  SELECT tissue, row_number() OVER (PARTITION BY tissue ORDER BY s_suppkey) - 1 AS fov_id, x, y FROM p""")
def _(spark, d):
    k = F.col("s_suppkey")
    good = F.concat((k * 1.5).cast("string"), F.lit(" , "), F.col("s_acctbal").cast("string"), F.lit(" # note"))
    bad = F.element_at(F.array(F.lit("# comment"), F.lit(""), F.lit("12.5"), F.lit("a,b")), (k % 4 + 1).cast("int"))
    lines = table(spark, d, "supplier").select(F.col("s_nationkey").alias("tissue"), k.alias("_line"), F.when(k % 7 == 0, bad).otherwise(good).alias("value"))
    p = X.read_positions(spark, write_docs(lines, "value", scratch_dir(spark), "tissue"))
    return p.select(F.regexp_extract("file", r"tissue=(\d+)", 1).cast("int").alias("tissue"), "fov_id", "x", "y")


@query("S3_read_focus_log", """WITH e AS (SELECT *, user_id % 5 = 0 AS broken FROM events) SELECT user_id AS movie, CAST(event_id AS INTEGER) AS frame, value AS stage_z, event_type <> 'error' AS good FROM e WHERE NOT broken""")
def _(spark, d):
    e = table(spark, d, "events")
    row = F.concat_ws("  ", F.col("event_id").cast("string"), F.lit("0.1"), F.lit("200"), F.col("value").cast("string"), (F.col("event_type") != "error").cast("int").cast("string"))
    cut = F.when((F.col("user_id") % 5 == 0), F.substring_index(row, "  ", 3)).otherwise(row)  # truncated lines in every fifth movie
    body = e.select(F.col("user_id").alias("movie"), F.col("event_id").alias("_line"), cut.alias("value"))
    head = e.select(F.col("user_id").alias("movie")).distinct().select("movie", F.lit(-1).cast("long").alias("_line"), F.lit("frame offset power stage-z good-offset").alias("value"))
    logs = X.read_focus_logs(spark, write_docs(head.unionByName(body), "value", scratch_dir(spark), "movie"))
    return logs.select(F.regexp_extract("file", r"movie=(\d+)", 1).cast("long").alias("movie"), "frame", "stage_z", "good")


@query("S4_read_frame_table", f"""WITH {FTB} SELECT fov_id % 2 AS layout, CAST(frame AS INTEGER) AS frame, color, z, CASE WHEN fov_id % 2 = 0 THEN segment END AS segment FROM fb""")
def _(spark, d):
    ft = fov_frames(spark, d)
    out = scratch_dir(spark)
    a = ft.where("fov_id % 2 = 0").select("frame", "color", F.lit(None).cast("int").alias("channel"), "z", "segment")
    b = ft.where("fov_id % 2 = 1").select("frame", "z", "color")
    for i, t in enumerate((a, b)):
        t.write.option("header", "true").csv(f"{out}/layout={i}")
    r = X.read_frame_tables(spark, out)
    return r.select(F.regexp_extract("file", r"layout=(\d)", 1).cast("long").alias("layout"), "frame", "color", "z", "segment")


@query("S5_read_codebook", """WITH g AS (SELECT p_brand AS book, p_partkey, [CAST(p_partkey >> i & 1 AS INTEGER) for i in range(8)] AS code FROM part)
  SELECT book AS codebook, 'g' || p_partkey AS gene, CAST(i AS INTEGER) AS bit, 'RS' || i AS bit_name, code[i] = 1 AS "on" FROM g, range(1, 9) t(i)""")
def _(spark, d):
    k = F.col("p_partkey")
    code = F.concat(*[(F.shiftright(k, i) % 2).cast("string") for i in range(8)])
    p = table(spark, d, "part")
    body = p.select(F.regexp_replace("p_brand", "#", "-").alias("book"), k.alias("_line"), F.concat(F.lit("g"), k, F.lit(", , "), code).alias("value"))
    heads = ["version, 1.0", "codebook_name, ", "bit_names, " + ", ".join(f"RS{i}" for i in range(1, 9)), "name, id, barcode"]
    top = F.explode(F.array(*[F.struct(F.lit(i - 4).cast("long").alias("_line"), F.lit(h).alias("value")) for i, h in enumerate(heads)]))
    head = p.select(F.regexp_replace("p_brand", "#", "-").alias("book"), F.col("p_brand")).distinct().select("book", "p_brand", top.alias("_t")).select(
        "book", "_t._line", F.when(F.col("_t._line") == -3, F.concat("_t.value", "p_brand")).otherwise(F.col("_t.value")).alias("value"))
    b = X.read_codebooks(spark, write_docs(head.unionByName(body), "value", scratch_dir(spark), "book"))
    return b.select("codebook", "gene", "bit", "bit_name", "on")


@query("S6_read_bit_name_maps", """SELECT CAST(p_partkey AS INTEGER) AS bit, CASE WHEN p_partkey % 3 = 0 THEN 'own' || p_partkey ELSE p_name END AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)""")
def _(spark, d):
    p, out, k = table(spark, d, "part"), scratch_dir(spark), F.col("p_partkey")
    p.where(k % 2 == 0).select(k.alias("bit"), F.col("p_name").alias("gene_name")).write.option("header", "true").csv(out + "/default")
    p.where(k % 3 == 0).select(k.alias("bit"), F.concat(F.lit("own"), k).alias("gene_name")).write.option("header", "true").csv(out + "/own")
    imaged = table(spark, d, "lineitem").select(F.col("l_partkey").cast("int").alias("bit")).distinct()
    return X.merge_bit_names(X.read_bit_names(spark, out + "/default"), X.read_bit_names(spark, out + "/own"), imaged)


@query("S7_file_inventory", """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey % 50 AS store, CAST(sum(n) AS BIGINT) AS n_rows FROM f GROUP BY ALL""")
def _(spark, d):
    out = scratch_dir(spark)
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("store"), F.lit("1234567").alias("value"))
    o.repartition(8, "store").write.partitionBy("store").text(out + "/s.zarr.tmp")
    # eight bytes per row, so the summed size of a store tells its row count
    inv = V.list_files(spark, out).withColumn("path", F.regexp_replace("path", r"store=(\d+)/", "store$1.zarr/"))
    inv = V.file_inventory(inv.withColumn("path", F.regexp_replace("path", r"s\.zarr\.tmp", "s")), ".zarr")
    return inv.select(F.regexp_extract("path", r"store(\d+)\.zarr", 1).cast("long").alias("store"), (F.col("length") / 8).cast("long").alias("n_rows"))


def write_stacks(spark, d) -> str:
    """64 frames per raw stack, with a sidecar; each task writes whole files under their final name."""
    folder = scratch_dir(spark)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        store, place = open_path(folder)
        store.create_dir(place, recursive=True)
        pdf = pdf.sort_values("frame")
        name = f"{place}/hal_{int(pdf['stack'].iloc[0])}"
        for part, end, data in (("-side", ".inf", f"frame dimensions = 8 x 8 ; size\nnumber of frames = {len(pdf)}\nbinning = 1 x 1\n".encode()), ("-part", ".dax", np.stack(pdf["px"].to_numpy()).astype("<u2").tobytes())):
            with store.open_output_stream(name + part) as out:
                out.write(data)
            store.move(name + part, name + end)
        return pd.DataFrame({"stack": pdf["stack"].iloc[:1], "n": [len(pdf)]})

    f = frames(spark, d).select(F.floor(F.col("frame") / 64).alias("stack"), "frame", "px")
    f.groupBy("stack").applyInPandas(write, "stack LONG, n LONG").agg(F.sum("n")).collect()
    return folder


STACK = r"hal_(\d+)\."


@query("S8_raw_frame_source", f"""WITH {IMG} SELECT frame, r, c, v FROM img WHERE frame % 64 BETWEEN 3 AND 40""")
def _(spark, d):
    f = R.read_frames(spark, write_stacks(spark, d)).where("frame >= 3 and frame <= 40")
    px = R.explode_pixels(f, ["path", "frame"])
    return px.select((F.regexp_extract("path", STACK, 1).cast("long") * 64 + F.col("frame")).alias("frame"), "r", "c", "v")


@query("S8_counters_from_frames", f"""WITH {IMG} SELECT frame, v AS value, count(*) AS count FROM img GROUP BY ALL""")
def _(spark, d):
    f = R.read_frames(spark, write_stacks(spark, d))
    c = R.frame_counters(f, ["path", "frame"])
    return c.select((F.regexp_extract("path", STACK, 1).cast("long") * 64 + F.col("frame")).alias("frame"), "value", "count")


@query("S9_read_stack_sidecar", """SELECT vec_id // 64 AS stack, 8 AS frame_width, 8 AS frame_height, CAST(count(*) AS INTEGER) AS n_frames, '1 x 1' AS binning FROM embeddings GROUP BY ALL""")
def _(spark, d):
    s = X.parse_sidecars(X.read_lines(spark, write_stacks(spark, d), "*.inf"))
    return s.select(F.regexp_extract("file", STACK, 1).cast("long").alias("stack"), "frame_width", "frame_height", "n_frames", F.try_element_at("fields", F.lit("binning")).alias("binning"))


@query("S10_collect_sample_records", """SELECT 'sample_' || s_suppkey AS sample_name, '' AS project, CASE WHEN s_suppkey % 2 = 0 THEN 'MF3' ELSE '' END AS microscope, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS fix_type, CAST(NULL AS VARCHAR) AS absent FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    lines = F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("_line"), F.concat(F.lit("sample_name: 'sample_"), k, F.lit("'")).alias("value")),
        F.struct(F.lit(1).alias("_line"), F.when(k % 2 == 0, "microscope: MF3").alias("value")),
        F.struct(F.lit(2).alias("_line"), F.when(k % 3 == 0, F.concat(F.lit("fix_type: "), "s_name")).alias("value")),
        F.struct(F.lit(3).alias("_line"), F.lit("lib_name: null").alias("value"))), lambda s: s["value"].isNotNull()))
    recs = table(spark, d, "supplier").select(k.alias("sample"), lines.alias("_l")).select("sample", "_l._line", "_l.value")
    r = X.parse_sample_records(X.read_lines(spark, write_docs(recs, "value", scratch_dir(spark), "sample")))
    return X.widen_extra(r, ["fix_type", "absent"]).select("sample_name", "project", "microscope", "fix_type", "absent")


@query("S11_read_event_xml", """SELECT CAST(o_orderkey AS INTEGER) AS frame, CAST(o_orderkey % 5 AS INTEGER) AS channel FROM orders WHERE o_orderkey % 10 <> 0""")
def _(spark, d):
    k, out = F.col("o_orderkey"), scratch_dir(spark)
    table(spark, d, "orders").select(
        F.format_string("%.2f", k + 0.3).alias("on"), F.format_string("%.2f", k + 0.9).alias("off"), F.when(k % 10 != 0, k % 5).alias("channel"),
    ).write.format("xml").option("rootTag", "repeat").option("rowTag", "event").save(out)
    return M.read_events(spark, out).select("frame", "channel")


@query("S11_z_offsets", """SELECT c_custkey AS doc, CAST(i AS INTEGER) AS frame, c_custkey % 7 + i * 0.5e0 AS z, 0.25e0 AS exposure_time FROM customer, range(5) t(i)""")
def _(spark, d):
    k = F.col("c_custkey")
    zs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (k % 7 + i * 0.5).cast("string")), ",")
    docs = table(spark, d, "customer").select(k.alias("file"), F.concat(
        F.lit("<settings><exposure_time type=\"float\">0.25</exposure_time><z_offsets type=\"string\">"), zs, F.lit("</z_offsets></settings>")).alias("value"))
    return M.parse_z_offsets(docs).join(M.read_settings(docs, ["exposure_time"]), "file").withColumnRenamed("file", "doc")


def protocol_docs(spark, d):
    """One configuration document per customer: its orders as steps."""
    k = F.col("o_orderkey")
    step = F.when(k % 3 == 0, F.concat(F.lit("<pump duration=\""), k % 50, F.lit("\"> Run "), k % 4, F.lit("</pump>"))).when(
        k % 3 == 1, F.concat(F.lit("<valve duration=\"x\">Set "), k % 4, F.lit("</valve>"))).otherwise(F.lit("<!-- <pump>old</pump> -->"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), step.alias("s")))), lambda x: x["s"]), "").alias("_b"))
    return o.select(F.col("o_custkey").cast("string").alias("file"), F.concat(F.lit("<kilroy><protocol name=\" P "), "o_custkey", F.lit("\">"), "_b", F.lit("</protocol></kilroy>")).alias("content"))


@query("S12_read_protocol_steps", """WITH s AS (SELECT o_custkey, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 2)
  SELECT 'P ' || o_custkey AS protocol, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS INTEGER) AS pos, CASE WHEN k % 3 = 0 THEN 'pump' ELSE 'valve' END AS kind, CASE WHEN k % 3 = 0 THEN ' Run ' ELSE 'Set ' END || k % 4 AS name, CASE WHEN k % 3 = 0 THEN CAST(k % 50 AS VARCHAR) ELSE 'x' END AS duration FROM s""")
def _(spark, d):
    return M.parse_protocols(protocol_docs(spark, d)).drop("file")


@query("S12_protocol_durations", """SELECT 'P ' || o_custkey AS protocol, coalesce(CAST(sum(o_orderkey % 50) FILTER (WHERE o_orderkey % 3 = 0) AS DOUBLE), 0) AS duration_s FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY o_custkey""")
def _(spark, d):
    return M.protocol_durations(M.parse_protocols(protocol_docs(spark, d))).drop("file")


@query("S13_load_result_files", """SELECT o_orderkey AS fov, o_orderpriority AS series, CAST(o_orderkey % 9 AS DOUBLE) AS x_drift, CAST(o_orderkey % 7 AS DOUBLE) AS y_drift FROM orders WHERE o_orderkey % 4 <> 3""")
def _(spark, d):
    out, k = scratch_dir(spark), F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        (k % 4).alias("part"), k.alias("fov"), F.col("o_orderpriority").alias("series"), (k % 9).alias("x_drift"), (k % 7).alias("y_drift"))
    # three valid parts in two column orders, and one without the needed columns
    good = o.where("part < 2").select("fov", "series", "x_drift", "y_drift")
    turned = o.where("part = 2").select("y_drift", "fov", "x_drift", "series")
    bad = o.where("part = 3").select("fov", "series")
    for name, t in (("a", good), ("b", turned), ("c", bad)):
        t.write.option("header", "true").csv(f"{out}/drift_{name}.csv")
    return V.load_drift(spark, out)


@query("S15_idempotent_result_sink", """SELECT c_custkey AS fov_id, CAST(c_nationkey AS INTEGER) AS round_id, CASE WHEN c_custkey % 2 = 0 THEN 1e0 ELSE 2e0 END AS value, 10 AS threshold FROM customer""")
def _(spark, d):
    out = scratch_dir(spark)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("fov_id"), F.col("c_nationkey").alias("round_id"))
    V.write_once(c.where("fov_id % 2 = 0").withColumn("value", F.lit(1.0)), out, ["fov_id"], {"threshold": 10}, ["round_id"])
    V.write_once(c.withColumn("value", F.lit(2.0)), out, ["fov_id"], {"threshold": 10}, ["round_id"])  # only new keys are added
    return spark.read.parquet(out).select("fov_id", F.col("round_id").cast("int").alias("round_id"), "value", "threshold")


@query("S16_extract_frames_sink", """SELECT vec_id // 64 AS stack, CAST(vec_id % 64 AS INTEGER) AS frame, CAST(row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS INTEGER) AS new_frame FROM embeddings WHERE vec_id % 3 = 0""")
def _(spark, d):
    f = R.read_frames(spark, write_stacks(spark, d))
    stack = F.regexp_extract("path", STACK, 1).cast("long")
    keep = f.select("path", "frame").where((stack * 64 + F.col("frame")) % 3 == 0)
    n = R.extract_frames(f, keep, scratch_dir(spark))
    return n.select(stack.alias("stack"), "frame", "new_frame")


@query("S17_write_positions", """SELECT s_nationkey AS tissue, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS fov_id, s_suppkey * 0.5e0 AS x, s_acctbal AS y FROM supplier""")
def _(spark, d):
    out = scratch_dir(spark)
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fov_id"), F.col("s_nationkey").alias("tissue"), (F.col("s_suppkey") * 0.5).alias("x"), F.col("s_acctbal").alias("y"))
    X.write_positions(p, out, by="tissue")
    r = X.read_positions(spark, out)
    return r.select(F.regexp_extract("file", r"tissue=(\d+)", 1).cast("int").alias("tissue"), "fov_id", "x", "y")


@query("S18_read_polygons", """WITH v AS (SELECT c_nationkey AS n, c_custkey, c_custkey % 50 AS x, c_acctbal AS y FROM customer)
  SELECT CAST(n AS VARCHAR) AS hole, len(list(x)) AS n_points, round(sum(x * 1e0), 4) AS sum_x, round(arg_min(y, c_custkey), 4) AS first_y, round(arg_max(y, c_custkey), 4) AS last_y FROM v GROUP BY n HAVING count(*) >= 3""")
def _(spark, d):
    c = table(spark, d, "customer")
    lines = c.select(F.col("c_nationkey").alias("hole"), F.col("c_custkey").alias("_line"), F.concat_ws(",", F.col("c_custkey") % 50, F.col("c_acctbal")).alias("value"))
    rings = X.read_rings(spark, write_docs(lines, "value", scratch_dir(spark), "hole"))
    rings = rings.withColumn("file", F.regexp_replace("file", r"hole=(\d+)\.txt$", "hole$1.txt"))
    h = X.hole_polygons(rings)
    sum_x = F.aggregate("ring", F.lit(0.0), lambda a, p: a + p["x"])
    return h.select("hole", F.size("ring").cast("long").alias("n_points"), F.round(sum_x, 4).alias("sum_x"), F.round(F.col("ring")[0]["y"], 4).alias("first_y"), F.round(F.element_at("ring", -1)["y"], 4).alias("last_y"))
