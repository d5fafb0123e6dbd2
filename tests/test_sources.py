"""Readers, sinks and streams on literal files."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagelight.operators.aggregate import stage_z_summary
from stagelight.sources import inventory as V
from stagelight.sources import raw_frames as R
from stagelight.sources import text as X
from stagelight.sources import xml as M
from stagelight.streaming import runs as S


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if isinstance(text, bytes) else "w") as fh:
        fh.write(text)
    return path


def test_positions(spark, tmp_path):
    put(tmp_path, "a.txt", "# head\n1,2 # tail\n\n5\nx,1\n3.5 , -4\n" + "".join(f"{i},{i}\n" for i in range(10)))
    put(tmp_path, "b.txt", "9,9\nnan,1\n8,8")
    got = sorted((os.path.basename(r.file), r.fov_id, r.x, r.y) for r in X.read_positions(spark, str(tmp_path)).collect())
    assert got[:3] == [("a.txt", 0, 1.0, 2.0), ("a.txt", 1, 3.5, -4.0), ("a.txt", 2, 0.0, 0.0)]
    assert len([g for g in got if g[0] == "a.txt"]) == 12 and got[-2:] == [("b.txt", 0, 9.0, 9.0), ("b.txt", 1, 8.0, 8.0)]


def test_focus_log_readiness(spark, tmp_path):
    head = "frame offset power stage-z good-offset\n"
    put(tmp_path, "ok.off", head + "0 0.1 5 1.5 1\n1 0.2 5 1.75 0\n")
    put(tmp_path, "swapped.off", "offset frame power good-offset stage-z\n0.1 7 5 1 3.5\n")
    put(tmp_path, "header.off", head)
    put(tmp_path, "cut.off", head + "0 0.1 5 1.5 1\n1 0.2")
    put(tmp_path, "lacks.off", "frame offset power\n0 1 2\n")
    put(tmp_path, "empty.off", "")
    got = sorted((os.path.basename(r.file), r.frame, r.stage_z, r.good) for r in X.read_focus_logs(spark, str(tmp_path)).collect())
    assert got == [("ok.off", 0, 1.5, True), ("ok.off", 1, 1.75, False), ("swapped.off", 7, 3.5, True)]


def test_round_table_needs_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="round_id"):
        X.read_round_table(spark, put(tmp_path, "r.csv", "series,x\na,1\n"))
    df = X.read_round_table(spark, put(tmp_path, "s.csv", "imaging_round,series,dir,note\n2, h_{fov:03d} ,d1,\n"))
    assert df.first().asDict() == {"round_id": 2, "series": "h_{fov:03d}", "note": None, "data_dir": "d1"}


def test_codebook_length(spark, tmp_path):
    good = "version, 1\ncodebook_name, C\nbit_names, A, B, C\nname, id, barcode\n"
    rows = X.read_codebooks(spark, put(tmp_path, "g/c.csv", good + "g1, , 101\n")).orderBy("bit").collect()
    assert [(r.codebook, r.gene, r.bit_name, r.on) for r in rows] == [("C", "g1", "A", True), ("C", "g1", "B", False), ("C", "g1", "C", True)]
    with pytest.raises(Exception, match="g2"):
        X.read_codebooks(spark, put(tmp_path, "b/c.csv", good + "g2, , 10\n")).collect()


def test_absent_bit_names(spark):
    assert X.read_bit_names(spark, "/nowhere/x.csv").count() == 0


def test_raw_frames(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 65535, (7, 3, 4)).astype("<u2")
    put(tmp_path, "m/hal_1.dax", a.tobytes())
    put(tmp_path, "m/hal_1.inf", "frame dimensions = 4 x 3 ; w x h\nnumber of frames = 7\n")
    df = R.read_frames(spark, str(tmp_path / "m"), frames_per_partition=3)
    got = {r.frame: np.frombuffer(r.pixels, "<u2").reshape(r.h, r.w) for r in df.collect()}
    assert len(got) == 7 and all((got[i] == a[i]).all() for i in range(7))
    assert sorted(r.frame for r in df.where(F.col("frame").isin(5, 1)).collect()) == [1, 5]
    plan = df.where("frame = 2 AND path LIKE '%hal_1%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")  # only wanted frames reach the read
    assert "read_pixels" not in df.select("path", "frame")._jdf.queryExecution().optimizedPlan().toString()
    assert [r.frame for r in R.read_frames(spark, str(tmp_path / "m"), frames="5,0").collect()] == [5, 0]
    put(tmp_path, "bad/hal_2.dax", a.tobytes()[:-2])
    with pytest.raises(Exception, match="frame 6"):
        R.read_frames(spark, str(tmp_path / "bad"), frame_height=3, frame_width=4, frames="0,6").collect()
    with pytest.raises(Exception, match="no frame size"):
        R.read_frames(spark, str(tmp_path / "bad")).collect()


def test_frames_are_planned_by_the_listing(spark, tmp_path):
    """Odd names, a glob, a stack without frames, and nothing there; small batches inside one task."""
    a = np.random.default_rng(2).integers(0, 65535, (9, 2, 3)).astype("<u2")
    for name in ("a b+%41é", "c"):
        put(tmp_path, f"deep/{name}.dax", a.tobytes())
        put(tmp_path, f"deep/{name}.inf", "frame dimensions = 3 x 2\n")
    put(tmp_path, "deep/none.dax", b"")
    put(tmp_path, "deep/none.inf", "frame dimensions = 3 x 2\n")
    for path in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/deep/*.dax"):
        df = R.read_frames(spark, path, frames_per_partition=4)
        got = {(os.path.basename(r.path), r.frame): bytes(r.pixels) for r in df.collect()}
        assert got == {(f"{n}.dax", i): a[i].tobytes() for n in ("a b+%41é", "c") for i in range(9)}
    keep = spark.createDataFrame([(p, f) for p in {r.path for r in df.select("path").distinct().collect()} for f in (7, 1)], "path string, frame int")
    out = R.extract_frames(df, keep, str(tmp_path / "out"))
    assert sorted({(r.frame, r.new_frame) for r in out.collect()}) == [(1, 0), (7, 1)]
    put(tmp_path, "empty/x.txt", "")
    assert R.read_frames(spark, str(tmp_path / "empty")).count() == 0


def test_counters_from_frames(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 9, (3, 8, 8)).astype("<u2")
    put(tmp_path, "x.dax", a.tobytes())
    f = R.read_frames(spark, str(tmp_path), frame_height=8, frame_width=8)
    got = {(r.frame, r.value): r["count"] for r in R.frame_counters(f, ["path", "frame"]).collect()}
    assert got == {(i, int(v)): int(n) for i in range(3) for v, n in zip(*np.unique(a[i], return_counts=True))}


def test_inventory_of_stores(spark, tmp_path):
    put(tmp_path, "d/a.zarr/0/0", "x" * 10)
    put(tmp_path, "d/a.zarr/.zattrs", "y" * 5)
    put(tmp_path, "d/b.zarr/1", "z")
    put(tmp_path, "d/c.txt", "q")
    got = sorted((os.path.basename(r.path), r.length, r.n_files) for r in V.file_inventory(V.walk_files(spark, str(tmp_path)), ".zarr").collect())
    assert got == [("a.zarr", 15, 2), ("b.zarr", 1, 1)]
    plain = V.file_inventory(V.list_files(spark, str(tmp_path)), ".zarr")  # Spark's listing leaves hidden files out
    assert sorted((os.path.basename(r.path), r.length) for r in plain.collect()) == [("a.zarr", 10), ("b.zarr", 1)]


def test_chunk_headers(spark, tmp_path):
    put(tmp_path, "a.zarr/0", bytes(12) + (20).to_bytes(4, "little") + bytes(4))
    put(tmp_path, "a.zarr/1", b"short")
    got = sorted((r.chunk, r.size, r.declared_size) for r in V.chunk_headers(spark, str(tmp_path)).collect())
    assert got == [("0", 20, 20), ("1", 5, None)]


def test_result_files(spark, tmp_path):
    assert V.load_result_files(spark, str(tmp_path / "none*.parquet"), "fov LONG, v DOUBLE").columns == ["fov", "v"]
    put(tmp_path, "drift_a.csv", "")
    put(tmp_path, "drift_b.csv", "fov,series\n1,s\n")
    put(tmp_path, "channels_a.csv", "fov,bit,series,x_drift,y_drift\n1,3,s,0.5,1\n1,4,s,0.5,1\n2,3,s,,1\n")
    assert [tuple(r) for r in V.load_drift(spark, str(tmp_path)).collect()] == [(1, "s", 0.5, 1.0)]
    put(tmp_path, "drift_c.csv", "series,fov,y_drift,x_drift\nt,7,2,3\n")
    assert [tuple(r) for r in V.load_drift(spark, str(tmp_path)).collect()] == [(7, "t", 3.0, 2.0)]
    _, report = V.load_csv_tolerant(spark, str(tmp_path / "drift_*.csv"), ["fov", "x_drift"])
    assert {os.path.basename(r.file): r.loaded for r in report.collect()} == {"drift_b.csv": False, "drift_c.csv": True}


def test_write_once(spark, tmp_path):
    out = str(tmp_path / "t")
    df = lambda v, ids: spark.createDataFrame([(i, i % 2, v) for i in ids], "fov long, round_id int, value double")
    V.write_once(df(1.0, [1, 2]), out, ["fov"], {"limit": 5}, ["round_id"])
    V.write_once(df(2.0, [1, 2, 3]), out, ["fov"], {"limit": 5}, ["round_id"])
    assert {r.fov: r.value for r in spark.read.parquet(out).collect()} == {1: 1.0, 2: 1.0, 3: 2.0}
    V.write_once(df(3.0, [1]), out, ["fov"], {"limit": 9}, ["round_id"])  # another signature recomputes
    assert {r.fov: (r.value, r.limit) for r in spark.read.parquet(out).collect()} == {1: (3.0, 9), 2: (1.0, 5), 3: (2.0, 5)}


def test_xml(spark, tmp_path):
    p = put(tmp_path, "s.xml", "<repeat><oversampling>1</oversampling><event><on>1.2</on><off>2</off><channel>3</channel></event><event><on>4</on></event></repeat>")
    assert [(r.frame, r.channel) for r in M.read_events(spark, p).collect()] == [(1, 3)]
    bad = put(tmp_path, "t.xml", "<repeat><event><on>1.2</on><channel>3</channel></event><event><on>0.9</on><channel>4</channel></event></repeat>")
    with pytest.raises(Exception, match="two events"):
        M.read_events(spark, bad).collect()
    put(tmp_path, "k/k.xml", "<k><protocol name=' P '><valve duration='3'>Set A </valve><!-- <pump>no</pump> --><pump duration='x'>Go</pump></protocol></k>")
    steps = M.read_protocols(spark, str(tmp_path / "k"))
    assert [(r.protocol, r.kind, r.name) for r in steps.orderBy("pos").collect()] == [("P", "valve", "Set A "), ("P", "pump", "Go")]
    assert M.protocol_durations(steps).first().duration_s == 3.0


def test_polygons(spark, tmp_path):
    put(tmp_path, "hole1.txt", "0,0\n9,0\n9,9\n")
    put(tmp_path, "hole1_island1.txt", "1,1\n2,1\n2,2\n")
    put(tmp_path, "hole2.txt", "0,0\n1,1\n")
    got = X.hole_polygons(X.read_rings(spark, str(tmp_path))).collect()
    assert [(r.hole, len(r.ring), len(r.islands)) for r in got] == [("1", 3, 1)]


def test_documents_are_streamed(spark, tmp_path):
    doc = "<cfg><!-- <protocol/> --><valve_cmd name=' a '/><valve_cmd/><pump_cmd name='p'/>" + "".join(
        f"<protocol name='p{i}'><valve duration='2'> v{i} </valve><!-- no --><pump duration='x'>q</pump><wait/></protocol>" for i in range(3000)) + "<valve_cmd name='b'/></cfg>"
    put(tmp_path, "d/config.xml", doc)
    steps = M.read_protocols(spark, str(tmp_path / "d"))
    rows = [(r.protocol, r.pos, r.kind, r.name, r.duration) for r in steps.collect()]
    assert sorted(rows) == sorted(t for i in range(3000) for t in ((f"p{i}", 0, "valve", f" v{i} ", "2"), (f"p{i}", 1, "pump", "q", "x"), (f"p{i}", 2, "wait", "", None)))
    held = M.parse_protocols(spark.createDataFrame([("f", doc)], "file string, content string")).drop("file")
    assert held.exceptAll(steps.drop("file")).count() == 0 and held.count() == len(rows)
    commands = M.parse_commands(spark.createDataFrame([("f", doc)], "file string, content string")).collect()
    assert sorted((r.kind, r.name, r.pos) for r in commands) == [("pump", "p", 0), ("valve", "a", 0), ("valve", "b", 2)]


def test_a_document_passes_in_bounded_memory():
    """The pull parser never holds more than the open elements, however many protocols a document has."""
    import tracemalloc

    def chunks(n):
        yield "<cfg>"
        for i in range(n):
            yield f"<protocol name='p'><valve duration='{i}'>{'x' * 200}</valve></protocol>"
        yield "</cfg>"

    peaks = []
    for n in (2000, 40_000):
        tracemalloc.start()
        assert sum(1 for _ in M.protocol_steps(chunks(n))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 100_000


def test_batches_cost_their_own_rows(spark, tmp_path, monkeypatch):
    """50 batches: none reads a result table, and the state written per batch follows the batch, not the run."""
    src = str(tmp_path / "in")
    for i in range(50):
        rows = spark.createDataFrame([(r, 4 * i + f) for r in (i % 5, 7) for f in range(4)], "round_id long, fov_id long").coalesce(1)
        rows.write.parquet(f"{src}/{i:02d}")
        if i < 10:
            rows.write.parquet(f"{src}-few/{i:02d}")
    reads = []
    monkeypatch.setattr(S, "path_exists", lambda *a: reads.append(a))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # state in few stores; batches are small
    monkeypatch.setattr(S, "get_table", lambda *a, **k: reads.append(a))
    arrivals = lambda folder: S.read_arrivals(spark, folder, "round_id LONG, fov_id LONG", files_per_batch=1)
    expected = spark.createDataFrame([(i, 30) for i in range(5)] + [(7, 200)], "round_id long, n_expected long")
    q = S.round_trigger(arrivals(src), expected, str(tmp_path / "fired"), str(tmp_path / "cp1"))
    late = S.take_late_and_partial(arrivals(src + "-few"), ["round_id", "fov_id"], F.col("fov_id") % 2 == 0, str(tmp_path / "ok"), str(tmp_path / "retry"), str(tmp_path / "cp2"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    for query, n in ((q, 50), (late, 10)):
        batches = [p for p in query.recentProgress if p.numInputRows]
        assert len(batches) == n and all(p.numInputRows == 8 for p in batches)
        written = [sum(o.numRowsUpdated for o in p.stateOperators) for p in batches]
        assert max(written) <= 16 and not reads
    monkeypatch.undo()
    assert sorted(r.round_id for r in S.get_table(spark, str(tmp_path / "fired"), S.FIRED).collect()) == [0, 1, 2, 3, 4, 7]
    assert S.get_table(spark, str(tmp_path / "ok"), "round_id LONG, fov_id LONG").count() == 40


def test_once_enough_samples_and_fixed_ranges(spark, tmp_path):
    """Samples wait in state over runs, NULLs and large whole numbers come back as they were, a range is fixed once."""
    src, big = str(tmp_path / "in"), 2**60 + 1
    for i, rows in enumerate([[(1, "a", 1.0), (1, "b", None), (2, "a", 5.0)], [(1, "a", 3.0), (None, "z", 2.0)], [(1, "c", 4.0), (1, "d", -7.0), (2, "b", 6.0)], [(1, "e", 99.0)]]):
        spark.createDataFrame([(k, t, v, big if v else None) for k, t, v in rows], "k long, tile_id string, v double, n long").coalesce(1).write.parquet(f"{src}/{i}")
        s = lambda: S.read_arrivals(spark, src, "k LONG, tile_id STRING, v DOUBLE, n LONG", files_per_batch=1)
        S.compute_once(s(), "k", 4, lambda df: df, str(tmp_path / "once"), str(tmp_path / "cp1"))
        S.live_tiles(s().select("k", "tile_id", "v"), "k", 3, str(tmp_path / "tiles"), str(tmp_path / "ranges"), str(tmp_path / "cp2"))
    once = S.get_table(spark, str(tmp_path / "once"), "k LONG, tile_id STRING, v DOUBLE, n LONG").collect()
    assert sorted((r.k, r.tile_id, r.v, r.n) for r in once if r.tile_id != "b") == [(1, "a", 1.0, big), (1, "a", 3.0, big), (1, "c", 4.0, big), (1, "d", -7.0, big)]
    assert [(r.k, r.v, r.n) for r in once if r.tile_id == "b"] == [(1, None, None)] and {r.batch_id for r in once} == {2}
    ranges = S.get_table(spark, str(tmp_path / "ranges"), "k LONG, lo DOUBLE, hi DOUBLE").collect()
    assert [(r.k, r.lo, r.hi) for r in ranges] == [(1, -7.0, 4.0)]
    shown = S.render_tiles(spark, "k", str(tmp_path / "tiles"), "k LONG, tile_id STRING, v DOUBLE", str(tmp_path / "ranges")).collect()
    assert {(r.k, r.tile_id, r.provisional) for r in shown} == {(1, t, False) for t in "abcde"} | {(2, "a", True), (2, "b", True), (None, "z", True)}


def test_keys_of_an_old_cache_are_known(spark, tmp_path):
    spark.createDataFrame([(0, 5.0), (3, 6.0)], "fov_id long, stage_z double").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    s = S.read_arrivals(spark, str(tmp_path / "in"), "fov_id LONG, stage_z DOUBLE")
    old = spark.createDataFrame([(-1,)], "fov_id int")
    S.summary_cache(s, ["fov_id"], lambda df: df.groupBy("fov_id").agg(F.max("stage_z").alias("z")), str(tmp_path / "out"), str(tmp_path / "cp"), old)
    assert [(r.fov_id, r.z) for r in S.get_table(spark, str(tmp_path / "out"), "fov_id LONG, z DOUBLE").collect()] == [(3, 6.0)]


def test_stream_restart_and_growth(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "fov_id LONG, series LONG, frame LONG, stage_z DOUBLE"
    cache = "fov_id LONG, series LONG, first_stage_z DOUBLE, min_stage_z DOUBLE, max_stage_z DOUBLE, all_same BOOLEAN"

    def drop(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{src}/{name}")

    def run():
        s = S.read_arrivals(spark, src, schema, files_per_batch=1)
        S.summary_cache(s, ["fov_id", "series"], lambda df: stage_z_summary(df, ["fov_id", "series"]), out, cp)
        return sorted((r.fov_id, r.first_stage_z) for r in S.get_table(spark, out, cache).collect())

    drop("a", [(1, 0, 0, 5.0), (1, 0, 1, 6.0)])
    assert run() == [(1, 5.0)]
    assert run() == [(1, 5.0)]  # nothing new
    drop("b", [(1, 0, 2, 9.0), (2, 0, 0, 7.0)])
    assert run() == [(1, 5.0), (2, 7.0)]  # known keys stay, new ones are added


def test_new_keys_cost_no_python_call_each(spark, tmp_path):
    """All rows of a key's first batch, NULL keys too, and no later ones; known keys are dropped by Spark's own state."""
    schema = "k LONG, day STRING, v DOUBLE"
    for i, rows in enumerate([[(1, "a", 1.0), (1, "a", None), (None, "a", 2.0), (2, None, 3.0)], [(1, "a", 9.0), (1, None, 4.0), (None, "a", 9.0), (None, None, 5.0), (None, None, 6.0), (2, None, 9.0), (7, "z", 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        s = S.rows_of_new_keys(S.read_arrivals(spark, str(tmp_path / "in"), schema), ["k", "day"], spark.createDataFrame([(7, "z")], "k int, day string"))
        q = S.run_to_end(s, lambda df, n: S.put_batch(df, str(tmp_path / "out"), n), str(tmp_path / "cp"))
    got = [(r.batch_id, r.k, r.day, r.v) for r in S.get_table(spark, str(tmp_path / "out"), schema).collect()]
    assert sorted(got, key=repr) == sorted([(0, 1, "a", 1.0), (0, 1, "a", None), (0, None, "a", 2.0), (0, 2, None, 3.0), (1, 1, None, 4.0), (1, None, None, 5.0), (1, None, None, 6.0)], key=repr)
    assert [o["operatorName"] for o in q.lastProgress["stateOperators"]] == ["dedupe"]


def test_stability_gate_over_runs(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "path STRING, tick LONG, size LONG"
    for tick, sizes in enumerate([{"a": 0, "b": 5, "c": 1}, {"a": 0, "b": 5, "c": 2}, {"a": 4, "b": 5, "c": 3}, {"a": 4, "b": 9, "c": 3}]):
        spark.createDataFrame([(p, tick, s) for p, s in sizes.items()], schema).coalesce(1).write.parquet(f"{src}/{tick}")
        S.run_to_end(S.stable_paths(S.read_arrivals(spark, src, schema)), lambda df, n: S.put_batch(df, out, n), cp)
    got = sorted((r.path, r.size, r.tick) for r in S.get_table(spark, out, "path STRING, size LONG, tick LONG").collect())
    assert got == [("a", 4, 3), ("b", 5, 1), ("c", 3, 3)]


def test_docs_are_files_of_tasks_not_folders(spark, tmp_path):
    """Many small documents, one of several Arrow batches: one file each, no folder per value, lines in order."""
    from stagelight.plans.source_queries import write_docs

    few, long = spark.range(300).selectExpr("id AS doc", "1 AS _line", "concat('a', id) AS value"), spark.range(25_000).selectExpr("7L AS doc", "CAST(id + 2 AS INT) AS _line", "CAST(id AS STRING) AS value")
    out = write_docs(few.union(few.selectExpr("doc", "0", "concat('b', doc)")).union(long), "value", str(tmp_path / "docs"), "doc")
    files = [f for f in (tmp_path / "docs").rglob("*") if f.is_file()]
    assert len(files) == 300 and all(f.name.startswith("doc=") for f in files) and not [f for f in (tmp_path / "docs").rglob("doc=*") if f.is_dir()]
    texts = {f.name[4:-4]: f.read_text().splitlines() for f in files}
    assert texts["12"] == ["b12", "a12"] and texts["7"] == ["b7", "a7", *map(str, range(25_000))]
    assert spark.read.option("recursiveFileLookup", "true").text(out).count() == 25_600


def test_focus_logs_are_read_once(spark, tmp_path):
    """Header, rows and check come from one read of the files."""
    (tmp_path / "a.off").write_text("frame offset power stage-z good-offset\n1 0.1 200 3.5 1\n2 0.1 200 4.5 0\n")
    (tmp_path / "b.off").write_text("frame offset power stage-z good-offset\n1 0.1 200\n")
    logs = X.read_focus_logs(spark, str(tmp_path))
    assert "FileScan" not in logs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.frame, r.stage_z, r.good) for r in logs.collect()) == [(1, 3.5, True), (2, 4.5, False)]


def test_a_value_is_asked_for_once_a_key():
    """Keyed processors ask for their value in one call, and a path that was told is not written again."""
    from stagelight.streaming import state as T

    class Held:
        def __init__(self, value=None):
            self.value, self.calls = value, []

        def get(self):
            self.calls.append("get")
            return self.value

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def update(self, value):
            self.calls.append("update")
            self.value = value

    def calls(value):
        p = T.StableSize(None)
        p.state = Held(value)
        out = list(p.handleInputRows(("a",), iter([pd.DataFrame({"tick": [2, 1], "size": [5, 5]})]), None))
        return p.state.calls, [tuple(r) for d in out for r in d.itertuples(index=False)]

    assert calls(None) == (["get", "update"], [("a", 5, 2)])
    assert calls((5, False)) == (["get", "update"], [("a", 5, 1)])
    assert calls((5, True)) == (["get"], [])


def test_frames_are_decoded_in_small_batches():
    """A batch of many small frames does not become one large table of pixels in the Python worker (640,000 rows before)."""
    import pyarrow as pa

    n = 10_000
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([bytes(128)] * n, pa.binary())], names=["frame", "pixels"])
    out = list(R.in_chunks(iter([b]), ["frame"], lambda v, row: {"v": v.astype(np.int32)}))
    assert max(x.num_rows for x in out) < 70_000
    assert np.array_equal(np.concatenate([x.column("frame").to_numpy() for x in out]), np.repeat(np.arange(n), 64))
