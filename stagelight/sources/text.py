"""Readers of small text formats: lines in file order, then SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight import schemas
from stagelight.operators.scan import ordered_scan
from stagelight.session import cut_lineage


def read_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(file, block, at, value): ``block`` and ``at`` order the lines of a file, also when a large file is split.

    A scan task reads its file pieces in sequence, so the running row id orders the lines of one piece.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return raw.withColumn("at", F.monotonically_increasing_id())


def number(c: Column) -> Column:
    """Text to double, NULL when it is not a number; NaN counts as missing."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def read_round_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with one row per (round, series); all other columns pass through as text, blanks as NULL."""
    df = spark.read.option("header", "true").csv(path)
    if "round_id" not in df.columns and "imaging_round" in df.columns:
        df = df.withColumnRenamed("imaging_round", "round_id")
    missing = [c for c in ("round_id", "series") if c not in df.columns]
    if missing:
        raise ValueError(f"round table needs {missing}; columns found: {df.columns}")
    blank = {c: F.when(F.trim(c) != "", F.col(c)) for c in df.columns}
    df = df.select(*[blank[c].alias(c) for c in df.columns])
    df = df.withColumn("series", F.trim("series")).withColumn("round_id", F.col("round_id").cast("double").cast("int"))
    if "dir" in df.columns:
        own = F.col("data_dir") if "data_dir" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("data_dir", F.coalesce(own, F.col("dir"))).drop("dir")
    return df


def read_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, fov_id, x, y): fov_id counts the valid lines of a file in order; ``#`` starts a comment."""
    text = F.trim(F.substring_index("value", "#", 1))
    parts = F.split(text, ",")
    rows = read_lines(spark, path).select(
        "file", "block", "at", number(F.trim(F.get(parts, F.lit(0)))).alias("x"), number(F.trim(F.get(parts, F.lit(1)))).alias("y")
    ).where("x is not null and y is not null")
    s = ordered_scan(rows, ["file"], ["block", "at"], row_number="_rn")
    return s.select("file", (F.col("_rn") - 1).alias("fov_id"), "x", "y")


# fixed values: columns a focus log must have
FOCUS_COLUMNS = ["frame", "offset", "power", "stage-z", "good-offset"]


def parse_focus_logs(lines: DataFrame) -> DataFrame:
    """Focus logs from (file, block, at, value): a file contributes rows only when every line of it is complete."""
    tokens = F.split(F.trim("value"), r"\s+")
    # many small files are slow to open: they are read once, for the header, the rows and the check alike
    body = cut_lineage(lines.where(F.trim("value") != "").select("file", "block", "at", tokens.alias("_t")))
    head = body.groupBy("file").agg(
        F.min_by("_t", F.struct("block", "at")).alias("_h"), F.min(F.struct("block", "at")).alias("_first"))
    rows = body.join(head, "file").where(F.struct("block", "at") != F.col("_first"))
    field = lambda name: number(F.get("_t", (F.array_position("_h", F.lit(name)) - 1).cast("int")))
    have = F.array_position("_h", F.lit(FOCUS_COLUMNS[0])) > 0
    for c in FOCUS_COLUMNS[1:]:
        have &= F.array_position("_h", F.lit(c)) > 0
    vals = rows.select("file", have.alias("_have"), *[F.when(have, field(c)).alias(c) for c in FOCUS_COLUMNS])
    ok = F.col("_have")
    for c in FOCUS_COLUMNS:
        ok &= F.col(f"`{c}`").isNotNull()
    ready = vals.groupBy("file").agg(F.bool_and(ok).alias("_ready")).where("_ready")
    return vals.join(ready, "file", "left_semi").select(
        "file", F.col("frame").cast("int").alias("frame"), "offset", "power", F.col("`stage-z`").alias("stage_z"),
        (F.col("`good-offset`") != 0).alias("good"))


def read_focus_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_focus_logs(read_lines(spark, path))


def rows_by_header(lines: DataFrame, columns: list[str], first: str | None = None) -> DataFrame:
    """Cells of CSV lines by the header of their own file: (file, header, columns...), NULL where a file lacks a column.

    ``first`` names the first column of every file, whatever its header says. No quoting.
    """
    head = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("header"), F.min(F.struct("block", "at")).alias("_first"))
    names = F.transform(F.split("header", ","), lambda s: F.trim(s))
    if first:
        names = F.concat(F.array(F.lit(first)), F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))))
    head = head.withColumn("header", names)
    cells = F.split("value", ",", -1)
    cell = lambda c: F.nullif(F.trim(F.get(cells, F.nullif(F.array_position("header", F.lit(c)), F.lit(0)).cast("int") - 1)), F.lit(""))
    return lines.join(head, "file").where((F.struct("block", "at") != F.col("_first")) & (F.trim("value") != "")).select(
        "file", "header", *[cell(c).alias(c) for c in columns])


def read_frame_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frame tables of several layouts as one table with the file name; the first column is the frame number."""
    out = rows_by_header(read_lines(spark, path), ["frame", "color", "channel", "z", "segment"], first="frame")
    return out.select(
        "file", number(F.col("frame")).cast("int").alias("frame"), number(F.col("color")).alias("color"),
        number(F.col("channel")).cast("int").alias("channel"), number(F.col("z")).alias("z"), "segment")


def parse_codebooks(lines: DataFrame) -> DataFrame:
    """(file, codebook, gene, gene_id, bit, bit_name, on): one row per gene and bit.

    A barcode whose length differs from the number of bit names is an error naming the gene.
    """
    key = F.trim(F.substring_index("value", ",", 1))
    head = lines.where(key.isin("version", "codebook_name", "bit_names")).groupBy("file").agg(
        F.max(F.when(key == "codebook_name", F.trim(F.regexp_extract("value", r"^[^,]*,(.*)$", 1)))).alias("codebook"),
        F.max(F.when(key == "bit_names", F.regexp_extract("value", r"^[^,]*,(.*)$", 1))).alias("_names"),
    ).withColumn("_names", F.transform(F.split("_names", ","), lambda s: F.trim(s)))
    cols = F.transform(F.split("value", ","), lambda s: F.trim(s))
    body = lines.where(~key.isin("version", "codebook_name", "bit_names", "name") & (F.trim("value") != "")).select(
        "file", cols[0].alias("gene"), F.nullif(cols[1], F.lit("")).alias("gene_id"), cols[2].alias("_code"))
    j = body.join(head, "file")
    bits = F.when(F.length("_code") == F.size("_names"), F.split("_code", "")).otherwise(
        F.raise_error(F.concat(F.lit("wrong barcode length for "), F.col("gene"))).cast("array<string>"))
    e = j.select("file", "codebook", "gene", "gene_id", "_names", F.posexplode(bits).alias("_i", "_b")).where("_b <> ''")
    return e.select("file", "codebook", "gene", "gene_id", (F.col("_i") + 1).alias("bit"), F.get("_names", F.col("_i")).alias("bit_name"), (F.col("_b") == "1").alias("on"))


def read_codebooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_codebooks(read_lines(spark, path))


def merge_bit_names(default: DataFrame, override: DataFrame | None = None, imaged: DataFrame | None = None) -> DataFrame:
    """(bit, name): the override wins per bit; optionally only imaged bits are kept."""
    out = default.select("bit", "name")
    if override is not None:
        out = out.join(override.select("bit", F.col("name").alias("_o")), "bit", "full").select("bit", F.coalesce("_o", "name").alias("name"))
    return out if imaged is None else out.join(imaged.select("bit"), "bit", "left_semi")


def read_bit_names(spark: SparkSession, path: str | None, name_column: str = "gene_name") -> DataFrame:
    """(bit, name) from a CSV; an absent file is an empty map."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], "bit INT, name STRING")
    df = spark.read.option("header", "true").csv(path)
    return df.select(F.col("bit").cast("int").alias("bit"), F.col(name_column).alias("name"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob matches, on any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def parse_sidecars(lines: DataFrame) -> DataFrame:
    """One row per sidecar: (file, fields MAP, frame_width, frame_height, n_frames). A sidecar has tens of keys."""
    text = F.trim(F.substring_index("value", ";", 1))
    kv = lines.where(text.contains("=")).select(
        "file", F.struct("block", "at").alias("_o"), F.lower(F.trim(F.substring_index(text, "=", 1))).alias("k"),
        F.trim(F.regexp_extract(text, r"^[^=]*=(.*)$", 1)).alias("v"))
    last = kv.groupBy("file", "k").agg(F.max_by("v", "_o").alias("v"))
    dims = r"(\d+)\s*[xX]\s*(\d+)"
    one = lambda name: F.max(F.when(F.col("k") == name, F.col("v")))
    return last.groupBy("file").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("fields"),
        F.regexp_extract(one("frame dimensions"), dims, 1).try_cast("int").alias("frame_width"),
        F.regexp_extract(one("frame dimensions"), dims, 2).try_cast("int").alias("frame_height"),
        one("number of frames").try_cast("int").alias("n_frames"))


def parse_sample_records(lines: DataFrame) -> DataFrame:
    """One row per record file: core fields (empty text when missing) and every other field in ``extra``."""
    key = F.trim(F.substring_index("value", ":", 1))
    val = F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1))
    plain = F.regexp_replace(val, r"^(['\"])(.*)\1$", "$2")
    kv = lines.where(F.col("value").contains(":") & ~F.col("value").startswith("#")).select("file", key.alias("k"), F.when(~plain.isin("null", "~"), plain).alias("v"))
    core = [F.coalesce(F.max(F.when(F.col("k") == c, F.col("v"))), F.lit("")).alias(c) for c in schemas.SAMPLE_CORE]
    extra = F.map_from_entries(F.sort_array(F.collect_set(F.when(~F.col("k").isin(schemas.SAMPLE_CORE), F.struct("k", "v"))))).alias("extra")
    return kv.groupBy("file").agg(*core, extra)


def widen_extra(records: DataFrame, columns: list[str]) -> DataFrame:
    """Outer-joined table: the named extra fields as columns, NULL where a record lacks them."""
    return records.select(*[c for c in records.columns if c != "extra"], *[F.try_element_at("extra", F.lit(c)).alias(c) for c in columns])


def read_rings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ring ARRAY<STRUCT<x,y>>) of vertex files in line order; fewer than three points are skipped."""
    pts = read_positions(spark, path)
    return pts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("fov_id", "x", "y"))).alias("_p")).where(F.size("_p") >= 3).select(
        "file", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def hole_polygons(rings: DataFrame) -> DataFrame:
    """Holes with their islands from files ``holeN.txt`` and ``holeN_islandM.txt``: (folder, hole, ring, islands)."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    r = rings.withColumn("folder", F.regexp_extract("file", r"^(.*)/[^/]+$", 1)).withColumn(
        "hole", F.regexp_extract(name, r"(?i)^hole(\d+)(?:_island.*)?\.txt$", 1)).withColumn(
        "island", F.regexp_extract(name, r"(?i)^hole\d+_island(.*)\.txt$", 1)).where("hole <> ''")
    isl = r.where("island <> ''").groupBy("folder", "hole").agg(F.sort_array(F.collect_list(F.struct("island", "ring")))["ring"].alias("islands"))
    return r.where("island = ''").select("folder", "hole", "ring").join(isl, ["folder", "hole"], "left").select(
        "folder", "hole", "ring", F.coalesce("islands", F.array().cast("array<array<struct<x:double,y:double>>>")).alias("islands"))


def write_positions(positions: DataFrame, path: str, tier: str | None = None, by: str | None = None) -> None:
    """``x,y`` (optionally ``,tier``) lines in FOV order; with ``by`` one file per value of that column.

    Without ``by`` the lines are range-sorted over several part files whose names keep the order.
    """
    parts = [F.col("x").cast("string"), F.col("y").cast("string")] + ([F.col(tier).cast("string")] if tier else [])
    line = F.concat_ws(",", *parts).alias("value")
    if by:
        positions.repartition(by).sortWithinPartitions(by, "fov_id").select(by, line).write.mode("overwrite").partitionBy(by).text(path)
    else:
        positions.orderBy("fov_id").select(line).write.mode("overwrite").text(path)
