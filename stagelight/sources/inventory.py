"""File inventories, result files and write-once result tables."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight import schemas
from stagelight.sources.scratch import open_path
from stagelight.sources.text import path_exists, read_lines, rows_by_header


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of every file below ``root``; the contents are never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(root).select("path", "length", "modificationTime")


def walk_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """As :func:`list_files` but with the hidden files that Spark's own listing leaves out (store metadata).

    The driver lists only the folders down to ``depth``, one call each; what is below is walked inside tasks, on any file system that Arrow opens.
    """
    store, top = open_path(root)
    prefix = root[: len(root) - len(top)] if root.endswith(top) else ""
    entries, level = [], [top]
    for _ in range(depth):
        found = [i for folder in level for i in store.get_file_info(fs.FileSelector(folder))]
        entries += [i.path for i in found if i.type == fs.FileType.File]
        level = [i.path for i in found if i.type == fs.FileType.Directory]
    n = max(1, min(len(level) + len(entries), 4 * spark.sparkContext.defaultParallelism))
    heads = spark.createDataFrame([(prefix + p,) for p in level + entries], "top STRING").repartition(n)

    def walk(batches):
        for b in batches:
            for head in b.column(0).to_pylist():
                store, top = open_path(head)
                found = [store.get_file_info(top)]
                if found[0].type == fs.FileType.Directory:
                    found = [i for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(prefix or "file:") + i.path for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()), pa.array([(i.mtime_ns or 0) // 1000 for i in found], pa.timestamp("us", "UTC"))],
                    names=["path", "length", "modificationTime"])

    return heads.mapInArrow(walk, "path STRING, length LONG, modificationTime TIMESTAMP")


def file_inventory(files: DataFrame, suffix: str = ".zarr", directory_store: bool = True) -> DataFrame:
    """Entries with a suffix. A folder with the suffix is one entry: its size is the sum, its time the latest, of its files."""
    s = suffix.replace(".", r"\.")
    if not directory_store:
        return files.where(F.lower("path").endswith(suffix.lower())).select(
            F.col("path"), "length", "modificationTime", F.lit(1).cast("long").alias("n_files"))
    root = F.regexp_extract("path", rf"(?i)^(.*?{s})(?:/.*)?$", 1)
    return files.withColumn("_root", root).where("_root <> ''").groupBy(F.col("_root").alias("path")).agg(
        F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"), F.count(F.lit(1)).alias("n_files"))


def load_result_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """All result files of a glob with a fixed schema; none gives an empty table with the same columns."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", "true").format(fmt).load(path)


def load_csv_tolerant(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (as text) of CSV files that have all required columns and at least one row, and a (file, loaded) report.

    The header decides per file, so files of different column order load together.
    """
    lines = read_lines(spark, path)
    need = F.array(*[F.lit(c) for c in required])
    rows = rows_by_header(lines, required).where(F.size(F.array_except(need, F.col("header"))) == 0).drop("header")
    return rows, lines.select("file").distinct().join(rows.select("file").distinct().withColumn("loaded", F.lit(True)), "file", "left").select(
        "file", F.coalesce("loaded", F.lit(False)).alias("loaded"))


def load_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Drift records: ``drift_*.csv`` when any is valid, else ``channels_*.csv`` without blanks, one row per (fov, series)."""
    required = ["fov", "series", "x_drift", "y_drift"]
    typed = lambda df: df.select(
        F.col("fov").try_cast("long").alias("fov"), "series", F.col("x_drift").try_cast("double").alias("x_drift"),
        F.col("y_drift").try_cast("double").alias("y_drift"), "file")
    for kind in ("drift", "channels"):
        path = f"{folder}/{kind}_*.csv"
        if not path_exists(spark, path):
            continue
        rows, _ = load_csv_tolerant(spark, path, required)
        if rows.limit(1).count() == 0:
            continue
        if kind == "drift":
            return typed(rows).drop("file")
        t = typed(rows).where("x_drift is not null and y_drift is not null")
        return t.groupBy("fov", "series").agg(F.min_by(F.struct("x_drift", "y_drift"), F.struct("file", "x_drift", "y_drift")).alias("_r")).select(
            "fov", "series", "_r.x_drift", "_r.y_drift")
    raise FileNotFoundError(f"no valid drift_*.csv or channels_*.csv in {folder}")


def write_once(df: DataFrame, path: str, keys: list[str], signature: dict[str, object], partition_by: list[str]) -> DataFrame:
    """Append results for keys without a row of the same parameter signature; return the rows written.

    The signature travels as columns. Partitions touched by new rows are rewritten as a whole (dynamic overwrite), so a
    failed job never leaves half a partition behind.
    """
    spark = df.sparkSession
    sig = list(signature)
    new = df.withColumns({k: F.lit(v) for k, v in signature.items()})
    if not path_exists(spark, path):
        new.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return spark.read.parquet(path)
    old = spark.read.parquet(path)
    same = old.select(*keys, *sig)
    fresh = new.join(same, [*keys, *sig], "left_anti")
    touched = fresh.select(*partition_by).distinct()
    kept = old.join(touched, partition_by, "left_semi").join(fresh.select(*keys).distinct(), keys, "left_anti")
    # the result is materialised apart from the folder being rewritten
    from stagelight.session import cut_lineage

    merged = cut_lineage(kept.unionByName(fresh))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return merged.where(" and ".join(f"{k} = {v!r}" for k, v in signature.items()))


def chunk_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, chunk, size, declared_size) of every chunk file below stores: only 16 bytes of each are read.

    The listing is a Spark scan; tasks open the files on any file system that Arrow opens and read the header.
    """
    files = list_files(spark, root).where(F.col("path").rlike(r"\.zarr/.*\d+$"))
    store = F.regexp_extract("path", r"(?i)^(.*?\.zarr)/(.*)$", 1)
    listed = files.select(store.alias("path"), F.regexp_extract("path", r"(?i)^(.*?\.zarr)/(.*)$", 2).alias("chunk"),
                          F.col("length").alias("size"), F.col("path").alias("_file"))

    def read(batches):
        for b in batches:
            sizes = []
            for name in b.column("_file").to_pylist():
                store, place = open_path(name)
                with store.open_input_file(place) as f:
                    head = f.read(16)
                sizes.append(int.from_bytes(head[12:16], "little") if len(head) == 16 else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "chunk", "size")), pa.array(sizes, pa.int64())], names=["path", "chunk", "size", "declared_size"])

    return listed.mapInArrow(read, "path STRING, chunk STRING, size LONG, declared_size LONG")
