"""Datasets as partitioned Parquet with a manifest of file hashes, and scans that verify them.

Hashes are taken where the files lie, a row per file, so neither writing nor verifying passes data through the driver.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a file at most, and bytes that are read of a file at a time to hash it.
FILE_ROWS, CHUNK = 1_000_000, 1 << 20


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset, a local master gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "inkwell-pen")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def keeper(spark: SparkSession, what: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table to a new scratch folder and reads it again, so that what follows doesn't compute it twice and
    doesn't depend on the executors that made it."""
    folder = scratch_dir(spark, what)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


def _table_of(path: Column) -> tuple[Column, Column]:
    """Table and place within it of a data file's path."""
    place = F.regexp_extract(path, r"/tables/(.*)$", 1)
    return F.substring_index(place, "/", 1), place


def file_hashes(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """table, file, length, sha256 of all data files of a dataset, a task reading a chunk of a file at a time. Files are listed by Spark
    and opened by pyarrow's file systems."""
    table, place = _table_of(F.col("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/tables")
    listed = files.select("path", table.alias("table"), place.alias("file"), "length")
    return hashed(listed.repartition(F.col("path")), chunk)


def hashed(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """table, file, length, sha256 of files (path, table, file, length). The function is shipped whole, so workers needn't be able to import
    this package."""

    def run(batches):
        import hashlib
        from urllib.parse import unquote

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                system, path = (fs.LocalFileSystem(), unquote(uri[5:])) if uri.startswith("file:/") else fs.FileSystem.from_uri(uri)
                sha = hashlib.sha256()
                with system.open_input_stream(path, buffer_size=0) as f:
                    while data := f.read(chunk):
                        sha.update(data)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("table", "file", "length")], pa.array(found, pa.string())], names=["table", "file", "length", "sha256"])

    return files.select("path", "table", "file", "length").mapInArrow(run, "table string, file string, length bigint, sha256 string")


def write_dataset(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> DataFrame:
    """Write each table under path, by split where it has that column, and then the manifest, which it returns. An existing dataset
    raises unless it is to be overwritten; without a manifest a dataset isn't whole."""
    spark = next(iter(tables.values())).sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    for name, df in tables.items():
        writer = df.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS)
        (writer.partitionBy("split") if "split" in df.columns and len(df.columns) > 1 else writer).parquet(f"{path}/tables/{name}")
    file_hashes(spark, path).write.mode(mode).json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table string, file string, length bigint, sha256 string").option("mode", "FAILFAST").json(f"{path}/manifest")


def verify(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """rule, file of what is wrong with a dataset: files that are missing, changed or not in the manifest, and required tables that
    the manifest doesn't have, paths that lead out of the dataset."""
    stated = read_manifest(spark, path)
    actual = file_hashes(spark, path).select(F.col("file").alias("_file"), F.col("sha256").alias("_sha256"))
    both = stated.join(actual, F.col("file") == F.col("_file"), "full")
    unsafe = F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)")
    rule = (
        F.when(unsafe, "UNSAFE_PATH").when(F.col("_file").isNull(), "MISSING_FILE").when(F.col("file").isNull(), "UNLISTED_FILE").when(F.col("sha256") != F.col("_sha256"), "HASH_MISMATCH")
    )
    wrong = both.select(rule.alias("rule"), F.coalesce("file", "_file").alias("file")).where("rule IS NOT NULL")
    if not required:
        return wrong
    named = spark.createDataFrame([(t,) for t in required], "table string")
    return wrong.unionByName(named.join(stated, "table", "left_anti").select(F.lit("TABLE_ABSENT").alias("rule"), F.col("table").alias("file")))


def write_lineage(stated: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a dataset's lineage (level, name, hash, n) beside its manifest."""
    stated.write.mode("overwrite" if overwrite else "errorifexists").json(f"{path}/lineage")


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level string, name string, hash string, n bigint").option("mode", "FAILFAST").json(f"{path}/lineage")


def read_dataset(spark: SparkSession, path: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of a dataset whose files are all there and unchanged; else raises with what is wrong."""
    if wrong := verify(spark, path, tables).limit(20).collect():
        raise ValueError(f"the dataset isn't what its manifest says: {[tuple(r) for r in wrong]}")
    return {t: spark.read.parquet(f"{path}/tables/{t}") for t in tables}
