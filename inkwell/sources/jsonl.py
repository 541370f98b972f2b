"""JSON lines: a writer that commits per task, the layout of cases, and lines that aren't objects.

The writer is a Python data source. A task writes to a folder of its own attempt; the driver moves the files of the attempts that count
into place when all are done, so a failed or repeated attempt leaves no file. Paths are those that pyarrow's file systems open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators.scan import scan

FORMAT = "inkwell_jsonl"


def _data_source() -> type:
    """The data source's class. It is made here, so that it is shipped whole and workers needn't be able to import this package."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        file: str
        name: str
        lines: int

    class Lines(DataSourceWriter):
        def __init__(self, path: str, overwrite: bool, run: str):
            self.uri, self.overwrite, self.run = path.rstrip("/"), overwrite, run

        def _fs(self):
            from pyarrow import fs

            if "://" in self.uri or self.uri.startswith("file:"):
                system, path = fs.FileSystem.from_uri(self.uri)
            else:
                system, path = fs.LocalFileSystem(), self.uri
            return system, path, f"{path}/_temporary/{self.run}"

        def write(self, iterator):
            import uuid

            from pyspark import TaskContext

            system, _, temporary = self._fs()
            part = TaskContext.get().partitionId()
            name, n = f"part-{part:05d}.jsonl", 0
            folder = f"{temporary}/{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{name}") as out:
                for row in iterator:
                    out.write(row[0].encode() + b"\n")
                    n += 1
            return Written(f"{folder}/{name}", name, n)

        def commit(self, messages):
            from pyarrow import fs

            system, path, _ = self._fs()
            there = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            old = [f.path for f in there if f.type == fs.FileType.File]
            if old and not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.uri} has files already")
            for f in old:
                system.delete_file(f)
            written = [m for m in messages if m is not None]
            for m in sorted(written, key=lambda m: m.name):
                if m.lines or m is written[0]:  # one file even if there are no lines
                    system.move(m.file, f"{path}/{m.name}")
            with system.open_output_stream(f"{path}/_SUCCESS"):
                pass
            self._clear(system, path)

        def abort(self, messages):
            import time

            system, path, _ = self._fs()
            for _ in range(10):  # tasks that are just being stopped may still open their file
                self._clear(system, path)
                time.sleep(0.2)

        def _clear(self, system, path):
            from pyarrow import fs

            if system.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
                system.delete_dir(f"{path}/_temporary")

    class JsonLines(DataSource):
        @classmethod
        def name(cls):
            return "inkwell_jsonl"

        def writer(self, schema, overwrite):
            return Lines(self.options["path"], overwrite, self.options["run"])

    return JsonLines


def write_lines(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (one text column) as lines, a file for each partition that has any, in the partitions' order."""
    import uuid

    if len(rows.columns) != 1 or not isinstance(rows.schema[0].dataType, T.StringType):
        raise ValueError("one text column is needed")
    rows.sparkSession.dataSource.register(_data_source())
    rows.write.format(FORMAT).option("path", path).option("run", uuid.uuid4().hex).mode("overwrite" if overwrite else "append").save()


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of all structs in it in order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    return value


def canonical_line(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as a JSON object with keys in order at every depth, without blanks, nulls kept."""
    columns = sorted(columns or rows.columns)
    return F.to_json(F.struct(*[_ordered(F.col(c), rows.schema[c].dataType).alias(c) for c in columns]), {"ignoreNullFields": "false"})


def write_cases(rows: DataFrame, kind: str, path: str, order: list[str], case: str = "case_id", overwrite: bool = False) -> None:
    """Write rows as lines {case_id, kind: {...}}, in order of the case and then of order over all files."""
    wrapped = rows.select(F.col(case).alias("case_id"), F.struct(*[c for c in rows.columns if c != case]).alias(kind), *[F.col(c).alias(f"_{c}") for c in order])
    keys = ["case_id", *[f"_{c}" for c in order]]
    placed = wrapped.repartitionByRange(*keys).sortWithinPartitions(*keys)
    write_lines(placed.select(canonical_line(wrapped, ["case_id", kind]).alias("value")), path, overwrite)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), reason (NOT_JSON or NOT_OBJECT), text of the lines that are neither blank nor JSON objects.

    Lines are numbered in their part of the file, and by what the parts before it have.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_at"))
    numbered = scan(lines, ("file",), ("_at",), total={"line": F.lit(1).cast("long")})
    parsed = F.try_parse_json(F.col("value"))
    reason = F.when(parsed.isNull(), "NOT_JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "NOT_OBJECT")
    return numbered.where(F.trim("value") != "").select("file", "line", reason.alias("reason"), F.col("value").alias("text")).where("reason IS NOT NULL")
