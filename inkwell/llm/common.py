"""Shared helpers: table access, scratch tables, batch sizes, tokenizer files."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch sent to Python. Texts can be very long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 200, 1 << 26
#: Bits of an id filter (as powers of two, at least and at most), places a bit for each id, and bytes of each of Spark's bitmaps.
LEAST_BITS, MOST_BITS, PLACES, BITMAP_BYTES = 20, 29, 16, 4096
#: Where in a key its places begin.
SHIFTS = (0, 7, 14, 21, 28, 35)
#: Tasks that read files back, at most.
FILE_TASKS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Python worker holds at a time, and let workers import this package from where the driver has it.

    Both stay set in the session: a plan reads them when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir. Where that is unset, a local master gets a folder of
    its own; a cluster has none that all its machines see, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "inkwell-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to a shared scratch table and read it again, so that later steps don't depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_file(files: DataFrame) -> DataFrame:
    """A manifest's rows dealt evenly to as many tasks as there are files, up to a bound, since each row stands for a whole file."""
    return files.repartition(min(max(files.count(), 1), FILE_TASKS))


@dataclass(frozen=True)
class IdFilter:
    """A bitmap of hashed ids. Rows without a set place have none of the ids and needn't be shuffled; the others still have to be joined."""

    bits: int
    bitmap: np.ndarray

    def place(self, number: Column) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(1 << self.bits))

    def at(self, places: np.ndarray) -> np.ndarray:
        return (self.bitmap[places >> 3] >> (places & 7)) & 1 > 0

    def passes(self, places: pa.Array) -> pa.Array:
        """Whether each place is set."""
        return pa.array(self.at(places.to_numpy(zero_copy_only=False).astype(np.int64)))


class KeyFilter(IdFilter):
    """A Bloom filter of keys that are 64-bit hashes already; parts of a key are its places."""

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the keys."""
        found = np.ones(len(keys), bool)
        for shift in SHIFTS:
            found &= self.at((keys >> shift) & ((1 << self.bits) - 1))
        return found


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    own = 8 * BITMAP_BYTES
    parts = places.groupBy(F.expr(f"at div {own}").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % own).alias("bits"))
    found = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():
        found[r["part"] * BITMAP_BYTES :][:BITMAP_BYTES] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return found


def _bits(n: int) -> int:
    return min(max((PLACES * max(n, 1)).bit_length(), LEAST_BITS), MOST_BITS)


def id_filter(ids: DataFrame, column: str = "id") -> IdFilter:
    """The filter of all ids, of any type that xxhash64 takes. It grows with their number up to 2 ** MOST_BITS bits (64 MB); with more ids
    than that it lets more of the other rows pass, which costs shuffling but changes no result."""
    bits = _bits(ids.count())
    return IdFilter(bits, _bitmap(ids.select(F.pmod(F.xxhash64(column), F.lit(1 << bits)).alias("at")), bits))


def key_filter(ids: DataFrame, column: str) -> KeyFilter:
    """The filter of all keys, which are 64-bit hashes; sized as an id filter, and more exact."""
    bits = _bits(ids.count())
    places = F.array(*[F.shiftright(column, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in SHIFTS])
    return KeyFilter(bits, _bitmap(ids.select(F.explode(places).alias("at")), bits))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it several times in body."""
    return F.transform(F.array(value), body)[0]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
