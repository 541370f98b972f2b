"""Token-id files: documents' ids one after the other, with Elias-Fano coded boundaries and document numbers.

A file is: magic, ids as little-endian unsigned 16-bit integers (32-bit if an id needs them), boundaries, document numbers, a
bit per document that says whether its number is null, and a footer with the lengths of the parts. Files are bounded in size; a
longer text has one of its own. Documents are found by select on the boundaries' stored samples.

Order: ascending doc_id, null first, equal numbers by the hash of the text, then by text. Cases: a null text is an empty one and gives the end id only;
repeated rows are all written; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import by_file, prepare, scratch_dir, table, tokenizer_file
from inkwell.llm.elias_fano import SAMPLE, EliasFano
from inkwell.llm.files import new_file, open_output, read_all
from inkwell.llm.tokens import file_encoder

MAGIC = b"INKTOK01"
#: Ids in a file, beyond which the next document starts another one.
FILE_IDS = 8_000_000
#: Documents whose boundaries are read at once: whole blocks of samples.
BLOCK = 8 * SAMPLE
_FOOTER = "<QQQQQB8s"


class Writer:
    """One file at a time; the ids go out as they come, only the boundaries are held."""

    def __init__(self, folder: str, vocabulary: int):
        self.folder, self.kind, self.out = folder, "<u2" if vocabulary <= 1 << 16 else "<u4", None

    def add(self, doc_id: int | None, ids: np.ndarray):
        """The manifest's row of the file before, if this document starts another."""
        done = self.close() if self.out and self.total + len(ids) > FILE_IDS else None
        if self.out is None:
            self.name = new_file(self.folder, ".tok")
            self.out, self.ends, self.docs, self.total = open_output(self.name), [], [], 0
            self.out.write(MAGIC)
        self.out.write(ids.astype(self.kind).tobytes())
        self.total += len(ids)
        self.ends.append(self.total)
        self.docs.append(doc_id)
        return done

    def close(self):
        known = np.array([d for d in self.docs if d is not None], dtype=np.int64)
        low = int(known.min()) if len(known) else 0
        parts = [EliasFano.encode(np.array(self.ends)).to_bytes(), EliasFano.encode((known - low).astype(np.uint64)).to_bytes(), np.packbits([d is None for d in self.docs]).tobytes()]
        self.out.write(b"".join(parts))
        self.out.write(struct.pack("<q", low))
        self.out.write(struct.pack(_FOOTER, self.total, len(self.docs), *map(len, parts), 2 if self.kind == "<u2" else 4, MAGIC))
        self.out.close()
        self.out = None
        return self.name, len(self.docs), self.total


class Reader:
    """A token file's documents, a block at a time by select on the boundaries; ids are views of the file's bytes."""

    def __init__(self, data: bytes):
        total, self.n, *sizes, width, magic = struct.unpack_from(_FOOTER, data, len(data) - struct.calcsize(_FOOTER))
        if magic != MAGIC or data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", total, 8)
        at, parts = 8 + total * width, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        self.low = struct.unpack_from("<q", data, at)[0]
        self.ends, self.numbers, self.nulls = EliasFano.from_bytes(parts[0]), EliasFano.from_bytes(parts[1]), np.frombuffer(parts[2], np.uint8)
        self.known = 0  # numbers read so far

    def blocks(self, size: int):
        """(document numbers, starts, ends) of so many documents each."""
        before = 0
        for at in range(0, self.n, size):
            stop = min(self.n, at + size)
            ends = self.ends.block(at, stop).astype(np.int64)
            null = np.unpackbits(self.nulls[at // 8 : (stop + 7) // 8])[at % 8 :][: stop - at].astype(bool)
            some = int((~null).sum())
            numbers = iter((self.numbers.block(self.known, self.known + some).astype(np.int64) + self.low).tolist())
            self.known += some
            yield [None if x else next(numbers) for x in null], np.append(before, ends[:-1]), ends
            before = int(ends[-1])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs (doc_id, text) to files in folder; returns the manifest: part, number, file, n_docs, n_tokens."""
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))  # rows of one number, or of none, are dealt too
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    names = ["part", "number", "file", "n_docs", "n_tokens"]

    def run(batches):
        encoder = file_encoder(tokenizer)
        writer, part, number = Writer(f"{folder}/files", encoder.tokenizer.get_vocab_size()), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        rows = []
        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                if done := writer.add(doc, np.concatenate([np.frombuffer(x, "<u4"), end])):
                    rows.append((part, len(rows), *done))
        if writer.out:
            rows.append((part, len(rows), *writer.close()))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    manifest = ordered.mapInArrow(run, "part bigint, number bigint, file string, n_docs bigint, n_tokens bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return manifest.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all files before each: sums per part first, so that one task sees a row per part."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return manifest.join(before, "part").withColumn("file_start", own + F.col("before")).drop("before")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of all documents in the manifest's files."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                reader = Reader(read_all(name))
                for docs, starts, ends in reader.blocks(BLOCK):
                    data = [reader.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(ends - starts), pa.array(data, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return by_file(with_starts(manifest).select("file", "file_start")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    manifest = write(table(spark, sf_dir, "documents"), scratch_dir(spark, "token-files"), tokenizer_file("byte_bpe_50k.json"))
    return read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
