"""Byte-level BPE encoding and decoding by the tokenizers library over Arrow batches: ids with character offsets, and back.

Cases: a null text is an empty one (no ids); an empty table gives an empty table; repeated rows each give a row; other columns
than the key and the text are ignored. Very long texts are encoded whole, a batch holds a bounded number of rows.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import prepare, table, tokenizer_file
from inkwell.llm.tokens import byte_table, rank_encoder


def decode_stream(parts: Iterable[bytes]) -> Iterator[str]:
    """Characters as soon as all their bytes are there; a character split over tokens comes with its last one."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for p in parts:
        yield decoder.decode(p)
    yield decoder.decode(b"", True)


class Decoder:
    """Ids back to bytes: their tokens are written in visible characters, which the reversed byte table turns into bytes."""

    def __init__(self, tokens: list[bytes]):
        show, back = byte_table()
        self.shown = ["".join(map(show.__getitem__, t)) for t in tokens]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.back = {ord(c): b for c, b in back.items()}

    def data(self, ids: list[int]) -> bytes:
        """The bytes; ids that end within a character give its first bytes."""
        return "".join(map(self.shown.__getitem__, ids)).translate(self.back).encode("latin-1")

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character that each id has bytes of; a split character belongs to all its ids."""
        chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # continuation bytes stay with the one before
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        return (chars[starts], chars[ends - 1] + 1) if len(ids) else (starts, ends)


@lru_cache(maxsize=1)
def decoder(ranks: str) -> Decoder:
    return Decoder(rank_encoder(ranks)[1])


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, starts and ends (arrays of int): the characters that each id has bytes of."""

    def run(batches):
        encoder, made = rank_encoder(ranks)[0], decoder(ranks)
        for batch in batches:
            rows = [np.frombuffer(x, "<u4") for x in encoder.encode(batch.column("text").to_pylist())]
            spans = [made.offsets(r, made.data(r.tolist())) for r in rows]
            columns = [batch.column("doc_id"), *(_lists(x) for x in (rows, [a for a, _ in spans], [b for _, b in spans]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded (doc_id, ids, ...) with data: the bytes that the ids stand for."""
    names = [c for c in encoded.columns if c != "data"]

    def run(batches):
        made = decoder(ranks)
        for batch in batches:
            data = [made.data(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(data, pa.binary())], names=[*names, "data"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*[f"`{c}`" for c in names]).schema)
    return encoded.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{schema}, data binary")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas and of the bytes they decode to, and n_split: ids that begin within
    a character. Ids and bytes don't leave the task, which encodes, decodes and takes offsets as ``encode`` and ``decode`` do."""

    def run(batches):
        encoder, made = rank_encoder(ranks)[0], decoder(ranks)
        for batch in batches:
            n, ids_sha, text_sha, split = [], [], [], []
            for x in encoder.encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(x, "<u4")
                listed = ids.tolist()
                data = made.data(listed)
                starts, ends = made.offsets(ids, data)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(data).hexdigest())
                split.append(int((starts[1:] < ends[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(split, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))
