"""WARC archives with revisits resolved: equal payloads are stored once, later copies become revisit records.

``resolve`` writes the headers once, shuffles them by payload digest and joins the revisits to their original response. A payload is
only shuffled if its digest may occur twice, and then once per digest and map task, so a hot payload is a few rows; all others, and
those below ``MIN_REVISIT`` bytes, go straight to the archives. ``write_archives`` writes records with fresh headers as gzip members, one
member a record, in files of bounded size that begin with a warcinfo record; ``read_archives`` reads them back.

Cases: a null payload is an empty one; a null url has no target header and reads back as null; a url loses control characters, and
blanks at its ends when it is read back; payloads below ``MIN_REVISIT`` bytes are always stored; equal payloads with the same smallest
page_id (repeated rows) are all stored, under one record id; a null page_id is last in order; an empty table gives no archives; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import by_file, cut, id_filter, prepare, scratch_dir, table
from inkwell.llm.files import new_file, open_output, read_all

#: Payloads of fewer bytes are never turned into revisits.
MIN_REVISIT = 100
#: Bytes of compressed records in an archive, beyond which the next record starts another one.
ARCHIVE_BYTES = 32_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_digest, payload_bytes, payload and, on revisits (whose payload is null), refers_to: page_id and url of
    the response, the row of the smallest page_id with an equal payload."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha2("payload", 256).alias("payload_digest")
    whole = ["page_id", "url", "payload_digest", "payload_bytes"]
    # near tells most payloads apart at a fraction of the digest's price: payloads go by it, and only those taken are digested again.
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.xxhash64("payload").alias("near"), "payload")
    headers = cut(rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "url", digest, "payload_bytes", "near"), "headers")
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first")
    firsts = headers.groupBy("payload_digest").agg(first, F.count("*").alias("n"), F.first("near").alias("near")).where("n > 1")
    firsts = cut(firsts.select("payload_digest", "near", F.struct("first.page_id", "first.url").alias("first")), "firsts")
    known = id_filter(firsts, "near")
    shared = spark.sparkContext.broadcast(known)

    def select(wanted: bool, columns: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                passed = shared.value.passes(batch.column("at"))
                large = pc.greater_equal(batch.column("payload_bytes"), MIN_REVISIT)
                maybe = pc.and_(passed, large)
                yield batch.filter(maybe if wanted else pc.invert(maybe)).drop_columns(["at"])

        columns = columns.withColumn("at", known.place(F.col("near"))).drop("near")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.drop("at").schema)
        return columns.mapInArrow(run, schema)

    none = F.lit(None).cast("struct<page_id: bigint, url: string>").alias("refers_to")
    alone = select(False, rows).select("page_id", "url", digest, "payload_bytes", "payload", none)
    # Copies are headers; of the payloads one per digest is kept before the shuffle.
    copies = select(True, headers).join(firsts.drop("near"), "payload_digest", "left")
    payloads = select(True, rows.select("payload_bytes", "near", "payload")).select(digest, "payload").groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    stored = copies.where(~again).join(payloads, "payload_digest").select(*whole, "payload", none)
    revisits = copies.where(again).select(*whole, F.lit(None).cast("binary").alias("payload"), F.struct(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url")).alias("refers_to"))
    return alone.unionByName(stored).unionByName(revisits)


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record: the same in every attempt of a task, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _clean(uri: str) -> str:
    return "".join(c for c in uri if c >= " ")


def record(kind: str, page_id: int | None, uri: str | None, digest: str, size: int, payload: bytes, refers_to: dict | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers name the response."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to['page_id'], digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to['page_id']}"]
        if refers_to["url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(refers_to['url'])}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + _CRLF * 2 + payload + _CRLF * 2


def info(name: str, date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: inkwell\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name.rpartition('/')[2]}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2


def parse_records(stream):
    """(headers, block) of each record of an archive; stream: a file of gzip members."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := f.readline()) not in (b"", _CRLF):
                name, _, value = line.decode().rstrip("\r\n").partition(":")
                headers[name] = value.strip()
            yield headers, f.read(int(headers["Content-Length"]))
            f.read(4)


def write_archives(resolved: DataFrame, folder: str) -> DataFrame:
    """Write resolved pages as archives in folder; returns the manifest of the files that finished tasks wrote: file, n_records."""
    names = ["file", "n_records"]
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # of the whole run, so that revisits can name it

    def member(data: bytes) -> bytes:
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    def run(batches):
        out, done = None, []
        for batch in batches:
            for x in batch.to_pylist():
                kind = "response" if x["refers_to"] is None else "revisit"
                packed = member(record(kind, x["page_id"], x["url"], x["payload_digest"], x["payload_bytes"], x["payload"] or b"", x["refers_to"], date))
                if out is None:
                    name, size, n = new_file(f"{folder}/archives", ".warc.gz"), 0, 0
                    out = open_output(name)
                    out.write(member(info(name, date)))
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = done.append((name, n))
        if out:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done])

    manifest = resolved.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "file string, n_records bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return manifest.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, block of every record.

    The digest of a response is taken from its block anew; a revisit has its response's.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", block binary" * payloads

    def run(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for h, block in parse_records(io.BytesIO(read_all(name))):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    own = h["WARC-Type"] == "response"
                    rows.append(
                        {
                            "page_id": int(h["X-Page-ID"]) if h["X-Page-ID"] else None,
                            "url": h.get("WARC-Target-URI"),
                            "payload_bytes": len(block) if own else int(h["X-Payload-Length"]),
                            "payload_digest": hashlib.sha256(block).hexdigest() if own else h["WARC-Payload-Digest"].removeprefix("sha256:"),
                            "record_type": h["WARC-Type"],
                            "refers_to": None if own else int(h["X-Refers-To-Page-ID"]),
                        }
                        | ({"block": block} if payloads else {})
                    )
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("block", pa.binary())] * payloads)
    return by_file(manifest.select("file")).mapInArrow(run, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    manifest = write_archives(resolve(table(spark, sf_dir, "pages")), scratch_dir(spark, "warc"))
    return read_archives(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
