"""WARC archives with revisit resolution.

Headers (id, payload digest, size) are shuffled by digest to find the record
that keeps each payload; the others become revisit records without one.  Of
the payloads themselves only those whose digest may repeat, by a filter of
bounded size, meet the result in a shuffle, and none of the most frequent ones
does.  Every record is a gzip member of its own; an archive begins with a
``warcinfo`` record and is closed by size.  Archives are written by Spark's
text writer, one row each, so any file system that Spark writes to will do;
its line end, a zero byte, is padding that gzip allows behind the last member.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import drop_written, new_folder, ship, written
from .textkernel import tidy

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Uncompressed bytes at which an archive is closed; the record that passes them is its last.
FILE_BYTES = 16 << 20
#: Greatest number of 64-bit words of the filter that is broadcast: 4 MiB of bits.
FILTER_WORDS = 1 << 19
#: A digest is hot where its records are more than this part of what a task gets on average.
HOT = 0.25


def repeated_digests(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``payload_digest, first_id, n`` of every payload of ``min_bytes`` or more that several ids have.

    ``headers`` has page_id, payload_digest and payload_bytes.  Counts are
    combined before the shuffle, so a payload of very many records moves as one
    row for each task.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    # rows without an id revisit the one that has one
    several = (F.col("first_id") < F.col("last_id")) | F.col("first_id").isNotNull() & (F.col("n") > 1)
    return firsts.where(several).select(F.col("payload_digest").alias("_digest"), "first_id", "n")


def _bits(digest: Column, words: int) -> tuple[Column, Column]:
    """Word of the filter that a digest falls on, and three bits of it."""
    h = F.xxhash64(digest)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(words)), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def filter_of(repeated: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``_word, _mask``: a Bloom filter of the digests, of 24 bits for each up to FILTER_WORDS words in all, and the number of words."""
    words = 1
    while words < FILTER_WORDS and 64 * words < 24 * n:
        words *= 2
    word, mask = _bits(F.col("_digest"), words)
    return repeated.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask")), words


def records_of(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 100) -> DataFrame:
    """The pages as WARC records: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Payload is the text in UTF-8; null is empty.  Of the pages with an equal
    payload of ``min_bytes`` or more the one with the smallest id is the
    response and the others revisit it.  Rows that repeat an id are the same
    capture and get the same type.  A page without an id cannot be referred to:
    it is a revisit where its payload has a response, and else a response.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    repeated = written(repeated_digests(rows.select("page_id", "payload_bytes", "payload_digest"), min_bytes), "digests")
    n, held = repeated.agg(F.count(F.lit(1)), F.sum("n")).first()
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    types = [F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to")]
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    if not n:
        kind = pages.schema[id_column].dataType
        drop_written(repeated)
        return rows.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    bits, words = filter_of(repeated, n)
    word, mask = _bits(F.col("payload_digest"), words)
    marked = rows.withColumns({"_at": word, "_bits": mask}).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    maybe = F.coalesce(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False)) & (F.col("payload_bytes") >= min_bytes)
    once = marked.where(~maybe).select(*columns, F.lit(None).cast(pages.schema[id_column].dataType).alias("first_id"))
    # hot digests: by definition fewer than partitions / HOT, so they are broadcast
    per_task = max(1, int(HOT * held / int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = repeated.where(F.col("n") > per_task).select("_digest", "first_id")
    met = marked.where(maybe).select(*columns).join(F.broadcast(hot.withColumnRenamed("first_id", "_hot")), F.col("payload_digest") == F.col("_digest"), "left").drop("_digest")
    cool = repeated.where(F.col("n") <= per_task).select("_digest", "first_id")
    asked = met.where(F.col("_hot").isNull()).select(*columns).join(cool, F.col("payload_digest") == F.col("_digest"), "left").select(*columns, "first_id")
    known = met.where(F.col("_hot").isNotNull()).select(*columns, F.col("_hot").alias("first_id"))
    return once.unionByName(known).unionByName(asked).select(*columns, *types)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + packer.compress(block) + packer.compress(END) + packer.flush()


def _archives(date: str, file_bytes: int):
    columns = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    clean = lambda text: re.sub("[\r\n]+", " ", text or "")
    name = lambda x: f"<urn:page:{'' if x is None else x}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, nth = 0, 0

        def close() -> pa.RecordBatch:
            info = b"software: quadrille\r\nformat: WARC File Format 1.1\r\n"
            first = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{TaskContext.get().partitionId()}:{nth}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)
            return pa.record_batch({"value": pa.array([b"".join([first, *held])], pa.binary())})

        for batch in batches:
            columns_at = [batch.schema.get_field_index(c) for c in columns]
            for k in range(batch.num_rows):
                page, url, payload, digest, length, kind, refers = (batch.column(c)[k].as_py() for c in columns_at)
                headers = [("WARC-Type", kind), ("WARC-Record-ID", name(page)), ("WARC-Date", date), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length))]
                if kind == "revisit":
                    headers += [("WARC-Refers-To", name(refers)), ("WARC-Profile", PROFILE)]
                block = payload.encode() if kind == "response" else b""
                held.append(_member([*headers, ("Content-Type", "text/html; charset=utf-8")], block))
                size += len(block) + 512
                if size >= file_bytes:
                    yield close()
                    held, size, nth = [], 0, nth + 1
                    tidy()
        if held:
            yield close()

    return run


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write records as gzip-compressed WARC files, each closed at ``file_bytes`` of content."""
    ship(records.sparkSession)
    # a revisit is written without its payload
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("").alias("payload")
    files = records.select("page_id", "url", payload, "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(_archives(date, file_bytes), "value binary")
    # text keeps the bytes of a string as they are
    files.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one after the other; a file that isn't compressed is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data) and data[at : at + 2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        parts = []
        while not unpacker.eof:
            piece = view[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("a gzip member is cut off")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        begin = end + 4
        at = begin + int(headers["Content-Length"])
        yield headers, data[begin:at]
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, url, payload_digest, payload_bytes, refers_to, content`` of each page's record below a path.

    A response's digest and length are taken of its block and must equal its
    headers; a revisit has no block, so its headers give them, and content is
    null.  Plain and gzip-compressed files are read; records of other types are
    passed over.
    """
    ship(spark)
    schema = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
        made = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        strip = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in (record for member in members(content.as_buffer().to_pybytes()) for record in parse(member)):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
                    if kind == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, length):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its headers")
                    rows.append((strip(headers["WARC-Record-ID"]), kind, headers["WARC-Target-URI"], digest, length, strip(headers.get("WARC-Refers-To")), block.decode() if kind == "response" else None))
                    size += len(block)
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)
            tidy()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > 0).select("content").mapInArrow(run, schema)


def archive(pages: DataFrame, path: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_bytes: int = 100, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages as deduplicated archives and read these back; one row for each page.

    Ids may be null or repeated.  A payload of any length is one record; it
    closes its archive.  An empty table gives an archive without records and no
    rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_warc(records_of(pages, id_column, url_column, payload_column, min_bytes), path, file_bytes=file_bytes)
    found = read_warc(spark, path)
    kind = pages.schema[id_column].dataType
    named = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(named("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"), "url", "content")
