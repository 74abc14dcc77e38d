"""Harmonic packing of documents into fixed-length training sequences.

Class k holds pieces of length in (C/(k+1), C/k] and puts exactly k of them
into a sequence of C tokens, so a worker needs no view of other workers and a
bin needs no search.  Cutting is free, therefore a rest that would waste more
than ``slack`` of its class's sequence gives up a piece of exactly C/(k+1)
first.  What is left in open bins when a worker ends is laid end to end.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .session import ship
from .textkernel import chunks

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class HarmonicPacker:
    """Bins of one worker.  ``place`` and ``finish`` return the pieces whose sequences are closed."""

    def __init__(self, worker: int, capacity: int = 2048, slack: float = 0.02):
        self.capacity, self.slack = capacity, slack
        self.next_id = worker << 40
        self.open: dict[int, list] = defaultdict(list)

    def _close(self, pieces: list) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1
        return rows

    def place(self, doc, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // 4, 0, []
        for length in cut_lengths(total, self.capacity, self.slack):
            k = self.capacity // length
            self.open[k].append((doc, start, ids[4 * start : 4 * (start + length)], total))
            if len(self.open[k]) == k:
                out += self._close(self.open.pop(k))
            start += length
        return out

    def finish(self) -> list[tuple]:
        out, current, room = [], [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    head = ids[: 4 * room]
                    current.append((doc, start, head, total))
                    start, ids, room = start + len(head) // 4, ids[len(head) :], room - len(head) // 4
                    if not room:
                        out += self._close(current)
                        current, room = [], self.capacity
        if current:
            out += self._close(current)
        self.open.clear()
        return out


def pack(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 1, slack: float = 0.02) -> DataFrame:
    """One row for each piece of each document.

    A document is its token ids and then ``end_id``; a null text is empty, so
    its only id is ``end_id``.  Ids of documents may be null or repeated: every
    row is packed.  An empty table gives no rows.  Other columns are not read.
    Sequence ids hold the input partition's number, so a lost task that runs
    again gives the same ones and no two tasks share any.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, kind = encoder(shared.value), HarmonicPacker(TaskContext.get().partitionId(), capacity, slack), None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
            return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, _, _ in chunks(batch, limit=4 << 20):
                found = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found += packer.place(doc, (encode(text) if text else b"") + end)
                if found:
                    yield batch_of(found)
        if found := packer.finish():
            yield batch_of(found)

    return rows.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
