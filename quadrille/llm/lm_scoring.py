"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and unigrams with a
uniform floor.  Mixture weights depend on how often the context was seen, in
buckets of powers of two, and are learned by expectation-maximisation on a
deleted part of the training documents with the counts of the rest.

Counts cover all documents and are exact.  A chunk of documents lists its
distinct n-grams once, in blobs by hash bucket; a bucket adds up the counts of
all chunks and answers each chunk in the order of its list, so answers carry
counts only.  Chunks and answers meet again by chunk, and the documents are
scored there.  The number of buckets follows the input, so that neither a
chunk nor a bucket outgrows a task.  Both grow with the fourth root of the
input, up to eight times, so a chunk's lists, one for each bucket that it has
n-grams in, grow more slowly than the square of the input; from some terabytes
on there are as many as a chunk has different n-grams, and they grow in
proportion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .session import drop_written, ship, written
from .textkernel import SPACE, chunks, cut, mix

U64 = np.uint64
END, START = U64(0x0E0D0C0B0A090807), U64(0x1716151413121110)
LEFT, RIGHT = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)
#: Text bytes of a chunk, and of the text whose n-grams a bucket gets on average, for an input of up to SCALE bytes, and how much larger they become.
CHUNK, BUCKET, SCALE, LARGER = 8 << 20, 8 << 20, 1 << 30, 8
#: Context-frequency buckets: 0, 1, 2-3, 4-7 and so on; the last is open.
CONTEXTS = 20
#: Cells per decade of a probability, and cells, for the held-out events.
FINE, CELLS = 16, 192
FOLDS = 10


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as single bytes, with those of 255 and more behind."""
    large = counts >= 255
    small = np.where(large, 255, counts).astype(np.uint8)
    return small.tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(blob, np.uint8, n)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(blob, "<u8", offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """The lower 48 bits of each key; its bucket holds the rest of what tells keys apart."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def fold_of(doc_id) -> int:
    """CRC-32 of the id's text modulo 10: 0 is held out, 1 is the deleted part, the others train both; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


@dataclass
class Chunk:
    """Tokens of a run of documents as numbers of the chunk's distinct words."""

    tags: np.ndarray
    token: np.ndarray
    start: int
    first: np.ndarray
    folds: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) numbers as one, and which of them each token is."""
        before = np.empty(len(self.token), np.int64)
        before[1:] = self.token[:-1]
        before[self.first[:-1]] = self.start
        return np.unique(before * len(self.tags) + self.token, return_inverse=True)

    def order(self, pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, and pairs, in the order of their buckets, and these buckets."""
        with np.errstate(over="ignore"):
            tags = self.tags.astype(np.uint64)
            words = (mix(tags) % U64(buckets)).astype(np.int64)
            two = mix(tags[pairs // len(tags)] * LEFT + tags[pairs % len(tags)] * RIGHT)
            both = (two % U64(buckets)).astype(np.int64)
        a, b = np.argsort(words, kind="stable"), np.argsort(both, kind="stable")
        return a, words[a], b, both[b]

    def to_row(self) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        return {"tags": pack(self.tags.tobytes()), "token": pack(self.token.astype("<u4").tobytes()), "start": self.start, "first": self.first.astype("<i8").tobytes(), "folds": self.folds.astype(np.uint8).tobytes()}

    @classmethod
    def of_row(cls, row: dict) -> Chunk:
        unpack = lambda x: zstandard.ZstdDecompressor().decompress(x)
        return cls(np.frombuffer(unpack(row["tags"]), np.uint32), np.frombuffer(unpack(row["token"]), "<u4").astype(np.int64), row["start"], np.frombuffer(row["first"], "<i8"), np.frombuffer(row["folds"], np.uint8))


def growth(size: int) -> float:
    """How much larger chunks and buckets are than for a small input."""
    return float(min(max(1.0, (size / SCALE) ** 0.25), LARGER))


def read_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.Array, np.ndarray, Chunk]]:
    """Number, document ids, word hashes and tokens of each chunk of a partition of (_id, text)."""
    nth = TaskContext.get().partitionId() << 32
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def close() -> tuple[int, pa.Array, np.ndarray, Chunk]:
        ids = pa.concat_arrays([i for i, _, _ in held])
        lengths = np.concatenate([n for _, _, n in held]) + 1
        first = np.concatenate([[0], np.cumsum(lengths)])
        hashes = np.empty(int(first[-1]) + 1, np.uint64)
        ends = first[1:] - 1
        word = np.ones(len(hashes), bool)
        word[ends] = word[-1] = False
        hashes[word] = np.concatenate([h for _, h, _ in held])
        hashes[ends], hashes[-1] = END, START
        words, token = np.unique(hashes, return_inverse=True)
        folds = np.array([fold_of(i) for i in ids.to_pylist()], np.uint8)
        return nth, ids, words, Chunk((words >> U64(32)).astype(np.uint32), token[:-1].astype(np.int64), int(token[-1]), first, folds)

    for batch in batches:
        for part, data, offsets in chunks(batch):
            words = cut(data, offsets, SPACE)
            held.append((part.column(0), words.hash, words.counts))
            size += len(data) + 64 * part.num_rows
            if size >= chunk_bytes:
                yield close()
                nth, held, size = nth + 1, [], 0
    if held:
        yield close()


REQUEST = "bucket long, chunk long, n long, words binary, word_train binary, word_deleted binary, pairs binary, pair_train binary, pair_deleted binary, tokens long, tokens_main long"
ANSWER = "bucket long, chunk long, word_train binary, word_deleted binary, n_words long, pair_train binary, pair_deleted binary, n_pairs long, types long, types_main long, tokens long, tokens_main long"
CHUNK_ROW = "chunk long, ids binary, tags binary, token binary, start long, first binary, folds binary"


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in columns], names=[name for name, _ in columns])


def _requests(buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, words, chunk in read_chunks(batches, chunk_bytes):
            pairs, which = chunk.pairs()
            lengths = np.diff(chunk.first)
            train, deleted = np.repeat(chunk.folds != 0, lengths), np.repeat(chunk.folds == 1, lengths)
            count = lambda at, mask, n: np.bincount(at[mask], minlength=n)
            word_train, word_deleted = count(chunk.token, train, len(words)), count(chunk.token, deleted, len(words))
            word_train[chunk.start], word_deleted[chunk.start] = (chunk.folds != 0).sum(), (chunk.folds == 1).sum()
            pair_train, pair_deleted = count(which, train, len(pairs)), count(which, deleted, len(pairs))
            with np.errstate(over="ignore"):
                keys = mix(words[pairs // len(words)] * LEFT ^ words[pairs % len(words)] * RIGHT)
            a, a_bucket, b, b_bucket = chunk.order(pairs, buckets)
            asked = np.union1d(a_bucket, b_bucket)
            edges = [np.searchsorted(of, asked, side).tolist() for of in (a_bucket, b_bucket) for side in ("left", "right")]
            rows, total, main = [], int(train.sum()), int((train & ~deleted).sum())
            for k, a_begin, a_end, b_begin, b_end in zip(asked.tolist(), *edges, strict=True):
                w, p = a[a_begin:a_end], b[b_begin:b_end]
                rows.append(
                    {
                        "bucket": k, "chunk": number, "n": len(w), "words": words[w].tobytes(), "word_train": pack_counts(word_train[w]), "word_deleted": pack_counts(word_deleted[w]),
                        "pairs": pack_keys(keys[p]), "pair_train": pack_counts(pair_train[p]), "pair_deleted": pack_counts(pair_deleted[p]), "tokens": total, "tokens_main": main,
                    }
                )
                total = main = 0
                if len(rows) >= 256:
                    yield _table(rows, REQUEST)
                    rows = []
            if rows:
                yield _table(rows, REQUEST)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Answers of one bucket: for each chunk the counts over all chunks."""
    rows = table.to_pylist()

    def totals(keys: list[np.ndarray], train: list[np.ndarray], deleted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        t = np.bincount(which, np.concatenate(train)).astype(np.int64)
        d = np.bincount(which, np.concatenate(deleted)).astype(np.int64)
        return t[which], d[which], np.array([(t > 0).sum(), (t > d).sum()])

    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    pairs = [unpack_keys(r["pairs"]) for r in rows]
    word_train, word_deleted, types = totals(words, [unpack_counts(r["word_train"], r["n"]) for r in rows], [unpack_counts(r["word_deleted"], r["n"]) for r in rows])
    pair_train, pair_deleted, _ = totals(pairs, [unpack_counts(r["pair_train"], len(p)) for r, p in zip(rows, pairs, strict=True)], [unpack_counts(r["pair_deleted"], len(p)) for r, p in zip(rows, pairs, strict=True)])
    # the start of a text is counted as a context, and is no word
    start = np.concatenate(words) == START
    begun = np.array([(word_train[start] > 0).any(), (word_train[start] > word_deleted[start]).any()]).astype(np.int64)
    out, a, b = [], 0, 0
    for r, w, p in zip(rows, words, pairs, strict=True):
        wide, deep = slice(a, a + len(w)), slice(b, b + len(p))
        a, b = a + len(w), b + len(p)
        known = types - begun if not out else np.zeros(2, np.int64)
        out.append(
            {
                "bucket": r["bucket"], "chunk": r["chunk"], "word_train": pack_counts(word_train[wide]), "word_deleted": pack_counts(word_deleted[wide]), "n_words": len(w),
                "pair_train": pack_counts(pair_train[deep]), "pair_deleted": pack_counts(pair_deleted[deep]), "n_pairs": len(p), "types": int(known[0]), "types_main": int(known[1]), "tokens": r["tokens"], "tokens_main": r["tokens_main"],
            }
        )
    return pa.Table.from_batches([_table(out, ANSWER)])


def _chunk_rows(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, _, chunk in read_chunks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
                out.write_batch(pa.record_batch([ids], names=["id"]))
            yield _table([{"chunk": number, "ids": sink.getvalue().to_pybytes()} | chunk.to_row()], CHUNK_ROW)

    return run


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of the count's binary logarithm."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], CONTEXTS - 1)


def cell_of(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else the cell of its decimal logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.floor(-np.log10(np.maximum(p, 1e-300)) * FINE), 0, CELLS - 2), 0).astype(np.int64)


def cell_value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 10.0 ** (-(cell - 0.5) / FINE), 0.0)


MATCHED = CHUNK_ROW + ", word_train binary, pair_train binary, n_pairs long, cells binary, cell_counts binary"


def _match(buckets: int, tokens_main: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The chunk with the counts of its words and pairs, and its held-out events by cell."""
        if left.num_rows != 1:
            raise ValueError(f"{left.num_rows} chunks have one number; the input gave other partitions when it was read again")
        row = left.to_pylist()[0]
        chunk = Chunk.of_row(row)
        pairs, which = chunk.pairs()
        a, _, b, _ = chunk.order(pairs, buckets)
        answers = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        if sum(r["n_words"] for r in answers) != len(a) or sum(r["n_pairs"] for r in answers) != len(b):
            raise ValueError("counts do not fit the chunk; the input gave other partitions when it was read again")

        def placed(order: np.ndarray, name: str, size: str) -> np.ndarray:
            out = np.empty(len(order), np.int64)
            out[order] = np.concatenate([unpack_counts(r[name], r[size]) for r in answers])
            return out

        word_train, word_deleted = placed(a, "word_train", "n_words"), placed(a, "word_deleted", "n_words")
        pair_train, pair_deleted = placed(b, "pair_train", "n_pairs"), placed(b, "pair_deleted", "n_pairs")
        deleted = np.repeat(chunk.folds == 1, np.diff(chunk.first))
        pair = which[deleted]
        before = (word_train - word_deleted)[pairs[pair] // len(chunk.tags)]
        two = (pair_train - pair_deleted)[pair] / np.maximum(before, 1)
        one = (word_train - word_deleted)[chunk.token[deleted]] / max(tokens_main, 1)
        cells, n = np.unique((context_bucket(before) * CELLS + cell_of(two)) * CELLS + cell_of(one), return_counts=True)
        done = {"word_train": pack_counts(word_train), "pair_train": pack_counts(pair_train), "n_pairs": len(pairs), "cells": cells.astype("<i8").tobytes(), "cell_counts": n.astype("<i8").tobytes()}
        return pa.Table.from_batches([_table([row | done], MATCHED)])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.record_batch({"cell": np.frombuffer(cells, "<i8"), "n": np.frombuffer(counts, "<i8")})


def learn_weights(cells: np.ndarray, counts: np.ndarray, floor: float, rounds: int = 40) -> np.ndarray:
    """Weights of bigram, unigram and floor for each context bucket, by expectation-maximisation.

    A bucket without held-out events takes those of all events together; an
    unseen context has no bigram estimate, so its bigram weight is 0.
    """
    context, two, one = cells // CELLS // CELLS, cell_value(cells // CELLS % CELLS), cell_value(cells % CELLS)
    p = np.stack([two, one, np.full(len(cells), floor)])

    def em(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weights[:, None] * p
            share /= share.sum(axis=0)
            weights = (share * n).sum(axis=1) / n.sum()
        return weights

    common = em(p, counts) if len(cells) else np.full(3, 1 / 3)
    out = np.tile(common, (CONTEXTS, 1))
    for b in range(CONTEXTS):
        if (at := context == b).any():
            out[b] = em(p[:, at], counts[at])
    out[:, 2] = np.maximum(out[:, 2], 1e-6)
    out[0, 0] = 0
    if out[0].sum() == 0:
        out[0, 2] = 1
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """What scoring needs besides the counts: ``tokens`` and ``types`` of training, and the mixture weights."""

    tokens: int
    types: int
    weights: np.ndarray


def _score(model: Model, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of_row(row)
                pairs, which = chunk.pairs()
                word, pair = unpack_counts(row["word_train"], len(chunk.tags)), unpack_counts(row["pair_train"], row["n_pairs"])
                own = word[chunk.token]
                before = word[pairs // len(chunk.tags)]
                two = (pair / np.maximum(before, 1))[which]
                weights = model.weights[context_bucket(before)][which]
                p = weights[:, 0] * two + weights[:, 1] * own / max(model.tokens, 1) + weights[:, 2] / (model.types + 1)
                base = np.log10((own + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
                at = chunk.first[:-1]
                ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
                yield pa.record_batch(
                    {
                        "doc_id": ids.cast(id_type), "held_out": chunk.folds == 0, "n_tokens": np.diff(chunk.first).astype(np.int64), "n_known": np.add.reduceat((own > 0).astype(np.int64), at),
                        "train_tokens": np.full(len(at), model.tokens, np.int64), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at),
                    }
                )

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the additive unigram score; ``score`` the model's.  A
    null text is empty: its only token is the end.  Ids may be null or
    repeated; each row is a document of its own.  An empty table gives no rows,
    and one without training documents scores everything by the floor.  Other
    columns are not read.

    The input is read twice and must give the same partitions both times, as
    tables do; where it doesn't, the mismatch is found and raised.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_bytes, bucket_bytes = int(CHUNK * growth(size)), int(BUCKET * growth(size))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    asked = rows.mapInArrow(_requests(buckets, chunk_bytes), REQUEST)
    answers = written(asked.groupBy("bucket").applyInArrow(_add_up, ANSWER), "lm-counts")
    total = answers.agg(*(F.sum(c).alias(c) for c in ("tokens", "tokens_main", "types", "types_main"))).first()
    tokens, tokens_main, types, types_main = (total[k] or 0 for k in range(4))
    own = rows.mapInArrow(_chunk_rows(chunk_bytes), CHUNK_ROW)
    matched = written(own.groupBy("chunk").cogroup(answers.drop("types", "types_main", "tokens", "tokens_main").groupBy("chunk")).applyInArrow(_match(buckets, tokens_main), MATCHED), "lm-chunks")
    drop_written(answers)
    # one row for each cell at most
    events = matched.select("cells", "cell_counts").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([e["cell"] for e in events], np.int64), np.array([e["n"] for e in events], np.float64), 1 / (types_main + 1))
    id_type = rows.schema["_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return matched.drop("cells", "cell_counts").mapInArrow(_score(Model(tokens, types, weights), to_arrow_type(id_type)), schema)
