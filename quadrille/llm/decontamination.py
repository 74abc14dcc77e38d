"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of documents.  Its words become symbols: those of the
benchmark's vocabulary are numbered, everything else, and the end of each
document, is a separator.  Runs of symbols that are shorter than the shortest
phrase cannot hold one and are left out.  Of the rest a suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix; phrases are searched
backwards through its ranks, all at once, and their occurrences located by
walking to sampled suffix positions.  Spans are merged by document.

The benchmark is encoded once and broadcast in blocks of bounded size.  One
block is the usual case; with several, each gives the spans of the texts it
hits, and these are merged by the text's hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import INTERNAL, ship, written
from .textkernel import ALNUM, CHUNK_BYTES, Words, chunks, cut, windows

#: Every how many text positions the suffix array keeps a sample.
SAMPLE = 8
#: Text bytes of the benchmark in a block; its arrays, which a worker holds, are several times that.
BLOCK_BYTES = 16 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling.  Separators (0) differ from each other, by their place."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ranked = rank[order]
        new = np.empty(n, np.int64)
        if step == 1:
            differs = np.r_[False, ranked[1:] != ranked[:-1]]
        else:
            key = keys[order]
            differs = np.r_[False, key[1:] != key[:-1]]
        new[order] = np.cumsum(differs)
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence; each level holds one bit of every symbol and the running count of ones."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(alphabet - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(bit) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        # where the run of each symbol begins once all levels are done
        every = np.arange(alphabet)
        self.begin = self._descend(every, np.zeros(alphabet, np.int64))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._descend(symbol, position) - self.begin[symbol]

    def _descend(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        at = position
        for k, (ones, zeros) in enumerate(self.levels):
            upper = (symbol >> (self.bits - 1 - k)) & 1
            before = ones[at]
            at = np.where(upper == 1, zeros + before, at - before)
        return at

    def access_rank(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        at, symbol = position, np.zeros(len(position), np.int64)
        for ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            symbol = 2 * symbol + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Full-text index of symbols 1..alphabet-1 with separators 0; phrases hold no separator."""

    def __init__(self, text: np.ndarray, alphabet: int):
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], alphabet)
        self.first = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet), out=self.first[1:])
        # separators are ordered by place and not by what follows, so no walk may cross one: each run's first word is sampled too
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.marked = kept
        self.mark_rank = np.cumsum(kept) - kept
        self.samples = order[kept]
        self.size = len(text)

    def search(self, symbols: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that begin with each phrase; phrases are runs of ``symbols``."""
        low = np.zeros(len(start), np.int64)
        high = np.full(len(start), self.size, np.int64)
        live = np.arange(len(start))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = symbols[start[live] + lengths[live] - back]
            low[live] = self.first[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        found = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            done = self.marked[at]
            found[left[done]] = self.samples[self.mark_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbol, rank = self.bwt.access_rank(at)
            at = self.first[symbol] + rank
            steps += 1
        return found


class Phrases:
    """Distinct phrases of benchmark items: windows of ``size`` words, or a shorter item as a whole, as runs of the items' symbols."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        data = [t.encode() for _, t in items]
        words = cut(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), ALNUM)
        self.vocabulary = np.unique(words.hash)
        self.symbols = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.int32)
        n, first = words.counts, words.first[:-1]
        many = np.where(n > 0, np.maximum(n - size, 0) + 1, 0)
        start = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        lengths = np.repeat(np.minimum(n, size), many)
        key = np.zeros(len(start), np.uint64)
        for length in np.unique(lengths).tolist():
            at = lengths == length
            key[at] = windows(words.hash, length)[start[at]]
        owner = np.repeat(np.array([number[i] for i, _ in items], np.int32), many)
        # each phrase once, with the items that own it in a run of ``owner``
        _, place, which = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.lengths = start[place], lengths[place]
        pairs = np.unique(which * max(len(self.items), 1) + owner)
        self.owner = (pairs % max(len(self.items), 1)).astype(np.int32)
        self.owner_edge = np.searchsorted(pairs // max(len(self.items), 1), np.arange(len(place) + 1))
        self.shortest = int(self.lengths.min(initial=size)) if len(place) else 0

    def owners(self, phrase: int) -> list[int]:
        return self.owner[self.owner_edge[phrase] : self.owner_edge[phrase + 1]].tolist()

    def held(self, symbols: np.ndarray) -> np.ndarray:
        """The phrases all of whose symbols are among these."""
        absent = np.ones(len(self.vocabulary) + 1, bool)
        absent[symbols] = False
        missing = np.r_[0, np.cumsum(absent[self.symbols])]
        return np.flatnonzero(missing[self.start + self.lengths] == missing[self.start])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word; 0 for one that the benchmark lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        near = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[near] == hashes, near + 1, 0)


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word in the shard) of all occurrences inside documents."""
    none = np.zeros(0, np.int64)
    if not len(words.hash) or not len(phrases.start):
        return none, none
    symbol = phrases.numbers(words.hash)
    # runs of known words that lie in one document
    known = symbol > 0
    opens = np.zeros(len(symbol) + 1, bool)
    opens[words.first] = True
    start = np.flatnonzero(known & (np.r_[True, ~known[:-1]] | opens[:-1]))
    stop = np.flatnonzero(known & (np.r_[~known[1:], True] | opens[1:])) + 1
    long = stop - start >= phrases.shortest
    start, size = start[long], (stop - start)[long]
    if not len(start):
        return none, none
    # each run, and one separator behind it
    total = size + 1
    base = np.cumsum(total) - total
    place = np.arange(int(total.sum())) - np.repeat(base - start, total)
    text = np.where(np.arange(len(place)) == np.repeat(base + size, total), 0, symbol[np.minimum(place, len(symbol) - 1)])
    asked = phrases.held(text)
    if not len(asked):
        return none, none
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.symbols, phrases.start[asked], phrases.lengths[asked])
    n = high - low
    which = np.repeat(asked, n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
    return which, place[index.locate(rows)]


def removal_spans(words: Words, which: np.ndarray, at: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Mask of the words inside any occurrence."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[which], -1)
    return np.cumsum(edge)[:-1] > 0


def blocks_of(benchmark: DataFrame, size: int, id_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The items, a null id named ``null``, in blocks of about ``block_bytes``: the driver encodes one at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    held: list[tuple[str, str]] = []
    total, some = 0, False
    for row in rows.toLocalIterator():
        held.append((row["i"], row["t"]))
        total += len(row["t"].encode()) + 64
        if total >= block_bytes:
            yield Phrases(held, size)
            held, total, some = [], 0, True
    if held or not some:
        yield Phrases(held, size)


def _found(words: Words, phrases: Phrases) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Mask of the words that are hit, and the items of each document."""
    which, at = occurrences(words, phrases)
    items: dict[int, set[int]] = {}
    pairs = np.unique(np.stack([np.searchsorted(words.first, at, side="right") - 1, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    for doc, k in pairs.T.tolist():
        items.setdefault(doc, set()).update(phrases.owners(k))
    return removal_spans(words, which, at, phrases), items


SPAN = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64())]))


def _spans(mask: np.ndarray) -> list[dict]:
    edges = np.diff(np.r_[False, mask, False].astype(np.int8))
    return [{"word": a, "words": b - a} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)]


RESULTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<word: long, words: long>>"


def _result(part: pa.RecordBatch, words: Words, hit: np.ndarray, names: list[list[str]], prefix: str, keep: list[str]) -> pa.RecordBatch:
    """Results of a chunk whose columns are id, text and those to keep."""
    total = np.r_[0, np.cumsum(hit)]
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    spans: list[list[dict]] = [[] for _ in names]
    for d in np.flatnonzero(n_hit).tolist():
        spans[d] = _spans(hit[words.first[d] : words.first[d + 1]])
    columns = {
        "doc_id": part.column(0),
        "n_words": words.counts.astype(np.int64),
        "n_hit": n_hit.astype(np.int64),
        "n_items": pa.array([len(n) for n in names], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()),
        "contaminated": n_hit > 0,
        "spans": pa.array(spans, SPAN),
    }
    return pa.record_batch([*columns.values(), *(part.column(2 + k) for k in range(len(keep)))], names=[*(prefix + c for c in columns), *keep])


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", size: int = 10, shard_bytes: int = CHUNK_BYTES, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` are the merged removal spans as (first word, words).  A document
    with no hit has the digest of the empty string.  A null text has no words;
    a null or empty item gives no phrase.  Ids of documents may be null or
    repeated, each row gives one row; items that share an id count once.  Empty
    tables on either side give no hits, or no rows.  ``keep`` names input
    columns to return as well; the names of the results then begin with
    ``INTERNAL``.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = keep or []
    prefix = INTERNAL if keep else ""
    rows = docs.select(F.col(id_column).alias(f"{INTERNAL}id"), F.col(text_column).alias(f"{INTERNAL}text"), *keep)
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    named = ", ".join(f"{prefix}{c}" for c in re.split(r", (?=\w+ \w)", RESULTS))
    schema = f"{prefix}doc_id {rows.schema[INTERNAL + 'id'].dataType.simpleString()}, {named}{kept}"
    shared = [spark.sparkContext.broadcast(block) for block in blocks_of(benchmark, size, item_column, block_bytes=block_bytes)]
    if len(shared) > 1:
        return _merged(rows, shared, schema, shard_bytes, prefix, keep)
    only = shared[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = only.value
        for batch in batches:
            for part, data, offsets in chunks(batch, f"{INTERNAL}text", shard_bytes):
                words = cut(data, offsets, ALNUM)
                hit, items = _found(words, phrases)
                names = [sorted(phrases.items[k] for k in items.get(d, ())) for d in range(part.num_rows)]
                yield _result(part, words, hit, names, prefix, keep)

    return rows.mapInArrow(run, schema)


def _merged(rows: DataFrame, blocks: list, schema: str, shard_bytes: int, prefix: str, keep: list[str]) -> DataFrame:
    """``scan`` with a benchmark of several blocks: what each finds in a text is written, by the text's hash, and all of it meets the rows."""
    text = F.coalesce(F.col(f"{INTERNAL}text"), F.lit(""))
    key = F.xxhash64(text)
    hits = None
    for number, block in enumerate(blocks):

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(batch, "text", shard_bytes):
                    words = cut(data, offsets, ALNUM)
                    hit, items = _found(words, block.value)
                    docs = sorted(items)
                    spans = [_spans(hit[words.first[d] : words.first[d + 1]]) for d in docs]
                    yield pa.record_batch({"key": part.column(0).take(pa.array(docs, pa.int64())), "spans": pa.array(spans, SPAN), "items": pa.array([[block.value.items[k] for k in sorted(items[d])] for d in docs], pa.list_(pa.string()))})

        found = rows.select(key.alias("key"), text.alias("text")).mapInArrow(find, "key long, spans array<struct<word: long, words: long>>, items array<string>").dropDuplicates(["key"])
        found = written(found.withColumn("block", F.lit(number)), "hits")
        block.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    by_text = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias(f"{INTERNAL}spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(f"{INTERNAL}items"))
    met = rows.withColumn(f"{INTERNAL}key", key).join(by_text.withColumnRenamed("key", f"{INTERNAL}key"), f"{INTERNAL}key", "left").select(*rows.columns, f"{INTERNAL}spans", f"{INTERNAL}items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, f"{INTERNAL}text", shard_bytes):
                words = cut(data, offsets, ALNUM)
                hit = np.zeros(len(words.hash), bool)
                columns = [part.column(part.schema.get_field_index(f"{INTERNAL}{c}")).to_pylist() for c in ("spans", "items")]
                for d, spans in enumerate(columns[0]):
                    for span in spans or ():
                        hit[words.first[d] + span["word"] : words.first[d] + span["word"] + span["words"]] = True
                yield _result(part, words, hit, [sorted(names or ()) for names in columns[1]], prefix, keep)

    return met.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no phrase of the benchmark."""
    found = scan(docs, benchmark, id_column, text_column, keep=docs.columns)
    return found.where(~F.col(f"{INTERNAL}contaminated")).select(*docs.columns)
