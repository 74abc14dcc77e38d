"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of five words.  Documents with
the same set are one class; classes whose sets have a Jaccard similarity of at
least 3/4 are linked; the components of the links are returned.  No link is
lost:

1. Two linked sets share one of the first ``n - ceil(3n/4) + 1`` shingles of
   each in any common order (prefix filter).  The order is by frequency, then by
   hash; frequencies only serve to keep common passages out of the prefixes,
   so their table may be bounded.  Classes that share a prefix shingle form a
   list; equal lists are one.
2. Each list links its classes to a few leaders, where the pair passes the
   bound of the signatures and the comparison of the sets.  That joins most
   near copies without looking at all pairs among them.
3. Of the lists that still hold several components, signature trees find the
   pairs of classes of different components that may be linked: for each two
   components first the pair that can overlap most and then, where that is no
   link and the components are still apart, every other.  A node holds the OR of the token bitmaps below it, their range of sizes and of
   components; two trees are traversed together, and a pair of nodes is pruned
   where its greatest possible overlap is too small or it lies in one
   component.  Surviving pairs are compared exactly, up to collisions of hashes.

A list larger than ``BLOCK`` is dealt into parts, and each pair of parts is a
block of its own.  A shingle known to be frequent is dealt into parts by the
class when the lists are made.  Frequent are shingles that repeat within a
task's runs, and those that a sample of the classes, by their hash, holds often,
however thinly they are spread.  The most frequent TABLE of them are known, so
a list that is not dealt has no more than the postings over TABLE members.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connect
from .session import INTERNAL, drop_written, saved, ship
from .textkernel import SPACE, chunks, cut, mix, tidy, windows

U64 = np.uint64
SHINGLE = 5
ROW_KEY = f"{INTERNAL}row_key"
#: Least bits of a bitmap; a set of n shingles has at least 2n.
LEAST_BITS = 512
#: A shingle that tasks saw this often, counting only tasks that saw it twice or more, is frequent.
FREQUENT = 32
#: One class in SAMPLED tells of its shingles, and a shingle counts by that where OFTEN of them hold it.
SAMPLED, OFTEN = 64, 8
#: Greatest number of frequent shingles that are sent to the tasks; the most frequent go first.
TABLE = 1 << 18
#: Classes in a part of a list.
BLOCK = 1024
#: Children of a tree node.
FAN = 8
#: Pairs of nodes that are looked at together.
SLICE = 1 << 15
#: Classes from which on a list is large, and the leaders that it has then.
LARGE, LEADERS = 64, 4
#: Text bytes whose shingles a task sorts together, and whose prefixes a bucket gets on average.
CHUNK, BUCKET = 8 << 20, 8 << 20


def shingle_sets(words, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    all_windows = windows(words.hash, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(all_windows[a : b - SHINGLE + 1]))
        else:
            out.append(windows(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """One 64-bit signed number for a set, whatever its order; 0 for the empty set."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        total = mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([total + U64(len(shingles))], np.uint64)).view(np.int64)[0]) or 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Bit h modulo width for every shingle; the width is a power of two."""
    width = max(LEAST_BITS, 1 << int(2 * max(len(shingles), 1) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(shingles & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, of which two linked sets share one."""
    n = len(shingles)
    size = n - -(-3 * n // 4) + 1
    if n and len(common):
        near = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        seen = np.where(common[near] == shingles, counts[near], 0)
        if seen.any():
            shingles = shingles[np.lexsort((shingles, seen))]
    return shingles[: min(size, n)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part, data, offsets in chunks(batch):
            words = cut(data, offsets, SPACE)
            yield part, shingle_sets(words, words.first)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for documents, for shingles that stand in several documents of a run (token, seen), and for those of the sampled classes (token, fp)."""
    held: list[np.ndarray] = []
    size = 0

    def repeated() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        many = n > 1
        k = int(many.sum())
        nothing = pa.nulls(k, pa.int64())
        return pa.record_batch([pa.nulls(k, id_type), nothing, nothing, nothing, pa.nulls(k, pa.binary()), pa.array(tokens[many].view(np.int64)), pa.array(n[many])], names=names)

    names = ["doc_id", "key", "fp", "n", "bitmap", "token", "seen"]
    id_type = None
    for part, sets in _sets(batches):
        id_type = part.column(0).type
        fps = [fingerprint(s) for s in sets]
        n = part.num_rows
        yield pa.record_batch(
            [part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=names,
        )
        # copies of a set count once
        own = {f: s for f, s in zip(fps, sets, strict=True) if f}
        held += list(own.values())
        classes = np.array(list(own), np.int64)
        for f in classes[mix(classes.view(np.uint64)) % U64(SAMPLED) == 0].tolist():
            k = len(own[f])
            nothing = pa.nulls(k, pa.int64())
            yield pa.record_batch([pa.nulls(k, id_type), nothing, pa.array(np.full(k, f)), nothing, pa.nulls(k, pa.binary()), pa.array(own[f].view(np.int64)), nothing], names=names)
        size += sum(map(len, sets))
        if size > CHUNK // 4:
            yield repeated()
            held, size = [], 0
    if held:
        yield repeated()


POSTINGS = "bucket long, tokens binary, classes binary"


def _postings(buckets: int, common: np.ndarray, counts: np.ndarray):
    parts_of = np.maximum(1, -(-counts // BLOCK)).astype(np.uint64) if len(counts) else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            classes = np.repeat(np.array(list(held), np.int64), [len(p) for p in held.values()])
            tokens = np.concatenate(list(held.values()))
            with np.errstate(over="ignore"):
                place = mix(tokens ^ U64(0x2545F4914F6CDD1D))
                if len(common):
                    near = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    parts = np.where(common[near] == tokens, parts_of[near], U64(1))
                    place = mix(place + classes.view(np.uint64) % parts)
            bucket = (place % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            for at in range(0, len(full), 256):
                some = full[at : at + 256]
                pick = [order[edges[k] : edges[k + 1]] for k in some]
                yield pa.record_batch({"bucket": pa.array(some, pa.int64()), "tokens": pa.array([tokens[p].tobytes() for p in pick], pa.binary()), "classes": pa.array([classes[p].tobytes() for p in pick], pa.binary())})

        for _, sets in _sets(batches):
            for s in sets:
                fp = fingerprint(s)
                if fp and fp not in held:
                    held[fp] = prefix(s, common, counts)
                    size += len(held[fp])
            if size > CHUNK // 16:
                yield from close()
                held, size = {}, 0
        if held:
            yield from close()

    return run


LISTS = "list long, part long, members array<long>"


def _lists(common: np.ndarray, counts: np.ndarray):
    many = {int(t): -(-int(c) // BLOCK) for t, c in zip(common, counts, strict=True) if c > BLOCK}

    def run(table: pa.Table) -> pa.Table:
        """Distinct lists of the classes that share a token; a token dealt into parts gives one for each part."""
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
        classes = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("classes").to_pylist()])
        order = np.lexsort((classes, tokens))
        tokens, classes = tokens[order], classes[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])]
        tokens, classes = tokens[new], classes[new]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        size = np.diff(np.r_[start, len(tokens)])
        found: dict[tuple[int, int], list[int]] = {}
        for a, n, token in zip(start.tolist(), size.tolist(), tokens[start].tolist(), strict=True):
            if parts := many.get(token):
                part = classes[a : a + n].view(np.uint64) % U64(parts)
                for k in np.unique(part).tolist():
                    found[int(np.uint64(token).view(np.int64)), int(k)] = classes[a : a + n][part == k].tolist()
            elif n > 1:
                members = classes[a : a + n]
                with np.errstate(over="ignore"):
                    name = int(list_name(members).view(np.int64)[0])
                found.setdefault((name, 0), members.tolist())
        return pa.table({"list": pa.array([k[0] for k in found], pa.int64()), "part": pa.array([k[1] for k in found], pa.int64()), "members": pa.array(list(found.values()), pa.list_(pa.int64()))})

    return run


def list_name(members: np.ndarray) -> np.ndarray:
    """One number for a sorted list of classes."""
    return np.array([mix(mix(members.view(np.uint64)) + np.arange(1, len(members) + 1, dtype=np.uint64)).sum(dtype=np.uint64)], np.uint64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of packed bytes on fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, width // 8), axis=0)


class SignatureTree:
    """Members in their order, in nodes of FAN children; level 0 are the members themselves."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, spare: np.ndarray, components: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes, spare, components, components)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra, least, most = self.levels[-1]
            cuts = np.arange(0, len(bits), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(extra, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts),
                )
            )

    def pairs(self, other: SignatureTree, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Members (of this, of the other tree) that the bounds leave; of one tree with itself, each pair once."""
        top = max(len(self.levels), len(other.levels)) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            x, y = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            a, b = self._prune(x, y, a, b)
            if same:
                keep = (a < b) if level == 0 else (a <= b)
                a, b = a[keep], b[keep]
            if level:
                a, b = _cross(self._open(a, level), other._open(b, level))
        return a, b

    def _open(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of each node; a tree that is lower than the other stays at its root for now."""
        if level >= len(self.levels):
            return nodes, np.ones(len(nodes), np.int64)
        first = nodes * FAN
        return first, np.minimum(first + FAN, len(self.levels[level - 1][0])) - first

    @staticmethod
    def _prune(x: tuple, y: tuple, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = []
        for begin in range(0, len(a), SLICE):
            i, j = a[begin : begin + SLICE], b[begin : begin + SLICE]
            near = (4 * x[2][i] >= 3 * y[1][j]) & (4 * y[2][j] >= 3 * x[1][i])
            near &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
            i, j = i[near], j[near]
            shared = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1, dtype=np.int64)
            # shingles of a set that fall on bits of another of its own are not seen in the bitmap
            most = shared + np.minimum(x[3][i], y[3][j])
            wide = 7 * most >= 3 * (x[1][i] + y[1][j])
            kept.append((i[wide], j[wide]))
        if not kept:
            return a, b
        return np.concatenate([i for i, _ in kept]), np.concatenate([j for _, j in kept])


def _cross(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All children of the first with all children of the second, for each pair of nodes."""
    n = a[1] * b[1]
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(b[1], n)
    return np.repeat(a[0], n) + nth // wide, np.repeat(b[0], n) + nth % wide


def greatest_similarity(n: tuple[np.ndarray, np.ndarray], bits: tuple[list[bytes], list[bytes]]) -> np.ndarray:
    """For pairs of sets: the greatest similarity that sizes and full bitmaps allow, or 0 where it is below 3/4."""
    out = np.zeros(len(n[0]))
    near = np.flatnonzero((4 * n[0] >= 3 * n[1]) & (4 * n[1] >= 3 * n[0]))
    widths = np.array([8 * min(len(bits[0][k]), len(bits[1][k])) for k in near.tolist()], np.int64)
    for width in np.unique(widths).tolist():
        for begin in range(0, int((widths == width).sum()), 4096):
            at = near[widths == width][begin : begin + 4096]
            x = np.stack([fold(np.frombuffer(bits[0][k], np.uint8), width) for k in at.tolist()])
            y = np.stack([fold(np.frombuffer(bits[1][k], np.uint8), width) for k in at.tolist()])
            only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[0][at] - only_x, n[1][at] - only_y)
            union = n[0][at] + n[1][at] - most
            out[at] = np.where(4 * most >= 3 * union, most / union, 0)
    return out


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, bits_a, bits_b) that may be linked."""
    for batch in batches:
        a, b, n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        keep = greatest_similarity((n_a, n_b), (batch.column(4).to_pylist(), batch.column(5).to_pylist())) > 0
        yield pa.record_batch({"a": a[keep], "b": b[keep]})


def _tree_pairs(every: bool):
    """Pairs of each block, whose rows (list, i, j, side, class, n, bitmap, component, large lists) come together; side 2: in both halves.

    With ``every`` all pairs, else for each two components the pair that can
    overlap most, and how many others there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _block_pairs(batches, every)
        tidy()

    return run


def _owned(i: np.ndarray, j: np.ndarray, name: int, large: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of a large list those that no large list of a lesser name holds too; all pairs of a small list."""
    if not len(i) or name not in large[int(i[0])]:
        return i, j
    names = np.array(sorted({x for row in large for x in row}), np.int64)
    held = np.zeros((len(large), len(names)), bool)
    for k, row in enumerate(large):
        held[k, np.searchsorted(names, row)] = True
    own, kept = int(np.searchsorted(names, name)), np.zeros(len(i), bool)
    for begin in range(0, len(i), SLICE):
        part = slice(begin, begin + SLICE)
        kept[part] = (held[i[part]] & held[j[part]]).argmax(axis=1) == own
    return i[kept], j[kept]


def _block_pairs(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    blocks: list[tuple] = []
    last: tuple = ()

    def close() -> Iterator[tuple[int, int, int, int]]:
        sides = np.array([r[0] for r in blocks])
        n = np.array([r[2] for r in blocks], np.int64)
        component = np.array([r[4] for r in blocks], np.int64)
        small = np.stack([fold(np.frombuffer(r[3], np.uint8), LEAST_BITS) for r in blocks])
        spare = n - np.bitwise_count(small).sum(axis=1, dtype=np.int64)
        # members of one component together, so that whole nodes of them are pruned, and the others by size
        _, group, many = np.unique(component, return_inverse=True, return_counts=True)
        order = np.lexsort((n, np.where(many[group] >= FAN, group, -1)))

        def tree(at: np.ndarray) -> SignatureTree:
            return SignatureTree(n[at], small[at], spare[at], component[at])

        if (sides == 2).all():
            i, j = tree(order).pairs(tree(order), True)
            i, j = order[i], order[j]
        else:
            left, right = order[sides[order] == 0], order[sides[order] == 1]
            if not len(left) or not len(right):
                return
            i, j = tree(left).pairs(tree(right), False)
            i, j = left[i], right[j]
        keep = component[i] != component[j]
        i, j = _owned(i[keep], j[keep], last[0], [r[5] for r in blocks])
        most = greatest_similarity((n[i], n[j]), ([blocks[k][3] for k in i.tolist()], [blocks[k][3] for k in j.tolist()]))
        i, j, most = i[most > 0], j[most > 0], most[most > 0]
        others = np.zeros(len(i), np.int64)
        if not every and len(i):
            low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
            order = np.lexsort((j, i, -most, high, low))
            first = np.flatnonzero(np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            others = np.diff(np.r_[first, len(order)]) - 1
            i, j = i[order[first]], j[order[first]]
        yield from ((last[0], blocks[x][1], blocks[y][1], o) for x, y, o in zip(i.tolist(), j.tolist(), others.tolist(), strict=True))

    found: list[tuple] = []

    def out() -> pa.RecordBatch:
        lists, a, b, others = (np.array(c, np.int64) for c in zip(*found, strict=True))
        return pa.record_batch({"list": lists, "a": np.minimum(a, b), "b": np.maximum(a, b), "others": others})

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(9)]
        for name, *row in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
            if name != last and blocks:
                found += close()
                blocks = []
                if len(found) > 20_000:
                    yield out()
                    found = []
            last = name
            blocks.append(tuple(row))
    if blocks:
        found += close()
    if found:
        yield out()


PACKED = 5
#: Shingles from which on a set is compared by all 64 bits: below, two of a pair's shingles agree in 40 bits once in 3,000 pairs at most.
WHOLE = 1 << 14


def pack_set(shingles: np.ndarray) -> bytes:
    """The lower 40 bits of each shingle, or all of them in a large set, sorted, after a byte that tells the width; sets are only compared with each other in pairs."""
    width = PACKED if len(shingles) < WHOLE else 8
    low = np.sort(shingles & U64((1 << 8 * width) - 1))
    return bytes([width]) + low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_set(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def common_shingles(x: bytes, y: bytes) -> int:
    """Shingles that two packed sets share, by all bits where both have them and by the lower ones otherwise."""
    one, two = unpack_set(x), unpack_set(y)
    if x[0] != y[0]:
        one, two = one & U64((1 << 8 * PACKED) - 1), two & U64((1 << 8 * PACKED) - 1)
    # a value that a set holds several times counts as often as both hold it
    values, counts = np.unique(one, return_counts=True)
    others, more = np.unique(two, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[i], more[j]).sum())


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, set) of rows (wanted class, text)."""
    for part, sets in _sets(batches):
        fps = np.array([fingerprint(s) for s in sets], np.int64)
        right = np.flatnonzero(fps == part.column(0).to_numpy(zero_copy_only=False))
        yield pa.record_batch({"class": fps[right], "shingles": pa.array([pack_set(sets[k]) for k in right.tolist()], pa.binary())})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose intersection is at least 3/4 of their union."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = x.as_py(), y.as_py()
            common = common_shingles(one, two)
            total = sum((len(s) - 1) // s[0] for s in (one, two))
            linked.append(100 * common >= 75 * (total - common))
        keep = np.array(linked, bool)
        yield pa.record_batch({"a": batch.column(0).to_numpy(zero_copy_only=False)[keep], "b": batch.column(1).to_numpy(zero_copy_only=False)[keep]})


@contextmanager
def _bloom_filters(spark):
    """Let Spark put its runtime Bloom filter in front of a shuffle of texts however small the input is."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Join:
    """The classes of a table of documents, and comparisons among them."""

    def __init__(self, docs: DataFrame, id_column: str, text_column: str):
        self.spark = docs.sparkSession
        self.passing: list[DataFrame] = []
        ship(self.spark)
        text = F.coalesce(F.col(text_column), F.lit(""))
        self.texts = docs.select(F.xxhash64(id_column, text).alias("key"), text.alias("text"))
        rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column, text).alias("key"), text.alias("text"))
        id_type = rows.schema["doc_id"].dataType.simpleString()
        described, _ = saved(rows, "shingles", _describe, f"doc_id {id_type}, key long, fp long, n long, bitmap binary, token long, seen long")
        self.docs = described.where(F.col("token").isNull()).select("doc_id", "key", "fp", "n", "bitmap")
        tokens = described.where(F.col("token").isNotNull())
        in_runs = tokens.where(F.col("seen").isNotNull()).select("token", "seen", F.lit(0).alias("classes"))
        in_sample = tokens.where(F.col("seen").isNull()).select("token", "fp").distinct().select("token", F.lit(0).cast("long").alias("seen"), F.lit(1).alias("classes"))
        sums = in_runs.unionByName(in_sample).groupBy("token").agg(F.sum("seen").alias("seen"), F.sum("classes").alias("classes"))
        common = sums.select("token", F.greatest("seen", F.when(F.col("classes") >= OFTEN, F.col("classes") * SAMPLED).otherwise(0)).alias("seen")).where(F.col("seen") >= FREQUENT)
        found = common.orderBy(F.desc("seen"), "token").limit(TABLE).collect()
        tokens, counts = np.array([r["token"] for r in found], np.int64).view(np.uint64), np.array([r["seen"] for r in found], np.int64)
        order = np.argsort(tokens)
        self.common, self.counts = tokens[order], counts[order]
        size = self.docs.agg(F.sum("n")).first()[0] or 0
        self.buckets = max(2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-6 * size // BUCKET))
        # one row for each different set; the bitmap is a function of the set
        first = F.min(F.struct("key", "n", "bitmap")).alias("first")
        self.classes, _ = saved(self.docs.where("n > 0").groupBy("fp").agg(first).select("fp", "first.*"), "classes")

    def passed(self, df: DataFrame, what: str, *run) -> DataFrame:
        """A written table that goes when the components are known."""
        self.passing.append(saved(df, what, *run)[0])
        return self.passing[-1]

    def lists(self) -> DataFrame:
        postings = self.texts.select("text").mapInArrow(_postings(self.buckets, self.common, self.counts), POSTINGS)
        lists = postings.groupBy("bucket").applyInArrow(_lists(self.common, self.counts), LISTS)
        return self.passed(lists.groupBy("list", "part").agg(F.first("members").alias("members")), "lists")

    def with_bitmaps(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.classes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bits_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def links(self, pairs: DataFrame, *run) -> DataFrame:
        """Those of the distinct pairs of classes that are linked; ``run``: the function and schema by which workers choose the pairs."""
        pairs, _ = saved(pairs, "pairs", *run)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        keys, _ = saved(self.classes.select("fp", "key").join(wanted, "fp").select("fp", "key", F.lit(1).alias("one")), "wanted")
        with _bloom_filters(self.spark):
            sets, _ = saved(self.texts.join(keys.where("one = 1"), "key").select("fp", "text"), "sets", _pack_sets, "class long, shingles binary")
        side = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
        out = self.passed(both, "links", _compare, "a long, b long")
        drop_written(pairs, keys, sets)
        return out

    def star_pairs(self, lists: DataFrame) -> DataFrame:
        """Each class of a list with the list's leaders, and the first leaders of its parts with each other, for ``_bounded``.

        The first leader is the least class.  A large list has others, by
        hashes of the class, so that a near copy that has drifted too far from
        one of them still meets one that it is linked with.
        """
        drawn = lambda k: F.array_min(F.transform("members", lambda m: F.struct(F.xxhash64(m, F.lit(k)).alias("h"), m.alias("m"))))["m"]
        others = F.when(F.size("members") >= LARGE, F.array(*(drawn(k) for k in range(1, LEADERS)))).otherwise(F.array().cast("array<long>"))
        led = lists.select(F.explode(F.concat(F.array(F.array_min("members")), others)).alias("a"), "members")
        stars = led.select("a", F.explode("members").alias("b"))
        leaders = lists.select("list", F.array_min("members").alias("leader"))
        top = leaders.groupBy("list").agg(F.min("leader").alias("a"), F.max("leader").alias("other")).where("a <> other").select("list", "a")
        across = leaders.join(top, "list").select("a", F.col("leader").alias("b"))
        pairs = stars.unionByName(across).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return self.with_bitmaps(pairs)

    def tree_pairs(self, lists: DataFrame, components: DataFrame, every: bool) -> DataFrame:
        """``list, a, b, others``: pairs of classes of a list that lie in different components and may be linked, written."""
        member = lists.select("list", F.explode("members").alias("fp"))
        placed = member.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("list", "fp", F.coalesce("root", "fp").alias("component"))
        placed = self.passed(placed, "placed")
        split = placed.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("list", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
        split = self.passed(split, "split")
        # near copies share many large lists: each class knows its own, so that a pair is looked at in one of them
        large = placed.join(split.where(F.col("size") >= LARGE), "list").groupBy("fp").agg(F.collect_set("list").alias("large"))
        known = self.classes.select("fp", "n", "bitmap").join(large, "fp", "left").withColumn("large", F.coalesce("large", F.array().cast("array<long>")))
        rows = placed.join(split, "list").join(known, "fp")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = rows.withColumn("own", own).withColumn("other", other).select(
            "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
            "fp", "n", "bitmap", "component", "large",
        )
        sorted_blocks = dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
        return self.passed(sorted_blocks, "best", _tree_pairs(every), "list long, a long, b long, others long")


def _components(join: Join) -> DataFrame:
    """``fp, root`` of every class; the root is one of the classes that links reach."""
    lists = join.lists()
    near = connect(join.links(join.star_pairs(lists), _bounded, "a long, b long"))
    best = join.tree_pairs(lists, near, False)
    near = _more(join, near, best)
    # where the best pair of two components is no link, any other may be one
    root = lambda x: near.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    open_ = best.where("others > 0").join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    rest = join.passed(lists.join(open_.select("list").distinct(), "list", "left_semi"), "rest")
    if not rest.isEmpty():
        near = _more(join, near, join.tree_pairs(rest, near, True))
    drop_written(*join.passing)
    linked = near.withColumnRenamed("node", "fp")
    return join.classes.select("fp").join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _more(join: Join, near: DataFrame, pairs: DataFrame) -> DataFrame:
    """The components ``node, root`` that the links among the pairs leave of the components so far."""
    join.passing.append(near)
    links = join.links(pairs.select("a", "b").distinct())
    return connect(near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    ``component_id`` is the smallest id that links reach, the row's own id
    included.  A null text, and one without words, has the empty set and is
    linked with nothing, not even its copies.  Rows may repeat an id; a row
    with a null id is linked as any other and does not name its component
    unless all of it are null.  An empty table gives no rows.  Other columns
    are not read.
    """
    join = Join(docs, id_column, text_column)
    names = join.docs.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _components(join).join(names, "fp")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(component, "root").select("fp", "component_id")
    return join.docs.join(of_class, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, less all but one document of each component: that with the smallest id stays.

    Rows with the same id and text are one document.  Documents without words
    are linked with nothing and stay; of a component where some ids are null,
    one with an id stays.
    """
    join = Join(docs, id_column, text_column)
    best = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    of_class = join.docs.where("n > 0").groupBy("fp").agg(best().alias("best"))
    chosen = _components(join).join(of_class, "fp").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias(ROW_KEY))
    kept, _ = saved(chosen.unionByName(join.docs.where("n = 0").select(F.col("key").alias(ROW_KEY))).distinct(), "kept")
    rows = docs.withColumn(ROW_KEY, F.xxhash64(id_column, F.coalesce(F.col(text_column), F.lit(""))))
    return rows.join(kept, ROW_KEY, "left_semi").dropDuplicates([ROW_KEY]).select(*docs.columns)
