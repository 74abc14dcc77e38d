"""Language identification by cross-parsing.

For each language a suffix automaton is built of passages from a bounded number
of labelled texts.  A text is parsed against it: each phrase is the longest run of
characters that occurs in the sample.  A language whose text resembles the
sample needs few phrases; phrases times the bits that point into the sample,
over the characters parsed, estimate the cross entropy, and the least wins.

Texts are folded before (lower case, every run of non-letters one blank) and
parsed in blocks of ``BLOCK`` bytes, each from the start state, so that numpy
steps through all blocks of a batch at once.  All bytes of all texts count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import INTERNAL, ship
from .textkernel import tidy

BLOCK = 128
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    return _GAPS.sub(" ", text.lower()).strip().encode()


class Automaton:
    """Suffix automaton of a byte string as a dense table.

    ``step[state * width + code]`` is the next state times two, plus one where
    a phrase ends: the byte cannot follow, so it begins the next phrase.
    """

    def __init__(self, sample: bytes, codes: np.ndarray, width: int):
        follow: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes[np.frombuffer(sample, np.uint8)].tolist():
            new = len(follow)
            follow.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        # one state more, after a byte that no sample has: it follows nothing, so a phrase begins behind it
        lost = len(follow)
        step = np.full((lost + 1, width), -1, np.int32)
        for state, edges in enumerate(follow):
            for c, to in edges.items():
                step[state, c] = 2 * to
        anew = np.where(step[0] >= 0, step[0], 2 * lost) | 1
        step = np.where(step >= 0, step, anew)
        # the start state is only met before the first byte, where a phrase has begun anyway
        step[0] = anew & ~1
        self.step = step.astype(np.int32).ravel()
        self.width = width
        self.bits = float(np.log2(max(len(sample), 2)))


class Identifier:
    """Automata of all languages, by name."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.codes = np.zeros(256, np.int32)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.automata = [Automaton(samples[n], self.codes, len(used) + 1) for n in self.names]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns)."""
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = -(-lengths // BLOCK)
        if not blocks.sum():
            return counts
        owner = np.repeat(np.arange(len(texts)), blocks)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(lengths)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(ends - lengths, blocks) + nth * BLOCK
        size = np.minimum(np.repeat(ends, blocks) - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        coded = self.codes[data]
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        state = np.zeros((len(self.names), len(owner)), np.int32)
        found = np.ones((len(self.names), len(owner)), np.int32)
        for k in range(BLOCK):
            n = active[k]
            if not n:
                break
            code = coded[start[:n] + k]
            for j, automaton in enumerate(self.automata):
                now = automaton.step.take(state[j, :n] * automaton.width + code)
                found[j, :n] += now & 1
                state[j, :n] = now >> 1
        for j in range(len(self.names)):
            counts[:, j] = np.bincount(owner, found[j], len(texts)).astype(np.int64)
        return counts

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it has letters; the score is the lead over the second language."""
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        folded = [fold(t) if k else b"" for t, k in zip(texts, known.tolist(), strict=True)]
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), known
        lengths = np.maximum(np.array([len(t) for t in folded], np.float64), 1)
        entropy = self.phrases(folded) * np.array([a.bits for a in self.automata]) / lengths[:, None]
        best = entropy.argmin(axis=1)
        if len(self.names) > 1:
            ranked = np.partition(entropy, 1, axis=1)
            score = np.clip(1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9), 0, 1)
        else:
            score = np.ones(len(texts))
        return [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0), known


def joined(passages: list[bytes]) -> bytes:
    """Different passages, in their order, with a blank between them."""
    return b" ".join(dict.fromkeys(p for p in passages if p))


def samples(labelled: DataFrame, sample_docs: int, passage_chars: int, max_languages: int) -> dict[str, bytes]:
    """For each language one passage of each of about ``sample_docs`` different texts.

    ``labelled`` has text and lang.  Texts are chosen by their hash, and the
    passage, of up to ``passage_chars`` characters, begins where another hash
    says, anywhere in the whole text.  Of more than ``max_languages`` languages
    those with the most texts are learned.  Only the passages come to the
    driver, so the three bounds set their size, and not the table.
    """
    text_hash = F.xxhash64("text")
    # the count of different texts need not be exact, since it only sets the share
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct(text_hash).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    if not sizes:
        return {}
    span = 1 << 40
    place = F.pmod(text_hash, F.lit(span))
    wanted: Column = F.lit(False)
    for lang, n in sizes.items():
        share = span if n <= sample_docs else int(span * sample_docs / n)
        wanted = wanted | ((F.col("lang") == lang) & (place < share))
    begin = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - passage_chars, F.lit(0)) + 1) + 1
    rows = labelled.where(wanted).select("lang", text_hash.alias("number"), F.substring("text", begin.cast("int"), F.lit(passage_chars)).alias("passage")).distinct().collect()
    out: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["number"], r["passage"])):
        out.setdefault(row["lang"], []).append(fold(row["passage"]))
    return {lang: sample for lang, passages in out.items() if (sample := joined(passages))}


def identify(docs: DataFrame, model: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.

    ``und`` with score 0 where the text is null or has no letter, or no
    language was learned.  Of languages with equal entropy the first by name
    wins, with score 0.  Only the text is looked at; ids may be null or
    repeated; an empty table gives no rows.
    """
    return _apply(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), model, ["doc_id"]).drop("letters")


def _apply(rows: DataFrame, model: dict[str, bytes], keep: list[str], prefix: str = "") -> DataFrame:
    """The columns to keep, and language and score, whose names begin with ``prefix``."""
    spark = rows.sparkSession
    ship(spark)
    # the automata are built once; their size follows the bounds of the sample
    shared = spark.sparkContext.broadcast(Identifier(model))
    results = [f"{prefix}{c}" for c in ("lang_pred", "score", "letters")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", {results[0]} string, {results[1]} double, {results[2]} boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = shared.value
        for batch in batches:
            at, column = 0, batch.schema.get_field_index("text")
            while at < batch.num_rows:
                part = batch.slice(at, 500)
                texts, begin = part.column(column).to_pylist(), 0
                while begin < len(texts):
                    end, total = begin, 0
                    while end < len(texts) and (end == begin or total < 1 << 20):
                        total += len(texts[end] or "")
                        end += 1
                    names, score, letters = identifier(texts[begin:end])
                    piece = part.slice(begin, end - begin)
                    yield pa.record_batch([*(piece.column(piece.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(letters)], names=[*keep, *results])
                    begin = end
                at += 500
            tidy()

    return rows.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def learn(docs: DataFrame, held_out: Column, sample_docs: int = 64, passage_chars: int = 256, max_languages: int = 100) -> dict[str, bytes]:
    """Passages of the rows that have text and lang and are not held out."""
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return samples(rows, sample_docs, passage_chars, max_languages)


def held_out_fold(id_column: str = "doc_id") -> Column:
    """Documents whose CRC-32 of the id's text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keep_known(docs: DataFrame, min_lead: float = 0.4, min_chars: int = 200, min_sample: int = 2048) -> DataFrame:
    """The rows, with all their columns, less those whose language is unknown or wrongly given.

    A text that is null or without letters goes.  Where a row's ``lang`` is a
    language that was learned, from ``min_sample`` bytes or more, and the
    prediction is another such language, which leads over all others by
    ``min_lead`` or more on a text of ``min_chars`` characters or more, the row
    goes too.  A row without ``lang``, or with one that was not learned so, is
    not judged by it: where no language could be learned at all, every text
    with letters stays.
    """
    model = learn(docs, held_out_fold())
    sure = [lang for lang, sample in model.items() if len(sample) >= min_sample]
    predicted, lead, letters = F.col(f"{INTERNAL}lang_pred"), F.col(f"{INTERNAL}score"), F.col(f"{INTERNAL}letters")
    judged = _apply(docs, model, docs.columns, INTERNAL)
    wrong = F.col("lang").isin(*sure) & predicted.isin(*sure) & (predicted != F.col("lang")) & (lead >= min_lead) & (F.length("text") >= min_chars) if sure else F.lit(False)
    return judged.where(letters & ~F.coalesce(wrong, F.lit(False))).select(*docs.columns)
