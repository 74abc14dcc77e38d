"""Licence scan with a positional rare-token index.

Licence templates are word sequences.  The index maps each of their words to
postings (template, position); document frequencies of the whole corpus weigh
the words.  Two kinds of templates are looked up:

* Phrases hold where all their words stand at one offset: the places of the
  phrase's rarest word are intersected with those of the others, each shifted
  by its position.
* Notices hold where enough of their weight stands in order.  A file is a
  candidate of those notices whose words it holds with enough weight at all.
  Its highest-weighted words of such a notice are looked up in the postings:
  so many of them that a match, which may lack the rest of the weight, has
  several.  Places minus positions must agree within ``slack`` of an offset,
  so words may be inserted, dropped or replaced.  At the offsets near such
  places the mandatory key phrases are verified, in each of which one word more
  may stand, as at the beginning of a commented line, and the notice's words are
  aligned with the file's in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licenses import TEMPLATES, Template
from .session import ship
from .textkernel import ALNUM, Words, chunks, cut

#: Offsets that are aligned together.
SLICE = 64
#: How many of a notice's rarest words, at the least, a match must hold of those that are looked up.
SEVERAL = 4


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return cut(data, np.array([0, len(data)], np.int64), ALNUM).hash


@dataclass
class Notice:
    """A template's words as vocabulary numbers, the place and numbers of its key phrases, and its slack."""

    words: np.ndarray
    keys: list[tuple[int, np.ndarray]]
    slack: int


class Index:
    """Postings by word, with the weights that the document frequencies give."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        hashes = [word_hashes(t.words) for t in templates]
        self.vocabulary = np.unique(np.concatenate(hashes)) if templates else np.zeros(0, np.uint64)
        self.notices = []
        for t, h in zip(templates, hashes, strict=True):
            words = np.searchsorted(self.vocabulary, h)
            keys = [(self._place(h, word_hashes(k)), np.searchsorted(self.vocabulary, word_hashes(k))) for k in t.keys]
            self.notices.append(Notice(words, keys, 0 if t.share == 1 else max(2, len(words) // 8)))
        self.weigh(np.zeros(len(self.vocabulary), np.int64), 0)

    @staticmethod
    def _place(words: np.ndarray, key: np.ndarray) -> int:
        for k in range(len(words) - len(key) + 1):
            if (words[k : k + len(key)] == key).all():
                return k
        raise ValueError("a key phrase is not part of its template")

    def weigh(self, frequency: np.ndarray, documents: int) -> Index:
        self.idf = np.log((documents + 1) / (frequency + 1)) + 1
        # rank of each word: the rarest first, ties by hash
        self.rank = np.empty(len(self.idf), np.int64)
        self.rank[np.lexsort((np.arange(len(self.idf)), -self.idf))] = np.arange(len(self.idf))
        self.total = np.array([self.idf[n.words].sum() for n in self.notices])
        self.weight = np.zeros((len(self.idf), len(self.notices)))
        for t, n in enumerate(self.notices):
            np.add.at(self.weight[:, t], n.words, self.idf[n.words])
        return self

    def known(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places in the file and vocabulary numbers of licence words."""
        if not len(words.hash) or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[near] == words.hash)
        return at, near[at]

    def scan(self, words: Words) -> list[list[tuple[int, int, float]]]:
        """For each document (template, first word, score) of all places where a template holds."""
        at, which = self.known(words)
        owner = np.searchsorted(words.first, at, side="right") - 1
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(words.first) - 1)]
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(self.vocabulary) + 1))
        places = lambda w: at[order[edges[w] : edges[w + 1]]]
        for t, notice in enumerate(self.notices):
            if self.templates[t].share == 1:
                for place in self._phrase(notice, places, words).tolist():
                    doc = int(np.searchsorted(words.first, place, side="right")) - 1
                    found[doc].append((t, place - int(words.first[doc]), 1.0))
        # weight of each template that each document holds, anywhere
        wide = [t for t in range(len(self.notices)) if self.templates[t].share < 1]
        if not wide or not len(at):
            return found
        held = np.zeros((len(found), len(self.vocabulary)), bool)
        held[owner, which] = True
        share = np.array([self.templates[t].share for t in wide])
        enough = held.astype(np.float32) @ self.weight[:, wide].astype(np.float32) >= (share * self.total[wide]) * (1 - 1e-5)
        for doc, k in zip(*(x.tolist() for x in np.nonzero(enough)), strict=True):
            a, b = np.searchsorted(at, words.first[doc : doc + 2])
            size = int(words.first[doc + 1] - words.first[doc])
            found[doc] += [(wide[k], place, score) for place, score in self.places(wide[k], at[a:b] - words.first[doc], which[a:b], size)]
        return found

    @staticmethod
    def _phrase(notice: Notice, places, words: Words) -> np.ndarray:
        """First words of all places of a phrase: its postings intersected by relative position, the rarest first."""
        by_count = sorted(range(len(notice.words)), key=lambda k: len(places(notice.words[k])))
        out = places(notice.words[by_count[0]]) - by_count[0]
        for k in by_count[1:]:
            if not len(out):
                return out
            out = np.intersect1d(out, places(notice.words[k]) - k, assume_unique=True)
        # all in one document
        first = np.searchsorted(words.first, out, side="right")
        last = np.searchsorted(words.first, out + len(notice.words) - 1, side="right")
        return out[(first == last) & (out >= 0)]

    def anchors(self, t: int, held: np.ndarray) -> tuple[np.ndarray, float]:
        """The rarest of the template's words that a document holds (``held`` are their numbers), and the least weight of them that a match has."""
        notice = self.notices[t]
        mine = np.unique(notice.words[np.isin(notice.words, held)])
        mine = mine[np.argsort(self.rank[mine])]
        weight = self.weight[mine, t]
        spare = self.total[t] * (1 - self.templates[t].share) - (self.total[t] - weight.sum())
        # what a match may lack of the chosen is spare at most; the rest must be worth several words
        n = int(np.searchsorted(np.cumsum(weight), spare + SEVERAL * self.idf[mine].max(initial=0), side="right")) + 1
        return mine[:n], float(weight[:n].sum() - spare)

    def places(self, t: int, at: np.ndarray, which: np.ndarray, size: int) -> list[tuple[int, float]]:
        """(first word, score) of the places of a notice in a document of ``size`` words, given the places of licence words in it."""
        notice, template = self.notices[t], self.templates[t]
        chosen, least = self.anchors(t, which)
        offsets, anchor = [], []
        for position, w in enumerate(notice.words.tolist()):
            if w in chosen:
                mine = at[which == w] - position
                offsets.append(mine)
                anchor.append(np.full(len(mine), position))
        if not offsets:
            return []
        offset, anchor = np.concatenate(offsets), np.concatenate(anchor)
        order = np.argsort(offset, kind="stable")
        offset, anchor = offset[order], anchor[order]
        # the anchors of a match agree on an offset within the slack, and are worth the least weight together
        low, high = np.searchsorted(offset, offset - 2 * notice.slack), np.searchsorted(offset, offset + 2 * notice.slack, side="right")
        worth = np.r_[0.0, np.cumsum(self.idf[notice.words[anchor]])]
        agree = worth[high] - worth[low] >= least * (1 - 1e-9)
        if not agree.any():
            return []
        near = np.unique((offset[agree][:, None] + np.arange(-notice.slack, notice.slack + 1)).ravel())
        words = np.full(size, -1, np.int64)
        words[at] = which
        scores = np.concatenate([self.align(t, words, near[k : k + SLICE]) for k in range(0, len(near), SLICE)])
        good = scores >= template.share
        d, score = near[good], scores[good]
        # offsets that follow each other within the slack are one place: the middle of those with the greatest score
        out: list[tuple[int, float]] = []
        for run in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d) > 2 * notice.slack + 1) + 1):
            if len(run):
                best = d[run][score[run] >= score[run].max() - 1e-12]
                out.append((max(int(best[0] + best[-1]) // 2, 0), float(score[run].max())))
        return out

    def align(self, t: int, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each offset the greatest share of the template's weight that stands in order within the slack; 0 where a key phrase is missing."""
        notice = self.notices[t]
        slack, n = notice.slack, len(notice.words)
        padded = np.concatenate([np.full(n + 3 * slack + 1, -1), words, np.full(n + 3 * slack + 1, -1)])
        base = offsets + n + 3 * slack + 1
        fine = np.ones(len(offsets), bool)
        for place, key in notice.keys:
            seen = np.zeros(len(offsets), bool)
            for shift in range(-slack, slack + 1):
                begin = base + place + shift
                ahead = padded[begin[:, None] + np.arange(len(key) + 1)]
                now, later = ahead[:, :-1] == key, ahead[:, 1:] == key
                # whole, or its first words and, behind one word more, the others
                seen |= now.all(axis=1) | (np.logical_and.accumulate(now, axis=1)[:, :-1] & np.logical_and.accumulate(later[:, ::-1], axis=1)[:, -2::-1]).any(axis=1)
            fine &= seen
        out = np.zeros(len(offsets))
        base = base[fine]
        if not len(base):
            return out
        # best[d]: greatest weight up to this word of the template and the place d - slack words from where it is due
        band = np.arange(-slack, slack + 1)
        best = np.zeros((len(base), len(band)))
        for position, w in enumerate(notice.words.tolist()):
            # a step to the next position moves every place one to the left in the band
            before = best
            best = np.concatenate([before[:, 1:], before[:, -1:]], axis=1)
            hit = padded[base[:, None] + position + band] == w
            best = np.maximum(best, np.where(hit, before + self.idf[w], 0))
            best = np.maximum.accumulate(best, axis=1)
        out[fine] = best[:, -1] / self.total[t]
        return np.minimum(out, 1.0)


def document_frequencies(docs: DataFrame, text_column: str, templates: tuple[Template, ...]) -> tuple[np.ndarray, int]:
    """In how many documents each licence word stands, and the number of documents; one row for each word comes to the driver."""
    vocabulary = Index(templates).vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, rows = Index(templates), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for part, data, offsets in chunks(batch):
                words = cut(data, offsets, ALNUM)
                at, which = index.known(words)
                owner = np.searchsorted(words.first, at, side="right") - 1
                pairs = np.unique(owner * len(vocabulary) + which)
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                rows += part.num_rows
        yield pa.record_batch({"word": np.arange(-1, len(vocabulary)), "n": np.concatenate([[rows], total])})

    counts = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    return np.array([found.get(k, 0) for k in range(len(vocabulary))], np.int64), found.get(-1, 0)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``places``.

    ``places`` lists every (label, word, words, score) that was found, the
    evidence for the other columns.  ``score`` is the greatest share of a
    template's weight that a place of the row holds in order; a phrase has 1.

    A null text is an empty one: no words, null first and last word, empty
    labels, score 0.  Ids may be null or repeated; each row gives one row.  A
    place is the middle of the offsets with its greatest score.  An empty table
    gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    frequency, documents = document_frequencies(docs, text_column, templates)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates).weigh(frequency, documents)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                words = cut(data, offsets, ALNUM)
                found = [[(templates[t], place, len(index.notices[t].words), score) for t, place, score in row] for row in index.scan(words)]
                base = [[f for f in row if f[0].base] for row in found]
                label = lambda row: ",".join(sorted({f[0].label for f in row}))
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_words": words.counts.astype(np.int64),
                        "n_base": pa.array([len(b) for b in base], pa.int64()),
                        "first_word": pa.array([min((f[1] for f in b), default=None) for b in base], pa.int64()),
                        "last_word": pa.array([max((f[1] for f in b), default=None) for b in base], pa.int64()),
                        "base_labels": pa.array([label(b) for b in base], pa.string()),
                        "labels": pa.array([label(r) for r in found], pa.string()),
                        "score": pa.array([max((f[3] for f in r), default=0.0) for r in found], pa.float64()),
                        "places": pa.array([[{"label": f[0].label, "word": f[1], "words": f[2], "score": f[3]} for f in sorted(r, key=lambda f: (f[1], f[0].label, f[2]))] for r in found], place_type),
                    }
                )

    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, word: long, words: long, score: double>>"
    return rows.mapInArrow(run, schema)
