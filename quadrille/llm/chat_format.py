"""Transcripts to chat turns with a hidden Markov model.

The hidden state of a line is its role and whether it opens a turn; what is
observed is the line's speaker marker and its form.  Transition and emission
counts are gathered over all labelled transcripts.  Viterbi's most probable
path recovers the roles; each recovered turn is rendered in one canonical form,
its marker removed.

Lines are put in order by range partitions, so one transcript may lie in many
segments.  A transcript that crosses a border is scored within each segment
for every state before and every last state; the tables of the borders, two
for each segment at most, are joined on the driver, and the segments are then
decoded with the states so fixed at their borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ship, written

ROLES = ("assistant", "system", "user")
#: Words that open a line before a colon, by the class of speaker they name.
MARKERS = {
    "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "a": 2, "answer": 2,
    "system": 3, "instructions": 3, "note": 3, "context": 3,
}
_MARKER = re.compile(r"\s*[*#\[(]*([A-Za-z]+)[*\])]*\s*:\s?")
LENGTHS = (1, 40, 120, 400)
#: Codes of a line's observation: marker, form and whether a blank line stands before.
N_MARKERS, N_FORMS = 4, (len(LENGTHS) + 1) * 2 * 2
STATES = 2 * len(ROLES)
NONE = -1e30
#: Lines, and bytes of text, of a segment: a task holds one transcript's part of a segment at a time.
SEGMENT_LINES, SEGMENT_BYTES = 100_000, 32 << 20
_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text that opens no turn and closes none: a backslash more between ``<`` and ``|``."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def marker_of(line: str) -> tuple[int, int]:
    """Class of the speaker marker that opens a line, and where the rest begins."""
    found = _MARKER.match(line)
    kind = MARKERS.get(found[1].lower(), 0) if found else 0
    return kind, found.end() if kind else 0


def observe(line: str, gap: bool) -> tuple[int, int]:
    """Marker and form codes."""
    kind, at = marker_of(line)
    rest = line[at:].rstrip()
    length = sum(len(rest) >= n for n in LENGTHS)
    return kind, (length * 2 + rest.endswith("?")) * 2 + gap


@dataclass
class Model:
    """Log probabilities: of the first state, from state to state, and of marker and form in a state."""

    first: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    form: np.ndarray

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, int, int], int]) -> Model:
        def table(kind: str, rows: int, columns: int) -> np.ndarray:
            out = np.full((rows, columns), 0.1)
            for (k, i, j), n in counts.items():
                if k == kind:
                    out[i, j] += n
            return np.log(out / out.sum(axis=1, keepdims=True))

        model = cls(table("first", 1, STATES)[0], table("step", STATES, STATES), table("marker", STATES, N_MARKERS), table("form", STATES, N_FORMS))
        # a turn is opened by its own role: only the same role's inner state follows within it
        for a in range(STATES):
            for b in range(STATES):
                if b % 2 == 1 and a // 2 != b // 2:
                    model.step[a, b] = NONE
        model.first[1::2] = NONE
        return model

    def emit(self, marker: np.ndarray, form: np.ndarray) -> np.ndarray:
        return self.marker[:, marker].T + self.form[:, form].T

    def across(self, emission: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines (row ``STATES``: none, the transcript begins) to each last state."""
        score = np.vstack([self.step, self.first]) + emission[0]
        for e in emission[1:]:
            score = (score[:, :, None] + self.step).max(axis=1) + e
        return score

    def decode(self, emission: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """Most probable states of the lines; of equal paths that of the lower states from behind."""
        score = (self.first if before is None else self.step[before]) + emission[0]
        back = np.zeros(emission.shape, np.int8)
        for k in range(1, len(emission)):
            through = score[:, None] + self.step
            back[k] = through.argmax(axis=0)
            score = through.max(axis=0) + emission[k]
        path = np.empty(len(emission), np.int64)
        path[-1] = score.argmax() if last is None else last
        for k in range(len(emission) - 1, 0, -1):
            path[k - 1] = back[k, path[k]]
        return path


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Lines ``conv_id, turn, line, text, state`` of conversations written out as transcripts.

    A conversation's markers follow one of three styles, by its id's hash; one
    turn in eight has none, and one in four follows a blank line.  ``state``
    is the true one, or null where the role is none of ROLES.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    luck = F.pmod(F.xxhash64("conv_id", "turn", F.coalesce("text", F.lit(""))), F.lit(8))
    names = {"user": ("User", "Human", "Q"), "assistant": ("Assistant", "AI", "A"), "system": ("System", "Instructions", "Note")}
    marker: Column = F.lit("")
    for role, by_style in names.items():
        for k, name in enumerate(by_style):
            marker = F.when((F.col("role") == role) & (style == k) & (luck != 0), F.lit(f"{name}: ")).otherwise(marker)
    number = F.when(F.col("role").isin(*ROLES), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1)
    blank = F.when(luck % 4 == 1, F.lit("\n")).otherwise(F.lit(""))
    text = F.concat(blank, marker, F.coalesce("text", F.lit("")))
    lines = turns.select("conv_id", "turn", number.alias("role"), blank.alias("blank"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    opens = F.col("line") == F.length("blank")
    return lines.select("conv_id", "turn", "line", "text", (F.col("role") * 2 + F.when(opens, 0).otherwise(1)).cast("int").alias("state"))


def in_segments(lines: DataFrame) -> DataFrame:
    """The lines that are not blank, in order of transcript, turn and line, with segment, place and observation codes."""
    ship(lines.sparkSession)
    order = ["conv_id", "turn", "line", F.xxhash64("text"), F.monotonically_increasing_id()]
    sorted_lines = lines.select("conv_id", "turn", "line", "text", "state", *(c.alias(f"_{k}") for k, c in enumerate(order[3:])))
    by = ["conv_id", "turn", "line", "_0", "_1"]
    n, size = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    partitions = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_LINES), -(-size // SEGMENT_BYTES))
    dealt = sorted_lines.repartitionByRange(partitions, *by).sortWithinPartitions(*by).select("conv_id", "turn", "line", "text", "state")
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = f"segment int, place long, conv_id {kind['conv_id']}, turn {kind['turn']}, line int, text string, state int, marker int, form int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place, gap, conv = TaskContext.get().partitionId(), 0, False, object()
        for batch in batches:
            keep, marks, forms = [], [], []
            for k, (c, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                gap, conv = gap and c == conv, c
                if not text or text.isspace():
                    gap = True
                    continue
                mark, form = observe(text, gap)
                gap = False
                keep.append(k)
                marks.append(mark)
                forms.append(form)
            part = batch.take(pa.array(keep, pa.int64()))
            n = len(keep)
            yield pa.record_batch(
                [pa.array(np.full(n, segment, np.int32)), pa.array(np.arange(place, place + n)), *part.columns, pa.array(marks, pa.int32()), pa.array(forms, pa.int32())],
                names=["segment", "place", "conv_id", "turn", "line", "text", "state", "marker", "form"],
            )
            place += n

    return written(dealt.mapInArrow(run, schema), "lines")


def learn(segments: DataFrame, held_out: Column) -> Model:
    """Counts of states and observations over all labelled lines that are not held out; a few hundred sums come to the driver."""
    known = segments.where(~held_out & F.col("state").isNotNull()).select("segment", "conv_id", "place", "state", "marker", "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        counts: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for segment, conv, place, state, marker, form in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if last and last[:2] == (segment, conv) and last[2] == place - 1:
                    keys = [("step", last[3], state)]
                else:
                    keys = [("first", 0, state)] if state % 2 == 0 else []
                for key in (*keys, ("marker", state, marker), ("form", state, form)):
                    counts[key] = counts.get(key, 0) + 1
                last = (segment, conv, place, state)
        if counts:
            yield pa.record_batch({"kind": [k[0] for k in counts], "i": [k[1] for k in counts], "j": [k[2] for k in counts], "n": list(counts.values())})

    sums = known.mapInArrow(run, "kind string, i long, j long, n long").groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))
    return Model.of_counts({(r["kind"], r["i"], r["j"]): r["n"] for r in sums.collect()})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Lines of each transcript of a segment, in order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[-1]["conv_id"] != row["conv_id"] or held[-1]["segment"] != row["segment"]):
                yield held[0]["conv_id"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["conv_id"], held


def _emission(model: Model, rows: list[dict]) -> np.ndarray:
    return model.emit(np.array([r["marker"] for r in rows]), np.array([r["form"] for r in rows]))


def borders(segments: DataFrame, model: Model) -> dict[tuple[int, object], tuple[int | None, int, bool]]:
    """For the segment and transcript of each part of one that crosses a border: the state before, the last state, and whether it goes on."""
    edges = segments.groupBy("segment").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.min_by("conv_id", "place").alias("first"), F.max_by("conv_id", "place").alias("last")).orderBy("segment").collect()
    crossing = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a["last"] == b["first"]]
    if not crossing:
        return {}
    wanted = {(a["segment"], a["last"]) for a, _ in crossing} | {(b["segment"], b["first"]) for _, b in crossing}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _runs(batches):
            if (rows[0]["segment"], conv) in wanted:
                yield pa.record_batch({"segment": pa.array([rows[0]["segment"]], pa.int32()), "place": [rows[0]["place"]], "score": [model.across(_emission(model, rows)).ravel()]})

    tables = segments.mapInArrow(run, "segment int, place long, score array<double>").collect()
    score = {(r["segment"], r["place"] > 0): np.array(r["score"]).reshape(STATES + 1, STATES) for r in tables}
    out: dict[tuple[int, object], tuple[int | None, int, bool]] = {}
    chain: list = []
    conv: object = None

    def close() -> None:
        best, back = None, []
        for segment, later in chain:
            t = score[segment, later]
            if best is None:
                best = t[STATES]
                back.append(None)
            else:
                through = best[:, None] + t[:STATES]
                back.append(through.argmax(axis=0))
                best = through.max(axis=0)
        last = int(best.argmax())
        for (segment, later), b in zip(reversed(chain), reversed(back), strict=True):
            before = None if b is None else int(b[last])
            out[segment, conv] = (before, last, (segment, later) != chain[-1])
            last = before

    for a, b in crossing:
        whole = a["first"] == a["last"]
        if not chain or chain[-1][0] != a["segment"] or not whole:
            if chain:
                close()
            chain, conv = [(a["segment"], not whole)], a["last"]
        chain.append((b["segment"], False))
    close()
    return out


def format_chats(lines: DataFrame, held_out: Column | None = None, model: Model | None = None) -> DataFrame:
    """One row for each recovered turn: ``conv_id, turn, line, role, n_lines, rendered, continued, true_lines``.

    ``turn`` and ``line`` are those of its first line; ordered by them, the
    ``rendered`` texts of a transcript are its canonical form.  A turn that
    crosses a segment's border is returned in parts: those after the first are
    ``continued`` and have no header.  The mark that closes a turn stands
    before the next header, or ends the transcript.
    ``true_lines`` counts the lines whose labelled role is the recovered one.

    ``lines`` is as from ``as_transcripts``; blank and null lines only mark
    gaps.  Null transcript ids are one transcript.  Without a model it is
    learned from the lines not ``held_out``; with no labelled line every state
    is as likely.  Lines that repeat a place are all kept, those with equal
    text in some order; of equally probable paths that of the lower states
    wins.  Text that looks like a header or an end is escaped (``escape``), so
    it can be told from one.  Other columns are not read; an empty table gives
    no rows.
    """
    ship(lines.sparkSession)
    segments = in_segments(lines)
    model = model or learn(segments, F.lit(False) if held_out is None else held_out)
    fixed = borders(segments, model)
    kind = {f.name: f.dataType.simpleString() for f in segments.schema}
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, line int, role string, n_lines long, rendered string, continued boolean, true_lines long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "line", "role", "n_lines", "rendered", "continued", "true_lines"]
        types: list[pa.DataType] = []

        def recording(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                types[:] = [batch.schema.field("conv_id").type, batch.schema.field("turn").type, pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
                yield batch

        out: list[tuple] = []
        for _, rows in _runs(recording(batches)):
            before, last, goes_on = fixed.get((rows[0]["segment"], rows[0]["conv_id"]), (None, None, False))
            path = model.decode(_emission(model, rows), before, last).tolist()
            starts = [k for k, s in enumerate(path) if k == 0 or s % 2 == 0]
            for a, b in zip(starts, [*starts[1:], len(path)], strict=True):
                role, opened = ROLES[path[a] // 2], path[a] % 2 == 0
                texts = [r["text"] for r in rows[a:b]]
                if opened:
                    texts[0] = texts[0][marker_of(texts[0])[1] :]
                body = escape("\n".join(texts))
                header = f"<|{role}|>\n" if opened else ""
                if opened and a == 0 and before is not None:
                    header = "<|end|>\n" + header
                # the last turn before a border is closed by what follows it
                open_end = b == len(path) and goes_on
                text = header + body + ("\n" if open_end else "\n<|end|>\n")
                true = sum(r["state"] is not None and r["state"] // 2 == path[a] // 2 for r in rows[a:b])
                out.append((rows[a]["conv_id"], rows[a]["turn"], rows[a]["line"], role, b - a, text, not opened, true))
            if len(out) > 2000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return segments.mapInArrow(run, schema)
