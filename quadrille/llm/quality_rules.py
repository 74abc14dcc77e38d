"""Quality rules in plain DataFrame operations, with cross-document line frequency.

Lines are normalised (without blanks, lower-cased) and hashed with their host.
For each of these hashes the distinct documents that hold it are counted.  A
line that stands in more than ``min_docs`` documents and in more than
``max_percent`` per cent of its host's documents is boilerplate: it is removed
from all of them, and a document left with too small a share of its characters
is rejected.  Both limits are alike at every size of the table.

Frequent lines are few, since each takes a share of its host's documents.  Up to
``FEW`` of them each host's are broadcast, and documents are judged where they
are read; beyond, the lines of documents meet them in a shuffle, and documents
those of their lines that are frequent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import INTERNAL, drop_written, written

#: ASCII blanks, and those that stand within lines.
BLANKS, WITHIN = " \t\n\x0b\x0c\r", " \t\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Limits of the rules: see ``judge``.
MIN_DOCS, MAX_PERCENT = 5, 8
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_LEFT_PERCENT = 20, 30, 20
#: Frequent lines up to which they are broadcast, as 64-bit hashes.
FEW = 1 << 17
#: A line is hot where its documents are more than this part of what a task gets on average.
HOT = 0.25


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII blanks."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def without_blanks(text: Column, blanks: str = BLANKS) -> Column:
    """Replacing one blank after another takes far less time than ``translate``, which looks at every character."""
    return reduce(lambda done, blank: F.replace(done, F.lit(blank), F.lit("")), blanks, text)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), f), 0)


def covered(places: Column) -> Column:
    """Words in the windows that begin at the sorted places: each adds its words up to the next one."""
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)


def repeated_places(pairs: Column) -> Column:
    """Sorted places of (hash, place) pairs, in order of hash, that have a neighbour of the same hash."""
    like_next = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    marked = lambda same: F.zip_with(
        pairs, F.zip_with(same, F.concat(F.array(F.lit(False)), F.slice(same, 1, F.size(same) - 1)), lambda a, b: a | b), lambda p, e: F.when(e, p["i"])
    )
    return let(like_next, lambda same: F.array_sort(F.array_compact(marked(same))))


def repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of the windows in order; texts whose windows all differ skip the sort."""
    in_order = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    total = lambda h: let(let(in_order(h), repeated_places), covered)
    return let(hashes, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), total(h)).otherwise(0)).cast("long")


def paired(hashes: Column, step: int) -> Column:
    """A hash of each element and the one ``step`` places behind it."""
    return let(hashes, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step))))


def window_hashes(words: Column) -> Column:
    """A hash of each run of ``WINDOW`` words, made of the hashes of its halves, and these of theirs."""
    size, made = 1, F.transform(words, lambda w: F.xxhash64(w))
    while size < WINDOW:
        made, size = paired(made, size), 2 * size
    return F.when(F.size(words) >= WINDOW, made).otherwise(F.array().cast("array<bigint>"))


def features(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), has_word)
    words, hashes = F.col(f"{INTERNAL}words"), F.col(f"{INTERNAL}lines")
    first = docs.withColumns({f"{INTERNAL}words": words_of(text), f"{INTERNAL}lines": F.transform(lines, lambda x: F.xxhash64(x))})
    second = first.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": word_chars(text),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(hashes, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": let(words, lambda w: repeat_words(window_hashes(w))),
        }
    )
    return second.drop(f"{INTERNAL}words", f"{INTERNAL}lines")


def word_chars(text: Column) -> Column:
    return F.length(without_blanks(text)).cast("long")


def normal_line(line: Column) -> Column:
    """A line without its blanks, in lower case."""
    return F.lower(without_blanks(line, WITHIN))


def line_hash(host: Column, line: Column) -> Column:
    return F.xxhash64(host, normal_line(line))


def row_hash(text_column: str, host_column: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")), F.lit("\n"), F.col(host_column))


def host_lines(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """``doc_id, row, host, pos, line, chars`` of every line that has a word; ``chars`` are its code points in words."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.split(without_blanks(text, WITHIN), "\n")
    rows = docs.select(F.col(id_column).alias("doc_id"), row_hash(text_column, host_column).alias("row"), F.col(host_column).alias("host"), F.posexplode(lines).alias("pos", "x"))
    return rows.where(F.col("x") != "").select("doc_id", "row", F.xxhash64("host").alias("host"), "pos", line_hash(F.col("host"), F.col("x")).alias("line"), F.length("x").alias("chars"))


def frequent_lines(lines: DataFrame, docs_of_host: DataFrame, min_docs: int, max_percent: float) -> DataFrame:
    """``host, line, n_docs`` of the lines above the limits.

    Documents are told apart by their ids; all rows without an id count as one
    document.  The pairs of line and document are made distinct first, so no
    task gets all rows of a line.
    """
    pairs = lines.groupBy("line", "doc_id").agg(F.min("host").alias("host"))
    counted = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("host").alias("host")).where(F.col("n_docs") > min_docs)
    return counted.join(docs_of_host, "host").where(100 * F.col("n_docs") > max_percent * F.col("host_docs")).select("host", "line", "n_docs")


def lines_of_rows(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """``doc_id, row, gone`` of the documents that hold frequent lines; ``gone`` are the hashes of these.

    Rows that hold a hot line, of which there are few by their definition, are
    dealt over as many copies of it as its documents fill tasks; the others
    meet theirs by a plain join.
    """
    spark = lines.sparkSession
    most, total = frequent.agg(F.max("n_docs")).first()[0] or 0, lines.count()
    per_task = max(1, int(HOT * total / int(spark.conf.get("spark.sql.shuffle.partitions"))))
    columns = ["doc_id", "row", "line"]
    hit = lines.join(frequent.where(F.col("n_docs") <= per_task).select("line"), "line").select(*columns)
    if most > per_task:
        salts = -(-most // per_task)
        hot = frequent.where(F.col("n_docs") > per_task).select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "pos"), F.lit(salts)).cast("int"))
        hit = hit.unionByName(salted.join(hot, ["line", "salt"]).select(*columns))
    return hit.groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone"))


GONE = f"{INTERNAL}gone"


def with_frequent(docs: DataFrame, id_column: str, text_column: str, host_column: str, min_docs: int, max_percent: float) -> DataFrame:
    """The rows with the hashes of frequent lines, of their host or of their own, or null."""
    lines = written(host_lines(docs, id_column, text_column, host_column), "lines")
    host = F.xxhash64(F.col(host_column))
    of_host = docs.select(host.alias("host"), F.col(id_column).alias("doc_id")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = written(frequent_lines(lines, of_host, min_docs, max_percent), "frequent")
    at, key = f"{INTERNAL}host", f"{INTERNAL}row"
    if frequent.count() <= FEW:
        by_host = written(frequent.groupBy(F.col("host").alias(at)).agg(F.collect_set("line").alias(GONE)), "by-host")
        out = docs.join(F.broadcast(by_host), host == F.col(at), "left").drop(at)
    else:
        own = written(lines_of_rows(lines, frequent).select(F.col("doc_id").alias(at), F.col("row").alias(key), F.col("gone").alias(GONE)), "gone")
        out = docs.join(own, F.col(id_column).eqNullSafe(F.col(at)) & (row_hash(text_column, host_column) == F.col(key)), "left").drop(at, key)
    drop_written(lines, frequent)
    return out


def removed_chars(text: Column, host: Column) -> Column:
    """Code points in words of the lines that go."""
    lines = F.split(without_blanks(text, WITHIN), "\n")
    gone = F.filter(lines, lambda x: F.array_contains(F.col(GONE), line_hash(host, x)))
    return F.when(F.col(GONE).isNull() | text.isNull(), F.lit(0)).otherwise(F.aggregate(gone, F.lit(0), lambda n, x: n + F.length(x))).cast("long")


def without_lines(text: Column, host: Column) -> Column:
    """The text less the lines that go."""
    left = lambda x: ~has_word(x) | ~F.array_contains(F.col(GONE), line_hash(host, x))
    lines = F.split(text, "\n")
    # a text that keeps all its lines is handed on as it is
    return F.when(F.col(GONE).isNull(), text).otherwise(let(lines, lambda x: F.array_join(F.filter(x, left), "\n")))


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_docs: int = MIN_DOCS,
    max_percent: float = MAX_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """The rows with the features, ``removed_chars``, ``base_failed``, ``kept`` and ``clean_text``.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` per cent of them in repeated windows.  A line of the
    host that stands in more than ``min_docs`` distinct documents and more than
    ``max_percent`` per cent of the host's is removed from all of them:
    ``clean_text`` is the text without it, and ``removed_chars`` counts the code
    points in its words.  ``kept`` is false where the base rules failed, and
    where less than ``min_left_percent`` per cent of the code points in words
    are left.

    A null text counts as empty and fails; a null host is a host of its own;
    rows with the same id, text and host are judged alike, and all rows without
    an id count as one document.  Copies of a document count each for itself,
    as documents that share all their lines.  All input columns pass through,
    but those named like a result are replaced.  An empty table gives no rows.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars", "base_failed", "kept", "clean_text"]
    rows = with_frequent(docs.drop(*(c for c in results if c in docs.columns)), id_column, text_column, host_column, min_docs, max_percent)
    text, host = F.col(text_column), F.col(host_column)
    base = features(rows, text_column).withColumn("removed_chars", removed_chars(text, host))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * (F.col("word_chars") - F.col("removed_chars")) < min_left_percent * F.col("word_chars")
    return base.withColumns({"base_failed": failed, "kept": ~failed & ~depleted, "clean_text": without_lines(text, host)}).drop(GONE)


def keep_good(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", chars_column: str | None = None,
    min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, frequent lines of their host removed from the text.

    ``chars_column``, where there is one, holds the length of the text and
    follows it.  The verdict is one expression that cuts a text into words
    once, wherever the optimizer evaluates it.
    """
    rows = with_frequent(docs, id_column, text_column, host_column, min_docs, max_percent)
    text, host = F.coalesce(F.col(text_column), F.lit("")), F.col(host_column)
    failed = let(words_of(text), lambda w: (F.size(w) < min_words) | (100 * repeat_words(window_hashes(w)) > max_repeat_percent * F.size(w)))
    depleted = F.col(GONE).isNotNull() & let(word_chars(text), lambda n: 100 * (n - removed_chars(F.col(text_column), host)) < min_left_percent * n)
    changed = {text_column: without_lines(F.col(text_column), host)}
    if chars_column:
        length = F.length(changed[text_column]).cast(docs.schema[chars_column].dataType)
        changed[chars_column] = F.when(F.col(GONE).isNull() | (length == F.length(F.col(text_column))), F.col(chars_column)).otherwise(length)
    return rows.where(~failed & ~depleted).withColumns(changed).select(*docs.columns)
