"""N-Triples and N-Quads: read and written line by line inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import datatype_of, is_blank, is_iri, is_literal, lang_of, text_of

_IRI = r"<[^<>\"{}|^`\x00-\x20]*>"
_NODE = rf"(?:{_IRI}|_:[^\s<>\"]+)"
_LITERAL = rf'"(?:[^"\\\n\r]|\\.)*"(?:\^\^{_IRI}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
LINE = rf"^\s*({_NODE})\s*({_IRI})\s*({_NODE}|{_LITERAL})\s*({_NODE})?\s*\.\s*(?:#.*)?$"
_HEX = r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"


def _code_points(text: Column) -> Column:
    """``\\uXXXX`` and ``\\UXXXXXXXX`` as characters, by way of their UTF-32 bytes; texts without any pass as they are."""
    parts = F.regexp_extract_all(text, F.lit(_HEX), F.lit(0))
    made = F.aggregate(
        F.array_distinct(parts), text,
        lambda done, e: F.replace(done, e, F.decode(F.unhex(F.lpad(F.substring(e, F.lit(3), F.lit(8)), 8, "0")), "UTF-32")),
    )
    return F.when(F.contains(text, F.lit("\\u")) | F.contains(text, F.lit("\\U")), made).otherwise(text)


def unescaped(text: Column) -> Column:
    """Escapes of a literal as characters.  A double backslash is set aside first, so that it opens no other escape."""
    out = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    out = _code_points(out)
    for escape, character in (("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        out = F.replace(out, F.lit(escape), F.lit(character))
    return F.when(F.contains(text, F.lit("\\")), F.replace(out, F.lit("\x00"), F.lit("\\"))).otherwise(text)


def escaped(text: Column) -> Column:
    """The canonical escapes of a literal."""
    for character, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(character), F.lit(escape))
    return text


def _term(token: Column, scope: Column) -> Column:
    body = unescaped(F.regexp_extract(token, r'(?s)^"(.*)"', 1))
    tail = F.regexp_extract(token, r'(?s)^".*"(@.*|\^\^.*)?$', 1)
    tail = F.when(tail == "^^<http://www.w3.org/2001/XMLSchema#string>", F.lit("")).when(tail.startswith("@"), F.lower(tail)).otherwise(tail)
    return F.when(token.startswith('"'), F.concat(F.lit('"'), body, F.lit('"'), tail)).when(token.startswith("_:"), F.concat(F.lit("_:"), scope, F.substring(token, F.lit(3), F.length(token)))).otherwise(_code_points(token))


def parse_lines(lines: DataFrame, column: str = "value", scope: Column | None = None, keep: tuple[str, ...] = (), errors: bool = False) -> DataFrame:
    """``graph, s, p, o`` of lines, and the columns to keep; graph is null for triples.

    Blank nodes are renamed by ``scope``, one string for each source, so that
    equal labels of two sources stay apart.  Empty lines and comments are
    skipped; any other line that is no statement raises or, with ``errors``,
    gives a row of nulls with its ``error``.
    """
    scope = F.lit("") if scope is None else scope
    text = F.trim(F.col(column))
    rows = lines.where((text != "") & ~text.startswith("#"))
    part = lambda k: F.regexp_extract(column, LINE, k)
    error = F.concat(F.lit("no statement: "), F.substring(column, 1, 200))
    fine = F.col(column).rlike(LINE)
    if errors:
        parts = [_term(F.nullif(part(4), F.lit("")), scope).alias("graph"), _term(part(1), scope).alias("s"), _code_points(part(2)).alias("p"), _term(part(3), scope).alias("o")]
        empty = [F.when(fine, p).alias(name) for p, name in zip(parts, ("graph", "s", "p", "o"), strict=True)]
        return rows.select(*keep, *empty, F.when(~fine, error).alias("error"))
    checked = F.when(fine, part(1)).otherwise(F.raise_error(error))
    graph = _term(F.nullif(part(4), F.lit("")), scope)
    return rows.select(*keep, graph.alias("graph"), _term(checked, scope).alias("s"), _code_points(part(2)).alias("p"), _term(part(3), scope).alias("o"))


def read(spark: SparkSession, path: str, dataset: str = "file", graph: str | None = None, named: bool = True) -> DataFrame:
    """Quads of N-Triples or N-Quads files.  Triples go to ``graph``, by default the file's IRI; named graphs are an error unless ``named``."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    found = parse_lines(lines, "value", F.concat(F.hex(F.xxhash64("_file")), F.lit("x")), ("_file",))
    own = F.concat(F.lit("<"), F.col("_file"), F.lit(">")) if graph is None else F.lit(graph)
    target = F.coalesce("graph", own) if named else F.when(F.col("graph").isNull(), own).otherwise(F.raise_error(F.lit("named graphs are not expected here")))
    return found.select(F.lit(dataset).alias("dataset"), target.alias("graph"), "s", "p", "o").dropDuplicates()


def to_text(term: Column) -> Column:
    """A term as N-Triples writes it."""
    lang, kind = lang_of(term), datatype_of(term)
    tail = F.when(lang != "", F.concat(F.lit("@"), lang)).when(kind != "http://www.w3.org/2001/XMLSchema#string", F.concat(F.lit("^^<"), kind, F.lit(">"))).otherwise(F.lit(""))
    return F.when(is_literal(term), F.concat(F.lit('"'), escaped(text_of(term)), F.lit('"'), tail)).when(is_iri(term) | is_blank(term), term)


def lines_of(quads: DataFrame, graphs: bool = False) -> DataFrame:
    """``value``: one statement in each row."""
    terms = [to_text(F.col(c)) for c in ("s", "p", "o", *(["graph"] if graphs else []))]
    return quads.select(F.concat(F.concat_ws(" ", *terms), F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, graphs: bool = False) -> None:
    lines_of(quads, graphs).write.text(path)
