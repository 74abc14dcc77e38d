"""Values of query expressions as columns.

An error, like an unbound variable, is null.  A value is held in the form that
it was computed in: a term, a truth value, a number (rank of the numeric type,
decimal, double) or a text (string, and what follows its closing quote).
Operators take each operand once and bind it with ``let``, so that nested
expressions grow with the query and not with a power of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import RDF, XSD, datatype_of, is_literal, lang_of, split, text_of

INTEGERS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
INTEGER, DECIMAL, FLOAT, DOUBLE = 1, 2, 3, 4
EXACT = "decimal(38,18)"


@dataclass(frozen=True)
class Value:
    column: Column


class Term(Value):
    pass


@dataclass(frozen=True)
class Fixed(Term):
    """A constant; its parts are known when the query is compiled."""

    term: str


class Truth(Value):
    pass


class Number(Value):
    """A struct of rank, exact and double; a null rank is no number."""


class Text(Value):
    """A struct of text and tail, ``@lang``, ``^^<datatype>`` or empty; a null text is no string."""


def fixed(term: str) -> Fixed:
    return Fixed(F.lit(term), term)


def let(f: Callable[..., Column], *columns: Column) -> Column:
    """``f`` of the columns, each of which is computed once."""
    parts = [f"c{k}" for k in range(len(columns))]
    one = F.array(F.struct(*(c.alias(n) for c, n in zip(columns, parts, strict=True))))
    return F.get(F.transform(one, lambda row: f(*(row[n] for n in parts))), 0)


def number(rank: Column, exact: Column, double: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), exact.try_cast(EXACT).alias("exact"), double.cast("double").alias("double"))


def text(column: Column, tail: Column | None = None) -> Column:
    return F.struct(column.alias("text"), (F.lit("") if tail is None else tail).alias("tail"))



def no_number() -> Column:
    none = F.lit(None)
    return number(none.cast("int"), none.cast(EXACT), none.cast("double"))


def integer(column: Column) -> Number:
    return Number(let(lambda x: number(F.when(x.isNotNull(), INTEGER), x, x), column))


def decimal(column: Column) -> Number:
    return Number(let(lambda x: number(F.when(x.isNotNull(), DECIMAL), x, x), column))


def rank_of(kind: Column) -> Column:
    return F.when(kind.isin(*(XSD + k for k in INTEGERS)), INTEGER).when(kind == XSD + "decimal", DECIMAL).when(kind == XSD + "float", FLOAT).when(kind == XSD + "double", DOUBLE)


def parsed_double(lexical: Column) -> Column:
    return F.when(lexical == "INF", F.lit("Infinity")).when(lexical == "-INF", F.lit("-Infinity")).otherwise(lexical).try_cast("double")


def _number_of_term(term: Column) -> Column:
    def ranked(lexical: Column, rank: Column, double: Column) -> Column:
        real = rank.isNotNull() & double.isNotNull()
        return number(F.when(real, rank), F.when(real, lexical.try_cast(EXACT)), F.when(real, double))

    parts = lambda lexical, kind: let(ranked, lexical, rank_of(kind), parsed_double(lexical))
    return let(lambda t: F.when(t.startswith('"') & F.contains(t, F.lit(f'"^^<{XSD}')), let(parts, F.trim(text_of(t)), datatype_of(t))).otherwise(no_number()), term)


def _fixed_number(term: str) -> Column:
    kind, lexical, datatype, _ = split(term)
    name = (datatype or "").removeprefix(XSD)
    rank = INTEGER if name in INTEGERS else {"decimal": DECIMAL, "float": FLOAT, "double": DOUBLE}.get(name)
    if kind != "literal" or rank is None or datatype is None or not datatype.startswith(XSD):
        return no_number()
    try:
        double = float(lexical.strip().replace("INF", "inf"))
        exact = Decimal(lexical.strip()) if rank <= DECIMAL else None
    except (ValueError, InvalidOperation):
        return no_number()
    return number(F.lit(rank), F.lit(None if exact is None else str(exact)).cast(EXACT), F.lit(double))


def number_of(v: Value) -> Column:
    """The number's struct; its fields are null for other values."""
    if isinstance(v, Number):
        return v.column
    if isinstance(v, Fixed):
        return _fixed_number(v.term)
    return _number_of_term(v.column) if isinstance(v, Term) else no_number()


def string_of(v: Value) -> Column:
    """The struct of a simple literal or one with a language; null fields for other terms."""
    if isinstance(v, Text):
        return v.column
    if not isinstance(v, Term):
        return text(F.lit(None).cast("string"), F.lit(None).cast("string"))
    made = lambda t, lang: text(F.when(datatype_of(t).isin(XSD + "string", RDF + "langString"), text_of(t)), F.when(lang != "", F.concat(F.lit("@"), lang)).otherwise(F.lit("")))
    return let(lambda t: let(made, t, lang_of(t)), v.column)


def number_text(n: Column) -> Column:
    whole = F.when(n["exact"] == 0, F.lit("0")).otherwise(F.regexp_replace(n["exact"].cast("string"), r"\.?0+$", ""))
    wide = n["double"].cast("string")
    special = F.when(wide == "Infinity", F.lit("INF")).when(wide == "-Infinity", F.lit("-INF")).otherwise(wide)
    return F.when(n["rank"] <= DECIMAL, whole).when(n["rank"].isNotNull(), special)


def text_value(v: Value) -> Column:
    """STR of a value."""
    if isinstance(v, Term):
        return let(text_of, v.column)
    if isinstance(v, Text):
        return v.column["text"]
    if isinstance(v, Truth):
        return v.column.cast("string")
    return let(number_text, v.column)


def term_of(v: Value) -> Column:
    if isinstance(v, Term):
        return v.column
    if isinstance(v, Truth):
        return F.concat(F.lit('"'), v.column.cast("string"), F.lit(f'"^^<{XSD}boolean>'))
    if isinstance(v, Text):
        return let(lambda x: F.concat(F.lit('"'), x["text"], F.lit('"'), F.coalesce(x["tail"], F.lit(""))), v.column)
    name = lambda n: F.when(n["rank"] == INTEGER, "integer").when(n["rank"] == DECIMAL, "decimal").when(n["rank"] == FLOAT, "float").otherwise("double")
    return let(lambda n: F.concat(F.lit('"'), number_text(n), F.lit(f'"^^<{XSD}'), name(n), F.lit(">")), v.column)


def _real(n: Column) -> Column:
    return ~F.isnan(n["double"]) & (n["double"] != 0)


def _truth_of_term(t: Column) -> Column:
    def judged(x: Column, lexical: Column, kind: Column) -> Column:
        return (
            F.when(~is_literal(x), F.lit(None).cast("boolean"))
            .when(kind == XSD + "boolean", lexical.isin("true", "1"))
            .when(kind.isin(XSD + "string", RDF + "langString"), F.length(lexical) > 0)
            .when(rank_of(kind).isNotNull(), F.coalesce(let(lambda d: ~F.isnan(d) & (d != 0), parsed_double(F.trim(lexical))), F.lit(False)))
        )

    return let(lambda x: let(judged, x, text_of(x), datatype_of(x)), t)


def truth_of(v: Value) -> Column:
    """Effective boolean value."""
    if isinstance(v, Truth):
        return v.column
    if isinstance(v, Text):
        return F.length(v.column["text"]) > 0
    if isinstance(v, Number):
        return let(lambda n: F.when(n["rank"].isNotNull(), _real(n)), v.column)
    return _truth_of_term(v.column)


_TESTS: dict[str, Callable[[Column, Column], Column]] = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


def _compare_numbers(op: str, x: Column, y: Column) -> Column:
    test = _TESTS[op]
    exact = F.when((x["rank"] <= DECIMAL) & (y["rank"] <= DECIMAL) & x["exact"].isNotNull() & y["exact"].isNotNull(), test(x["exact"], y["exact"]))
    wide = exact.when(F.isnan(x["double"]) | F.isnan(y["double"]), F.lit(False)).otherwise(test(x["double"], y["double"]))
    return F.when(x["rank"].isNotNull() & y["rank"].isNotNull(), wide)


def _compare_terms(op: str, a: Column, b: Column) -> Column:
    test = _TESTS[op]

    def judged(s: Column, t: Column, text_s: Column, text_t: Column, kind_s: Column, kind_t: Column) -> Column:
        same = kind_s == kind_t
        kinds = lambda *names: same & kind_s.isin(*(XSD + n for n in names))
        out = (
            F.when(rank_of(kind_s).isNotNull() & rank_of(kind_t).isNotNull(), let(lambda x, y: _compare_numbers(op, x, y), _number_of_term(s), _number_of_term(t)))
            .when(kind_s.isin(XSD + "string", RDF + "langString") & kind_t.isin(XSD + "string", RDF + "langString"), (s == t) if op == "=" else F.when(lang_of(s) == lang_of(t), test(text_s, text_t)))
            .when(kinds("dateTime", "date"), test(text_s.try_cast("timestamp"), text_t.try_cast("timestamp")))
            .when(kinds("boolean"), test(text_s.isin("true", "1"), text_t.isin("true", "1")))
        )
        if op == "=":
            # literals of unknown types that differ as terms are no error only where one of them is no literal
            out = out.when(s == t, F.lit(True)).when(~is_literal(s) | ~is_literal(t), F.lit(False))
        return F.when(s.isNotNull() & t.isNotNull(), out)

    return let(lambda s, t: let(judged, s, t, text_of(s), text_of(t), datatype_of(s), datatype_of(t)), a, b)


def compare(op: str, a: Value, b: Value) -> Column:
    """``=``, ``<`` and so on of two values; null where they cannot be compared."""
    if isinstance(a, Truth) or isinstance(b, Truth):
        return _TESTS[op](truth_of(a), truth_of(b))
    if op == "=" and any(isinstance(v, Fixed) and v.term.startswith("<") for v in (a, b)):
        # plain equality of strings, which reaches the scan
        return term_of(a) == term_of(b)
    numeric = [isinstance(v, Number) or isinstance(v, Fixed) and "^^<" + XSD in v.term and split(v.term)[2].removeprefix(XSD) in (*INTEGERS, "decimal", "float", "double") for v in (a, b)]  # type: ignore[union-attr]
    if any(numeric) and op != "=" or any(isinstance(v, Number) for v in (a, b)):
        return let(lambda x, y: _compare_numbers(op, x, y), number_of(a), number_of(b))
    if isinstance(a, Text) and isinstance(b, (Text, Fixed)) or isinstance(b, Text) and isinstance(a, Fixed):
        return let(lambda x, y: F.when(x["tail"] == y["tail"], _TESTS[op](x["text"], y["text"])), string_of(a), string_of(b))
    return _compare_terms(op, term_of(a), term_of(b))


def arithmetic(op: str, a: Value, b: Value) -> Number:
    """Sum, difference, product or quotient in the wider type; integers divide to a decimal.

    Products and quotients of exact numbers keep at least six decimal places;
    an exact result out of range, and exact division by zero, is an error.
    """
    some = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    narrow = "decimal(28,10)" if op in "*/" else EXACT

    def wide(x: Column, y: Column) -> Column:
        if op != "/":
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(y == 0, zero).otherwise(F.try_divide(x, y))

    def made(x: Column, y: Column) -> Column:
        rank = F.greatest(x["rank"], y["rank"], F.lit(DECIMAL)) if op == "/" else F.greatest(x["rank"], y["rank"])
        rank = F.when(x["rank"].isNotNull() & y["rank"].isNotNull(), rank)
        exact = some(x["exact"].try_cast(narrow), y["exact"].try_cast(narrow)).try_cast(EXACT)
        return let(lambda r, e, d: number(F.when((r > DECIMAL) | e.isNotNull(), r), F.when(r <= DECIMAL, e), d), rank, exact, wide(x["double"], y["double"]))

    return Number(let(made, number_of(a), number_of(b)))


def order_key(v: Value) -> Column:
    """Unbound, blank nodes, IRIs, literals: numbers by value and then others by text."""

    def made(t: Column, n: Column) -> Column:
        rank = F.when(t.isNull(), 0).when(t.startswith("_:"), 1).when(t.startswith("<"), 2).when(n["rank"].isNotNull(), 3).otherwise(4)
        return F.struct(rank.alias("rank"), n["double"].alias("number"), F.when(n["rank"].isNull(), text_of(t)).alias("text"), t.alias("term"))

    return let(lambda t: let(made, t, _number_of_term(t)), term_of(v))
