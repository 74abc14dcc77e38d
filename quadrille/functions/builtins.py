"""The functions of SPARQL 1.1 over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import XSD, datatype_of, is_blank, is_iri, is_literal, lang_of, text_of
from .values import DOUBLE, EXACT, FLOAT, Fixed, Number, Term, Text, Truth, Value, compare, decimal, integer, let, number, number_of, string_of, term_of, text, text_value, truth_of

_MOMENT = r"^-?\d{4,}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"


def _iri_term(name: Column) -> Column:
    return F.concat(F.lit("<"), name, F.lit(">"))


def _fits(a: Column, b: Column) -> Column:
    """Argument compatibility: the second is plain or has the first one's language."""
    return (b["tail"] == "") | (a["tail"] == b["tail"])


def _string(v: Value) -> Column:
    return string_of(v)["text"]


def _pair(test: Callable[[Column, Column], Column]) -> Callable[..., Value]:
    return lambda a, b: Truth(let(lambda x, y: F.when(_fits(x, y), test(x["text"], y["text"])), string_of(a), string_of(b)))


def _around(after: bool) -> Callable[..., Value]:
    """The part before or after the first place of the second string; empty and plain where there is none."""

    def made(x: Column, y: Column, at: Column) -> Column:
        whole = x["text"] if after else F.lit("")
        part = F.substring(x["text"], at + F.length(y["text"]), F.length(x["text"])) if after else F.substring(x["text"], F.lit(1), at - 1)
        found = F.when(y["text"] == "", whole).when(at > 0, part).otherwise(F.lit(""))
        return text(F.when(_fits(x, y) & at.isNotNull(), found), F.when((at > 0) | (y["text"] == ""), x["tail"]).otherwise(F.lit("")))

    return lambda a, b: Text(let(lambda x, y: let(made, x, y, F.position(y["text"], x["text"])), string_of(a), string_of(b)))


def _substr(a: Value, start: Value, size: Value | None = None) -> Value:
    """Characters from the rounded start, counted from 1, before the rounded end."""

    def made(x: Column, first: Column, end: Column) -> Column:
        begin = F.greatest(first, F.lit(1))
        return text(F.when(first.isNotNull() & end.isNotNull(), F.substring(x["text"], begin, F.greatest(end - begin, F.lit(0)))), x["tail"])

    whole = lambda v: F.floor(number_of(v)["double"] + 0.5).cast("int")
    if size is None:
        return Text(let(lambda x, first: let(made, x, first, F.length(x["text"]) + 1), string_of(a), whole(start)))
    return Text(let(lambda x, first, n: let(made, x, first, first + n), string_of(a), whole(start), whole(size)))


def _pattern(pattern: Value, flags: Value | None) -> Column:
    """The pattern with Java's inline flags, quoted for the flag q."""
    if flags is None:
        return _string(pattern)

    def made(p: Column, f: Column) -> Column:
        letters = F.regexp_replace(f, "[^ismx]", "")
        quoted = F.when(F.contains(f, F.lit("q")), F.concat(F.lit("\\Q"), p, F.lit("\\E"))).otherwise(p)
        return F.when(letters == "", quoted).otherwise(F.concat(F.lit("(?"), letters, F.lit(")"), quoted))

    return let(made, _string(pattern), _string(flags))


def _regex(a: Value, pattern: Value, flags: Value | None = None) -> Value:
    return Truth(F.regexp_like(_string(a), _pattern(pattern, flags)))


def _replace(a: Value, pattern: Value, with_: Value, flags: Value | None = None) -> Value:
    return Text(let(lambda x, p, w: text(F.regexp_replace(x["text"], p, w), x["tail"]), string_of(a), _pattern(pattern, flags), _string(with_)))


def _concat(*parts: Value) -> Value:
    if not parts:
        return Text(text(F.lit("")))

    def made(*xs: Column) -> Column:
        same = F.lit(True)
        for x in xs[1:]:
            same = same & (x["tail"] == xs[0]["tail"])
        return text(F.concat(*(x["text"] for x in xs)), F.when(same, xs[0]["tail"]).otherwise(F.lit("")))

    return Text(let(made, *map(string_of, parts)))


def _encode(a: Value) -> Value:
    out = F.url_encode(_string(a))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return Text(text(out))


def _lang_matches(a: Value, b: Value) -> Value:
    made = lambda tag, wanted: F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-"))))
    return Truth(let(made, F.lower(_string(a)), F.lower(_string(b))))


def _hash(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda a: Text(text(f(_string(a).cast("binary"))))


def _moment_text(a: Value) -> Column:
    """The text of a dateTime or date that is well formed; its own fields count, whatever the session's time zone."""
    return let(lambda t: F.when(datatype_of(t).isin(XSD + "dateTime", XSD + "date") & text_of(t).rlike(_MOMENT), text_of(t)), term_of(a))


def _part(pattern: str) -> Callable[[Value], Value]:
    return lambda a: integer(F.nullif(F.regexp_extract(_moment_text(a), pattern, 1), F.lit("")).cast("long"))


def _seconds(a: Value) -> Value:
    return decimal(F.nullif(F.regexp_extract(_moment_text(a), r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1), F.lit("")).cast(EXACT))


def _zone(a: Value) -> Column:
    return F.regexp_extract(_moment_text(a), _MOMENT, 1)


def _timezone(a: Value) -> Value:
    def made(zone: Column) -> Column:
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
        sign = F.when(zone.startswith("-"), F.lit("-")).otherwise(F.lit(""))
        out = F.when(zone.isin("Z", "+00:00", "-00:00"), F.lit("PT0S")).otherwise(F.concat(sign, F.lit("PT"), part(hours, "H"), part(minutes, "M")))
        return text(F.when(zone != "", out), F.lit(f"^^<{XSD}dayTimeDuration>"))

    return Text(let(made, _zone(a)))


def _mapped(exact: Callable[[Column], Column], double: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda a: Number(let(lambda n: number(n["rank"], exact(n["exact"]), double(n["double"])), number_of(a)))


def _if(test: Value, then: Value, other: Value) -> Value:
    return Term(let(lambda t, x, y: F.when(t.isNull(), F.lit(None).cast("string")).when(t, x).otherwise(y), truth_of(test), term_of(then), term_of(other)))


def _strdt(a: Value, kind: Value) -> Value:
    def made(x: Column, k: Column) -> Column:
        return text(F.when(is_iri(k) & (x["tail"] == ""), x["text"]), F.when(k == f"<{XSD}string>", F.lit("")).otherwise(F.concat(F.lit("^^"), k)))

    return Text(let(made, string_of(a), term_of(kind)))


def _strlang(a: Value, lang: Value) -> Value:
    return Text(let(lambda x, y: text(F.when(x["tail"] == "", x["text"]), F.concat(F.lit("@"), F.lower(y))), string_of(a), _string(lang)))


def _iri(a: Value) -> Value:
    return Term(let(lambda t, s: F.when(is_iri(t), t).otherwise(_iri_term(s)), term_of(a), _string(a)))


def _blank(a: Value | None = None) -> Value:
    """Equal labels give equal nodes; without one every row has its own."""
    name = F.replace(F.uuid(), F.lit("-"), F.lit("")) if a is None else F.hex(F.xxhash64(_string(a)))
    return Term(F.concat(F.lit("_:b"), name))


def _same_text(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda a: Text(let(lambda x: text(f(x["text"]), x["tail"]), string_of(a)))


BUILTINS: dict[str, Callable[..., Value]] = {
    "STR": lambda a: Text(text(text_value(a))),
    "LANG": lambda a: Text(text(lang_of(term_of(a)))),
    "DATATYPE": lambda a: Term(_iri_term(let(datatype_of, term_of(a)))),
    "IRI": _iri,
    "URI": _iri,
    "BNODE": _blank,
    "STRDT": _strdt,
    "STRLANG": _strlang,
    "UUID": lambda: Term(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
    "STRUUID": lambda: Text(text(F.uuid())),
    "SAMETERM": lambda a, b: Truth(term_of(a) == term_of(b)),
    "ISIRI": lambda a: Truth(is_iri(term_of(a))),
    "ISURI": lambda a: Truth(is_iri(term_of(a))),
    "ISBLANK": lambda a: Truth(is_blank(term_of(a))),
    "ISLITERAL": lambda a: Truth(is_literal(term_of(a))),
    "ISNUMERIC": lambda a: Truth(let(lambda t, n: F.when(t.isNotNull(), n["rank"].isNotNull()), term_of(a), number_of(a))),
    "IF": _if,
    "STRLEN": lambda a: integer(F.length(_string(a))),
    "SUBSTR": _substr,
    "UCASE": _same_text(F.upper),
    "LCASE": _same_text(F.lower),
    "STRSTARTS": _pair(F.startswith),
    "STRENDS": _pair(F.endswith),
    "CONTAINS": _pair(F.contains),
    "STRBEFORE": _around(False),
    "STRAFTER": _around(True),
    "CONCAT": _concat,
    "ENCODE_FOR_URI": _encode,
    "LANGMATCHES": _lang_matches,
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _mapped(F.abs, F.abs),
    "CEIL": _mapped(F.ceil, F.ceil),
    "FLOOR": _mapped(F.floor, F.floor),
    "ROUND": _mapped(lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")), lambda x: F.floor(x + 0.5)),
    "RAND": lambda: Number(number(F.lit(DOUBLE), F.lit(None).cast(EXACT), F.rand())),
    "YEAR": _part(r"^(-?\d{4,})-"),
    "MONTH": _part(r"^-?\d{4,}-(\d\d)"),
    "DAY": _part(r"^-?\d{4,}-\d\d-(\d\d)"),
    "HOURS": _part(r"T(\d\d):"),
    "MINUTES": _part(r"T\d\d:(\d\d):"),
    "SECONDS": _seconds,
    "TIMEZONE": _timezone,
    "TZ": lambda a: Text(text(_zone(a))),
    "NOW": lambda: Text(text(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(f"^^<{XSD}dateTime>"))),
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
}


_WIDE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def cast(kind: str, a: Value) -> Value | None:
    """``xsd:kind(a)``; none where there is no such cast."""
    lexical, n = F.trim(text_value(a)), number_of(a)
    truth = a.column if isinstance(a, Truth) else let(lambda t: F.when(datatype_of(t) == XSD + "boolean", text_of(t).isin("true", "1")), term_of(a))
    if kind == "string":
        return Text(text(text_value(a)))
    if kind == "boolean":
        of_text = lambda x: F.when(x.isin("true", "1"), F.lit(True)).when(x.isin("false", "0"), F.lit(False))
        return Truth(let(lambda x, m: F.coalesce(F.when(m["rank"].isNotNull(), (m["double"] != 0) & ~F.isnan(m["double"])), of_text(x)), lexical, n))
    double = lambda x, m, b: F.coalesce(m["double"], b.cast("int").cast("double"), F.when(x.rlike(_WIDE), x).try_cast("double"))
    exact = lambda x, m, b: F.coalesce(m["exact"], b.cast("int").cast(EXACT), F.when(x.rlike(_PLAIN), x).try_cast(EXACT), F.when(m["rank"].isNotNull(), m["double"].try_cast(EXACT)))
    if kind in ("double", "float"):
        rank = DOUBLE if kind == "double" else FLOAT
        return Number(let(lambda d: number(F.when(d.isNotNull(), rank), F.lit(None).cast(EXACT), d), let(double, lexical, n, truth)))
    if kind == "decimal":
        return decimal(let(exact, lexical, n, truth))
    if kind == "integer":
        fits = lambda x, m, b: F.when(m["rank"].isNotNull() | b.isNotNull() | x.rlike(r"^[+-]?\d+$"), exact(x, m, b))
        return integer(let(lambda e: F.when(e >= 0, F.floor(e)).otherwise(F.ceil(e)), let(fits, lexical, n, truth)))
    if kind in ("dateTime", "date"):

        def moment(x: Column) -> Column:
            fits = x.try_cast("timestamp").isNotNull() & x.rlike(_MOMENT)
            out = F.when(F.contains(x, F.lit("T")), x).otherwise(F.concat(x, F.lit("T00:00:00"))) if kind == "dateTime" else F.substring_index(x, "T", 1)
            return text(F.when(fits, out), F.lit(f"^^<{XSD}{kind}>"))

        return Text(let(moment, lexical))
    return None


def is_in(a: Value, others: list[Value]) -> Column:
    """Equal to any of the others; constant IRIs need no more than a look-up."""
    if others and all(isinstance(b, Fixed) and b.term.startswith("<") for b in others):
        return term_of(a).isin(*(b.term for b in others if isinstance(b, Fixed)))
    out = F.lit(False)
    for b in others:
        out = out | compare("=", a, b)
    return out
