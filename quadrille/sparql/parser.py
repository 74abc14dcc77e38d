"""SPARQL 1.1 queries to algebra, by recursive descent."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

from .. import terms
from . import algebra as A


class SparqlError(ValueError):
    pass


_NAME = r"[A-Za-z_\u00C0-\U000EFFFF][\w\u00B7\u00C0-\U000EFFFF.-]*"
_TOKEN = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{{}}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<var>[?$][\w\u00B7\u00C0-\U000EFFFF]+)
    |(?P<bnode>_:[\w\u00C0-\U000EFFFF](?:[\w.\-\u00B7\u00C0-\U000EFFFF]*[\w\-\u00C0-\U000EFFFF])?)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<pname>(?:{_NAME}?)?:(?:(?:[\w:\u00C0-\U000EFFFF]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-\u00B7\u00C0-\U000EFFFF]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-\u00B7\u00C0-\U000EFFFF]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z][A-Za-z0-9_]*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{{}}()\[\].,;=<>!+\-*/|^?])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = {
    "STR", "LANG", "LANGMATCHES", "DATATYPE", "BOUND", "IRI", "URI", "BNODE", "RAND", "ABS", "CEIL", "FLOOR", "ROUND", "CONCAT", "STRLEN",
    "UCASE", "LCASE", "ENCODE_FOR_URI", "CONTAINS", "STRSTARTS", "STRENDS", "STRBEFORE", "STRAFTER", "YEAR", "MONTH", "DAY", "HOURS",
    "MINUTES", "SECONDS", "TIMEZONE", "TZ", "NOW", "UUID", "STRUUID", "MD5", "SHA1", "SHA256", "SHA384", "SHA512", "COALESCE", "IF",
    "STRLANG", "STRDT", "SAMETERM", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "REGEX", "SUBSTR", "REPLACE",
}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        if m[3] not in _ESCAPES:
            raise SparqlError(f"unknown escape \\{m[3]}")
        return _ESCAPES[m[3]]

    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", one, text, flags=re.S)


class Parser:
    """One query text.  ``prefixes`` are known before any PREFIX of the text."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.prefixes, self.base, self.fresh = 0, dict(prefixes or {}), base, 0

    # -- tokens

    def peek(self, *texts: str) -> bool:
        kind, text = self.tokens[self.at]
        return (text.upper() if kind == "word" else text) in texts and kind in ("word", "op")

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, *texts: str) -> str:
        kind, text = self.tokens[self.at]
        if not self.take(*texts):
            raise SparqlError(f"expected {' or '.join(texts)}, found {text!r}")
        return text.upper()

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self, kind: str) -> str:
        found, text = self.tokens[self.at]
        if found != kind:
            raise SparqlError(f"expected {kind}, found {text!r}")
        self.at += 1
        return text

    # -- query forms

    def query(self) -> A.Query:
        while self.peek("BASE", "PREFIX"):
            if self.take("BASE"):
                self.base = urljoin(self.base, unescape(self.next("iri")[1:-1]))
            else:
                self.need("PREFIX")
                name = self.next("pname")
                self.prefixes[name[:-1]] = self.resolve(self.next("iri"))
        form = self.need("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        if form == "SELECT":
            out = self.select(A.Query("SELECT", A.Bgp()))
        elif form == "ASK":
            out = A.Query("ASK", A.Bgp())
            self.datasets(out)
            self.take("WHERE")
            out.pattern = self.modifiers(self.group())
        elif form == "CONSTRUCT":
            out = self.construct()
        else:
            out = self.describe()
        if self.peek("VALUES"):
            self.at += 1
            out.pattern = A.Join(out.pattern, self.values())
        if self.kind() != "end":
            raise SparqlError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def datasets(self, out: A.Query) -> None:
        while self.take("FROM"):
            named = self.take("NAMED")
            (out.named_graphs if named else out.default_graphs).append(self.iri())

    def select(self, out: A.Query) -> A.Query:
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("REDUCED")
        star, items = self.take("*"), []
        while not star and (self.kind() == "var" or self.peek("(")):
            if self.take("("):
                value = self.expression()
                self.need("AS")
                items.append((self.next("var")[1:], value))
                self.need(")")
            else:
                items.append((self.next("var")[1:], None))
        self.datasets(out)
        self.take("WHERE")
        pattern = self.group()
        out.pattern = self.modifiers(pattern, None if star else items, distinct)
        return out

    def construct(self) -> A.Query:
        out = A.Query("CONSTRUCT", A.Bgp())
        short = not self.peek("{")
        if not short:
            self.need("{")
            out.template = tuple(self.template())
            self.datasets(out)
            self.take("WHERE")
            pattern = self.group()
        else:
            self.datasets(out)
            self.need("WHERE")
            self.need("{")
            out.template = tuple(self.template())
            pattern = A.Bgp(out.template)
        out.pattern = self.modifiers(pattern)
        return out

    def template(self) -> list[A.Triple]:
        triples: list[A.Pattern | A.Triple] = []
        while not self.take("}"):
            self.triples_block(triples)
            self.take(".")
        if any(not isinstance(t, A.Triple) for t in triples):
            raise SparqlError("a template holds no property path")
        return triples

    def describe(self) -> A.Query:
        out = A.Query("DESCRIBE", A.Bgp())
        nodes: list[A.Node] = []
        star = self.take("*")
        while not star and self.kind() in ("var", "iri", "pname"):
            nodes.append(A.Var(self.next("var")[1:]) if self.kind() == "var" else self.iri())
        self.datasets(out)
        if self.take("WHERE") or self.peek("{"):
            out.pattern = self.modifiers(self.group())
        out.describe = tuple(A.Var(n) for n in sorted(visible(out.pattern))) if star else tuple(nodes)
        return out

    def modifiers(self, pattern: A.Pattern, items: list | None = None, distinct: bool = False) -> A.Pattern:
        keys: list[str] = []
        grouped = False
        if self.take("GROUP"):
            self.need("BY")
            grouped = True
            while self.kind() in ("var", "iri", "pname") or self.peek("(") or self.is_call():
                if self.kind() == "var":
                    keys.append(self.next("var")[1:])
                    continue
                if self.take("("):
                    value = self.expression()
                    name = self.next("var")[1:] if self.take("AS") else self.new_name()
                    self.need(")")
                else:
                    value, name = self.call(), self.new_name()
                pattern = A.Extend(pattern, name, value)
                keys.append(name)
        aggregates: list[tuple[str, A.Aggregate]] = []

        def lifted(e: A.Expression) -> A.Expression:
            if isinstance(e, A.Aggregate):
                for name, known in aggregates:
                    if known == e:
                        return A.Ref(name)
                aggregates.append((self.new_name(), e))
                return A.Ref(aggregates[-1][0])
            if isinstance(e, A.Call):
                return A.Call(e.name, tuple(map(lifted, e.args)))
            return e

        having = []
        if self.take("HAVING"):
            while self.peek("(") or self.is_call():
                having.append(lifted(self.bracketted() if self.peek("(") else self.call()))
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.peek("ASC", "DESC"):
                    up = self.need("ASC", "DESC") == "ASC"
                    order.append((lifted(self.bracketted()), up))
                elif self.kind() == "var":
                    order.append((A.Ref(self.next("var")[1:]), True))
                elif self.peek("(") or self.is_call():
                    order.append((lifted(self.bracketted() if self.peek("(") else self.call()), True))
                else:
                    break
        computed = [(n, lifted(v)) for n, v in items or [] if v is not None]
        if grouped or aggregates:
            pattern = A.Group(pattern, tuple(keys), tuple(aggregates))
        for h in having:
            pattern = A.Filter(h, pattern)
        for name, value in computed:
            pattern = A.Extend(pattern, name, value)
        if order:
            pattern = A.OrderBy(pattern, tuple(order))
        if items is not None:
            pattern = A.Project(pattern, tuple(n for n, _ in items))
        elif visible(pattern, hidden=True) - visible(pattern):
            pattern = A.Project(pattern, tuple(sorted(visible(pattern))))
        if distinct:
            pattern = A.Distinct(pattern)
        offset, limit = 0, None
        while self.peek("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                limit = int(self.next("number"))
            else:
                self.need("OFFSET")
                offset = int(self.next("number"))
        return A.Slice(pattern, offset, limit) if offset or limit is not None else pattern

    # -- group patterns

    def group(self) -> A.Pattern:
        self.need("{")
        if self.take("SELECT"):
            inner = self.select(A.Query("SELECT", A.Bgp())).pattern
            if self.take("VALUES"):
                inner = A.Join(inner, self.values())
            self.need("}")
            return inner
        out: A.Pattern | None = None
        filters: list[A.Expression] = []

        def add(p: A.Pattern) -> None:
            nonlocal out
            if out is None:
                out = p
            elif isinstance(out, A.Bgp) and isinstance(p, A.Bgp):
                out = A.Bgp(out.triples + p.triples)
            elif isinstance(out, A.Join) and isinstance(out.right, A.Bgp) and isinstance(p, A.Bgp):
                out = A.Join(out.left, A.Bgp(out.right.triples + p.triples))
            else:
                out = A.Join(out, p)

        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                right, condition = self.group(), None
                if isinstance(right, A.Filter):
                    right, condition = right.pattern, right.condition
                out = A.LeftJoin(out or A.Bgp(), right, condition)
            elif self.take("MINUS"):
                out = A.Minus(out or A.Bgp(), self.group())
            elif self.take("GRAPH"):
                name = A.Var(self.next("var")[1:]) if self.kind() == "var" else self.iri()
                add(A.Graph(name, self.group()))
            elif self.take("SERVICE"):
                silent = self.take("SILENT")
                if self.kind() == "var":
                    self.next("var")
                else:
                    self.iri()
                add(A.Service(self.group(), silent))
            elif self.take("BIND"):
                self.need("(")
                value = self.expression()
                self.need("AS")
                name = self.next("var")[1:]
                self.need(")")
                if out is not None and name in visible(out):
                    raise SparqlError(f"?{name} is bound before")
                out = A.Extend(out or A.Bgp(), name, value)
            elif self.take("VALUES"):
                add(self.values())
            elif self.peek("{"):
                inner = self.group()
                while self.take("UNION"):
                    inner = A.Union(inner, self.group())
                add(inner)
            else:
                found: list[A.Triple | A.Pattern] = []
                self.triples_block(found)
                plain = tuple(t for t in found if isinstance(t, A.Triple))
                if plain:
                    add(A.Bgp(plain))
                for p in found:
                    if not isinstance(p, A.Triple):
                        add(p)
        pattern = out or A.Bgp()
        if filters:
            condition = filters[0]
            for f in filters[1:]:
                condition = A.Call("&&", (condition, f))
            pattern = A.Filter(condition, pattern)
        return pattern

    def values(self) -> A.Values:
        rows = []
        single = self.kind() == "var"
        names = [self.next("var")[1:]] if single else []
        if not single:
            self.need("(")
            while not self.take(")"):
                names.append(self.next("var")[1:])
        self.need("{")
        while not self.take("}"):
            row = []
            if single:
                row.append(None if self.take("UNDEF") else self.constant())
            else:
                self.need("(")
                while not self.take(")"):
                    row.append(None if self.take("UNDEF") else self.constant())
            if len(row) != len(names):
                raise SparqlError("a row of VALUES has another number of terms than variables")
            rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    # -- triples

    def triples_block(self, out: list) -> None:
        subject = self.node(out)
        if self.peek(".", "}") and not self.property_ahead():
            return
        self.properties(subject, out)

    def property_ahead(self) -> bool:
        return self.kind() in ("var", "iri", "pname") or self.peek("A", "^", "!", "(")

    def properties(self, subject: A.Node, out: list) -> None:
        while True:
            if self.kind() == "var":
                verb: A.Node | A.Path = A.Var(self.next("var")[1:])
            else:
                verb = self.path()
            while True:
                target = self.node(out)
                if isinstance(verb, A.Step):
                    out.append(A.Triple(subject, verb.iri, target))
                elif isinstance(verb, A.Path):
                    out.append(A.PathPattern(subject, verb, target))
                else:
                    out.append(A.Triple(subject, verb, target))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if not self.property_ahead():
                return

    def node(self, out: list) -> A.Node:
        if self.kind() == "var":
            return A.Var(self.next("var")[1:])
        if self.kind() == "bnode":
            return A.Var("_:" + self.next("bnode")[2:], True)
        if self.take("["):
            blank = A.Var("_:" + self.new_name(), True)
            if not self.take("]"):
                self.properties(blank, out)
                self.need("]")
            return blank
        if self.take("("):
            members = []
            while not self.take(")"):
                members.append(self.node(out))
            tail: A.Node = terms.iri(terms.RDF + "nil")
            for member in reversed(members):
                cell = A.Var("_:" + self.new_name(), True)
                out.append(A.Triple(cell, terms.iri(terms.RDF + "first"), member))
                out.append(A.Triple(cell, terms.iri(terms.RDF + "rest"), tail))
                tail = cell
            return tail
        return self.constant()

    def path(self) -> A.Path:
        left = self.path_sequence()
        while self.take("|"):
            left = A.Alternative(left, self.path_sequence())
        return left

    def path_sequence(self) -> A.Path:
        left = self.path_element()
        while self.take("/"):
            left = A.Sequence(left, self.path_element())
        return left

    def path_element(self) -> A.Path:
        if self.take("^"):
            return A.Inverse(self.path_element())
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.take("!"):
            forward, backward = [], []
            many = self.take("(")
            while not (many and self.take(")")):
                (backward if self.take("^") else forward).append(self.verb())
                if not many:
                    break
                self.take("|")
            p = A.NotIn(tuple(forward), tuple(backward))
        else:
            p = A.Step(self.verb())
        if self.take("*"):
            return A.Repeat(p, True, True)
        if self.take("+"):
            return A.Repeat(p, False, True)
        if self.take("?"):
            return A.Repeat(p, True, False)
        return p

    def verb(self) -> str:
        return terms.TYPE if self.take("A") else self.iri()

    # -- terms

    def resolve(self, token: str) -> str:
        text = unescape(token[1:-1])
        return urljoin(self.base, text) if self.base else text

    def iri(self) -> str:
        if self.kind() == "iri":
            return terms.iri(self.resolve(self.next("iri")))
        name, _, local = self.next("pname").partition(":")
        if name not in self.prefixes:
            raise SparqlError(f"unknown prefix {name}:")
        return terms.iri(self.prefixes[name] + re.sub(r"\\(.)", r"\1", local))

    def constant(self) -> str:
        sign = "-" if self.take("-") else ("+" if self.take("+") else "")
        if self.kind() == "number":
            return terms.literal(sign + self.tokens[self.at][1].rstrip(), terms.XSD + self.number_type(self.next("number")))
        if sign:
            raise SparqlError("a sign stands before no number")
        if self.kind() == "string":
            token = self.next("string")
            quotes = 3 if token[:3] in ('"""', "'''") else 1
            text = unescape(token[quotes:-quotes])
            if self.kind() == "lang":
                return terms.literal(text, lang=self.next("lang")[1:])
            if self.take("^^"):
                return terms.literal(text, self.iri()[1:-1])
            return terms.literal(text)
        if self.peek("TRUE", "FALSE"):
            return terms.literal(self.need("TRUE", "FALSE").lower(), terms.XSD + "boolean")
        return self.iri()

    @staticmethod
    def number_type(text: str) -> str:
        return "double" if "e" in text.lower() else "decimal" if "." in text else "integer"

    def new_name(self) -> str:
        self.fresh += 1
        return f".{self.fresh}"

    # -- expressions

    def constraint(self) -> A.Expression:
        return self.bracketted() if self.peek("(") else self.call()

    def bracketted(self) -> A.Expression:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def expression(self) -> A.Expression:
        return self.binary(("||",), lambda: self.binary(("&&",), self.relation))

    def binary(self, ops: tuple[str, ...], part: Callable[[], A.Expression]) -> A.Expression:
        left = part()
        while self.peek(*ops):
            op = self.need(*ops)
            left = A.Call(op, (left, part()))
        return left

    def relation(self) -> A.Expression:
        left = self.sum()
        if self.peek("=", "!=", "<", ">", "<=", ">="):
            return A.Call(self.need("=", "!=", "<", ">", "<=", ">="), (left, self.sum()))
        negated = self.take("NOT")
        if negated or self.peek("IN"):
            self.need("IN")
            found = A.Call("IN", (left, *self.arguments()))
            return A.Call("!", (found,)) if negated else found
        return left

    def sum(self) -> A.Expression:
        return self.binary(("+", "-"), lambda: self.binary(("*", "/"), self.unary))

    def unary(self) -> A.Expression:
        if self.take("!"):
            return A.Call("!", (self.unary(),))
        if self.take("-"):
            return A.Call("negate", (self.unary(),))
        if self.take("+"):
            return self.unary()
        if self.peek("("):
            return self.bracketted()
        if self.kind() == "var":
            return A.Ref(self.next("var")[1:])
        if self.kind() in ("string", "number") or self.peek("TRUE", "FALSE"):
            return A.Const(self.constant())
        return self.call()

    def is_call(self) -> bool:
        kind, text = self.tokens[self.at]
        return kind in ("iri", "pname") or kind == "word" and text.upper() in FUNCTIONS | AGGREGATES | {"EXISTS", "NOT"}

    def arguments(self) -> tuple[A.Expression, ...]:
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        return tuple(args)

    def call(self) -> A.Expression:
        if self.take("EXISTS"):
            return A.Exists(self.group(), False)
        if self.take("NOT"):
            self.need("EXISTS")
            return A.Exists(self.group(), True)
        if self.kind() in ("iri", "pname"):
            name = self.iri()
            if self.peek("("):
                return A.Call(name, self.arguments())
            return A.Const(name)
        word = self.next("word").upper()
        if word in AGGREGATES:
            self.need("(")
            distinct = self.take("DISTINCT")
            arg = None if word == "COUNT" and self.take("*") else self.expression()
            separator = " "
            if self.take(";"):
                self.need("SEPARATOR")
                self.need("=")
                separator = terms.split(self.constant())[1]
            self.need(")")
            return A.Aggregate(word, arg, distinct, separator)
        if word not in FUNCTIONS:
            raise SparqlError(f"unknown function {word}")
        return A.Call(word, self.arguments())


def visible(p: A.Pattern, hidden: bool = False) -> set[str]:
    """Variables in scope after a pattern."""
    nodes = lambda *xs: {x.name for x in xs if isinstance(x, A.Var) and (hidden or not x.hidden)}
    if isinstance(p, A.Bgp):
        return set().union(*(nodes(t.s, t.p, t.o) for t in p.triples)) if p.triples else set()
    if isinstance(p, A.PathPattern):
        return nodes(p.s, p.o)
    if isinstance(p, (A.Join, A.LeftJoin, A.Union)):
        return visible(p.left, hidden) | visible(p.right, hidden)
    if isinstance(p, A.Minus):
        return visible(p.left, hidden)
    if isinstance(p, A.Graph):
        return visible(p.pattern, hidden) | nodes(p.name)
    if isinstance(p, A.Extend):
        return visible(p.pattern, hidden) | ({p.name} if hidden or not p.name.startswith(".") else set())
    if isinstance(p, A.Values):
        return set(p.names)
    if isinstance(p, A.Group):
        return {n for n in (*p.keys, *(n for n, _ in p.aggregates)) if hidden or not n.startswith(".")}
    if isinstance(p, A.Project):
        return set(p.names)
    return visible(p.pattern, hidden)


def parse(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> A.Query:
    return Parser(text, prefixes, base).query()
