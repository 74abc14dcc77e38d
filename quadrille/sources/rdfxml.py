"""RDF/XML to statements and back."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from io import StringIO
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from .. import terms
from .turtle import Parsed, RdfSyntaxError

_R = "{" + terms.RDF + "}"
_X = "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = {_R + n for n in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "bagID", "aboutEach", "aboutEachPrefix")}


class _Reader:
    def __init__(self, base: str, scope: str):
        self.base, self.scope, self.fresh, self.out = base, scope, 0, Parsed()

    def add(self, s: str, p: str, o: str) -> None:
        self.out.statements.append((None, s, p, o))

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}g{self.fresh}"

    @staticmethod
    def name(tag: str) -> str:
        space, _, local = tag[1:].partition("}")
        return terms.iri(space + local)

    def iri(self, text: str, base: str) -> str:
        return terms.iri(urljoin(base, text) if base else text)

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(_X + "base", base), e.get(_X + "lang", lang)
        if _R + "about" in e.attrib:
            subject = self.iri(e.attrib[_R + "about"], base)
        elif _R + "ID" in e.attrib:
            subject = self.iri("#" + e.attrib[_R + "ID"], base)
        elif _R + "nodeID" in e.attrib:
            subject = f"_:{self.scope}{e.attrib[_R + 'nodeID']}"
        else:
            subject = self.blank()
        if e.tag != _R + "Description":
            self.add(subject, terms.TYPE, self.name(e.tag))
        self.attributes(subject, e, lang)
        item = 0
        for child in e:
            if child.tag == _R + "li":
                item += 1
                child.tag = f"{_R}_{item}"
            self.property(subject, child, base, lang)
        return subject

    def attributes(self, subject: str, e: ET.Element, lang: str | None) -> None:
        for key, value in e.attrib.items():
            if key in _SYNTAX or key.startswith(_X) or not key.startswith("{"):
                continue
            if key == _R + "type":
                self.add(subject, terms.TYPE, self.iri(value, self.base))
            else:
                self.add(subject, self.name(key), terms.literal(value, lang=lang or None))

    def property(self, subject: str, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang, verb = e.get(_X + "base", base), e.get(_X + "lang", lang), self.name(e.tag)
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            target = self.blank()
            for child in e:
                self.property(target, child, base, lang)
        elif kind == "Collection":
            target = terms.iri(terms.RDF + "nil")
            for member in reversed([self.node(child, base, lang) for child in e]):
                cell = self.blank()
                self.add(cell, terms.iri(terms.RDF + "first"), member)
                self.add(cell, terms.iri(terms.RDF + "rest"), target)
                target = cell
        elif kind is not None:
            inner = (e.text or "") + "".join(ET.tostring(child, encoding="unicode") for child in e)
            target = terms.literal(inner, terms.RDF + "XMLLiteral")
        elif len(e):
            target = self.node(e[0], base, lang)
        elif _R + "resource" in e.attrib:
            target = self.iri(e.attrib[_R + "resource"], base)
            self.attributes(target, e, lang)
        elif _R + "nodeID" in e.attrib:
            target = f"_:{self.scope}{e.attrib[_R + 'nodeID']}"
            self.attributes(target, e, lang)
        elif _R + "datatype" not in e.attrib and not (e.text or "").strip() and any(k.startswith("{") and k not in _SYNTAX and not k.startswith(_X) for k in e.attrib):
            target = self.blank()
            self.attributes(target, e, lang)
        elif _R + "datatype" in e.attrib:
            target = terms.literal(e.text or "", urljoin(base, e.attrib[_R + "datatype"]))
        else:
            target = terms.literal(e.text or "", lang=lang or None)
        self.add(subject, verb, target)
        if _R + "ID" in e.attrib:
            own = self.iri("#" + e.attrib[_R + "ID"], base)
            for p, o in (("type", terms.iri(terms.RDF + "Statement")), ("subject", subject), ("predicate", verb), ("object", target)):
                self.add(own, terms.iri(terms.RDF + p), o)


def parse(text: str, base: str = "", scope: str = "") -> Parsed:
    reader = _Reader(base, scope)
    try:
        for _, (name, space) in ET.iterparse(StringIO(text), events=["start-ns"]):
            reader.out.prefixes[name] = space
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        raise RdfSyntaxError(str(e)) from e
    base, lang = root.get(_X + "base", base), root.get(_X + "lang")
    reader.base = base
    if root.tag == _R + "RDF":
        for child in root:
            reader.node(child, base, lang)
    elif root.tag.startswith("{"):
        reader.node(root, base, lang)
    else:
        raise RdfSyntaxError("no RDF/XML")
    return reader.out


def serialize(triples) -> str:
    """An RDF/XML text of (s, p, o), sorted; predicates must end in an XML name."""
    spaces: dict[str, str] = {terms.RDF: "rdf"}
    body: list[str] = []
    last = None
    for s, p, o in sorted(set(triples)):
        m = re.fullmatch(r"(.*?)([A-Za-z_][\w.-]*)", p[1:-1])
        if not m:
            raise RdfSyntaxError(f"{p} does not end in an XML name")
        tag = f"{spaces.setdefault(m[1], f'ns{len(spaces)}')}:{m[2]}"
        if s != last:
            if last is not None:
                body.append("  </rdf:Description>")
            where = f"rdf:about={quoteattr(s[1:-1])}" if s.startswith("<") else f"rdf:nodeID={quoteattr(s[2:])}"
            body.append(f"  <rdf:Description {where}>")
            last = s
        kind, text, datatype, lang = terms.split(o)
        if kind == "iri":
            body.append(f"    <{tag} rdf:resource={quoteattr(text)}/>")
        elif kind == "bnode":
            body.append(f"    <{tag} rdf:nodeID={quoteattr(text)}/>")
        else:
            more = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(datatype)}" if datatype else ""
            body.append(f"    <{tag}{more}>{escape(text)}</{tag}>")
    if last is not None:
        body.append("  </rdf:Description>")
    names = "".join(f" xmlns:{n}={quoteattr(u)}" for u, n in spaces.items())
    return "\n".join(['<?xml version="1.0" encoding="utf-8"?>', f"<rdf:RDF{names}>", *body, "</rdf:RDF>", ""])
