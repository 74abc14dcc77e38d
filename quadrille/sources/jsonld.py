"""JSON-LD to statements and back.  Contexts must be inline; remote ones are an error."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

from .. import terms
from .turtle import Parsed, RdfSyntaxError


class _Context:
    def __init__(self, base: str):
        self.base, self.vocab, self.language = base, "", None
        self.terms: dict[str, dict] = {}

    def extended(self, local) -> _Context:
        out = _Context(self.base)
        out.vocab, out.language, out.terms = self.vocab, self.language, dict(self.terms)
        for part in local if isinstance(local, list) else [local]:
            if part is None:
                out = _Context(self.base)
                continue
            if isinstance(part, str):
                raise RdfSyntaxError(f"remote context {part}")
            out.base = urljoin(out.base, part["@base"]) if part.get("@base") else out.base
            out.language = part.get("@language", out.language)
            out.vocab = part.get("@vocab", out.vocab) or ""
            raw = {k: v for k, v in part.items() if not k.startswith("@")}
            for name, value in raw.items():
                out.terms[name] = {"@id": value} if isinstance(value, str) or value is None else dict(value)
            for name in raw:
                entry = out.terms[name]
                target = entry.get("@id", entry.get("@reverse", name))
                entry["iri"] = None if target is None else out.expand(target, True, {name})
        return out

    def expand(self, text: str, vocab: bool, seen: set[str] | None = None) -> str:
        """The IRI of a term, compact IRI or relative IRI; keywords stay."""
        seen = seen or set()
        if text.startswith("@"):
            return text
        if vocab and text in self.terms and text not in seen:
            entry = self.terms[text]
            return entry.get("iri") or self.expand(entry.get("@id") or text, True, seen | {text})
        prefix, colon, local = text.partition(":")
        if colon:
            if prefix == "_" or local.startswith("//"):
                return text
            if prefix in self.terms and prefix not in seen:
                return self.expand(prefix, True, seen) + local
            return text
        if vocab and self.vocab:
            return self.vocab + text
        return urljoin(self.base, text) if self.base else text


class _Reader:
    def __init__(self, scope: str):
        self.scope, self.fresh, self.out = scope, 0, Parsed()

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}g{self.fresh}"

    def resource(self, text: str, context: _Context, vocab: bool = False) -> str:
        full = context.expand(text, vocab)
        return f"_:{self.scope}{full[2:]}" if full.startswith("_:") else terms.iri(full)

    def add(self, graph: str | None, s: str, p: str, o: str | None) -> None:
        if o is not None:
            self.out.statements.append((graph, s, p, o))

    def node(self, value: dict, context: _Context, graph: str | None) -> str:
        if "@context" in value:
            context = context.extended(value["@context"])
            for name, entry in context.terms.items():
                if entry.get("iri") and re.search(r"[#/:]$", entry["iri"]):
                    self.out.prefixes[name] = entry["iri"]
        alias = {k: context.terms[k]["iri"] if k in context.terms and (context.terms[k].get("iri") or "").startswith("@") else k for k in value}
        keyed = {alias[k]: v for k, v in value.items()}
        subject = self.resource(keyed["@id"], context) if keyed.get("@id") is not None else self.blank()
        for kind in _list(keyed.get("@type")):
            self.add(graph, subject, terms.TYPE, self.resource(kind, context, True))
        for p, targets in (keyed.get("@reverse") or {}).items():
            for target in _list(targets):
                self.add(graph, self.value(target, context, {"@type": "@id"}, graph) or "", self.resource(p, context, True), subject)
        for key, targets in value.items():
            if alias[key].startswith("@"):
                continue
            entry = context.terms.get(key, {})
            verb = context.expand(key, True)
            if ":" not in verb or (key in context.terms and entry.get("@id", "") is None):
                continue
            if "@reverse" in entry:
                for target in _list(targets):
                    self.add(graph, self.value(target, context, entry | {"@type": "@id"}, graph) or "", terms.iri(verb), subject)
            elif entry.get("@container") == "@list":
                self.add(graph, subject, terms.iri(verb), self.list(_list(targets), context, entry, graph))
            elif entry.get("@container") == "@language" and isinstance(targets, dict):
                for lang, texts in targets.items():
                    for text in _list(texts):
                        self.add(graph, subject, terms.iri(verb), terms.literal(text, lang=lang))
            else:
                for target in _list(targets):
                    self.add(graph, subject, terms.iri(verb), self.value(target, context, entry, graph))
        if "@graph" in keyed:
            inner = subject if set(keyed) - {"@graph", "@context"} else graph
            for member in _list(keyed["@graph"]):
                self.node(member, context, inner)
        return subject

    def list(self, values: list, context: _Context, entry: dict, graph: str | None) -> str:
        tail = terms.iri(terms.RDF + "nil")
        for target in reversed([self.value(v, context, entry, graph) for v in values]):
            cell = self.blank()
            self.add(graph, cell, terms.iri(terms.RDF + "first"), target)
            self.add(graph, cell, terms.iri(terms.RDF + "rest"), tail)
            tail = cell
        return tail

    def value(self, value, context: _Context, entry: dict, graph: str | None) -> str | None:
        if value is None:
            return None
        if isinstance(value, dict):
            if "@list" in value:
                return self.list(_list(value["@list"]), context, entry, graph)
            if "@set" in value:
                raise RdfSyntaxError("a set stands where one value is wanted")
            if "@value" in value:
                kind = value.get("@type")
                return self.literal(value["@value"], context.expand(kind, True) if kind else None, value.get("@language"))
            return self.node(value, context, graph)
        kind = entry.get("@type")
        if isinstance(value, str) and kind in ("@id", "@vocab"):
            return self.resource(value, context, kind == "@vocab")
        datatype = context.expand(kind, True) if kind and not kind.startswith("@") else None
        lang = entry.get("@language", context.language) if isinstance(value, str) and datatype is None else None
        return self.literal(value, datatype, lang)

    @staticmethod
    def literal(value, datatype: str | None, lang: str | None) -> str:
        if isinstance(value, bool):
            return terms.literal(str(value).lower(), datatype or terms.XSD + "boolean")
        if isinstance(value, int):
            return terms.literal(str(value), datatype or terms.XSD + "integer")
        if isinstance(value, float):
            if value.is_integer() and abs(value) < 1e21 and datatype is None:
                return terms.literal(str(int(value)), terms.XSD + "integer")
            mantissa, exponent = f"{value:.15E}".split("E")
            return terms.literal(f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa and mantissa.rstrip('0')[-1] != '.' else mantissa.rstrip('0') + '0'}E{int(exponent)}", datatype or terms.XSD + "double")
        return terms.literal(str(value), datatype, lang)


def _list(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


#: What keywords may hold, outside of a context and inside one.
_SHAPES = {"@id": (str,), "@language": (str, type(None)), "@reverse": (dict,), "@graph": (dict, list), "@context": (dict, list, str, type(None))}
_CONTEXT_SHAPES = {"@vocab": (str, type(None)), "@base": (str, type(None)), "@language": (str, type(None))}


def _check(value, context: bool = False) -> None:
    """Raise where a keyword holds what it cannot hold."""
    if isinstance(value, list):
        for x in value:
            _check(x, context)
    elif isinstance(value, dict):
        for key, x in value.items():
            kinds = (_CONTEXT_SHAPES if context else _SHAPES).get(key)
            types = key == "@type" and not all(isinstance(t, str) for t in _list(x)) and not (context and isinstance(x, dict))
            term = context and not key.startswith("@") and not isinstance(x, (str, dict, type(None)))
            if kinds and not isinstance(x, kinds) or types or term:
                raise RdfSyntaxError(f"{key} holds {type(x).__name__}")
            if context and isinstance(x, dict):
                for inner in ("@id", "@type", "@reverse"):
                    if not isinstance(x.get(inner), (str, type(None))):
                        raise RdfSyntaxError(f"{inner} of {key} is no string")
            elif key == "@graph" and not all(isinstance(n, dict) for n in _list(x)):
                raise RdfSyntaxError("@graph holds something else than nodes")
            else:
                _check(x, context or key == "@context")
    elif context and not isinstance(value, (str, type(None))):
        raise RdfSyntaxError(f"a context is {type(value).__name__}")


def parse(text: str, base: str = "", scope: str = "") -> Parsed:
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise RdfSyntaxError(str(e)) from e
    reader = _Reader(scope)
    _check(data)
    for value in _list(data):
        if not isinstance(value, dict):
            raise RdfSyntaxError("no JSON-LD")
        reader.node(value, _Context(base), None)
    return reader.out


def serialize(triples) -> str:
    """Expanded JSON-LD of (s, p, o), sorted."""
    nodes: dict[str, dict] = {}
    name = lambda t: t[1:-1] if t.startswith("<") else t
    for s, p, o in sorted(set(triples)):
        node = nodes.setdefault(s, {"@id": name(s)})
        if p == terms.TYPE and not o.startswith('"'):
            node.setdefault("@type", []).append(name(o))
            continue
        kind, text, datatype, lang = terms.split(o)
        value: dict = {"@id": name(o)} if kind != "literal" else {"@value": text}
        if datatype:
            value["@type"] = datatype
        if lang:
            value["@language"] = lang
        node.setdefault(name(p), []).append(value)
    return json.dumps(list(nodes.values()), indent=2, ensure_ascii=False) + "\n"
