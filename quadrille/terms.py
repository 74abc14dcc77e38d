"""RDF terms as strings, and columns over them.

A term is one string: ``<iri>``, ``_:label`` or a literal ``"text"``,
``"text"@lang`` or ``"text"^^<datatype>``.  The text of a literal is held as it
is, without escapes; the last quote ends it, since neither a language tag nor a
datatype can hold one.  ``xsd:string`` is left out, so equal terms are equal
strings and joins need no other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
DCTERMS = "http://purl.org/dc/terms/"
VAEM = "http://www.linkedmodel.org/schema/vaem#"

QUAD_COLUMNS = ("dataset", "graph", "s", "p", "o")
QUAD_SCHEMA = "dataset string, graph string, s string, p string, o string"


def iri(text: str) -> str:
    return f"<{text}>"


def bnode(label: str) -> str:
    return label if label.startswith("_:") else f"_:{label}"


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    """A language tag goes without a datatype and is lower-cased; ``xsd:string`` is no datatype."""
    if lang:
        return f'"{text}"@{lang.lower()}'
    if datatype and datatype != XSD + "string":
        return f'"{text}"^^<{datatype}>'
    return f'"{text}"'


def split(term: str) -> tuple[str, str, str | None, str | None]:
    """Kind, text, datatype and language of a term."""
    if term.startswith("<"):
        return "iri", term[1:-1], None, None
    if term.startswith("_:"):
        return "bnode", term[2:], None, None
    end = term.rindex('"')
    text, rest = term[1:end], term[end + 1 :]
    if rest.startswith("@"):
        return "literal", text, None, rest[1:]
    return "literal", text, rest[3:-1] if rest else None, None


TYPE = iri(RDF + "type")
ONTOLOGY = iri(OWL + "Ontology")
IMPORTS = iri(OWL + "imports")
SUBCLASS = iri(RDFS + "subClassOf")
PREFIXES = iri(SH + "prefixes")
DECLARE = iri(SH + "declare")
PREFIX = iri(SH + "prefix")
NAMESPACE = iri(SH + "namespace")
VERSION_IRI = iri(OWL + "versionIRI")


def iri_of(*parts: Column | str) -> Column:
    return F.concat(F.lit("<"), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts), F.lit(">"))


def literal_of(value: Column, datatype: str | None = None) -> Column:
    tail = '"' if datatype in (None, XSD + "string") else f'"^^<{datatype}>'
    return F.concat(F.lit('"'), value.cast("string"), F.lit(tail))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<(.*)>)?$'


def text_of(term: Column) -> Column:
    """The IRI, the label or the literal's text."""
    return (
        F.when(is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2))
        .when(is_blank(term), F.substring(term, F.lit(3), F.length(term)))
        .when(is_literal(term), F.regexp_extract(term, _LITERAL, 1))
    )


def lang_of(term: Column) -> Column:
    return F.when(is_literal(term), F.regexp_extract(term, _LITERAL, 2))


def datatype_of(term: Column) -> Column:
    """The datatype's IRI as text; ``rdf:langString`` with a language and ``xsd:string`` without either; null for others than literals."""
    found = F.regexp_extract(term, _LITERAL, 3)
    plain = F.when(lang_of(term) != "", F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string"))
    return F.when(is_literal(term), F.when(found != "", found).otherwise(plain))


def quads(df: DataFrame) -> DataFrame:
    """The quad columns, each quad once in its dataset and graph."""
    return df.select(*QUAD_COLUMNS).dropDuplicates()
