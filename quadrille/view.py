"""Read-only views of graphs: patterns, queries, prefixes and serialisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import closure, scan
from .plans.lineage import checkpointed
from .sources import jsonld, rdfxml, turtle
from .sources.ntriples import to_text
from .sparql.compiler import query

SPO = ["s", "p", "o"]
#: The context that stands for triples outside of all named graphs, of which a view has none.
DEFAULT_GRAPH = "default"


class View:
    """Quads of some graphs.  With ``root`` they are one graph of that name: the triples are a set, and it is the default graph too."""

    def __init__(self, quads: DataFrame, root: str | None = None):
        if root is not None:
            quads = quads.select(*SPO).distinct().select(F.lit("view").alias("dataset"), F.lit(root).alias("graph"), *SPO)
        self.quads, self.root = quads, root
        self.prefixes: dict[str, str] = {}

    def triples(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Matches.  With no position bound each graph's triples come one after another; a bound pattern gives a set."""
        if (s, p, o) == (None, None, None):
            return self.quads.select("graph", *SPO).distinct().select(*SPO)
        return scan.matching(self.quads, s, p, o).select(*SPO).distinct()

    def grouped(self, s: str | None = None, p: str | None = None, o: str | None = None, context: str | None = None) -> DataFrame:
        """``s, p, o, graphs``: matches with the graphs that hold them, of all graphs or of one; the default graph holds nothing of its own."""
        if context == DEFAULT_GRAPH:
            return scan.grouped_scan(self.quads.limit(0), s, p, o)
        return scan.grouped_scan(self.quads, s, p, o, None if context is None else [context])

    def contexts(self, triple: tuple[str | None, str | None, str | None] | None = None) -> DataFrame:
        return scan.contexts(self.quads, triple)

    def __len__(self) -> int:
        return scan.triple_count(self.quads).first()[0]

    def __contains__(self, triple: tuple[str | None, str | None, str | None]) -> bool:
        return scan.contains(self.quads, *triple)

    def __bool__(self) -> bool:
        return not self.quads.isEmpty()

    def subjects(self, p: str | None = None, o: str | None = None) -> DataFrame:
        return scan.distinct_terms(self.quads, "s", p=p, o=o)

    def predicates(self, s: str | None = None, o: str | None = None) -> DataFrame:
        return scan.distinct_terms(self.quads, "p", s=s, o=o)

    def objects(self, s: str | None = None, p: str | None = None) -> DataFrame:
        return scan.distinct_terms(self.quads, "o", s=s, p=p)

    def closure(self, predicate: str, node: str, reverse: bool = False) -> DataFrame:
        """Nodes that a predicate leads to, or comes from, within the view."""
        edges = closure.edges_of(self.quads, predicate)
        return closure.backward(edges, node) if reverse else closure.forward(edges, node)

    def query(self, text: str, bindings: dict[str, str] | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
        return query(self.quads, text, self.prefixes | (prefixes or {}), bindings=bindings, merged=self.root is not None)

    def bind(self, prefix: str, namespace: str, override: bool = True) -> None:
        """A prefix and a namespace name each other only, where ``override`` allows it."""
        if not override and (prefix in self.prefixes or namespace in self.prefixes.values()):
            return
        self.prefixes = {p: n for p, n in self.prefixes.items() if n != namespace} | {prefix: namespace}

    def namespace(self, prefix: str) -> str | None:
        return self.prefixes.get(prefix)

    def prefix(self, namespace: str) -> str | None:
        return next((p for p, n in self.prefixes.items() if n == namespace), None)

    def refresh_from_env(self, env, mode: str = "auto") -> None:
        """The quads of an environment as they are now: ``store`` reads its store, ``copy`` takes a copy of its own, ``auto`` the store where there is one."""
        if mode not in ("auto", "store", "copy"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "store" and env.store_path() is None:
            raise ValueError("the environment has no store")
        quads = env.quads()
        self.quads = checkpointed(quads) if mode == "copy" or mode == "auto" and env.store_path() is None else quads
        self.root = None

    def add(self, *_: object) -> None:
        raise ValueError("a view cannot be changed")

    addN = remove = update = add

    def serialize(self, format: str = "turtle") -> str:
        """A text of the triples; it is made on the driver.  For large graphs write N-Triples with ``sources.ntriples``."""
        return serialize(self.triples(), format, self.prefixes)


def serialize(triples: DataFrame, format: str = "turtle", prefixes: dict[str, str] | None = None) -> str:
    if format in ("nt", "ntriples"):
        line = F.concat_ws(" ", *(to_text(F.col(c)) for c in SPO)).alias("line")
        return "".join(r["line"] + " .\n" for r in triples.select(line).distinct().orderBy("line").toLocalIterator())
    rows = [(r["s"], r["p"], r["o"]) for r in triples.select(*SPO).toLocalIterator()]
    if format == "turtle":
        return turtle.serialize(rows, prefixes)
    if format in ("xml", "rdfxml"):
        return rdfxml.serialize(rows)
    if format in ("json-ld", "jsonld"):
        return jsonld.serialize(rows)
    raise ValueError(f"unknown format {format!r}")


def union_view(quads: DataFrame, graphs: Sequence[str]) -> View:
    return View(quads.where(F.col("graph").isin(*graphs)))
