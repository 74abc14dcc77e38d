"""Pattern scans over quads, with graph scopes and set semantics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPO = ["s", "p", "o"]


@dataclass(frozen=True)
class Scope:
    """All quads, some physical graphs (dataset, graph), or logical graphs by name.

    A logical graph is the set of the triples of all physical graphs of its
    name.
    """

    physical: tuple[tuple[str, str], ...] | None = None
    names: tuple[str, ...] | None = None

    def of(self, quads: DataFrame) -> DataFrame:
        if self.names is not None:
            return quads.where(F.col("graph").isin(*self.names))
        if self.physical is not None:
            wanted = F.lit(False)
            for dataset, graph in self.physical:
                wanted = wanted | ((F.col("dataset") == dataset) & (F.col("graph") == graph))
            return quads.where(wanted)
        return quads


ALL = Scope()


def matching(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Rows whose bound positions are equal; the filters reach the scan."""
    for column, term in zip(SPO, (s, p, o), strict=True):
        if term is not None:
            quads = quads.where(F.col(column) == term)
    return quads


def scan(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, scope: Scope = ALL) -> DataFrame:
    """Matches in a scope: quads as they are, or distinct triples where the scope names logical graphs."""
    found = matching(scope.of(quads), s, p, o)
    return found.select(*SPO).dropDuplicates() if scope.names is not None else found


def triple_count(quads: DataFrame, scope: Scope = ALL) -> DataFrame:
    """``n``: distinct triples of a scope."""
    return scope.of(quads).select(*SPO).distinct().agg(F.count(F.lit(1)).alias("n"))


def graph_counts(quads: DataFrame) -> DataFrame:
    """``graph, n`` of each logical graph."""
    return quads.select("graph", *SPO).distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


def length(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """``n``: triples of a graph, or the sum over all graphs, in which a triple of several graphs counts in each."""
    chosen = quads if graph is None else quads.where(F.col("graph") == graph)
    return chosen.select("graph", *SPO).distinct().agg(F.count(F.lit(1)).alias("n"))


def names_containing(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Names of the graphs with a match."""
    return matching(quads, s, p, o).select("graph").distinct()


def contexts(quads: DataFrame, triple: tuple[str | None, str | None, str | None] | None = None) -> DataFrame:
    """Graphs that hold a fully bound triple; all graphs for none, or for one that is partly bound."""
    if triple is None or None in triple:
        return quads.select("graph").distinct()
    return names_containing(quads, *triple)


def grouped_scan(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, graphs: Sequence[str] | None = None) -> DataFrame:
    """``s, p, o, graphs``: each matching triple with the sorted names of its graphs."""
    scope = ALL if graphs is None else Scope(names=tuple(graphs))
    return matching(scope.of(quads), s, p, o).groupBy(*SPO).agg(F.sort_array(F.collect_set("graph")).alias("graphs"))


def triples_in_graphs(quads: DataFrame, graphs: Sequence[str], s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Distinct matching triples of the graphs."""
    return scan(quads, s, p, o, Scope(names=tuple(graphs)))


def iter_triples(quads: DataFrame, graphs: Sequence[str]) -> DataFrame:
    """Triples of each graph, one after another: a triple of several graphs comes once for each."""
    return Scope(names=tuple(graphs)).of(quads).select("graph", *SPO).distinct().select(*SPO)


def contains(quads: DataFrame, s: str | None, p: str | None, o: str | None, graphs: Sequence[str] | None = None) -> bool:
    scope = ALL if graphs is None else Scope(names=tuple(graphs))
    return not matching(scope.of(quads), s, p, o).isEmpty()


def distinct_terms(quads: DataFrame, position: str, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Distinct subjects, predicates or objects of the matches."""
    return matching(quads, s, p, o).select(position).distinct()


def enumerate_graphs(quads: DataFrame, dataset: str | None = None, graph: str | None = None) -> DataFrame:
    """``dataset, graph, n_triples`` of the physical graphs, of a dataset or of a name."""
    if dataset is not None:
        quads = quads.where(F.col("dataset") == dataset)
    if graph is not None:
        quads = quads.where(F.col("graph") == graph)
    return quads.select("dataset", "graph", *SPO).distinct().groupBy("dataset", "graph").agg(F.count(F.lit(1)).alias("n_triples"))


def allowed_names(names: DataFrame, column: str, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    """Rows whose name no exclude pattern finds and, where there are any, some include pattern finds."""
    for pattern in excludes:
        names = names.where(~F.col(column).rlike(pattern))
    if includes:
        wanted = F.lit(False)
        for pattern in includes:
            wanted = wanted | F.col(column).rlike(pattern)
        names = names.where(wanted)
    return names
