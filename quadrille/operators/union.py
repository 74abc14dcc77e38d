"""Normalising union of named graphs: strip imports, collapse declarations, consolidate prefixes, rename, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.local import local_frame
from ..terms import DECLARE, IMPORTS, NAMESPACE, ONTOLOGY, PREFIX, PREFIXES, TYPE, VERSION_IRI, is_iri, is_literal, text_of

SPO = ["s", "p", "o"]


class PrefixConflict(ValueError):
    """One prefix is declared with different namespaces."""


def union_graphs(quads: DataFrame, graphs: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Quads of the graphs, under their names, and the names that are missing."""
    chosen = quads.where(F.col("graph").isin(*graphs))
    there = {r["graph"] for r in chosen.select("graph").distinct().collect()}
    return chosen, [g for g in graphs if g not in there]


def strip_imports(triples: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """Without import statements of the targets, or of any IRI; those of other terms stay."""
    gone = (F.col("p") == IMPORTS) & (is_iri(F.col("o")) if targets is None else F.col("o").isin(*targets))
    return triples.where(~gone)


def collapse_declarations(triples: DataFrame, root: str) -> DataFrame:
    """Without ontology declarations of other subjects than the root."""
    return triples.where(~((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY) & (F.col("s") != root)))


def declare_root(triples: DataFrame, root: str) -> DataFrame:
    row = local_frame(triples.sparkSession, [(root, TYPE, ONTOLOGY)], "s string, p string, o string")
    return triples.select(*SPO).unionByName(row).distinct()


def rename(triples: DataFrame, old: str, new: str) -> DataFrame:
    """A graph's IRI as subject and object; predicates, and objects of ``owl:versionIRI``, stay."""
    s = F.when(F.col("s") == old, F.lit(new)).otherwise(F.col("s"))
    o = F.when((F.col("o") == old) & (F.col("p") != VERSION_IRI), F.lit(new)).otherwise(F.col("o"))
    return triples.withColumns({"s": s, "o": o}).dropDuplicates()


def declarations(triples: DataFrame) -> DataFrame:
    """``s, o, prefix, namespace`` of ``sh:declare`` statements; what cannot be read is null.

    A prefix is a literal, a namespace a literal or an IRI; of several the
    least counts.
    """
    declared = triples.where(F.col("p") == DECLARE).select("s", "o").distinct()
    prefix = triples.where((F.col("p") == PREFIX) & is_literal(F.col("o"))).groupBy("s").agg(F.min(text_of(F.col("o"))).alias("prefix"))
    namespace = triples.where((F.col("p") == NAMESPACE) & (is_literal(F.col("o")) | is_iri(F.col("o")))).groupBy("s").agg(F.min(text_of(F.col("o"))).alias("namespace"))
    joined = declared.join(prefix.withColumnRenamed("s", "o"), "o", "left").join(namespace.withColumnRenamed("s", "o"), "o", "left")
    return joined.select("s", "o", "prefix", "namespace")


def check_prefixes(triples: DataFrame) -> None:
    """Raise ``PrefixConflict`` where a prefix has two namespaces; only the first conflict comes to the driver."""
    clash = declarations(triples).where(F.col("prefix").isNotNull() & F.col("namespace").isNotNull()).groupBy("prefix").agg(F.min("namespace").alias("a"), F.max("namespace").alias("b")).where("a <> b")
    for row in clash.orderBy("prefix").limit(1).collect():
        raise PrefixConflict(f"prefix {row['prefix']!r} is declared as {row['a']!r} and as {row['b']!r}; declare it once, or leave prefixes as they are")


def consolidate_prefixes(triples: DataFrame, root: str, check: bool = True) -> DataFrame:
    """All ``sh:prefixes`` point to the root, and declarations are the root's, each (prefix, namespace) once.

    The root's own declarations come first, then those of others in order of
    subject and node; one that cannot be read is always moved.
    """
    if check:
        check_prefixes(triples)
    rows = triples.select(*SPO)
    kept = rows.where(F.col("p") != DECLARE)
    pointed = kept.withColumn("o", F.when(F.col("p") == PREFIXES, F.lit(root)).otherwise(F.col("o")))
    rank = F.row_number().over(W.partitionBy("prefix", "namespace").orderBy((F.col("s") != root).cast("int"), "s", "o"))
    ranked = declarations(rows).withColumn("rank", rank)
    moved = ranked.where((F.col("s") == root) | (F.col("rank") == 1) | F.col("prefix").isNull() | F.col("namespace").isNull())
    return pointed.unionByName(moved.select(F.lit(root).alias("s"), F.lit(DECLARE).alias("p"), "o")).distinct()


def normalized_union(quads: DataFrame, graphs: Sequence[str], root: str, rewrite_prefixes: bool = True, remove_imports: bool = True, strict: bool = False) -> DataFrame:
    """``s, p, o`` of the graphs as one graph of the root.

    Prefixes are consolidated, imports of the graphs in the union stripped,
    declarations collapsed always, and the root declared.  No graphs are an
    error; missing ones are an error if ``strict``, and else left out.
    """
    if not graphs:
        raise ValueError("a union needs at least one graph")
    chosen, missing = union_graphs(quads, graphs)
    if strict and missing:
        raise KeyError(f"graphs are missing: {', '.join(missing)}")
    triples = chosen.select(*SPO).distinct()
    if rewrite_prefixes:
        triples = consolidate_prefixes(triples, root)
    if remove_imports:
        triples = strip_imports(triples, graphs)
    return declare_root(collapse_declarations(triples, root), root)


def import_graph(quads: DataFrame, members: Sequence[str], root: str) -> DataFrame:
    """The closure ``members`` flattened into the root, which then imports every other member, and what the members import of them."""
    flat = collapse_declarations(strip_imports(consolidate_prefixes(union_graphs(quads, members)[0].select(*SPO).distinct(), root)), root)
    others = [m for m in members if m != root]
    if not others:
        return flat.distinct()
    imports = local_frame(quads.sparkSession, [(root, IMPORTS, m) for m in others], "s string, p string, o string")
    return flat.unionByName(imports).distinct()


def import_into(destination: DataFrame, quads: DataFrame, members: Sequence[str], imported: str) -> DataFrame:
    """``import_graph`` into triples that exist: their own ontology, if any, stays the root."""
    own = destination.where((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY)).agg(F.min("s")).first()[0]
    root = own or imported
    declared = destination.where((F.col("p") == IMPORTS) & is_iri(F.col("o"))).select("o")
    merged = destination.select(*SPO).unionByName(import_graph(quads, members, root)).distinct()
    flat = collapse_declarations(strip_imports(consolidate_prefixes(merged, root)), root)
    targets = declared.unionByName(local_frame(quads.sparkSession, [(m,) for m in members], "o string")).where(F.col("o") != root).distinct()
    return flat.unionByName(targets.select(F.lit(root).alias("s"), F.lit(IMPORTS).alias("p"), "o")).distinct()


def merge_namespaces(maps: DataFrame, order: Column) -> DataFrame:
    """``prefix, namespace``: of the rows with a prefix the last in the order wins, then the greatest namespace."""
    last = F.max_by("namespace", F.struct(order.alias("o"), F.col("namespace").alias("n")))
    return maps.groupBy("prefix").agg(last.alias("namespace"))
