"""Catalog of graphs: records from quads, name resolution by aliases and policies, and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from ..terms import DCTERMS, DECLARE, IMPORTS, NAMESPACE, ONTOLOGY, OWL, PREFIX, RDFS, TYPE, VAEM, is_blank, is_iri, text_of
from .union import declarations

# The properties that tell a graph's version, in order of weight.
VERSION_PROPERTIES = (
    OWL + "versionInfo",
    OWL + "versionIRI",
    RDFS + "isDefinedBy",
    RDFS + "seeAlso",
    DCTERMS + "created",
    DCTERMS + "modified",
    DCTERMS + "hasVersion",
    RDFS + "label",
    DCTERMS + "title",
    VAEM + "revision",
)
HAS_METADATA = f"<{VAEM}hasGraphMetadata>"
KEYS = ["name", "location"]


class NoDeclaration(ValueError):
    """A graph names no ontology, or names it by a blank node."""


def normal_name(name: Column) -> Column:
    """A name without the number signs at its end, and then without the slashes."""
    return F.regexp_replace(F.regexp_replace(name, "#+$", ""), "/+$", "")


def declaration_counts(quads: DataFrame) -> DataFrame:
    """``graph, n``: declared ontologies of every graph."""
    declares = F.when((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY), F.col("s"))
    return quads.groupBy("graph").agg(F.count_distinct(declares).alias("n"))


def subjects(quads: DataFrame) -> DataFrame:
    """``graph, subject``: the least declared ontology of a graph, or else the least subject of a prefix declaration, or else the graph's own name."""
    declared = F.when((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY), F.col("s"))
    prefixed = F.when(F.col("p") == DECLARE, F.col("s"))
    return quads.groupBy("graph").agg(F.coalesce(F.min(declared), F.min(prefixed), F.first("graph")).alias("subject"))


def check_subjects(found: DataFrame) -> None:
    for row in found.where(is_blank(F.col("subject"))).orderBy("graph").limit(1).collect():
        raise NoDeclaration(f"the ontology of {row['graph']} is a blank node")


def describe(quads: DataFrame) -> DataFrame:
    """Records ``graph, name, imports, namespace_map, version_properties, n_triples`` of all graphs.

    The quads are read twice: for the counts, and for the few statements that
    records are made of, which are written before they are joined.  A graph
    does not import itself.  Version properties stand at the ontology or, with
    precedence, at its graph metadata; of several values the least counts.  A
    prefix with several namespaces has the greatest.
    """
    counted = quads.select("graph", "s", "p", "o").distinct().groupBy("graph").agg(F.count(F.lit(1)).alias("n_triples"))
    versioned = F.col("p").isin(*(f"<{p}>" for p in VERSION_PROPERTIES))
    telling = versioned | F.col("p").isin(IMPORTS, DECLARE, PREFIX, NAMESPACE, HAS_METADATA) | ((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY))
    rows = checkpointed(quads.where(telling).select("graph", "s", "p", "o").distinct())
    root = subjects(rows)
    own = rows.join(root.withColumnRenamed("subject", "s"), ["graph", "s"]).select("graph", F.col("s").alias("subject"), "p", "o")
    imports = own.where((F.col("p") == IMPORTS) & is_iri(F.col("o")) & (F.col("o") != F.col("subject"))).groupBy("graph").agg(F.sort_array(F.collect_set("o")).alias("imports"))
    meta = own.where(F.col("p") == HAS_METADATA).select("graph", F.col("o").alias("s"))
    versions = own.where(versioned).select("graph", "p", "o", F.lit(0).alias("rank")).unionByName(rows.where(versioned).join(meta, ["graph", "s"]).select("graph", "p", "o", F.lit(1).alias("rank")))
    best = versions.groupBy("graph", "p").agg(F.min(F.struct((-F.col("rank")).alias("r"), "o")).alias("best"))
    version_map = best.groupBy("graph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(text_of(F.col("p")).alias("p"), F.col("best.o").alias("o"))))).alias("version_properties"))
    per_graph = rows.select("graph", F.struct("graph", "s").cast("string").alias("s"), "p", F.when(F.col("p") == DECLARE, F.struct("graph", "o").cast("string")).otherwise(F.col("o")).alias("o"))
    names = declarations(per_graph).where("prefix IS NOT NULL AND namespace IS NOT NULL")
    owner = per_graph.where(F.col("p") == DECLARE).select("graph", F.col("o").alias("node")).distinct()
    pairs = names.withColumnRenamed("o", "node").join(owner, "node").groupBy("graph", "prefix").agg(F.max("namespace").alias("namespace"))
    namespace_map = pairs.groupBy("graph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("prefix", "namespace")))).alias("namespace_map"))
    out = counted.join(root, "graph", "left").join(imports, "graph", "left").join(namespace_map, "graph", "left").join(version_map, "graph", "left")
    empty = F.create_map().cast("map<string,string>")
    return out.select(
        "graph", F.coalesce("subject", "graph").alias("name"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"),
        F.coalesce("namespace_map", empty).alias("namespace_map"), F.coalesce("version_properties", empty).alias("version_properties"), "n_triples",
    )


def version_vector(properties: Column) -> Column:
    """Values of the version properties in order, ``0`` where one is missing."""
    return F.array(*(F.coalesce(F.try_element_at(properties, F.lit(p)), F.lit("0")) for p in VERSION_PROPERTIES))


def _by_policy(policy: str) -> list[Column]:
    if policy == "latest":
        return [F.col("last_updated").desc_nulls_last(), *map(F.col, KEYS)]
    if policy == "version":
        return [F.col("version").desc(), *map(F.col, KEYS)]
    if policy == "default":
        return list(map(F.col, KEYS))
    raise ValueError(f"unknown policy {policy!r}")


def choose(records: DataFrame, policy: str | list[Column] = "default") -> DataFrame:
    """One record of each name: the first by (name, location), the latest, the greatest version, or the first in an order of columns; ties go by (name, location)."""
    order = _by_policy(policy) if isinstance(policy, str) else [*policy, *map(F.col, KEYS)]
    return records.withColumn("_k", F.row_number().over(W.partitionBy("name").orderBy(*order))).where("_k = 1").drop("_k")


def resolve_names(asked: DataFrame, column: str, records: DataFrame, aliases: DataFrame | None = None, policy: str | list[Column] = "default") -> DataFrame:
    """The asked rows with ``name`` and ``location`` of the record that aliases (alias, name), or else names, give; null where none does."""
    known = choose(records, policy).select("name", "location").withColumn("_n", normal_name(F.col("name")))
    rows = asked.withColumn("_asked", normal_name(F.col(column)))
    if aliases is not None:
        single = aliases.groupBy(normal_name(F.col("alias")).alias("_asked")).agg(F.min("name").alias("_target"))
        rows = rows.join(single, "_asked", "left").withColumn("_asked", F.coalesce(normal_name(F.col("_target")), "_asked")).drop("_target")
    return rows.join(known, F.col("_asked") == F.col("_n"), "left").drop("_asked", "_n")


def duplicate_names(records: DataFrame) -> DataFrame:
    """``name, locations``: names of several locations."""
    return records.groupBy("name").agg(F.sort_array(F.collect_set("location")).alias("locations")).where(F.size("locations") > 1)


def conflicting_prefixes(records: DataFrame) -> DataFrame:
    """``prefix, namespaces`` of prefixes that graphs map to several namespaces; records hold ``namespace_map``."""
    pairs = records.select(F.explode("namespace_map").alias("prefix", "namespace"))
    return pairs.groupBy("prefix").agg(F.sort_array(F.collect_set("namespace")).alias("namespaces")).where(F.size("namespaces") > 1)


def dependency_edges(records: DataFrame, aliases: DataFrame | None = None, policy: str | list[Column] = "default") -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) of the imports that resolve, and the targets (target) of those that don't."""
    imports = records.select(F.col("name").alias("src"), F.explode("imports").alias("target"))
    found = resolve_names(imports, "target", records.withColumn("location", F.coalesce("location", F.lit(""))), aliases, policy)
    return found.where(F.col("name").isNotNull()).select("src", F.col("name").alias("dst")).distinct(), found.where(F.col("name").isNull()).select("target").distinct()
