"""Queries over the driver's tables, mapped to quads, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import Term, number_of
from .operators import catalog, closure, scan, sync, union
from .sources.access import Tables
from .sources.mapping import TableMap, subject, to_quads
from .sparql.compiler import query as sparql
from .terms import DECLARE, IMPORTS, NAMESPACE, ONTOLOGY, PREFIX, PREFIXES, SUBCLASS, TYPE, XSD, text_of

MAPS = {
    "region": TableMap("region", ("r_regionkey",), ("r_name",)),
    "nation": TableMap("nation", ("n_nationkey",), ("n_name",), {"n_regionkey": "region"}),
    "supplier": TableMap("supplier", ("s_suppkey",), ("s_name",), {"s_nationkey": "nation"}),
    "customer": TableMap("customer", ("c_custkey",), ("c_name", "c_mktsegment"), {"c_nationkey": "nation"}),
    "part": TableMap("part", ("p_partkey",), ("p_name", "p_brand", "p_type", "p_size")),
    "orders": TableMap("orders", ("o_orderkey",), ("o_orderstatus", "o_orderpriority", "o_orderdate"), {"o_custkey": "customer"}),
    "lineitem": TableMap("lineitem", ("l_orderkey", "l_linenumber"), ("l_linenumber", "l_returnflag", "l_linestatus"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, unique=False),
}
TABLES_OF_WORLD = ("nation", "region", "supplier")
PREFIX_MAP = {"c": "urn:c:", "p": "urn:p:", "g": "urn:g:", "xsd": XSD}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quads_of(spark: SparkSession, sf_dir: str, *tables: str, dataset: str = "db") -> DataFrame:
    return reduce(DataFrame.unionByName, (to_quads(table(spark, sf_dir, t), MAPS[t], dataset) for t in tables))


def tables_of(spark: SparkSession, sf_dir: str, *tables: str) -> Tables:
    """The same quads as a source that reads a column for each bound predicate."""
    return Tables([(table(spark, sf_dir, t), MAPS[t]) for t in tables])


# -- the same in SQL


def sql_subject(name: str, alias: str = "", key: tuple[str, ...] | None = None) -> str:
    at = f"{alias}." if alias else ""
    parts = " || '/' || ".join(f"CAST({at}{k} AS VARCHAR)" for k in key or MAPS[name].key)
    return f"'<urn:{name}/' || {parts} || '>'"


INTEGER_COLUMNS = {"p_size", "l_linenumber"}


def sql_object(column: str, alias: str = "") -> str:
    at = f"{alias}.{column}" if alias else column
    if column in INTEGER_COLUMNS:
        return f"'\"' || CAST({at} AS VARCHAR) || '\"^^<{XSD}integer>'"
    if column == "o_orderdate":
        return f"'\"' || strftime({at}, '%Y-%m-%dT%H:%M:%S') || '\"^^<{XSD}dateTime>'"
    return f"'\"' || {at} || '\"'"


def sql_quads(*tables: str) -> str:
    parts = []
    for name in tables:
        m, s = MAPS[name], sql_subject(name)
        row = lambda p, o, where="": f"SELECT '<urn:g:{m.table}>' AS graph, {s} AS s, '{p}' AS p, {o} AS o FROM {m.table}{where}"  # noqa: B023, E731
        parts.append(row(TYPE, f"'<urn:c:{name}>'"))
        parts += [row(f"<urn:p:{c}>", sql_object(c), f" WHERE {c} IS NOT NULL") for c in m.values]
        parts += [row(f"<urn:p:{c}>", sql_subject(t, key=(c,)), f" WHERE {c} IS NOT NULL") for c, t in m.refers.items()]
    return " UNION ALL ".join(parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


WORLD = f"WITH q AS ({sql_quads(*TABLES_OF_WORLD)}) "


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads_of(spark, sf_dir, *TABLES_OF_WORLD)


# -- scans

_SCANS = {
    "scan_all": (None, None, None),
    "scan_s": ("<urn:nation/3>", None, None),
    "scan_p": (None, "<urn:p:n_name>", None),
    "scan_o": (None, None, "<urn:region/1>"),
    "scan_sp": ("<urn:nation/3>", "<urn:p:n_name>", None),
    "scan_so": ("<urn:nation/3>", None, "<urn:c:nation>"),
    "scan_po": (None, "<urn:p:s_nationkey>", "<urn:nation/3>"),
    "scan_spo": ("<urn:nation/3>", TYPE, "<urn:c:nation>"),
}
for _name, _pattern in _SCANS.items():
    _where = " AND ".join(f"{c} = '{t}'" for c, t in zip("spo", _pattern, strict=True) if t) or "TRUE"

    def _scan(spark: SparkSession, sf_dir: str, pattern=_pattern) -> DataFrame:
        return scan.scan(world(spark, sf_dir), *pattern).select("graph", "s", "p", "o")

    _scan.__name__ = _name
    register(WORLD + f"SELECT graph, s, p, o FROM q WHERE {_where}")(_scan)


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under two datasets and one graph name, and regions."""
    return quads_of(spark, sf_dir, "nation").unionByName(quads_of(spark, sf_dir, "nation", "region", dataset="copy"))


@register(f"WITH q AS ({sql_quads('nation')}) SELECT DISTINCT s, p, o FROM q WHERE p = '<urn:p:n_name>'")
def scan_logical_dedup(spark, sf_dir):
    return scan.scan(twice(spark, sf_dir), p="<urn:p:n_name>", scope=scan.Scope(names=("<urn:g:nation>",)))


@register(f"WITH q AS ({sql_quads('nation')}) SELECT graph, s, p, o FROM q WHERE p = '<urn:p:n_name>'")
def scan_physical(spark, sf_dir):
    return scan.scan(twice(spark, sf_dir), p="<urn:p:n_name>", scope=scan.Scope(physical=(("copy", "<urn:g:nation>"),))).select("graph", "s", "p", "o")


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT count(*) AS n FROM (SELECT DISTINCT graph, s, p, o FROM q)")
def len_by_graph(spark, sf_dir):
    return scan.length(twice(spark, sf_dir))


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM q)")
def len_union_distinct(spark, sf_dir):
    return scan.triple_count(twice(spark, sf_dir))


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT count(*) AS n FROM (SELECT graph, s, p, o FROM q)")
def len_union_raw(spark, sf_dir):
    return scan.iter_triples(twice(spark, sf_dir), ["<urn:g:nation>", "<urn:g:region>"]).agg(F.count(F.lit(1)).alias("n"))


@register(WORLD + f"SELECT DISTINCT graph FROM q WHERE s = '<urn:nation/3>' AND p = '{TYPE}' AND o = '<urn:c:nation>'")
def contexts_of_triple(spark, sf_dir):
    return scan.contexts(world(spark, sf_dir), ("<urn:nation/3>", TYPE, "<urn:c:nation>"))


@register(WORLD + "SELECT DISTINCT graph FROM q")
def contexts_partial(spark, sf_dir):
    return scan.contexts(world(spark, sf_dir), ("<urn:nation/3>", None, None))


@register(WORLD + "SELECT DISTINCT graph FROM q WHERE o = '<urn:nation/3>'")
def names_containing(spark, sf_dir):
    return scan.names_containing(world(spark, sf_dir), o="<urn:nation/3>")


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT s, p, o, string_agg(DISTINCT graph, ',' ORDER BY graph) AS graphs FROM q WHERE p = '{TYPE}' GROUP BY s, p, o")
def grouped_scan(spark, sf_dir):
    return scan.grouped_scan(twice(spark, sf_dir), p=TYPE).withColumn("graphs", F.array_join("graphs", ","))


@register(WORLD + "SELECT DISTINCT p FROM q WHERE s = '<urn:nation/3>'")
def distinct_predicates(spark, sf_dir):
    return scan.distinct_terms(world(spark, sf_dir), "p", s="<urn:nation/3>")


@register(WORLD + "SELECT graph, count(*) AS n FROM (SELECT DISTINCT graph, s, p, o FROM q) GROUP BY graph")
def graph_counts(spark, sf_dir):
    return scan.graph_counts(world(spark, sf_dir))


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT 'copy' AS dataset, graph, count(*) AS n_triples FROM q GROUP BY graph")
def enumerate_graphs(spark, sf_dir):
    return scan.enumerate_graphs(twice(spark, sf_dir), dataset="copy")


# -- closures


def sales_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers to nations to regions."""
    source = tables_of(spark, sf_dir, "orders", "customer", "nation")
    quads = reduce(DataFrame.unionByName, (source.scan(p=f"<urn:p:{c}>") for c in ("o_custkey", "c_nationkey", "n_regionkey")))
    return quads.select(F.col("s").alias("src"), F.col("o").alias("dst"))


SALES = f"""e(src, dst) AS (
  SELECT {sql_subject("orders")}, {sql_subject("customer", key=("o_custkey",))} FROM orders
  UNION ALL SELECT {sql_subject("customer")}, {sql_subject("nation", key=("c_nationkey",))} FROM customer
  UNION ALL SELECT {sql_subject("nation")}, {sql_subject("region", key=("n_regionkey",))} FROM nation)"""


@register(f"""WITH RECURSIVE {SALES}, r(node, depth) AS (
  SELECT '<urn:orders/1>', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
  SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def closure_chain(spark, sf_dir):
    return closure.import_closure(sales_edges(spark, sf_dir), "<urn:orders/1>")


@register(f"""WITH {SALES} SELECT '<urn:nation/3>' AS node, 0 AS depth UNION SELECT dst, 1 FROM e WHERE src = '<urn:nation/3>'""")
def closure_depth1(spark, sf_dir):
    return closure.import_closure(sales_edges(spark, sf_dir), "<urn:nation/3>", 1)


@register(f"""WITH RECURSIVE {SALES}, r(node) AS (
  SELECT src FROM e WHERE dst = '<urn:region/1>' UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r""")
def closure_reverse(spark, sf_dir):
    return closure.backward(sales_edges(spark, sf_dir), "<urn:region/1>")


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a binary tree of subclasses: k below k / 2."""
    part = table(spark, sf_dir, "part").where("p_partkey > 1")
    return part.select(
        F.lit("db").alias("dataset"), F.lit("<urn:g:tree>").alias("graph"), subject("part", F.col("p_partkey")).alias("s"), F.lit(SUBCLASS).alias("p"),
        subject("part", F.expr("p_partkey div 2")).alias("o"),
    )


TREE = "t(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1)"
_PART = "'<urn:part/' || CAST({0} AS VARCHAR) || '>'"


@register(f"WITH RECURSIVE {TREE}, r(src, dst) AS (SELECT src, dst FROM t UNION SELECT r.src, t.dst FROM r JOIN t ON t.src = r.dst) SELECT {_PART.format('src')} AS src, {_PART.format('dst')} AS dst FROM r")
def closure_tree_full(spark, sf_dir):
    return closure.transitive(closure.edges_of(part_tree(spark, sf_dir), SUBCLASS))


@register(f"WITH RECURSIVE {TREE}, r(x) AS (SELECT src FROM t WHERE dst = 3 UNION SELECT t.src FROM r JOIN t ON t.dst = r.x) SELECT {_PART.format('x')} AS x FROM r")
def path_plus_const(spark, sf_dir):
    return sparql(part_tree(spark, sf_dir), f"SELECT ?x {{ ?x {SUBCLASS}+ <urn:part/3> }}", unique=True)


@register(f"WITH RECURSIVE {TREE}, r(x) AS (SELECT 100 UNION SELECT t.dst FROM r JOIN t ON t.src = r.x) SELECT {_PART.format('x')} AS x FROM r")
def path_star_const(spark, sf_dir):
    return sparql(part_tree(spark, sf_dir), f"SELECT ?x {{ <urn:part/100> {SUBCLASS}* ?x }}", unique=True)


@register("SELECT '<urn:absent>' AS x")
def path_star_absent(spark, sf_dir):
    return sparql(part_tree(spark, sf_dir), f"SELECT ?x {{ <urn:absent> {SUBCLASS}* ?x }}")


@register(f"WITH RECURSIVE {TREE}, r(src, dst) AS (SELECT src, dst FROM t WHERE src <= 50 UNION SELECT r.src, t.dst FROM r JOIN t ON t.src = r.dst) SELECT {_PART.format('src')} AS a, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY src")
def path_plus_variables(spark, sf_dir):
    """The counts that the SQL asks for: of the path over all parts, the starts up to 50."""
    return path_plus_all(spark, sf_dir).where(F.substring_index(text_of(F.col("a")), "/", -1).cast("long") <= 50)


@register(f"WITH RECURSIVE {TREE}, r(src, dst) AS (SELECT src, dst FROM t UNION SELECT r.src, t.dst FROM r JOIN t ON t.src = r.dst) SELECT {_PART.format('src')} AS a, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY src")
def path_plus_all(spark, sf_dir):
    """A path with both ends variable over all parts."""
    found = sparql(part_tree(spark, sf_dir), f"SELECT ?a ?b {{ ?a {SUBCLASS}+ ?b }}", unique=True)
    return found.groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT {_PART.format('p_partkey')} AS a, {_PART.format('p_partkey // 4')} AS b FROM part WHERE p_partkey >= 4")
def path_sequence(spark, sf_dir):
    return sparql(part_tree(spark, sf_dir), f"SELECT ?a ?b {{ ?a {SUBCLASS}/{SUBCLASS} ?b }}", unique=True)


@register(f"SELECT {_PART.format('p_partkey')} AS a, {_PART.format('p_partkey // 2')} AS b FROM part WHERE p_partkey > 1 UNION ALL SELECT {_PART.format('p_partkey // 2')}, {_PART.format('p_partkey')} FROM part WHERE p_partkey > 1")
def path_alternative_inverse(spark, sf_dir):
    return sparql(part_tree(spark, sf_dir), f"SELECT ?a ?b {{ ?a {SUBCLASS}|^{SUBCLASS} ?b }}", unique=True)


@register(WORLD + "SELECT s AS a, o AS b FROM q WHERE p NOT IN ('<urn:p:n_name>', '<urn:p:s_name>', '<urn:p:r_name>')")
def path_negated(spark, sf_dir):
    return sparql(world(spark, sf_dir), "SELECT ?a ?b { ?a !(p:n_name|p:s_name|p:r_name) ?b }", PREFIX_MAP)


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(subject("nation", F.col("n_nationkey")).alias("src"), subject("nation", (F.col("n_nationkey") + 1) % 25).alias("dst"))


@register("SELECT '<urn:nation/' || CAST(a.n_nationkey AS VARCHAR) || '>' AS src, '<urn:nation/' || CAST(b.n_nationkey AS VARCHAR) || '>' AS dst FROM nation a CROSS JOIN nation b")
def closure_cycle(spark, sf_dir):
    return closure.transitive(ring(spark, sf_dir))


@register(f"SELECT DISTINCT {sql_subject('nation')} AS node FROM nation WHERE n_regionkey = 1")
def importers(spark, sf_dir):
    return closure.importers(sales_edges(spark, sf_dir), "<urn:region/1>")


@register("SELECT DISTINCT '<urn:nation/' || CAST(s_nationkey AS VARCHAR) || '>' AS target FROM supplier WHERE s_nationkey % 3 <> 0")
def missing_imports(spark, sf_dir):
    imports = table(spark, sf_dir, "supplier").select(subject("supplier", F.col("s_suppkey")).alias("graph"), subject("nation", F.col("s_nationkey")).alias("target"))
    known = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(subject("nation", F.col("n_nationkey")).alias("graph"))
    return closure.missing_imports(imports, known)


@register("""SELECT '<urn:supplier/' || CAST(s_suppkey AS VARCHAR) || '> <urn:nation/' || CAST(n_nationkey AS VARCHAR) || '> <urn:region/1>' AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1
  UNION ALL SELECT '<urn:nation/' || CAST(n_nationkey AS VARCHAR) || '> <urn:region/1>' FROM nation
  WHERE n_regionkey = 1 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def import_paths(spark, sf_dir):
    quads = quads_of(spark, sf_dir, "supplier", "nation")
    edges = quads.where(F.col("p").isin("<urn:p:s_nationkey>", "<urn:p:n_regionkey>")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return closure.import_paths(edges, "<urn:region/1>").select(F.array_join("path", " ").alias("path"))


# -- unions


def nation_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each nation: its triples, its declaration, an import of the next nation, and a prefix declaration of its region."""
    n = table(spark, sf_dir, "nation")
    own = subject("nation", F.col("n_nationkey"))
    node = F.concat(F.lit("_:d"), F.col("n_nationkey").cast("string"))
    region = F.col("n_regionkey").cast("string")
    parts = (
        (own, TYPE, F.lit(ONTOLOGY)),
        (own, IMPORTS, subject("nation", (F.col("n_nationkey") + 1) % 25)),
        (own, "<urn:p:n_name>", F.concat(F.lit('"'), "n_name", F.lit('"'))),
        (own, PREFIXES, own),
        (own, DECLARE, node),
        (node, PREFIX, F.concat(F.lit('"r'), region, F.lit('"'))),
        (node, NAMESPACE, F.concat(F.lit('"urn:r'), region, F.lit('"'))),
        (F.lit("<urn:shared>"), TYPE, F.lit("<urn:c:shared>")),
    )
    rows = F.array(*(F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in parts))
    return n.select(F.lit("db").alias("dataset"), own.alias("graph"), F.inline(rows))


MEMBERS = [f"<urn:nation/{k}>" for k in range(8)]
ROOT = MEMBERS[0]
_N = sql_subject("nation")
_FEW = "FROM nation WHERE n_nationkey < 8"
_BODY = f"""SELECT {_N} AS s, '<urn:p:n_name>' AS p, '"' || n_name || '"' AS o {_FEW}
  UNION SELECT '_:d' || CAST(n_nationkey AS VARCHAR), '{PREFIX}', '"r' || CAST(n_regionkey AS VARCHAR) || '"' {_FEW}
  UNION SELECT '_:d' || CAST(n_nationkey AS VARCHAR), '{NAMESPACE}', '"urn:r' || CAST(n_regionkey AS VARCHAR) || '"' {_FEW}
  UNION SELECT '<urn:shared>', '{TYPE}', '<urn:c:shared>' UNION SELECT '{ROOT}', '{TYPE}', '{ONTOLOGY}'"""
_IMPORT = f"SELECT {_N} AS s, '{IMPORTS}' AS p, '<urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '>' AS o {_FEW}"
_POINTED = f"""SELECT {_N} AS s, '{PREFIXES}' AS p, '{ROOT}' AS o {_FEW}
  UNION SELECT '{ROOT}', '{DECLARE}', '_:d' || CAST(n_nationkey AS VARCHAR) FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k {_FEW}) WHERE k = 1"""
_LEFT_ALONE = f"SELECT {_N} AS s, '{PREFIXES}' AS p, {_N} AS o {_FEW} UNION SELECT {_N}, '{DECLARE}', '_:d' || CAST(n_nationkey AS VARCHAR) {_FEW}"


@register(f"SELECT DISTINCT s, p, o FROM ({_BODY} UNION SELECT * FROM ({_IMPORT}) WHERE o NOT IN ({', '.join(repr(m) for m in MEMBERS)}) UNION {_POINTED})")
def union_normalized(spark, sf_dir):
    return union.normalized_union(nation_graphs(spark, sf_dir), MEMBERS, ROOT)


@register(f"SELECT DISTINCT s, p, o FROM ({_BODY} UNION {_IMPORT} UNION {_LEFT_ALONE})")
def union_keep_imports(spark, sf_dir):
    return union.normalized_union(nation_graphs(spark, sf_dir), MEMBERS, ROOT, rewrite_prefixes=False, remove_imports=False)


@register(f"SELECT s, o FROM ({_POINTED}) WHERE p = '{DECLARE}'")
def prefix_consolidation(spark, sf_dir):
    chosen, _ = union.union_graphs(nation_graphs(spark, sf_dir), MEMBERS)
    return union.consolidate_prefixes(chosen.select("s", "p", "o"), ROOT).where(F.col("p") == DECLARE).select("s", "o")


@register(f"""SELECT DISTINCT CASE WHEN s = '<urn:nation/3>' THEN '<urn:new>' ELSE s END AS s, p, CASE WHEN o = '<urn:nation/3>' THEN '<urn:new>' ELSE o END AS o FROM
  (SELECT {_N} AS s, '{TYPE}' AS p, '{ONTOLOGY}' AS o {_FEW} UNION {_IMPORT})""")
def rename_graph(spark, sf_dir):
    chosen, _ = union.union_graphs(nation_graphs(spark, sf_dir), MEMBERS)
    wanted = chosen.where(F.col("p").isin(TYPE, IMPORTS) & (F.col("s") != "<urn:shared>")).select("s", "p", "o")
    return union.rename(wanted, "<urn:nation/3>", "<urn:new>")


@register(f"SELECT DISTINCT s, o FROM (SELECT '{ROOT}' AS s, {_N} AS o {_FEW} AND n_nationkey > 0)")
def import_graph_imports(spark, sf_dir):
    return union.import_graph(nation_graphs(spark, sf_dir), MEMBERS, ROOT).where(F.col("p") == IMPORTS).select("s", "o")


@register("SELECT 'k' || CAST(n_regionkey AS VARCHAR) AS prefix, 'urn:n' || CAST(max(n_nationkey) AS VARCHAR) AS namespace FROM nation GROUP BY n_regionkey")
def namespaces_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    maps = n.select(F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("prefix"), F.concat(F.lit("urn:n"), F.col("n_nationkey").cast("string")).alias("namespace"), F.col("n_nationkey").alias("place"))
    return union.merge_namespaces(maps, F.col("place"))


@register(f"SELECT graph, s, o FROM (SELECT {_N} AS graph, {_N} AS s, '<urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '>' AS o FROM nation) WHERE o NOT IN ({', '.join(repr(m) for m in MEMBERS)})")
def strip_imports(spark, sf_dir):
    return union.strip_imports(nation_graphs(spark, sf_dir), MEMBERS).where(F.col("p") == IMPORTS).select("graph", "s", "o")


@register(f"SELECT '{ROOT}' AS graph, '{ROOT}' AS s")
def collapse_declarations(spark, sf_dir):
    return union.collapse_declarations(nation_graphs(spark, sf_dir), ROOT).where((F.col("p") == TYPE) & (F.col("o") == ONTOLOGY)).select("graph", "s")


@register(f"SELECT {_N} AS graph FROM nation WHERE n_nationkey BETWEEN 10 AND 19 AND n_nationkey <> 13")
def ontology_filter(spark, sf_dir):
    names = nation_graphs(spark, sf_dir).select("graph").distinct()
    return scan.allowed_names(names, "graph", ["nation/1[0-9]"], ["13"])


_KEPT = f"WITH a AS ({sql_quads('nation')}), b AS ({sql_quads('nation', 'region')})"


@register(_KEPT + " SELECT graph, s, p, o FROM a UNION ALL SELECT graph, s, p, o FROM b WHERE graph NOT IN (SELECT graph FROM a)")
def ingest_preserve(spark, sf_dir):
    return sync.preserved(quads_of(spark, sf_dir, "nation"), quads_of(spark, sf_dir, "nation", "region", dataset="new")).select("graph", "s", "p", "o")


@register(_KEPT + " SELECT 'new' AS dataset, graph, s, p, o FROM b")
def ingest_overwrite(spark, sf_dir):
    return sync.overwritten(quads_of(spark, sf_dir, "nation"), quads_of(spark, sf_dir, "nation", "region", dataset="new")).select("dataset", "graph", "s", "p", "o")


@register(WORLD + "SELECT DISTINCT s AS a, s AS b FROM q UNION SELECT DISTINCT o, o FROM q UNION SELECT s, o FROM q WHERE p = '<urn:p:n_regionkey>'")
def path_optional_step(spark, sf_dir):
    return sparql(world(spark, sf_dir), "SELECT ?a ?b { ?a p:n_regionkey? ?b }", PREFIX_MAP)


@register(f"""WITH e AS (SELECT {_N} AS src, '<urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '>' AS dst FROM nation)
  SELECT src, dst FROM e WHERE dst IN ({', '.join(repr(m) for m in MEMBERS)}) AND src IN ({', '.join(repr(m) for m in MEMBERS)})""")
def dependency_edges(spark, sf_dir):
    """The edges that the SQL asks for: of those among all graphs, the ones within the members."""
    return dependency_edges_all(spark, sf_dir).where(F.col("src").isin(*MEMBERS) & F.col("dst").isin(*MEMBERS))


@register(f"SELECT {_N} AS src, '<urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '>' AS dst FROM nation")
def dependency_edges_all(spark, sf_dir):
    """The imports among all graphs."""
    found = catalog.describe(nation_graphs(spark, sf_dir))
    edges, _ = catalog.dependency_edges(found.withColumn("location", F.col("graph")))
    return edges


# -- SPARQL: patterns


def _sparql(name: str, tables: tuple[str, ...], text: str, sql: str, finish: Callable[[DataFrame], DataFrame] | None = None, **options) -> None:
    """A query over mapped tables, which know that their triples are unique."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = sparql(tables_of(spark, sf_dir, *tables), text, PREFIX_MAP, **options)
        return finish(found) if finish else found

    def over_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same over quads of which each stands twice: sets are made of them as the query is run."""
        quads = quads_of(spark, sf_dir, *tables).unionByName(quads_of(spark, sf_dir, *tables, dataset="copy"))
        found = sparql(quads, text, PREFIX_MAP, **options)
        return finish(found) if finish else found

    run.__name__ = name
    register(sql)(run)
    if name in AS_SETS:
        over_copies.__name__ = f"{name}_copies"
        register(sql)(over_copies)


#: Queries that are run over repeated quads as well.
AS_SETS = {"sparql_bgp_join", "sparql_optional", "sparql_union", "sparql_exists", "sparql_minus_some", "sparql_values", "sparql_graph_var", "sparql_subselect", "sparql_construct", "sparql_count_types", "agg_count_distinct", "agg_sum_avg", "fn_term"}


def integers(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """Terms of these columns as 64-bit integers."""
    return lambda df: df.withColumns({c: number_of(Term(F.col(c)))["exact"].cast("long") for c in columns})


def doubles(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: number_of(Term(F.col(c)))["double"] for c in columns})


def T(column: str, alias: str = "") -> str:
    return sql_object(column, alias)


_O, _C, _L, _P = sql_subject("orders"), sql_subject("customer"), sql_subject("lineitem"), sql_subject("part")
_sparql("sparql_labels", ("nation",), "SELECT ?s ?l { ?s a c:nation ; p:n_name ?l } LIMIT 1000", f"SELECT {_N} AS s, {T('n_name')} AS l FROM nation")
_sparql("sparql_bgp_join", ("customer", "nation", "region"), 'SELECT ?c ?n { ?c p:c_nationkey ?k ; p:c_mktsegment "BUILDING" . ?k p:n_name ?n ; p:n_regionkey ?r . ?r p:r_name "ASIA" }',
        f"SELECT {_C} AS c, {T('n_name')} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' AND r_name = 'ASIA'")
_sparql("sparql_optional", ("customer", "orders"), 'SELECT ?c ?o { ?c a c:customer OPTIONAL { ?o p:o_custkey ?c ; p:o_orderstatus "P" } }',
        f"SELECT {_C} AS c, {_O} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
_sparql("sparql_optional_filter", ("nation", "region"), "SELECT ?n ?r { ?n a c:nation ; p:n_name ?l OPTIONAL { ?n p:n_regionkey ?r FILTER(?l > 'NATION_17') } }",
        f"SELECT {_N} AS n, CASE WHEN n_name > 'NATION_17' THEN {sql_subject('region', key=('n_regionkey',))} END AS r FROM nation")
_sparql("sparql_union", ("nation", "region"), "SELECT ?x ?n ?r { { ?x p:n_name ?n } UNION { ?x p:r_name ?r } }",
        f"SELECT {_N} AS x, {T('n_name')} AS n, NULL AS r FROM nation UNION ALL SELECT {sql_subject('region')}, NULL, {T('r_name')} FROM region")
_sparql("sparql_minus", ("customer", "orders"), "SELECT ?c { ?c a c:customer MINUS { ?o p:o_custkey ?c } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_sparql("sparql_exists", ("customer", "orders"), 'SELECT ?c { ?c a c:customer FILTER EXISTS { ?o p:o_custkey ?c ; p:o_orderstatus "F" } }',
        f"SELECT {_C} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_sparql("sparql_not_exists", ("customer", "orders"), "SELECT ?c { ?c a c:customer FILTER NOT EXISTS { ?o p:o_custkey ?c } }", f"SELECT {_C} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sparql("sparql_values", ("nation",), 'SELECT ?n ?tag { VALUES (?l ?tag) { ("NATION_3" 1) ("NATION_9" 2) (UNDEF 3) } ?n p:n_name ?l }',
        f"SELECT {_N} AS n, '\"' || CAST(t AS VARCHAR) || '\"^^<{XSD}integer>' AS tag FROM nation JOIN (VALUES ('NATION_3', 1), ('NATION_9', 2), (NULL, 3)) v(l, t) ON v.l IS NULL OR v.l = n_name")
_sparql("sparql_bind", ("part",), "SELECT ?p ?twice { ?p p:p_size ?s BIND(?s * 2 + 1 AS ?twice) FILTER(?twice > 60) }", f"SELECT {_P} AS p, CAST(p_size * 2 + 1 AS BIGINT) AS twice FROM part WHERE p_size * 2 + 1 > 60", integers("twice"))
_sparql("sparql_graph_var", TABLES_OF_WORLD, "SELECT ?g ?s { GRAPH ?g { ?s a ?t . ?s p:s_nationkey <urn:nation/3> } }", f"SELECT '<urn:g:supplier>' AS g, {sql_subject('supplier')} AS s FROM supplier WHERE s_nationkey = 3")
_sparql("sparql_graph_iri", TABLES_OF_WORLD, "SELECT ?s { GRAPH g:nation { ?s a ?t } }", f"SELECT {_N} AS s FROM nation")
_sparql("sparql_from", TABLES_OF_WORLD, "SELECT ?s FROM g:region { ?s a ?t }", f"SELECT {sql_subject('region')} AS s FROM region")
_sparql("sparql_subselect", ("nation", "customer"), "SELECT ?n ?k { ?n p:n_name ?l { SELECT ?n (COUNT(?c) AS ?k) { ?c p:c_nationkey ?n } GROUP BY ?n } }",
        f"SELECT {_N} AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey", integers("k"))
_sparql("sparql_ask", ("nation",), 'ASK { ?s p:n_name "NATION_3" }', "SELECT count(*) > 0 AS ask FROM nation WHERE n_name = 'NATION_3'")
_sparql("sparql_construct", ("nation",), "CONSTRUCT { ?r <urn:has> ?n . ?l <urn:bad> ?n } { ?n p:n_regionkey ?r ; p:n_name ?l }",
        f"SELECT {sql_subject('region', key=('n_regionkey',))} AS s, '<urn:has>' AS p, {_N} AS o FROM nation")
_sparql("sparql_describe", ("nation",), "DESCRIBE <urn:nation/3>", f"WITH q AS ({sql_quads('nation')}) SELECT s, p, o FROM q WHERE s = '<urn:nation/3>'")
_sparql("sparql_bindings", ("nation",), "SELECT ?n { ?n p:n_regionkey ?r }", f"SELECT {_N} AS n FROM nation WHERE n_regionkey = 2", bindings={"r": "<urn:region/2>"})
_sparql("sparql_count_types", ("orders", "lineitem"), "SELECT ?t (COUNT(*) AS ?n) { ?s a ?t } GROUP BY ?t",
        "SELECT '<urn:c:orders>' AS t, count(*) AS n FROM orders UNION ALL SELECT '<urn:c:lineitem>', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", integers("n"))

# -- SPARQL: aggregates, order, functions

_sparql("agg_count_distinct", ("lineitem",), "SELECT ?f (COUNT(DISTINCT ?o) AS ?n) { ?l p:l_returnflag ?f ; p:l_orderkey ?o } GROUP BY ?f", f"SELECT {T('l_returnflag')} AS f, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_returnflag", integers("n"))
_sparql("agg_sum_avg", ("part",), "SELECT ?b (SUM(?s) AS ?t) (AVG(?s) AS ?m) { ?p p:p_brand ?b ; p:p_size ?s } GROUP BY ?b",
        f"SELECT {T('p_brand')} AS b, CAST(sum(p_size) AS BIGINT) AS t, round(avg(p_size), 4) AS m FROM part GROUP BY p_brand", lambda df: doubles("m")(integers("t")(df)).withColumn("m", F.round("m", 4)))
_sparql("agg_min_max", ("part",), "SELECT ?b (MIN(?s) AS ?lo) (MAX(?n) AS ?hi) { ?p p:p_brand ?b ; p:p_size ?s ; p:p_name ?n } GROUP BY ?b",
        f"SELECT {T('p_brand')} AS b, min(p_size)::BIGINT AS lo, '\"' || max(p_name) || '\"' AS hi FROM part GROUP BY p_brand", integers("lo"))
_sparql("agg_sum_distinct", ("part",), "SELECT ?b (SUM(DISTINCT ?s) AS ?t) (COUNT(*) AS ?n) { ?p p:p_brand ?b ; p:p_size ?s } GROUP BY ?b",
        f"SELECT {T('p_brand')} AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS t, count(*) AS n FROM part GROUP BY p_brand", integers("t", "n"))
_sparql("agg_group_concat", ("nation",), "SELECT ?r (GROUP_CONCAT(?l; SEPARATOR='|') AS ?all) { ?n p:n_regionkey ?r ; p:n_name ?l } GROUP BY ?r",
        f"SELECT {sql_subject('region', key=('n_regionkey',))} AS r, '\"' || string_agg(n_name, '|' ORDER BY n_name) || '\"' AS all FROM nation GROUP BY n_regionkey")
_sparql("agg_sample", ("nation",), "SELECT ?r (SAMPLE(?l) AS ?one) { ?n p:n_regionkey ?r ; p:n_name ?l } GROUP BY ?r", f"SELECT {sql_subject('region', key=('n_regionkey',))} AS r, '\"' || min(n_name) || '\"' AS one FROM nation GROUP BY n_regionkey")
_sparql("having", ("customer",), "SELECT ?n (COUNT(?c) AS ?k) { ?c p:c_nationkey ?n } GROUP BY ?n HAVING(COUNT(?c) > 55)",
        f"SELECT {sql_subject('nation', key=('c_nationkey',))} AS n, count(*) AS k FROM customer GROUP BY c_nationkey HAVING count(*) > 55", integers("k"))
_sparql("implicit_group_empty", ("nation",), "SELECT (COUNT(*) AS ?n) (SUM(?x) AS ?t) { ?s <urn:none> ?x }", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t", integers("n", "t"))
_sparql("order_limit_offset", ("part",), "SELECT ?p ?s { ?p p:p_size ?s } ORDER BY DESC(?s) ?p OFFSET 5 LIMIT 20", f"SELECT p, s FROM (SELECT {_P} AS p, {T('p_size')} AS s, p_size, CAST(p_partkey AS VARCHAR) AS k FROM part) ORDER BY p_size DESC, k LIMIT 20 OFFSET 5")
_sparql("distinct_order", ("orders",), "SELECT DISTINCT ?x { ?o p:o_orderpriority ?x } ORDER BY ?x LIMIT 3", f"SELECT DISTINCT {T('o_orderpriority')} AS x FROM orders ORDER BY x LIMIT 3")
_sparql("fn_string", ("part",), "SELECT ?p (STRLEN(?n) AS ?l) (UCASE(SUBSTR(?n, 2, 4)) AS ?u) (STRBEFORE(?n, 'a') AS ?b) (STRAFTER(?n, 'a') AS ?a) (CONCAT(?n, '-', ?t) AS ?c) { ?p p:p_name ?n ; p:p_type ?t FILTER(CONTAINS(?n, 'a') && STRSTARTS(?t, 'S')) }",
        f"""SELECT {_P} AS p, CAST(length(p_name) AS BIGINT) AS l, '"' || upper(substr(p_name, 2, 4)) || '"' AS u, '"' || substr(p_name, 1, instr(p_name, 'a') - 1) || '"' AS b,
        '"' || substr(p_name, instr(p_name, 'a') + 1) || '"' AS a, '"' || p_name || '-' || p_type || '"' AS c FROM part WHERE p_name LIKE '%a%' AND p_type LIKE 'S%'""", integers("l"))  # fmt: skip
_sparql("fn_regex_replace", ("part",), "SELECT ?p (REPLACE(?t, '[AEIOU]', '_') AS ?r) { ?p p:p_type ?t FILTER(REGEX(?t, '^s', 'i')) }",
        f"""SELECT {_P} AS p, '"' || regexp_replace(p_type, '[AEIOU]', '_', 'g') || '"' AS r FROM part WHERE regexp_matches(p_type, '^[sS]')""")
_sparql("fn_numeric", ("part",), "SELECT ?p (ABS(?s - 25) AS ?a) (?s / 4 AS ?q) (FLOOR(?s / 4) AS ?f) (CEIL(?s / 4) AS ?c) (ROUND(?s / 4) AS ?r) { ?p p:p_size ?s FILTER(?s IN (1, 7, 30) || ?s * 2 >= 90) }",
        f"SELECT {_P} AS p, CAST(abs(p_size - 25) AS BIGINT) AS a, p_size / 4.0 AS q, CAST(floor(p_size / 4.0) AS BIGINT) AS f, CAST(ceil(p_size / 4.0) AS BIGINT) AS c, CAST(floor(p_size / 4.0 + 0.5) AS BIGINT) AS r FROM part WHERE p_size IN (1, 7, 30) OR p_size * 2 >= 90",
        lambda df: doubles("q")(integers("a", "f", "c", "r")(df)))
ORACLES["fn_numeric"] = ORACLES["fn_numeric"].replace("p_size / 4.0 AS q", "CAST(p_size AS DOUBLE) / 4 AS q")
_sparql("fn_date", ("orders",), "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) { ?o p:o_orderdate ?d FILTER(?d >= '1996-01-01T00:00:00'^^xsd:dateTime && ?d < '1996-02-01T00:00:00'^^xsd:dateTime) }",
        f"SELECT {_O} AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k, hour(o_orderdate) AS h FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'", integers("y", "m", "k", "h"))
_sparql("fn_hash", ("nation",), "SELECT ?n (MD5(?l) AS ?a) (SHA256(?l) AS ?b) { ?n p:n_name ?l }", f"SELECT {_N} AS n, '\"' || md5(n_name) || '\"' AS a, '\"' || sha256(n_name) || '\"' AS b FROM nation")
_sparql("fn_term", ("nation",), "SELECT ?n (STR(?n) AS ?i) (DATATYPE(?l) AS ?d) (IF(ISIRI(?r), 'iri', 'no') AS ?k) (COALESCE(?none, ?l) AS ?v) (BOUND(?none) AS ?b) (STRLANG(?l, 'en') AS ?e) (xsd:integer(STRAFTER(STR(?n), '/')) AS ?key) { ?n p:n_name ?l ; p:n_regionkey ?r }",
        f"""SELECT {_N} AS n, '"urn:nation/' || CAST(n_nationkey AS VARCHAR) || '"' AS i, '<{XSD}string>' AS d, '"iri"' AS k, {T('n_name')} AS v, '"false"^^<{XSD}boolean>' AS b, {T('n_name')} || '@en' AS e, CAST(n_nationkey AS BIGINT) AS key FROM nation""", integers("key"))


# -- SPARQL: what the queries above leave out

_STATUS = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"
_sparql("sparql_minus_some", ("customer", "orders"), 'SELECT ?c { ?c a c:customer MINUS { ?o p:o_custkey ?c ; p:o_orderstatus "P" } }', f"SELECT {_C} AS c FROM customer WHERE c_custkey NOT IN ({_STATUS})")
_sparql("sparql_not_exists_some", ("customer", "orders"), 'SELECT ?c { ?c a c:customer FILTER NOT EXISTS { ?o p:o_custkey ?c ; p:o_orderstatus "P" } }', f"SELECT {_C} AS c FROM customer WHERE c_custkey NOT IN ({_STATUS})")
_sparql("sparql_minus_unbound", ("nation", "region"), "SELECT ?n { ?n a c:nation OPTIONAL { ?n p:n_regionkey ?r . ?r p:r_name ?l FILTER(?l < 'B') } MINUS { ?r p:r_name 'AMERICA' } }",
        f"SELECT {_N} AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AMERICA'")
_sparql("sparql_join_unbound", ("nation", "region"), "SELECT ?n ?r ?l { { ?n a c:nation OPTIONAL { ?n p:n_regionkey ?r FILTER(?n = <urn:nation/1>) } } { ?n p:n_name ?x . ?r p:r_name ?l FILTER(?x < 'NATION_2') } }",
        f"SELECT {_N} AS n, {sql_subject('region')} AS r, {T('r_name')} AS l FROM nation CROSS JOIN region WHERE n_name < 'NATION_2' AND (n_nationkey <> 1 OR n_regionkey = r_regionkey)")
_sparql("sparql_optional_exists", ("nation", "supplier"), "SELECT ?n ?l { ?n a c:nation OPTIONAL { ?n p:n_name ?l FILTER EXISTS { ?s p:s_nationkey ?n } } }",
        f"SELECT {_N} AS n, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN {T('n_name')} END AS l FROM nation")
_sparql("sparql_exists_or", ("nation", "supplier"), "SELECT ?n { ?n p:n_name ?l FILTER(EXISTS { ?s p:s_nationkey ?n } || ?l < 'NATION_15') }", f"SELECT {_N} AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) OR n_name < 'NATION_15'")
_sparql("sparql_from_named", TABLES_OF_WORLD, "SELECT ?g ?s FROM NAMED g:region FROM NAMED g:nation { GRAPH ?g { ?s a ?t } }", f"SELECT '<urn:g:nation>' AS g, {_N} AS s FROM nation UNION ALL SELECT '<urn:g:region>', {sql_subject('region')} FROM region")
_sparql("sparql_dataset_selection", TABLES_OF_WORLD, "SELECT ?s ?t { ?s a ?t }", f"SELECT {sql_subject('region')} AS s, '<urn:c:region>' AS t FROM region", default_graphs=["<urn:g:region>"], named_graphs=["<urn:g:region>"])
_sparql("sparql_service_silent", ("region",), "SELECT ?s { ?s a c:region SERVICE SILENT <urn:elsewhere> { ?s ?p ?o } }", f"SELECT {sql_subject('region')} AS s FROM region")
_sparql("sparql_custom_function", ("region",), "SELECT ?s (<urn:f:shout>(?l) AS ?x) { ?s p:r_name ?l }", f"SELECT {sql_subject('region')} AS s, '\"' || r_name || '!\"' AS x FROM region", functions={"<urn:f:shout>": lambda term: F.concat(F.substring(term, F.lit(1), F.length(term) - 1), F.lit('!"'))})
_sparql("agg_group_concat_distinct", ("part",), "SELECT ?s (GROUP_CONCAT(DISTINCT ?b; SEPARATOR=',') AS ?all) { ?p p:p_size ?s ; p:p_brand ?b } GROUP BY ?s", f"SELECT {T('p_size')} AS s, '\"' || string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) || '\"' AS all FROM part GROUP BY p_size")
_YES, _NO = (f"'\"{x}\"^^<{XSD}boolean>'" for x in ("true", "false"))
_sparql("fn_tests", ("nation",), "SELECT ?n (?l NOT IN ('NATION_3', 'NATION_9') AS ?a) (SAMETERM(?l, 'NATION_9') AS ?b) (ISBLANK(?n) AS ?c) (ISLITERAL(?l) AS ?d) (ISNUMERIC(?l) AS ?e) (ISNUMERIC(1.5) AS ?f) (LANG(STRLANG(?l, 'en')) AS ?g) (LANGMATCHES('en-GB', 'en') AS ?h) { ?n p:n_name ?l }",
        f"SELECT {_N} AS n, CASE WHEN n_name NOT IN ('NATION_3', 'NATION_9') THEN {_YES} ELSE {_NO} END AS a, CASE WHEN n_name = 'NATION_9' THEN {_YES} ELSE {_NO} END AS b, {_NO} AS c, {_YES} AS d, {_NO} AS e, {_YES} AS f, '\"en\"' AS g, {_YES} AS h FROM nation")
_sparql("fn_constructors", ("nation",), "SELECT ?n (IRI(CONCAT('urn:x/', ?l)) AS ?i) (STRDT('5', xsd:integer) AS ?d) (ISBLANK(BNODE()) AS ?b) (STRLEN(STRUUID()) AS ?u) (STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?v) (RAND() >= 0 && RAND() < 1 AS ?r) (NOW() = NOW() AS ?t) { ?n p:n_name ?l FILTER(!CONTAINS(?l, ' ')) }",
        f"SELECT {_N} AS n, '<urn:x/' || n_name || '>' AS i, '\"5\"^^<{XSD}integer>' AS d, {_YES} AS b, 36::BIGINT AS u, {_YES} AS v, {_YES} AS r, {_YES} AS t FROM nation WHERE n_name NOT LIKE '% %'", integers("u"))
_sparql("fn_encode", ("part",), "SELECT ?p (ENCODE_FOR_URI(CONCAT(?t, '*~é')) AS ?e) { ?p p:p_type ?t }", f"SELECT {_P} AS p, '\"' || replace(p_type, ' ', '%20') || '%2A~%C3%A9\"' AS e FROM part")
_sparql("fn_time_zone", ("nation",), "SELECT ?n (SECONDS(?d) AS ?s) (MINUTES(?d) AS ?m) (TZ(?d) AS ?z) (TIMEZONE(?d) AS ?o) (HOURS(?d) AS ?h) { ?n a c:nation BIND('2020-02-03T04:05:06+02:00'^^xsd:dateTime AS ?d) }",
        f"SELECT {_N} AS n, 6::BIGINT AS s, 5::BIGINT AS m, '\"+02:00\"' AS z, '\"PT2H\"^^<{XSD}dayTimeDuration>' AS o, 4::BIGINT AS h FROM nation", integers("s", "m", "h"))
_sparql("fn_hash_lengths", ("nation",), "SELECT ?n (STRLEN(SHA1(?l)) AS ?a) (STRLEN(SHA384(?l)) AS ?b) (STRLEN(SHA512(?l)) AS ?c) { ?n p:n_name ?l }", f"SELECT {_N} AS n, 40::BIGINT AS a, 96::BIGINT AS b, 128::BIGINT AS c FROM nation", integers("a", "b", "c"))
_sparql("fn_casts", ("part",), "SELECT ?p (xsd:string(?s) AS ?t) (xsd:double(STR(?s)) AS ?d) (xsd:decimal(?s) / 2 AS ?h) (xsd:boolean('true') AS ?b) (xsd:integer('x') AS ?bad) { ?p p:p_size ?s FILTER(?s - 1) }",
        f"SELECT {_P} AS p, '\"' || CAST(p_size AS VARCHAR) || '\"' AS t, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS DOUBLE) / 2 AS h, {_YES} AS b, CAST(NULL AS VARCHAR) AS bad FROM part WHERE p_size <> 1", doubles("d", "h"))


@register(f"WITH RECURSIVE {TREE}, r(x) AS (SELECT 100 UNION SELECT t.dst FROM r JOIN t ON t.src = r.x) SELECT count(*) > 0 AS up, FALSE AS down FROM r WHERE x = 3")
def path_both_constant(spark, sf_dir):
    """Whether one part lies below another, by asking for a path between two constants."""
    tree = part_tree(spark, sf_dir)
    one = lambda a, b: sparql(tree, f"ASK {{ <urn:part/{a}> {SUBCLASS}+ <urn:part/{b}> }}", unique=True)
    return one(100, 3).select(F.col("ask").alias("up")).crossJoin(one(3, 100).select(F.col("ask").alias("down")))


# -- catalog and sync


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records: each supplier is a source of its nation's name."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("urn:nation/"), F.col("s_nationkey").cast("string")).alias("name"), F.concat(F.lit("http://h/"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("location"),
        F.pmod(F.col("s_suppkey") * 7, F.lit(11)).cast("timestamp").alias("last_updated"), F.array(F.lpad(F.pmod("s_suppkey", F.lit(13)).cast("string"), 2, "0")).alias("version"),
        (F.pmod("s_suppkey", F.lit(2)) == 0).alias("is_default"),
    )


_RECORDS = """r AS (SELECT 'urn:nation/' || CAST(s_nationkey AS VARCHAR) AS name, 'http://h/' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS location,
  (s_suppkey * 7) % 11 AS updated, lpad(CAST(s_suppkey % 13 AS VARCHAR), 2, '0') AS version FROM supplier)"""


@register(f"WITH {_RECORDS} SELECT name, location FROM (SELECT name, location, row_number() OVER (PARTITION BY name ORDER BY updated DESC, location) AS k FROM r) WHERE k = 1")
def resolve_policy_latest(spark, sf_dir):
    return catalog.choose(records(spark, sf_dir), "latest").select("name", "location")


@register(f"WITH {_RECORDS} SELECT name, location FROM (SELECT name, location, row_number() OVER (PARTITION BY name ORDER BY version DESC, location) AS k FROM r) WHERE k = 1")
def resolve_policy_version(spark, sf_dir):
    return catalog.choose(records(spark, sf_dir), "version").select("name", "location")


@register(f"WITH {_RECORDS} SELECT name, min(location) AS location FROM r GROUP BY name")
def resolve_policy_default(spark, sf_dir):
    return catalog.choose(records(spark, sf_dir), "default").select("name", "location")


@register(f"WITH {_RECORDS} SELECT name, string_agg(location, ' ' ORDER BY location) AS locations FROM r GROUP BY name HAVING count(*) > 1")
def doctor_duplicates(spark, sf_dir):
    return catalog.duplicate_names(records(spark, sf_dir)).withColumn("locations", F.array_join("locations", " "))


@register("SELECT 'urn:alias/' || CAST(n_nationkey AS VARCHAR) || '#' AS asked, 'urn:nation/' || CAST(n_nationkey AS VARCHAR) AS name FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'urn:nation/' || CAST(n_nationkey AS VARCHAR) || '/', 'urn:nation/' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def alias_resolution(spark, sf_dir):
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    aliases = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("urn:alias/"), key).alias("alias"), F.concat(F.lit("urn:nation/"), key).alias("name"))
    asked = n.select(F.explode(F.array(F.concat(F.lit("urn:alias/"), key, F.lit("#")), F.concat(F.lit("urn:nation/"), key, F.lit("/")))).alias("asked"))
    return catalog.resolve_names(asked, "asked", records(spark, sf_dir), aliases).where("name IS NOT NULL").select("asked", "name")


@register("""SELECT '<urn:nation/' || CAST(n_nationkey AS VARCHAR) || '>' AS name, '<urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '>' AS imports,
  'r' || CAST(n_regionkey AS VARCHAR) || '=urn:r' || CAST(n_regionkey AS VARCHAR) AS namespaces FROM nation""")
def catalog_records(spark, sf_dir):
    found = catalog.describe(nation_graphs(spark, sf_dir))
    namespaces = F.array_join(F.transform(F.map_entries("namespace_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("name", F.array_join("imports", " ").alias("imports"), namespaces.alias("namespaces"))


@register("""SELECT graph, status FROM (SELECT CAST(n_nationkey AS VARCHAR) AS graph,
  CASE WHEN n_nationkey % 7 = 0 THEN 'added' WHEN n_nationkey % 7 = 1 THEN 'removed' WHEN n_nationkey % 7 = 2 THEN 'changed' ELSE 'unchanged' END AS status FROM nation)""")
def sync_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("graph"), "n_nationkey")
    stored = n.where("n_nationkey % 7 <> 0").select("graph", F.lit("1").alias("revision"))
    current = n.where("n_nationkey % 7 <> 1").select("graph", F.when(F.col("n_nationkey") % 7 == 2, "2").otherwise("1").alias("revision"))
    return sync.diff(stored, current)


@register("SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS location FROM nation WHERE n_nationkey % 7 IN (0, 2)")
def updated_locations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("location"), "n_nationkey")
    known = n.where("n_nationkey % 7 <> 0").select("location", F.lit("a").alias("hash"))
    listed = n.where("n_nationkey % 7 <> 1").select("location", F.when(F.col("n_nationkey") % 7 == 2, "b").otherwise("a").alias("hash"))
    return sync.updated_locations(known, listed)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: triples by predicate of the normalised union of an import closure."""
    quads = nation_graphs(spark, sf_dir)
    edges = closure.declared_imports(quads).select(F.col("graph").alias("src"), F.col("target").alias("dst"))
    members = [r["node"] for r in closure.import_closure(edges, ROOT).collect()]
    return union.normalized_union(quads, members, ROOT).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_sources  # noqa: F401  (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_sources  # noqa: F401

    return dict(ORACLES)
