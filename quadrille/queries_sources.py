"""Queries through sources, sinks, stores and environments, over the driver's tables, and the same in SQL.

Documents and stores are written below the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .env import Config, Environment, MemoryGraphs
from .operators import catalog, closure, dictionary, scan, sync
from .plans.lineage import new_folder
from .queries import _BODY, _FEW, _IMPORT, _N, MEMBERS, PREFIX_MAP, ROOT, nation_graphs, quads_of, records, register, sql_object, sql_quads, sql_subject, table, world
from .sources import files, ntriples
from .sources.access import Stored
from .sources.store import ReadOnlyError, Store, StoreConflict
from .sparql.compiler import query as sparql
from .sparql.parser import SparqlError
from .streaming.watch import stream_quads
from .terms import DECLARE, IMPORTS, NAMESPACE, ONTOLOGY, PREFIX, PREFIXES, TYPE, iri
from .view import DEFAULT_GRAPH, View, union_view

_R = sql_subject("region", key=("n_regionkey",))
#: Name and region of each nation, as two triples.
PAIRS = f"SELECT {_N} AS s, '<urn:p:n_name>' AS p, {sql_object('n_name')} AS o FROM nation UNION ALL SELECT {_N}, '<urn:p:n_regionkey>', {_R} FROM nation"


def document(spark: SparkSession, sf_dir: str, head: str, line: Column, tail: str = "", between: str = "\n") -> str:
    """The folder of one text: a line for each nation between head and tail."""
    path = new_folder(spark, "document")
    rows = table(spark, sf_dir, "nation").agg(F.array_join(F.sort_array(F.collect_list(line)), between).alias("value"))
    rows.select(F.concat(F.lit(head), "value", F.lit(tail)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def _text(*parts: str) -> Column:
    """Columns by their names, everything else as it is."""
    return F.concat(*(F.col(p).cast("string") if p in ("n_name", "n_nationkey", "n_regionkey") else F.lit(p) for p in parts))


def spo(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o")


# -- sources


@register(PAIRS)
def read_turtle(spark, sf_dir):
    line = _text("<urn:nation/", "n_nationkey", '> p:n_name "', "n_name", '" ; p:n_regionkey <urn:region/', "n_regionkey", "> .")
    return spo(files.read_quads(spark, document(spark, sf_dir, "@prefix p: <urn:p:> .\n", line)))


@register(PAIRS)
def read_rdfxml(spark, sf_dir):
    head = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:p="urn:p:">'
    line = _text('<rdf:Description rdf:about="urn:nation/', "n_nationkey", '"><p:n_name>', "n_name", '</p:n_name><p:n_regionkey rdf:resource="urn:region/', "n_regionkey", '"/></rdf:Description>')
    return spo(files.read_quads(spark, document(spark, sf_dir, head, line, "</rdf:RDF>")))


@register(PAIRS)
def read_jsonld(spark, sf_dir):
    line = _text('{"@id": "urn:nation/', "n_nationkey", '", "p:n_name": "', "n_name", '", "p:n_regionkey": {"@id": "urn:region/', "n_regionkey", '"}}')
    return spo(files.read_quads(spark, document(spark, sf_dir, '{"@context": {"p": "urn:p:"}, "@graph": [', line, "]}", ",")))


@register(f"SELECT {_R} AS graph, {_N} AS s, '<urn:p:n_name>' AS p, {sql_object('n_name')} AS o FROM nation")
def read_trig(spark, sf_dir):
    line = _text("<urn:region/", "n_regionkey", "> { <urn:nation/", "n_nationkey", '> p:n_name "', "n_name", '" }')
    return files.read_quads(spark, document(spark, sf_dir, "@prefix p: <urn:p:> .\n", line), named_graphs=True).select("graph", "s", "p", "o")


_WORLD = ("nation", "region", "supplier")


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT DISTINCT s, p, o FROM q")
def read_ntriples(spark, sf_dir):
    path = new_folder(spark, "document") + "/quads"
    ntriples.write(world(spark, sf_dir), path)
    return spo(ntriples.read(spark, path)).distinct()


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT graph, s, p, o FROM q")
def read_nquads(spark, sf_dir):
    path = new_folder(spark, "document") + "/quads"
    ntriples.write(world(spark, sf_dir), path, graphs=True)
    return ntriples.read(spark, path).select("graph", "s", "p", "o")


def nation_text(spark: SparkSession, sf_dir: str, line: Column, head: str = "") -> bytes:
    return (head + "\n".join(r[0] for r in table(spark, sf_dir, "nation").select(line).collect())).encode()


@register(f"SELECT {_N} AS s, '<urn:p:n_name>' AS p, {sql_object('n_name')} AS o FROM nation")
def format_fallback(spark, sf_dir):
    """Triples in a document whose name says otherwise."""
    data = nation_text(spark, sf_dir, _text("<urn:nation/", "n_nationkey", '> <urn:p:n_name> "', "n_name", '" .'))
    return spo(files.to_frame(spark, files.parse_bytes(data, "wrong.xml"), "<urn:g>"))


@register("SELECT * FROM (VALUES ('json', 'jsonld'), ('n3', 'turtle'), ('nq', 'ntriples'), ('trig', 'trig'), ('xml', 'rdfxml'), ('text', NULL)) v(kind, format)")
def format_sniff(spark, sf_dir):
    heads = {"json": b' {"@id": "x"}', "n3": b"@prefix a: <b> .\na:x a:y a:z .", "nq": b"<a> <b> <c> <d> .", "trig": b"@prefix a: <b> .\na:g { a:x a:y a:z }", "xml": b"<?xml version='1.0'?><a/>", "text": b"hello"}
    return spark.createDataFrame([(k, files.sniff(d)) for k, d in heads.items()], "kind string, format string")


@register("SELECT DISTINCT 'r' || CAST(n_regionkey AS VARCHAR) AS prefix, 'urn:r' || CAST(n_regionkey AS VARCHAR) || ':' AS namespace FROM nation")
def prefix_scan(spark, sf_dir):
    data = nation_text(spark, sf_dir, _text("@prefix r", "n_regionkey", ": <urn:r", "n_regionkey", ":> ."))
    return spark.createDataFrame(sorted(files.parse_bytes(data, "x.ttl").prefixes.items()), "prefix string, namespace string")


@register("SELECT 'k=' || CAST(n_regionkey AS VARCHAR) AS folder FROM nation WHERE n_regionkey <> 3 GROUP BY n_regionkey")
def directory_discovery(spark, sf_dir):
    path = new_folder(spark, "tree")
    table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_name").repartition("k").write.mode("overwrite").partitionBy("k").text(path)
    return files.list_files(spark, [path], ["*.txt"], ["k=3"]).select(F.element_at(F.split("location", "/"), -2).alias("folder")).distinct()


@register("SELECT n_name AS path FROM nation WHERE (n_name LIKE 'NATION\\_1%' ESCAPE '\\' OR n_name LIKE '%7') AND n_name <> 'NATION_13'")
def path_include_test(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("/data/"), "n_name", F.lit(".ttl")).alias("path"))
    return n.where(files.included(F.col("path"), ["NATION_1*", "/data/*7.ttl"], ["NATION_13.*"])).select(F.regexp_extract("path", "/data/(.*)\\.ttl", 1).alias("path"))


@register("SELECT CAST(count(*) AS BIGINT) AS files, TRUE AS dated, FALSE AS absent FROM (SELECT 1)")
def source_probes(spark, sf_dir):
    found = files.list_files(spark, [f"{sf_dir}/nation.parquet"], [])
    here = found.limit(1).collect()[0]["location"]
    rows = [(1, (files.last_modified(here, spark=spark) or 0) > 0, files.exists(here + ".none", spark=spark))]
    return spark.createDataFrame(rows, "files long, dated boolean, absent boolean")


# -- stores


def stored(spark: SparkSession, quads: DataFrame, **options) -> Store:
    store = Store(spark, new_folder(spark, "store") + "/quads", buckets=4, **options)
    store.write(quads)
    return store


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT graph, s, p, o FROM q")
def store_write_scan(spark, sf_dir):
    store = stored(spark, world(spark, sf_dir))
    return Store(spark, store.path, integrity="strict").quads().select("graph", "s", "p", "o")


@register(f"WITH q AS ({sql_quads('nation')}) SELECT graph, s, p, o FROM q")
def store_lazy_graph(spark, sf_dir):
    return stored(spark, world(spark, sf_dir)).graph("<urn:g:nation>").select("graph", "s", "p", "o")


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT s, p, o FROM q WHERE p = '<urn:p:s_nationkey>' AND o = '<urn:nation/3>'")
def store_scan_po(spark, sf_dir):
    return spo(stored(spark, world(spark, sf_dir)).scan(p="<urn:p:s_nationkey>", o="<urn:nation/3>"))


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT graph, count(*) AS n FROM q GROUP BY graph")
def store_counts(spark, sf_dir):
    """By the counts that are stored with the quads, each of which was given twice."""
    quads = world(spark, sf_dir)
    return stored(spark, quads.unionByName(quads)).graphs().select("graph", F.col("n_triples").alias("n"))


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT graph, s, p, o FROM q WHERE graph <> '<urn:g:region>' AND (graph <> '<urn:g:nation>' OR p = '{TYPE}')")
def store_replace_graph(spark, sf_dir):
    quads = world(spark, sf_dir)
    store = stored(spark, quads)
    store.replace_graphs(quads.where(F.col("p") == TYPE), ["<urn:g:nation>"])
    store.remove_graph("<urn:g:region>")
    return store.quads().select("graph", "s", "p", "o")


@register("SELECT 2 AS version, TRUE AS refused, TRUE AS read_only, 5::BIGINT AS n")
def store_versions(spark, sf_dir):
    """Of two writers the later is refused, as is one that may only read; readers have the first one's graph."""
    store = stored(spark, quads_of(spark, sf_dir, "nation", "region"))
    began, refused, read_only = store.version(), False, False
    region = quads_of(spark, sf_dir, "region").where("p = '<urn:p:r_name>'")
    store.replace_graphs(region, ["<urn:g:region>"], began)
    try:
        Store(spark, store.path).replace_graphs(region.limit(0), ["<urn:g:region>"], began)
    except StoreConflict:
        refused = True
    try:
        Store(spark, store.path, read_only=True).remove_graph("<urn:g:region>")
    except ReadOnlyError:
        read_only = True
    return store.graph("<urn:g:region>").agg(F.count(F.lit(1)).alias("n")).select(F.lit(store.version()).alias("version"), F.lit(refused).alias("refused"), F.lit(read_only).alias("read_only"), "n")


@register(f"SELECT {_N} AS graph, 8::BIGINT AS n FROM nation WHERE n_nationkey = 7")
def store_of_one_graph(spark, sf_dir):
    """Named by what it declares."""
    store = Store(spark, new_folder(spark, "store") + "/quads")
    store.write_graph(spo(nation_graphs(spark, sf_dir).where("graph = '<urn:nation/7>'")))
    return store.graphs().select("graph", F.col("n_triples").alias("n"))


@register(f"SELECT {sql_subject('supplier')} AS s, {sql_object('n_name')} AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sparql_over_store(spark, sf_dir):
    """Patterns read the copy that is sorted by predicate and object."""
    return sparql(Stored(stored(spark, world(spark, sf_dir)), one_dataset=True), "SELECT ?s ?n { ?s p:s_nationkey ?k . ?k p:n_name ?n }", PREFIX_MAP)


@register("SELECT TRUE AS built, 'file' AS dataset, count(*) AS n_triples FROM (SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation)")
def store_command_line(spark, sf_dir):
    line = _text("<urn:nation/", "n_nationkey", '> <urn:p:n_name> "', "n_name", '" ; <urn:p:n_regionkey> <urn:region/', "n_regionkey", "> .")
    path = new_folder(spark, "store") + "/quads"
    built = cli.main(["build", path, document(spark, sf_dir, "@prefix p: <urn:p:> .\n", line)], spark) == path
    rows = [(built, r.split("\t")[0], int(r.split("\t")[2])) for r in cli.main(["stat", path], spark).split("\n")]
    return spark.createDataFrame(rows, "built boolean, dataset string, n_triples long")


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT graph, s, p, o FROM q")
def term_round_trip(spark, sf_dir):
    """Quads by number, and back by the table of terms."""
    quads = quads_of(spark, sf_dir, "nation", "region")
    return dictionary.decoded(dictionary.encoded(quads), dictionary.terms_of(quads)).select("graph", "s", "p", "o")


@register("SELECT * FROM (VALUES ('<urn:nation/3>'), ('<urn:p:n_name>')) v(term)")
def term_lookup(spark, sf_dir):
    return dictionary.lookup(dictionary.terms_of(quads_of(spark, sf_dir, "nation")), "<urn:nation/3>", "<urn:p:n_name>", "<urn:nowhere>").select("term")


# -- sinks and views


def _round_trip(name: str, format: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = View(quads_of(spark, sf_dir, "nation", "region")).serialize(format)
        return spo(files.to_frame(spark, files.parse_bytes(text.encode(), "", format if format in files.FALLBACKS else None), "<urn:g>"))

    run.__name__ = name
    register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT DISTINCT s, p, o FROM q")(run)


for _format in ("turtle", "ntriples", "rdfxml", "jsonld"):
    _round_trip(f"serialize_{_format}", _format)


@register(f"WITH q AS ({sql_quads(*_WORLD)}) SELECT s, p, o FROM q WHERE p = '<urn:p:n_regionkey>'")
def view_scan(spark, sf_dir):
    return View(quads_of(spark, sf_dir, *_WORLD).unionByName(quads_of(spark, sf_dir, *_WORLD, dataset="copy"))).triples(p="<urn:p:n_regionkey>")


@register(f"WITH q AS ({sql_quads('nation')}) SELECT count(*) AS n, TRUE AS there, FALSE AS absent FROM q")
def view_count_contains(spark, sf_dir):
    view = View(quads_of(spark, sf_dir, "nation").unionByName(quads_of(spark, sf_dir, "nation", dataset="copy")))
    return spark.createDataFrame([(len(view), ("<urn:nation/3>", None, None) in view, ("<urn:nowhere>", None, None) in view)], "n long, there boolean, absent boolean")


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT s, graph AS graphs, 0::BIGINT AS in_default FROM q WHERE p = '{TYPE}'")
def store_triples_with_contexts(spark, sf_dir):
    view = View(quads_of(spark, sf_dir, "nation", "region"))
    none = view.grouped(p=TYPE, context=DEFAULT_GRAPH).count()
    parts = [view.grouped(p=TYPE, context=f"<urn:g:{t}>") for t in ("nation", "region")]
    return parts[0].unionByName(parts[1]).select("s", F.array_join("graphs", ",").alias("graphs"), F.lit(none).cast("long").alias("in_default"))


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT DISTINCT s, p, o FROM q WHERE s = '<urn:nation/3>'")
def scoped_triples(spark, sf_dir):
    return scan.triples_in_graphs(world(spark, sf_dir), ["<urn:g:nation>", "<urn:g:region>"], s="<urn:nation/3>")


@register(f"WITH q AS ({sql_quads('nation', 'region')}) SELECT count(*) AS n, TRUE AS there, FALSE AS elsewhere FROM (SELECT DISTINCT s, p, o FROM q)")
def scoped_length_contains(spark, sf_dir):
    quads, names = world(spark, sf_dir), ["<urn:g:nation>", "<urn:g:region>"]
    there = scan.contains(quads, None, "<urn:p:n_name>", None, names)
    elsewhere = scan.contains(quads, None, "<urn:p:n_name>", None, ["<urn:g:region>"])
    return scan.triple_count(quads, scan.Scope(names=tuple(names))).select("n", F.lit(there).alias("there"), F.lit(elsewhere).alias("elsewhere"))


@register(f"SELECT {_N} AS node FROM nation")
def view_closure(spark, sf_dir):
    """Within the view; its ring leads back to where it began."""
    return View(nation_graphs(spark, sf_dir)).closure(IMPORTS, "<urn:nation/3>")


@register("SELECT '<urn:nation/' || CAST(n_nationkey AS VARCHAR) || '>' AS node FROM nation WHERE n_nationkey BETWEEN 1 AND 8")
def view_closure_scoped(spark, sf_dir):
    """A view of eight graphs follows the edges of these only."""
    return union_view(nation_graphs(spark, sf_dir), MEMBERS).closure(IMPORTS, ROOT)


# -- environments


def nation_env(spark: SparkSession, sf_dir: str, **options) -> Environment:
    """Each nation's graph as a source of its own."""
    lines = nation_graphs(spark, sf_dir).select("graph", F.concat_ws(" ", *(ntriples.to_text(F.col(c)) for c in ("s", "p", "o")), F.lit(".")).alias("line"))
    env = Environment(spark, **options)
    for r in lines.groupBy("graph").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text")).orderBy("graph").collect():
        env.add(f"memory:{r['graph'][1:-1]}", r["text"].encode(), fetch_imports=False, format="ntriples")
    return env


def names_frame(spark: SparkSession, names: list[str], column: str = "name") -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n in enumerate(names)], f"place int, {column} string")


_NAME = "'urn:nation/' || CAST(n_nationkey AS VARCHAR)"


@register(f"SELECT CAST(n_nationkey AS INTEGER) AS place, {_NAME} AS name FROM nation")
def env_list_closure(spark, sf_dir):
    return names_frame(spark, nation_env(spark, sf_dir).list_closure("urn:nation/0"))


@register(f"SELECT CAST(n_nationkey - 20 AS INTEGER) AS place, {_NAME} AS name FROM nation WHERE n_nationkey BETWEEN 21 AND 24 UNION ALL SELECT 0, 'urn:mine'")
def env_closure_of_callers_graph(spark, sf_dir):
    """What triples from outside import, to a depth of four, behind their own root."""
    mine = spark.createDataFrame([("<urn:mine>", TYPE, ONTOLOGY), ("<urn:mine>", IMPORTS, "<urn:nation/21>"), ("<urn:mine>", IMPORTS, "<urn:nowhere>")], "s string, p string, o string")
    return names_frame(spark, nation_env(spark, sf_dir).list_closure(mine, 4))


_WHOLE = f"""SELECT p, CAST(n AS BIGINT) AS n FROM (SELECT '{TYPE}' AS p, 2 AS n UNION ALL SELECT '<urn:p:n_name>', count(*) FROM nation UNION ALL SELECT '{PREFIXES}', count(*) FROM nation
  UNION ALL SELECT '{DECLARE}', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT '{PREFIX}', count(*) FROM nation UNION ALL SELECT '{NAMESPACE}', count(*) FROM nation)"""


def by_predicate(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@register(_WHOLE)
def env_copy_closure(spark, sf_dir):
    return by_predicate(nation_env(spark, sf_dir).copy_closure("urn:nation/0")[0])


@register(_WHOLE)
def env_closure_view(spark, sf_dir):
    """One graph under the root's name, which is the default graph too; no other name has any."""
    view, _ = nation_env(spark, sf_dir).get_closure("urn:nation/0")
    inside = view.query("SELECT ?p { GRAPH <urn:nation/0> { ?s ?p ?o } }")
    return inside.unionByName(view.query("SELECT ?p { GRAPH <urn:nation/1> { ?s ?p ?o } }")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT DISTINCT s, p, o FROM ({_BODY} UNION {_IMPORT} UNION SELECT {_N}, '{PREFIXES}', {_N} {_FEW} UNION SELECT {_N}, '{DECLARE}', '_:d' || CAST(n_nationkey AS VARCHAR) {_FEW}) WHERE p IN ('<urn:p:n_name>', '{IMPORTS}', '{PREFIXES}')")
def env_copy_union(spark, sf_dir):
    """Unions keep imports and prefixes unless they are asked not to."""
    env = nation_env(spark, sf_dir)
    triples, _ = env.copy_union([m[1:-1] for m in MEMBERS], ROOT[1:-1])
    return triples.where(F.col("p").isin("<urn:p:n_name>", IMPORTS, PREFIXES))


@register(f"SELECT {_N} AS g, {sql_object('n_name')} AS l FROM nation WHERE n_nationkey IN (2, 3, 4)")
def env_union_view(spark, sf_dir):
    view, _ = nation_env(spark, sf_dir).get_union(["urn:nation/3", "urn:nation/2", "urn:nation/3", "urn:nation/4"])
    return view.query("SELECT ?g ?l { GRAPH ?g { ?s <urn:p:n_name> ?l } }")


@register(f"SELECT {_N} AS s, '<urn:p:n_name>' AS p, {sql_object('n_name')} AS o FROM nation WHERE n_nationkey = 9")
def env_copy_graph(spark, sf_dir):
    return nation_env(spark, sf_dir).copy_graph("urn:nation/9").where("p = '<urn:p:n_name>'")


@register("SELECT count(*) AS n FROM nation")
def env_copy_dataset(spark, sf_dir):
    return nation_env(spark, sf_dir).copy_dataset().where("p = '<urn:p:n_name>'").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT '  \"urn:nation/' || CAST(n_nationkey AS VARCHAR) || '\" -> \"urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '\";' AS line FROM nation")
def env_dot_export(spark, sf_dir):
    lines = [x for x in nation_env(spark, sf_dir).dep_graph_dot().split("\n") if "->" in x]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@register(f"SELECT {_N} AS g, '<urn:nation/' || CAST((n_nationkey + 1) % 25 AS VARCHAR) || '>' AS i FROM nation")
def catalog_record_triples(spark, sf_dir):
    return sparql(nation_env(spark, sf_dir).catalog_quads(), f"SELECT ?g ?i {{ ?g a {ONTOLOGY} ; {IMPORTS} ?i }}")


def env_on_disk(spark: SparkSession, sf_dir: str) -> tuple[Environment, str]:
    """An environment whose sources are files, one for each region, that import the next one."""
    folder = new_folder(spark, "sources").removeprefix("file:")
    folder = "/" + folder.lstrip("/")
    r = table(spark, sf_dir, "region")
    for row in r.orderBy("r_regionkey").collect():
        with open(f"{folder}/r{row['r_regionkey']}.ttl", "w") as file:
            file.write(f'<urn:region/{row["r_regionkey"]}> a {ONTOLOGY} ; {IMPORTS} <urn:region/{(row["r_regionkey"] + 1) % 5}> ; <urn:p:r_name> "{row["r_name"]}" .')
    path = new_folder(spark, "environment") + "/env"
    return Environment.create(spark, path, Config(search_directories=[folder])), path


_REGION = "'urn:region/' || CAST(r_regionkey AS VARCHAR)"


@register(f"SELECT {_REGION} AS name, 'urn:region/' || CAST((r_regionkey + 1) % 5 AS VARCHAR) AS imports FROM region")
def catalog_save_load(spark, sf_dir):
    _, path = env_on_disk(spark, sf_dir)
    return Environment.open(spark, path, read_only=True).catalog().select("name", F.array_join("imports", " ").alias("imports"))


@register(f"SELECT {sql_subject('region')} AS s, {sql_object('r_name')} AS o FROM region WHERE r_regionkey <> 2")
def env_recover(spark, sf_dir):
    """The catalog rebuilt from a store that has lost a graph behind its back."""
    _, path = env_on_disk(spark, sf_dir)
    Store(spark, path + "/store").remove_graph("<urn:region/2>")
    env = Environment.recover(spark, path)
    return env.get_dataset().triples(p="<urn:p:r_name>").where(F.col("s").isin(*(iri(n) for n in env.get_ontology_names()))).select("s", "o")


@register("SELECT * FROM (VALUES ('added', '5'), ('again', '0'), ('changed', 'urn:region/1'), ('vanished', 'urn:region/4')) v(step, outcome)")
def env_update(spark, sf_dir):
    """Discovery, reuse of what is unchanged, a changed file, and one that has vanished."""
    import os

    env, _ = env_on_disk(spark, sf_dir)
    folder = env.config.search_directories[0]
    steps = [("added", str(len(env))), ("again", str(len(env.update())))]
    with open(f"{folder}/r1.ttl", "a") as file:
        file.write("\n<urn:region/1> <urn:p:more> 1 .")
    steps.append(("changed", " ".join(env.update())))
    before = set(env.get_ontology_names())
    os.remove(f"{folder}/r4.ttl")
    env.update()
    steps.append(("vanished", " ".join(sorted(before - set(env.get_ontology_names())))))
    return spark.createDataFrame(steps, "step string, outcome string")


@register(f"SELECT CAST(n_nationkey AS INTEGER) AS place, {_NAME} AS name FROM nation")
def recursive_import_loading(spark, sf_dir):
    """One source is added; a fetcher gives what it imports, and what that imports."""
    names = {f"urn:nation/{r['n_nationkey']}": f"urn:nation/{(r['n_nationkey'] + 1) % 25}" for r in table(spark, sf_dir, "nation").collect()}

    def fetcher(url: str) -> bytes:
        key = url.removeprefix("http://h/")
        return f"<http://h/{key}> a {ONTOLOGY} ; {IMPORTS} <http://h/{names['urn:nation/' + key].removeprefix('urn:nation/')}> .".encode()

    env = Environment(spark, fetcher=fetcher)
    env.add("http://h/0")
    return names_frame(spark, [n.replace("http://h/", "urn:nation/") for n in env.list_closure("http://h/0")])


@register("SELECT * FROM (VALUES ('alias', 'urn:one'), ('offline', 'refused'), ('added', 'urn:one'), ('removed', 'none'), ('location', 'urn:one')) v(step, outcome)")
def aliases_and_locations(spark, sf_dir):
    """A location that differs from the name becomes an alias; aliases are added and removed; an offline environment fetches nothing."""
    env = Environment(spark, fetcher=lambda url: f"<urn:one> a {ONTOLOGY} .".encode())
    env.add("http://h/one#")
    steps = [("alias", env.resolve("http://h/one/").name), ("location", env.resolve("http://h/one#").name)]
    env.add_alias("urn:other", "urn:one")
    steps.append(("added", env.resolve("urn:other#").name))
    env.remove_alias("urn:other")
    steps.append(("removed", env.resolve_alias("urn:other") or "none"))
    env.config.offline = True
    try:
        env.add("http://h/two")
    except files.OfflineError:
        steps.append(("offline", "refused"))
    return spark.createDataFrame(steps, "step string, outcome string")


@register("SELECT 25 AS sources, 0 AS missing, 25 AS graphs FROM (SELECT 1)")
def env_status(spark, sf_dir):
    status = nation_env(spark, sf_dir).status()
    return spark.createDataFrame([(status["sources"], len(status["missing_imports"]), status["graphs"])], "sources int, missing int, graphs int")


@register(f"SELECT {_NAME} AS name FROM nation WHERE n_nationkey BETWEEN 10 AND 19 AND n_nationkey <> 13")
def env_prune_by_filter(spark, sf_dir):
    env = nation_env(spark, sf_dir, config=Config(include_ontologies=["nation/1[0-9]"], exclude_ontologies=["13"]))
    return spark.createDataFrame([(n,) for n in env.get_ontology_names()], "name string")


@register("SELECT * FROM (VALUES ('<urn:nowhere>')) v(target)")
def missing_in_closure(spark, sf_dir):
    """Of what the graphs within a closure import; another graph's missing import does not count."""
    quads = nation_graphs(spark, sf_dir)
    more = spark.createDataFrame([("<urn:nation/5>", "<urn:nowhere>"), ("<urn:apart>", "<urn:lost>")], "graph string, target string")
    imports = closure.declared_imports(quads).unionByName(more)
    within = closure.import_closure(imports.select(F.col("graph").alias("src"), F.col("target").alias("dst")), "<urn:nation/4>")
    return closure.missing_imports(imports, quads.select("graph").distinct(), within)


@register(f"SELECT '<urn:mine>' AS s, '<urn:nation/' || CAST(n_nationkey AS VARCHAR) || '>' AS o FROM nation WHERE n_nationkey IN (23, 24)")
def env_import_into_destination(spark, sf_dir):
    """The destination's own ontology stays the root, and imports the members."""
    mine = spark.createDataFrame([("<urn:mine>", TYPE, ONTOLOGY), ("<urn:mine>", "<urn:p>", "<urn:o>")], "s string, p string, o string")
    found = nation_env(spark, sf_dir).import_graph(mine, "urn:nation/23", 1)
    return found.where(F.col("p") == IMPORTS).select("s", "o")


_MINE = [("<urn:mine>", IMPORTS, "<urn:nation/3>"), ("<urn:mine>", "<urn:p>", "<urn:o>")]


@register(f"SELECT CAST(n AS BIGINT) AS n, p FROM (SELECT p, n FROM ({_WHOLE}) WHERE p <> '{TYPE}' UNION ALL SELECT '{TYPE}', 1 UNION ALL SELECT '<urn:p>', 1)")
def env_import_dependencies(spark, sf_dir):
    """The triples with the whole ring, without imports and without other declarations; prefixes are the caller's."""
    return by_predicate(nation_env(spark, sf_dir).import_dependencies(spark.createDataFrame(_MINE, "s string, p string, o string"))[0])


@register(f"SELECT CAST(n AS BIGINT) AS n, p FROM (SELECT p, CASE WHEN p = '{TYPE}' THEN 26 WHEN p = '{DECLARE}' THEN 25 ELSE n END AS n FROM ({_WHOLE}))")
def env_get_dependencies(spark, sf_dir):
    """The ring alone, each member with its declaration and prefixes."""
    return by_predicate(nation_env(spark, sf_dir).get_dependencies(spark.createDataFrame(_MINE, "s string, p string, o string"))[0])


class _Shelf(MemoryGraphs):
    """A graph store from outside, which gives revisions."""

    def graph_revisions(self) -> dict[str, str]:
        return {name: str(frame.count()) for name, frame in self.frames.items()}


@register(f"SELECT {_N} AS graph, CASE WHEN n_nationkey = 0 THEN 'changed' WHEN n_nationkey = 1 THEN 'removed' ELSE 'unchanged' END AS status FROM nation WHERE n_nationkey < 3 UNION ALL SELECT '<urn:new>', 'added'")
def refresh_from_store(spark, sf_dir):
    quads, shelf = nation_graphs(spark, sf_dir), _Shelf(spark)
    for m in MEMBERS[:3]:
        shelf.add_graph(m, quads.where(F.col("graph") == m))
    env = Environment.adopt(spark, None, shelf)
    shelf.add_graph(MEMBERS[0], quads.where(F.col("graph") == MEMBERS[0]).limit(3))
    shelf.remove_graph(MEMBERS[1])
    shelf.add_graph("<urn:new>", quads.where(F.col("graph") == MEMBERS[1]).withColumn("graph", F.lit("<urn:new>")))
    found = env.refresh_from_store()
    return spark.createDataFrame([(g, status) for status in ("added", "changed", "removed", "unchanged") for g in getattr(found, status)], "graph string, status string")


@register("SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS location FROM nation WHERE n_nationkey % 7 = 1")
def vanished_locations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("location"), "n_nationkey")
    return sync.vanished(n.select("location"), n.where("n_nationkey % 7 <> 1")).select("location")


@register(f"WITH q AS ({sql_quads('nation')}) SELECT s, p, o FROM q")
def stream_of_files(spark, sf_dir):
    """A folder of N-Triples as a stream, run until it is read up."""
    folder, state, out = (new_folder(spark, w) for w in ("in", "state", "out"))
    ntriples.lines_of(quads_of(spark, sf_dir, "nation")).write.mode("overwrite").text(folder)
    writer = stream_quads(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination(120)
    return spo(spark.read.parquet(out))


# -- catalog


@register("SELECT * FROM (VALUES ('<urn:g0>', 0::BIGINT), ('<urn:g2>', 2::BIGINT)) v(graph, n)")
def doctor_declarations(spark, sf_dir):
    """Graphs with no declaration, and with several."""
    rows = [(f"<urn:g{k}>", f"<urn:o{j}>", TYPE, ONTOLOGY) for k in range(3) for j in range(k)] + [(f"<urn:g{k}>", "<urn:x>", "<urn:p>", "<urn:o>") for k in range(3)]
    return catalog.declaration_counts(spark.createDataFrame(rows, "graph string, s string, p string, o string")).where("n <> 1")


@register("SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS prefix, 'urn:a urn:b' AS namespaces FROM nation WHERE n_regionkey = 2 GROUP BY n_regionkey")
def doctor_prefixes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("prefix"), F.when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 2 == 0), "urn:b").otherwise("urn:a").alias("namespace"))
    found = catalog.conflicting_prefixes(n.select(F.create_map("prefix", "namespace").alias("namespace_map")))
    return found.withColumn("namespaces", F.array_join("namespaces", " "))


@register("SELECT * FROM (VALUES ('<urn:g0>', '<urn:o>', FALSE), ('<urn:g1>', '<urn:d>', FALSE), ('<urn:g2>', '<urn:g2>', FALSE), ('<urn:g3>', '_:b', TRUE)) v(graph, subject, refused)")
def ontology_subjects(spark, sf_dir):
    """A declared ontology, or what declares prefixes, or the graph's own name; a blank node is refused."""
    rows = [("<urn:g0>", "<urn:o>", TYPE, ONTOLOGY), ("<urn:g0>", "<urn:a>", DECLARE, "_:x"), ("<urn:g1>", "<urn:d>", DECLARE, "_:x"), ("<urn:g2>", "<urn:x>", "<urn:p>", "<urn:o>"), ("<urn:g3>", "_:b", TYPE, ONTOLOGY)]
    found = catalog.subjects(spark.createDataFrame(rows, "graph string, s string, p string, o string"))
    bad = [g for g in ("<urn:g0>", "<urn:g1>", "<urn:g2>", "<urn:g3>") if refused(lambda g=g: catalog.check_subjects(found.where(F.col("graph") == g)), catalog.NoDeclaration)]
    return found.select("graph", "subject", F.col("graph").isin(*bad).alias("refused"))


@register(f"SELECT {_NAME} AS name FROM nation")
def env_snapshot(spark, sf_dir):
    """A copy in memory keeps what its original loses."""
    env = nation_env(spark, sf_dir)
    copy = env.temporary_snapshot()
    env.rename_graph_iri("urn:nation/3", "urn:renamed")
    found = copy.get_dataset().triples(p="<urn:p:n_name>").select("s")
    return found.select(F.substring_index(F.substring("s", 2, 100), ">", 1).alias("name")).where(F.col("name").isin(*copy.get_ontology_names()))


def versioned_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each supplier, which tells a version of its nation's ontology by when it was created, its label and what to see also."""
    s = table(spark, sf_dir, "supplier")
    graph, own = F.concat(F.lit("<urn:supplier/"), F.col("s_suppkey").cast("string"), F.lit(">")), F.concat(F.lit("<urn:nation/"), F.col("s_nationkey").cast("string"), F.lit(">"))
    two = lambda e: F.concat(F.lit('"'), F.lpad(F.pmod(F.col("s_suppkey"), F.lit(e)).cast("string"), 2, "0"), F.lit('"'))
    parts = [(TYPE, F.lit(ONTOLOGY)), (iri("http://purl.org/dc/terms/created"), two(7)), (iri("http://www.w3.org/2000/01/rdf-schema#label"), two(11)), (iri("http://www.w3.org/2000/01/rdf-schema#seeAlso"), two(3))]
    # what is no version property does not decide
    parts.append((iri("http://purl.org/dc/terms/issued"), two(13)))
    return s.select(F.lit("db").alias("dataset"), graph.alias("graph"), own.alias("s"), F.inline(F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in parts))))


@register("""SELECT name, graph FROM (SELECT '<urn:nation/' || CAST(s_nationkey AS VARCHAR) || '>' AS name, '<urn:supplier/' || CAST(s_suppkey AS VARCHAR) || '>' AS graph,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 DESC, s_suppkey % 7 DESC, s_suppkey % 11 DESC, '<urn:supplier/' || CAST(s_suppkey AS VARCHAR) || '>') AS k FROM supplier) WHERE k = 1""")
def resolve_version_from_quads(spark, sf_dir):
    """From the statements of graphs through their records and version vectors to the choice."""
    found = catalog.describe(versioned_graphs(spark, sf_dir))
    rows = found.select("name", F.col("graph").alias("location"), catalog.version_vector(F.col("version_properties")).alias("version"))
    return catalog.choose(rows, "version").select("name", F.col("location").alias("graph"))


@register("""SELECT '<urn:supplier/' || CAST(s_suppkey AS VARCHAR) || '>' AS graph,
  'http://purl.org/dc/terms/created="' || lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0') || '",http://www.w3.org/2000/01/rdf-schema#label="' || lpad(CAST(s_suppkey % 11 AS VARCHAR), 2, '0')
  || '",http://www.w3.org/2000/01/rdf-schema#seeAlso="' || lpad(CAST(s_suppkey % 3 AS VARCHAR), 2, '0') || '"' AS versions, 5::BIGINT AS n FROM supplier""")
def catalog_versions(spark, sf_dir):
    found = catalog.describe(versioned_graphs(spark, sf_dir))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("version_properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return found.select("graph", pairs.alias("versions"), F.col("n_triples").alias("n"))


@register("SELECT 'urn:nation/' || CAST(s_nationkey AS VARCHAR) AS name, max('http://h/' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS location FROM supplier GROUP BY s_nationkey")
def resolve_policy_from_outside(spark, sf_dir):
    """A policy that the caller gives: the greatest location."""
    return catalog.choose(records(spark, sf_dir), [F.col("location").desc()]).select("name", "location")


# -- what is refused


def refused(f: Callable[[], object], *kinds: type[Exception]) -> bool:
    try:
        f()
    except kinds:
        return True
    return False


@register("SELECT * FROM (VALUES ('update', TRUE), ('service', TRUE), ('view', TRUE)) v(what, refused)")
def sparql_refused(spark, sf_dir):
    quads = quads_of(spark, sf_dir, "nation")
    rows = [
        ("update", refused(lambda: View(quads).update("DELETE WHERE { ?s ?p ?o }"), ValueError) and refused(lambda: sparql(quads, "INSERT DATA { <a> <b> <c> }"), SparqlError)),
        ("service", refused(lambda: sparql(quads, "SELECT * { SERVICE <urn:x> { ?s ?p ?o } }"), NotImplementedError)),
        ("view", refused(lambda: View(quads).add(("a", "b", "c")), ValueError)),
    ]
    return spark.createDataFrame(rows, "what string, refused boolean")

