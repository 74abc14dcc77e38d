"""Scans, closures and unions against small hand-made graphs and plain Python."""

import pytest
from row_tools import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.operators import closure, scan, union
from quadrille.sparql.compiler import query
from quadrille.terms import DECLARE, IMPORTS, NAMESPACE, ONTOLOGY, PREFIX, PREFIXES, QUAD_SCHEMA, SUBCLASS, TYPE, iri, literal

CLASS = iri("http://www.w3.org/2002/07/owl#Class")


def frame(spark, quads):
    return spark.createDataFrame(quads, QUAD_SCHEMA)


def node(x):
    return iri(f"urn:{x}")


@pytest.fixture(scope="module")
def hierarchy(spark):
    g = node("g")
    quads = [("d", g, node(x), TYPE, CLASS) for x in "ABCDE"]
    quads += [("d", g, node(a), SUBCLASS, node(b)) for a, b in ("BA", "CB", "DB")]
    quads += [("d", g, node("X"), node("next"), node("Y")), ("d", g, node("Y"), node("next"), node("Z")), ("d", g, node("Z"), node("next"), literal("end"))]
    return frame(spark, quads).cache()


def names(df, column):
    return sorted(r[0].removeprefix("<urn:").removesuffix(">") for r in df.select(column).collect())


PATHS = [
    ("SELECT ?x { <urn:C> rdfs:subClassOf+ ?x }", "AB"),
    ("SELECT ?x { <urn:C> rdfs:subClassOf* ?x }", "ABC"),
    ("SELECT ?x { ?x rdfs:subClassOf+ <urn:A> }", "BCD"),
    ("SELECT ?x { ?x ^rdfs:subClassOf+ <urn:C> }", "AB"),
    ("SELECT ?x { <urn:C> rdfs:subClassOf? ?x }", "BC"),
    ("SELECT ?x { <urn:C> rdfs:subClassOf/rdfs:subClassOf ?x }", "A"),
]


@pytest.mark.parametrize("text, expected", PATHS)
def test_paths(hierarchy, text, expected):
    found = query(hierarchy, text, {"rdfs": "http://www.w3.org/2000/01/rdf-schema#"})
    assert names(found, "x") == list(expected)


@pytest.mark.parametrize("text, expected", [("C> rdfs:subClassOf+ <urn:A", True), ("C> rdfs:subClassOf+ <urn:E", False), ("E> rdfs:subClassOf* <urn:A", False), ("E> rdfs:subClassOf* <urn:E", True)])
def test_path_asks(hierarchy, text, expected):
    assert query(hierarchy, f"ASK {{ <urn:{text}> }}", {"rdfs": "http://www.w3.org/2000/01/rdf-schema#"}).first()[0] is expected


def test_all_pairs(hierarchy):
    found = query(hierarchy, f"SELECT ?a ?b {{ ?a {SUBCLASS}+ ?b }}")
    assert {(a[5], b[5]) for a, b in rows(found)} == {("B", "A"), ("C", "B"), ("D", "B"), ("C", "A"), ("D", "A")}


def test_paths_follow_any_predicate_and_keep_literals(hierarchy):
    found = query(hierarchy, f"SELECT ?x {{ <urn:X> {node('next')}+ ?x }}")
    assert rows(found) == [('"end"',), ("<urn:Y>",), ("<urn:Z>",)]


def test_path_within_graph_binds_the_graph(spark):
    q = frame(spark, [("d", node("g1"), node("a"), node("p"), node("b")), ("d", node("g2"), node("b"), node("p"), node("c"))])
    assert rows(query(q, f"SELECT ?g ?x {{ GRAPH ?g {{ <urn:a> {node('p')}+ ?x }} }}")) == [("<urn:g1>", "<urn:b>")]
    assert rows(query(q, f"SELECT ?x {{ <urn:a> {node('p')}+ ?x }}")) == [("<urn:b>",), ("<urn:c>",)]


def test_scopes(spark):
    t = (node("a"), node("p"), literal("x"))
    q = frame(spark, [("1", node("g"), *t), ("2", node("g"), *t), ("1", node("h"), *t)])
    assert scan.scan(q).count() == 3
    assert scan.scan(q, scope=scan.Scope(names=(node("g"),))).count() == 1
    assert scan.scan(q, scope=scan.Scope(physical=(("2", node("g")),))).count() == 1
    assert scan.length(q).first()[0] == 2
    assert scan.triple_count(q).first()[0] == 1
    assert scan.iter_triples(q, [node("g"), node("h")]).count() == 2
    assert rows(scan.contexts(q, t)) == [(node("g"),), (node("h"),)]
    assert rows(scan.contexts(q, (node("zz"), None, None))) == [(node("g"),), (node("h"),)]
    assert scan.matching(q, s=node("unknown")).isEmpty()
    assert scan.grouped_scan(q).first()["graphs"] == [node("g"), node("h")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
def test_transitive_is_reachability(spark, pairs):
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in sorted(pairs)], "src string, dst string")
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)
    expected = set()
    for start in step:
        todo, seen = list(step[start]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += step.get(x, ())
        expected |= {(str(start), str(x)) for x in seen}
    assert set(rows(closure.transitive(edges))) == expected


def test_import_paths_and_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "t"), ("r", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("x", "t")], "src string, dst string")
    found = sorted(r["path"] for r in closure.import_paths(edges, "t").collect())
    assert found == [["r", "a", "t"], ["r", "b", "a", "t"]]
    assert sorted(r["path"] for r in closure.import_paths(edges, "nowhere", present=False).collect()) == []
    assert [r["node"] for r in closure.import_closure(edges, "r").collect()] == ["r", "a", "b", "t"]
    assert [r["node"] for r in closure.import_closure(edges, "r", 0).collect()] == ["r"]


def declared(graph, prefix, namespace, label, namespace_iri=False):
    d = f"_:{label}"
    value = iri(namespace) if namespace_iri else literal(namespace)
    return [("d", graph, graph, DECLARE, d), ("d", graph, d, PREFIX, literal(prefix)), ("d", graph, d, NAMESPACE, value), ("d", graph, graph, PREFIXES, graph), ("d", graph, graph, TYPE, ONTOLOGY)]


def plain_union(quads, graphs, root):
    """The normalised union with sets."""
    t = {(s, p, o) for _, g, s, p, o in quads if g in graphs}
    read = {}
    for s, p, o in t:
        if p in (PREFIX, NAMESPACE):
            read.setdefault(s, {})[p] = o.strip('"<>')
    out, seen = set(), set()
    for s, p, o in sorted((x for x in t if x[1] == DECLARE), key=lambda x: (x[0] != root, x)):
        key = (read.get(o, {}).get(PREFIX), read.get(o, {}).get(NAMESPACE))
        if s == root or key not in seen:
            out.add((root, DECLARE, o))
        seen.add(key)
    for s, p, o in t:
        if p == DECLARE or p == IMPORTS and o in graphs or p == TYPE and o == ONTOLOGY and s != root:
            continue
        out.add((s, p, root if p == PREFIXES else o))
    return out | {(root, TYPE, ONTOLOGY)}


def test_normalized_union_is_the_plain_one(spark):
    a, b, c = node("a"), node("b"), node("c")
    quads = declared(a, "ex", "http://ex/", "d1") + declared(b, "ex", "http://ex/", "d2", True) + declared(c, "other", "http://o/", "d3")
    quads += [("d", a, a, IMPORTS, b), ("d", b, b, IMPORTS, iri("urn:outside")), ("d", c, c, IMPORTS, a), ("d", a, a, node("p"), literal("x"))]
    for root in (a, b):
        found = union.normalized_union(frame(spark, quads), [b, a, c], root)
        assert set(rows(found)) == plain_union(quads, [a, b, c], root)


def test_prefix_conflicts_raise(spark):
    quads = declared(node("a"), "ex", "http://one/", "d1") + declared(node("b"), "ex", "http://two/", "d2")
    with pytest.raises(union.PrefixConflict, match="http://one/.*http://two/"):
        union.normalized_union(frame(spark, quads), [node("a"), node("b")], node("a"))
    assert union.normalized_union(frame(spark, quads), [node("a"), node("b")], node("a"), rewrite_prefixes=False).count() > 0


def test_rename_keeps_version_iri_and_predicates(spark):
    old, new, version = node("o"), node("n"), iri("http://www.w3.org/2002/07/owl#versionIRI")
    q = frame(spark, [("d", old, old, version, old), ("d", old, node("x"), node("p"), old), ("d", old, old, old, literal("l"))]).select("s", "p", "o")
    assert set(rows(union.rename(q, old, new))) == {(new, version, old), (node("x"), node("p"), new), (new, old, literal("l"))}


def test_strip_imports_keeps_blank_objects(spark):
    q = frame(spark, [("d", node("g"), node("g"), IMPORTS, "_:b"), ("d", node("g"), node("g"), IMPORTS, node("x"))])
    assert [r["o"] for r in union.strip_imports(q).collect()] == ["_:b"]


def test_empty_union_is_an_error(spark):
    with pytest.raises(ValueError):
        union.normalized_union(frame(spark, []), [], node("a"))
