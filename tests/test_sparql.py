"""The query language: joins with unbound variables, errors, aggregates, functions, forms."""

import random

import pytest
from row_tools import rows

from quadrille.sources.access import Stored, Tables
from quadrille.sources.mapping import TableMap, to_quads
from quadrille.sources.store import Store
from quadrille.sparql.compiler import query
from quadrille.sparql.parser import SparqlError, parse
from quadrille.terms import QUAD_SCHEMA, TYPE, XSD, iri, literal

P = {"": "http://x/", "xsd": XSD}


def e(name):
    return iri("http://x/" + name)


def number(n):
    return literal(str(n), XSD + "integer")


@pytest.fixture(scope="module")
def people(spark):
    g1, g2 = e("g1"), e("g2")
    data = [
        (g1, e("a"), TYPE, e("P")), (g1, e("a"), e("name"), literal("Ann")), (g1, e("a"), e("age"), number(30)), (g1, e("a"), e("knows"), e("b")),
        (g1, e("b"), TYPE, e("P")), (g1, e("b"), e("name"), literal("Bob", lang="EN")), (g1, e("b"), e("age"), number(7)), (g1, e("b"), e("knows"), e("c")),
        (g2, e("c"), TYPE, e("P")), (g2, e("c"), e("knows"), e("a")), (g2, e("a"), e("name"), literal("Ann")),
    ]
    return spark.createDataFrame([("d", *r) for r in data], QUAD_SCHEMA).cache()


def ask(people, text, **more):
    return rows(query(people, text, P, **more))


def test_default_graph_is_a_set(people):
    assert ask(people, "SELECT ?s { ?s :name 'Ann' }") == [(e("a"),)]
    assert ask(people, "SELECT ?g { GRAPH ?g { ?s :name 'Ann' } }") == [(e("g1"),), (e("g2"),)]
    assert ask(people, "SELECT ?s FROM :g2 { ?s :name ?n }") == [(e("a"),)]
    assert ask(people, "SELECT ?g ?s FROM NAMED :g2 { GRAPH ?g { ?s :name ?n } }") == [(e("g2"), e("a"))]


def test_unbound_variables_join_with_anything(people):
    found = ask(people, "SELECT ?s ?n ?k { ?s a :P OPTIONAL { ?s :name ?n } VALUES (?n ?k) { ('Ann' 1) (UNDEF 2) } }")
    assert len(found) == 3 + 1 + 1
    assert (e("c"), literal("Ann"), number(1)) in found


def test_optional_filter_and_minus(people):
    assert ask(people, "SELECT ?s ?x { ?s a :P OPTIONAL { ?s :age ?x FILTER(?x > 10) } }") == [(e("a"), number(30)), (e("b"), None), (e("c"), None)]
    assert ask(people, "SELECT ?s { ?s a :P MINUS { ?s :age ?x } }") == [(e("c"),)]
    assert len(ask(people, "SELECT ?s { ?s a :P MINUS { ?other :age ?x } }")) == 3


def test_exists(people):
    assert ask(people, "SELECT ?s { ?s a :P FILTER EXISTS { ?s :age ?x FILTER(?x > 10) } }") == [(e("a"),)]
    assert ask(people, "SELECT ?s ?x { ?s :age ?x FILTER NOT EXISTS { ?t :age ?y FILTER(?y > ?x) } }") == [(e("a"), number(30))]
    assert ask(people, "SELECT ?s { ?s a :P FILTER(EXISTS { ?s :knows :c } || EXISTS { ?s :knows :b }) }") == [(e("a"),), (e("b"),)]


def test_errors_are_no_truth(people):
    assert ask(people, "SELECT ?s { ?s :name ?n FILTER(?n + 1 > 0) }") == []
    assert ask(people, "SELECT ?s { ?s :name ?n FILTER(!(?n + 1 > 0)) }") == []
    assert len(ask(people, "SELECT ?s { ?s :name ?n FILTER(?n + 1 > 0 || true) }")) == 2
    assert ask(people, "SELECT (COALESCE(1/0, 'none') AS ?x) {}") == [(literal("none"),)]
    assert ask(people, "SELECT ?x { BIND(?nothing + 1 AS ?x) }") == [(None,)]


def test_aggregates(people):
    found = ask(people, "SELECT (COUNT(*) AS ?n) (SUM(?x) AS ?s) (AVG(?x) AS ?m) (MIN(?x) AS ?lo) (MAX(?x) AS ?hi) { ?p :age ?x }")
    assert found == [(number(2), number(37), literal("18.5", XSD + "decimal"), number(7), number(30))]
    assert ask(people, "SELECT (SUM(?n) AS ?s) (COUNT(?n) AS ?k) { ?p :name ?n }") == [(None, number(2))]
    assert ask(people, "SELECT (COUNT(*) AS ?n) (SUM(?x) AS ?s) (AVG(?x) AS ?m) { ?p :none ?x }") == [(number(0), number(0), number(0))]
    assert ask(people, "SELECT ?p (COUNT(?x) AS ?n) { ?p :none ?x } GROUP BY ?p") == []
    assert ask(people, "SELECT (COUNT(DISTINCT ?t) AS ?n) { ?p a ?t }") == [(number(1),)]
    assert ask(people, "SELECT ?k (COUNT(*) AS ?n) { ?p a :P OPTIONAL { ?p :age ?x } BIND(BOUND(?x) AS ?k) } GROUP BY ?k HAVING(COUNT(*) > 1)") == [(literal("true", XSD + "boolean"), number(2))]
    assert ask(people, "SELECT (GROUP_CONCAT(DISTINCT ?t; SEPARATOR='+') AS ?x) { ?p a ?t }") == [(literal("http://x/P"),)]


def test_order(people):
    found = [r[0] for r in query(people, "SELECT ?o { ?s ?p ?o } ORDER BY ?o", P).collect()]
    kinds = ["iri" if x.startswith("<") else "literal" for x in found]
    assert kinds == sorted(kinds)
    assert [x for x in found if "integer" in x] == [number(7), number(30)]
    assert [r[0] for r in query(people, "SELECT ?s { ?s a :P OPTIONAL { ?s :age ?x } } ORDER BY ?x", P).collect()] == [e("c"), e("b"), e("a")]
    assert [r[0] for r in query(people, "SELECT DISTINCT ?t { ?s a ?t } ORDER BY DESC(?t) LIMIT 1 OFFSET 0", P).collect()] == [e("P")]


FUNCTIONS = [
    ("STRLEN('héllo')", number(5)), ("SUBSTR('hello', 2)", literal("ello")), ("SUBSTR('hello', 0, 3)", literal("he")), ("UCASE('a'@en)", literal("A", lang="en")),
    ("STRBEFORE('abc', 'b')", literal("a")), ("STRBEFORE('abc', 'z')", literal("")), ("STRAFTER('abc'@en, 'b')", literal("c", lang="en")), ("STRAFTER('abc', '')", literal("abc")),
    ("CONCAT('a'@en, 'b'@en)", literal("ab", lang="en")), ("CONCAT('a'@en, 'b')", literal("ab")), ("ENCODE_FOR_URI('~*-_. a')", literal("~%2A-_.%20a")),
    ("REPLACE('abcd', 'b', 'Z')", literal("aZcd")), ("REPLACE('a.b', '.', '-', 'q')", literal("a-b")), ("1/4", literal("0.25", XSD + "decimal")), ("7/0", None),
    ("1 + 2.5", literal("3.5", XSD + "decimal")), ("2 * 1e1", literal("20.0", XSD + "double")), ("ROUND(-2.5)", literal("-2", XSD + "decimal")), ("CEIL(1.2)", literal("2", XSD + "decimal")),
    ("ABS(-3)", number(3)), ("-(3)", number(-3)), ("IF(1 < 2, 'y', 'n')", literal("y")), ("DATATYPE('x'@en)", iri("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")),
    ("LANG('x'@EN-gb)", literal("en-gb")), ("STRDT('1', xsd:integer)", number(1)), ("STRLANG('a', 'fr')", literal("a", lang="fr")), ("IRI('http://x/a')", e("a")),
    ("YEAR('2020-02-03T04:05:06Z'^^xsd:dateTime)", number(2020)), ("SECONDS('2020-02-03T04:05:06.5Z'^^xsd:dateTime)", literal("6.5", XSD + "decimal")),
    ("TZ('2020-02-03T04:05:06-08:00'^^xsd:dateTime)", literal("-08:00")), ("TIMEZONE('2020-02-03T04:05:06-08:30'^^xsd:dateTime)", literal("-PT8H30M", XSD + "dayTimeDuration")),
    ("MD5('abc')", literal("900150983cd24fb0d6963f7d28e17f72")), ("SHA1('abc')", literal("a9993e364706816aba3e25717850c26c9cd0d89d")),
    ("xsd:integer('12')", number(12)), ("xsd:integer('x')", None), ("xsd:integer(3.9)", number(3)), ("xsd:boolean('1')", literal("true", XSD + "boolean")), ("xsd:string(5)", literal("5")),
    ("xsd:decimal('1.50')", literal("1.5", XSD + "decimal")), ("xsd:dateTime('2020-01-01T00:00:00')", literal("2020-01-01T00:00:00", XSD + "dateTime")),
]
TRUTHS = [
    ("1 = 1.0", True), ("'a' = 'a'@en", False), ("<urn:a> = <urn:b>", False), ("'a' < 'b'", True), ("2 IN (1, 2.0)", True), ("2 NOT IN (1)", True), ("CONTAINS('abc', 'b')", True),
    ("STRSTARTS('abc'@en, 'a')", True), ("STRENDS('abc', 'b')", False), ("REGEX('Abc', '^a', 'i')", True), ("LANGMATCHES('en-GB', 'en')", True), ("LANGMATCHES('', '*')", False),
    ("ISNUMERIC(1)", True), ("ISNUMERIC('1')", False), ("ISLITERAL('x')", True), ("ISBLANK(BNODE())", True), ("SAMETERM(1, 1.0)", False), ("'2020-01-01T00:00:00Z'^^xsd:dateTime = '2020-01-01T01:00:00+01:00'^^xsd:dateTime", True),
    ("true && 'x'", True), ("'' || false", False), ("'x'^^<urn:t> = 'y'^^<urn:t>", None), ("'x'^^<urn:t> = 'x'^^<urn:t>", True), ("1 < 'a'", None), ("'NaN'^^xsd:double = 'NaN'^^xsd:double", False),
]


def test_functions(spark, people):
    text = "SELECT " + " ".join(f"({f} AS ?v{k})" for k, (f, _) in enumerate(FUNCTIONS)) + " {}"
    found = query(people, text, P).first()
    assert [(f, v) for (f, _), v in zip(FUNCTIONS, found, strict=True)] == FUNCTIONS


def test_truths(spark, people):
    text = "SELECT " + " ".join(f"(({f}) AS ?v{k})" for k, (f, _) in enumerate(TRUTHS)) + " {}"
    found = query(people, text, P).first()
    as_term = lambda t: None if t is None else literal(str(t).lower(), XSD + "boolean")
    assert [(f, v) for (f, _), v in zip(TRUTHS, found, strict=True)] == [(f, as_term(t)) for f, t in TRUTHS]


def test_construct_and_describe(people):
    found = ask(people, "CONSTRUCT { ?s :is [ :old ?x ] . ?x :bad ?s } { ?s :age ?x }")
    assert len(found) == 4
    assert all(not s.startswith('"') for s, _, _ in found)
    assert (e("b"), e("age"), number(7)) in ask(people, "DESCRIBE :b")
    assert len(ask(people, "DESCRIBE ?s { ?s :age 7 }")) == 4


def test_bindings_and_functions(people):
    assert ask(people, "SELECT ?who ?n { ?who :age ?n }", bindings={"who": e("b")}) == [(e("b"), number(7))]
    from pyspark.sql import functions as F

    twice = {e("twice"): lambda t: F.concat(t, F.lit("!"))}
    assert ask(people, "SELECT (:twice(?n) AS ?x) { :a :name ?n }", functions=twice) == [('"Ann"!',)]


def test_subselect_and_blank_nodes(people):
    assert ask(people, "SELECT ?s { { SELECT ?s { ?s :age ?x } ORDER BY ?x LIMIT 1 } }") == [(e("b"),)]
    assert ask(people, "SELECT * { ?s :age 7 ; :knows [ a :P ] }") == [(e("b"),)]
    assert ask(people, "SELECT ?x { _:q :age ?x FILTER(?x < 10) }") == [(number(7),)]


def test_what_is_not_offered(people):
    for text in ("SELECT * { SERVICE <http://h/> { ?s ?p ?o } }",):
        with pytest.raises(NotImplementedError):
            query(people, text)
    assert len(ask(people, "SELECT * { SERVICE SILENT <http://h/> { ?s ?p ?o } ?s :age ?x }")) == 2
    for text in ("INSERT DATA { <a> <b> <c> }", "SELECT ?x { ?x :unknown", "SELECT (NOPE(1) AS ?x) {}", "SELECT ?x { ?x zz:p 1 }", "SELECT (1 AS ?x) { ?s :age ?x BIND(2 AS ?x) }"):
        with pytest.raises(SparqlError):
            parse(text, P)


@pytest.mark.parametrize("seed", range(6))
def test_solutions_with_unbound_variables_against_the_definition(spark, people, seed):
    """Join, OPTIONAL, MINUS and EXISTS of random solutions, by the compatibility of mappings."""
    rng = random.Random(seed)
    block = lambda names: [tuple(rng.choice([None, 1, 2, 3]) for _ in names) for _ in range(5)]
    one, two = ("a", "b"), rng.choice([("a", "b"), ("b", "c"), ("b", "a", "c")])
    left, right = block(one), block(two)
    values = lambda names, data: f"VALUES ({' '.join('?' + n for n in names)}) {{ {' '.join('(' + ' '.join('UNDEF' if x is None else str(x) for x in r) + ')' for r in data)} }}"
    solution = lambda names, r: {n: x for n, x in zip(names, r, strict=True) if x is not None}
    lefts, rights = [solution(one, r) for r in left], [solution(two, r) for r in right]
    fits = lambda x, y: all(x[n] == y[n] for n in x.keys() & y.keys())
    names = sorted({*one, *two})
    shown = lambda found, names: sorted((tuple(None if n not in m else number(m[n]) for n in names) for m in found), key=str)
    asked = lambda body, names: ask(people, f"SELECT {' '.join('?' + n for n in names)} {{ {values(one, left)} {body} }}")
    joined = [x | y for x in lefts for y in rights if fits(x, y)]
    assert asked(f"{{ {values(two, right)} }}", names) == shown(joined, names)
    optional = joined + [x for x in lefts if not any(fits(x, y) for y in rights)]
    assert asked(f"OPTIONAL {{ {values(two, right)} }}", names) == shown(optional, names)
    keep = lambda m: m.get("b", 0) > 1
    filtered = [x | y for x in lefts for y in rights if fits(x, y) and keep(x | y)] + [x for x in lefts if not any(fits(x, y) and keep(x | y) for y in rights)]
    assert asked(f"OPTIONAL {{ {values(two, right)} FILTER(?b > 1) }}", names) == shown(filtered, names)
    left_over = [x for x in lefts if not any(fits(x, y) and x.keys() & y.keys() for y in rights)]
    assert asked(f"MINUS {{ {values(two, right)} }}", one) == shown(left_over, one)
    met = [x for x in lefts if any(fits(x, y) for y in rights)]
    assert asked(f"FILTER EXISTS {{ {values(two, right)} }}", one) == shown(met, one)
    assert asked(f"FILTER NOT EXISTS {{ {values(two, right)} }}", one) == shown([x for x in lefts if x not in met], one)
    either = [x for x in lefts if x.get("a") == 1 or any(fits(x, y) for y in rights)]
    assert asked(f"FILTER(EXISTS {{ {values(two, right)} }} || COALESCE(?a = 1, false))", one) == shown(either, one)


def test_exists_in_an_optional(people):
    text = "SELECT ?s ?x { ?s a :P OPTIONAL { ?s :age ?x FILTER EXISTS { ?s :knows :c } } }"
    assert ask(people, text) == [(e("a"), None), (e("b"), number(7)), (e("c"), None)]
    text = "SELECT ?s ?x { ?s a :P OPTIONAL { ?s :name ?n } OPTIONAL { ?s :age ?x FILTER(NOT EXISTS { ?s :knows :c } && ?x > 10) } }"
    assert [(r[0], r[1]) for r in ask(people, text)] == [(e("a"), number(30)), (e("b"), None), (e("c"), None)]


def test_unbound_variables_join_by_keys(spark, people):
    """Of two sides that share a variable that is always bound, or bound in most rows, no pair without a key is looked at."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for text in (
            "SELECT * { { ?s a :P OPTIONAL { ?s :name ?n } } { ?s a :P OPTIONAL { ?s :name ?n } } }",
            "SELECT ?s { ?s a :P OPTIONAL { ?s :name ?n } MINUS { ?t :name ?n } }",
            "SELECT * { ?s a :P OPTIONAL { ?s :name ?n } OPTIONAL { ?s :name ?n ; :age ?x } }",
        ):
            plan = query(people, text, P)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sources(spark, people, tmp_path):
    """A store and mapped tables answer as the quads do, by the copy or the columns that fit."""
    store = Store(spark, str(tmp_path / "store"))
    store.write(people)
    for text in ("SELECT ?s { ?s :name 'Ann' }", "SELECT ?g ?s { GRAPH ?g { ?s :knows ?o } }", "SELECT ?s ?k { ?s a :P ; :knows+ ?k }", "SELECT (COUNT(*) AS ?n) FROM :g1 { ?s ?p ?o }"):
        assert ask(Stored(store), text) == ask(people, text)
    table = spark.createDataFrame([(1, "x", 2), (2, "y", None), (3, None, 1)], "k long, name string, up long")
    mapping = TableMap("t", ("k",), ("name",), {"up": "t"})
    quads, source = to_quads(table, mapping), Tables([(table, mapping)])
    for text in ("SELECT * { ?s <urn:p:name> ?n OPTIONAL { ?s <urn:p:up> ?u } }", "SELECT * { ?s ?p <urn:t/1> }", "SELECT * { <urn:t/3> <urn:p:up>/<urn:p:name> ?n }", "SELECT * { ?s <urn:p:none> ?o }", "SELECT ?t (COUNT(?s) AS ?n) { ?s a ?t } GROUP BY ?t"):
        assert ask(source, text) == ask(quads, text)
    assert "Generate" not in source.scan(p="<urn:p:name>")._jdf.queryExecution().optimizedPlan().toString()
