"""Formats, files, the store, environments, the command line, and streams."""

import json
import os
import shutil

import pytest
from row_tools import rows

from quadrille import cli
from quadrille.env import CapabilityError, Config, Environment, MemoryGraphs, RecoveryNeededError, StoreChangedError, StoredGraphs, UnresolvedImportError
from quadrille.operators import catalog, sync
from quadrille.sources import files, jsonld, ntriples, rdfxml, turtle
from quadrille.sources.store import ReadOnlyError, Store, StoreConflict
from quadrille.sparql.compiler import query
from quadrille.streaming import watch
from quadrille.terms import DCTERMS, IMPORTS, ONTOLOGY, QUAD_SCHEMA, RDFS, TYPE, VAEM, iri, literal

TTL = """@prefix : <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
<http://x/o> a owl:Ontology ; owl:imports <http://y/> ; :n 1, 2.5, 1e3, true ; :l "a\\"b\\nc\\\\d"@en-GB, \"\"\"long "q" x\"\"\"^^:dt ; :c (1 [ :p "z\\u00e9" ]) .
[] :q :a . _:x :y _:x ."""


def triples_of(parsed):
    return {(s, p, o) for _, s, p, o in parsed.statements}


def test_round_trips():
    t = triples_of(turtle.parse(TTL))
    assert len(t) == 16
    assert triples_of(turtle.parse(turtle.serialize(t, {"": "http://x/"}))) == t
    assert triples_of(rdfxml.parse(rdfxml.serialize(t))) == t
    assert triples_of(jsonld.parse(jsonld.serialize(t))) == t


def test_ntriples_in_the_jvm(spark, tmp_path):
    t = triples_of(turtle.parse(TTL))
    quads = spark.createDataFrame([("d", iri("urn:g"), *x) for x in t], QUAD_SCHEMA)
    ntriples.write(quads, str(tmp_path / "nt"))
    found = ntriples.read(spark, str(tmp_path / "nt"), graph=iri("urn:g")).select("s", "p", "o")
    assert found.count() == len(t)
    plain = lambda x: {r for r in x if not any(str(c).startswith("_:") for c in r)}
    assert plain(set(map(tuple, found.collect()))) == plain(t)
    lines = ['<urn:s> <urn:p> "a\\\\u0041\\u00e9\\U0001F600\\t" . # note', "", "# comment", '_:b <urn:p> "x"@EN <urn:g> .', '<urn:s> <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#string> .']
    got = rows(ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == sorted([(None, "<urn:s>", "<urn:p>", '"a\\u0041é😀\t"'), ("<urn:g>", "_:b", "<urn:p>", '"x"@en'), (None, "<urn:s>", "<urn:p>", '"1"')], key=str)
    with pytest.raises(Exception, match="no statement"):
        ntriples.parse_lines(spark.createDataFrame([("<a> <b> .",)], "value string")).collect()


@pytest.mark.parametrize("text", ['{"@graph": 3}', "[1]", "3", '{"a": {"@id": 5}}', '{"@context": 5}', '{"@context": {"a": 7}, "a": "x"}', '{"@id": 4, "urn:p": 1}', '{"@type": [5]}', '{"urn:p": {"@value": "x", "@language": 3}}',
                                  '{"@context": {"a": {"@id": 3}}, "a": 1}', '{"@reverse": 3}', '{"@graph": [null, 1]}', '{"@context": {"@vocab": 3}, "a": 1}', '{"@context": [{"@base": 3}], "@id": "a", "urn:p": 1}'])
def test_malformed_json_is_a_syntax_error(text):
    with pytest.raises(turtle.RdfSyntaxError):
        files.parse_bytes(text.encode(), "x.jsonld")


def test_formats_and_fallbacks():
    assert files.sniff(b"<?xml version='1.0'?>") == "rdfxml"
    assert files.sniff(b'{"@id": "x"}') == "jsonld"
    assert files.sniff(b"@prefix : <x> .") == "turtle"
    assert files.sniff(b"<a> <b> <c> .") == "ntriples"
    assert len(files.parse_bytes(TTL.encode(), "wrong.xml").statements) == 16
    with pytest.raises(turtle.RdfSyntaxError):
        files.parse_bytes(b"<a> <b> <c> <g> .", "x.nq")
    assert files.parse_bytes(b"<a> <b> <c> <g> .", "x.nq", named_graphs=True).statements[0][0] == "<g>"
    with pytest.raises(turtle.RdfSyntaxError):
        files.parse_bytes(b"nothing at all", "x.ttl")
    assert files.is_included("/a/b/c.ttl", ["b"]) and not files.is_included("/a/b/c.ttl", [], ["*.ttl"])
    with pytest.raises(files.OfflineError):
        files.fetch("http://h/x", offline=True)


def test_distributed_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<urn:a> <urn:p> _:x .")
    (tmp_path / "b.nt").write_text("<urn:b> <urn:p> _:x .\n")
    (tmp_path / "bad.ttl").write_text("<urn:a> <urn:p>")
    (tmp_path / "c.nq").write_text("<urn:c> <urn:p> <urn:o> <urn:g> .\n")
    (tmp_path / "d.nt").write_text("<urn:d> <urn:p> <urn:o> .\nnothing here\n# comment\n")
    (tmp_path / "notes.md").write_text("<urn:e> <urn:p>")
    patterns = ["*.ttl", "*.nt"]
    found = files.read_quads(spark, str(tmp_path), patterns, strict=False).collect()
    assert len(found) == 3 and len({r["o"] for r in found}) == 3 and len({r["graph"] for r in found}) == 3
    errors = {os.path.basename(r["location"]): (r["n"], r["error"]) for r in files.read_errors(spark, str(tmp_path), patterns).collect()}
    assert errors.keys() == {"bad.ttl", "d.nt"} and errors["d.nt"] == (1, "no statement: nothing here")
    with pytest.raises(Exception, match="parses in no format|no statement"):
        files.read_quads(spark, str(tmp_path), patterns).count()
    named = files.read_quads(spark, str(tmp_path / "c.nq"), named_graphs=True).collect()
    assert [r["graph"] for r in named] == ["<urn:g>"]
    assert files.read_errors(spark, str(tmp_path / "c.nq")).first()["error"] == "named graphs are not expected here"
    listed = files.list_files(spark, [str(tmp_path), str(tmp_path / "none")], ["*.nt"])
    assert sorted(os.path.basename(r["location"]) for r in listed.collect()) == ["b.nt", "d.nt"]
    # files of lines do not go through Python
    plan = files.read_statements(spark, str(tmp_path / "b.nt"))._jdf.queryExecution().toString()
    assert "text" in plan.lower()


def test_probes_and_negotiation(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<urn:a> <urn:p> <urn:o> .")
    here = str(tmp_path / "a.ttl")
    assert files.exists(here) and not files.exists(here + "x") and files.last_modified(here) == os.path.getmtime(here)
    assert abs(files.last_modified("file://" + here, spark=spark) - os.path.getmtime(here)) < 1
    assert files.fetch("file://" + here, spark=spark) == (tmp_path / "a.ttl").read_bytes()
    assert files.last_modified("http://h/x", prober=lambda url: 5.0) == 5.0 and files.last_modified("http://h/x") is None

    def gone(url):
        raise OSError(url)

    assert not files.exists("http://h/x", prober=gone) and files.exists("http://h/x") and files.exists("http://h/x", offline=True, prober=gone)
    assert files.accept_header().startswith("text/turtle, application/rdf+xml;q=0.9")
    page = files.Fetched(b"<html>no data</html>")
    page.media, page.links = "text/html", (("http://h/data", "text/turtle"), ("http://h/style", "text/css"))
    asked = []

    def fetcher(url):
        asked.append(url)
        if url == "http://h/x":
            return page
        if url == "http://h/x.ttl":
            return b"<urn:a> <urn:p> <urn:o> ."
        raise OSError(url)

    assert files.fetch("http://h/x", fetcher=fetcher) == b"<urn:a> <urn:p> <urn:o> ."
    assert asked == ["http://h/x", "http://h/data", "http://h/x.ttl"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    assert store.quads().isEmpty()
    quad = lambda g, o: ("d", iri(g), iri("urn:s"), iri("urn:p"), literal(o))
    store.write(spark.createDataFrame([quad("urn:1", "a"), quad("urn:1", "a"), quad("urn:2", "b"), quad("urn:3", "c")], QUAD_SCHEMA))
    before = {r["graph"]: r["revision"] for r in store.graphs().collect()}
    assert store.quads().count() == 3
    store.replace_graphs(spark.createDataFrame([quad("urn:2", "new"), quad("urn:9", "ignored")], QUAD_SCHEMA), [iri("urn:2")])
    assert sorted(r["o"] for r in store.quads().collect()) == ['"a"', '"c"', '"new"']
    after = {r["graph"]: r["revision"] for r in store.graphs().collect()}
    assert {g for g in after if after[g] != before[g]} == {iri("urn:2")}
    store.remove_graph(iri("urn:1"))
    assert store.graph(iri("urn:1")).isEmpty() and store.graph(iri("urn:3")).count() == 1
    with pytest.raises(ReadOnlyError):
        Store(spark, str(tmp_path / "store"), read_only=True).remove_graph(iri("urn:3"))
    # stored counts and the copy by predicate and object
    assert store.triple_count("d", iri("urn:2")) == 1 and store.triple_count("d", iri("urn:1")) == 0
    assert [r["graph"] for r in store.scan(p=iri("urn:p"), o=literal("c")).collect()] == [iri("urn:3")]
    assert any("/pos/" in f for f in store.scan(p=iri("urn:p")).inputFiles()) and all("/spo/" in f for f in store.scan(s=iri("urn:s")).inputFiles())
    # older versions stay readable until they are cleared away
    assert store.version() == 3 and len(store.vacuum()) >= 2
    assert Store(spark, str(tmp_path / "store"), integrity="strict").quads().count() == 2


def test_store_conflicts_and_integrity(spark, tmp_path):
    """Of two writers that began with one version the later is refused, and the pointer is never gone between."""
    path = str(tmp_path / "store")
    one, other = Store(spark, path, buckets=2), Store(spark, path, buckets=2)
    quad = lambda g, o: ("d", iri(g), iri("urn:s"), iri("urn:p"), literal(o))
    one.write(spark.createDataFrame([quad("urn:1", "a"), quad("urn:2", "b")], QUAD_SCHEMA))
    began = other.manifest()
    one.replace_graphs(spark.createDataFrame([quad("urn:1", "new")], QUAD_SCHEMA), [iri("urn:1")])
    with pytest.raises(StoreConflict):
        other._publish(spark.createDataFrame([quad("urn:1", "lost")], QUAD_SCHEMA), began, {"0", "1"})
    with pytest.raises(StoreConflict):
        other.replace_graphs(spark.createDataFrame([quad("urn:1", "lost")], QUAD_SCHEMA), [iri("urn:1")], expected=1)
    assert sorted(r["o"] for r in other.quads().collect()) == ['"b"', '"new"']
    folder = next(iter(other.manifest()["folders"]["pos"].values()))
    shutil.rmtree(os.path.join(path, folder))
    with pytest.raises(OSError):
        Store(spark, path).quads()
    assert Store(spark, path, integrity="trusted").quads().count() == 2
    with pytest.raises(ValueError):
        Store(spark, path, integrity="none")


OWL = "@prefix owl: <http://www.w3.org/2002/07/owl#> .\n"
#: Imports and further classes of six graphs.
SIX = {1: ([], 2), 2: ([1], 1), 3: ([1, 2], 1), 4: ([1], 1), 5: ([4, 2, 3], 1), 6: ([3, 4], 1)}


def six(folder):
    for k, (imports, classes) in SIX.items():
        lines = [f"<urn:o{k}> a owl:Ontology ."] + [f"<urn:o{k}> owl:imports <urn:o{i}> ." for i in imports] + [f"<urn:o{k}/c{c}> a owl:Class ." for c in range(classes)]
        (folder / f"o{k}.ttl").write_text(OWL + "\n".join(lines))
    return Config(search_directories=[str(folder)])


def test_closures_and_unions_of_six_graphs(spark, tmp_path):
    env = Environment(spark, config=six(tmp_path))
    assert len(env.update()) == 6 and env.update() == []
    sizes = {k: len(env.list_closure(f"urn:o{k}")) for k in (2, 3, 5)}
    assert sizes == {2: 2, 3: 3, 5: 5}
    assert len(env.list_closure("urn:o5", 0)) == 1 and len(env.list_closure("urn:o5", 1)) == 4
    assert {k: len(env.get_closure(f"urn:o{k}")[0]) for k in (2, 3, 5)} == {2: 4, 3: 5, 5: 7}
    assert {k: env.copy_closure(f"urn:o{k}", remove_owl_imports=False)[0].count() for k in (2, 3, 5)} == {2: 5, 3: 8, 5: 14}
    assert env.get_importers("urn:o1") == ["urn:o2", "urn:o3", "urn:o4"]
    assert env.import_paths("urn:o4") == [["urn:o5", "urn:o4"], ["urn:o6", "urn:o4"]]
    assert '"urn:o2" -> "urn:o1";' in env.dep_graph_dot(["urn:o2"])
    view, names = env.get_union(["urn:o2", "urn:o1"])
    assert names == ["urn:o2", "urn:o1"] and view.triples().count() == 6
    assert view.query("SELECT ?g { GRAPH ?g { ?s a <http://www.w3.org/2002/07/owl#Ontology> } }").count() == 2
    os.remove(tmp_path / "o6.ttl")
    (tmp_path / "o4.ttl").write_text(OWL + "<urn:o4> a owl:Ontology .")
    assert env.update() == ["urn:o4"] and "urn:o6" not in env and len(env.get_graph("urn:o4")) == 1


def test_environment_on_disk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    config = six(tmp_path / "src")
    path = str(tmp_path / "env")
    with Environment.create(spark, path, config) as env:
        assert len(env) == 6
    with pytest.raises(FileExistsError):
        Environment.create(spark, path, config)
    again = Environment.open(spark, path, read_only=True)
    assert again.get_ontology_names() == [f"urn:o{k}" for k in range(1, 7)] and len(again.get_graph("urn:o1")) == 3
    with pytest.raises(ReadOnlyError):
        again.update()
    writable = Environment.open(spark, path)
    assert len(writable.refresh_from_store().added) == 6
    report = writable.refresh_from_store()
    assert len(report.unchanged) == 6 and not report.changed
    with pytest.raises(CapabilityError):
        Environment(spark).refresh_from_store()
    assert cli.main(["--env", path, "list", "ontologies"], spark).split("\n")[0] == "urn:o1"
    assert "urn:o5 -> urn:o4" in cli.main(["--env", path, "why", "urn:o4"], spark)
    assert len(triples_of(turtle.parse(cli.main(["--env", path, "closure", "urn:o5"], spark)))) == 7
    assert json.loads(cli.main(["--env", path, "config", "set", "strict", "true"], spark)) is True
    assert json.loads(cli.main(["--env", path, "config", "get", "strict"], spark)) is True
    assert cli.main(["--env", path, "doctor"], spark) == ""


def test_lifecycle_and_recovery(spark, tmp_path):
    path, config = str(tmp_path / "env"), six(tmp_path)
    with pytest.raises(FileNotFoundError):
        Environment.connect(spark, path, read_only=True)
    env = Environment.open_or_init(spark, path, config)
    # all sources are one version of the store, and their records can be queried
    assert env.graphs.store.version() == 1 and len(env) == 6
    assert env.catalog().count() == 6
    found = query(env.catalog_quads(), f"SELECT ?g {{ ?g {IMPORTS} <urn:o3> }}")
    assert {r["g"] for r in found.collect()} == {"<urn:o5>", "<urn:o6>"}
    again = Environment.open(spark, path, overrides={"strict": True, "policy": "latest"})
    assert again.config.strict and Environment.open(spark, path).config.policy == "latest"
    with pytest.raises(ValueError):
        again.config.override(nothing=1)
    # someone else changes the store
    other = Store(spark, path + "/store")
    other.remove_graph(iri("urn:o6"))
    with pytest.raises(StoreChangedError):
        again.add("memory:x", b"<urn:x> <urn:p> <urn:y> .")
    # that change was broken off after its mark
    with pytest.raises(RecoveryNeededError):
        Environment.open(spark, path)
    whole = Environment.recover(spark, path)
    assert whole.get_ontology_names() == [f"urn:o{k}" for k in range(1, 6)] and whole.config.strict
    assert {r.location for r in whole.records.values()} == {str(tmp_path / f"o{k}.ttl") for k in range(1, 6)}
    other.remove_graph(iri("urn:o5"))
    assert Environment.connect(spark, path, sync="catalog").get_ontology_names()[-1] == "urn:o5"
    assert Environment.connect(spark, path).get_ontology_names()[-1] == "urn:o4"
    assert cli.main(["--env", path, "recover"], spark) == "4 graphs"
    fresh = str(tmp_path / "fresh")
    adopted = Environment.adopt(spark, fresh, StoredGraphs(other))
    adopted.flush()
    assert len(adopted) == 4 and adopted.resolve("urn:o4").imports == ["urn:o1"]
    with pytest.raises(FileExistsError):
        Environment.adopt(spark, fresh, StoredGraphs(other))


def test_closures_of_a_callers_graph(spark, tmp_path):
    env = Environment(spark, config=six(tmp_path))
    env.update()
    mine = spark.createDataFrame([(iri("urn:m"), TYPE, ONTOLOGY), (iri("urn:m"), IMPORTS, iri("urn:o3")), (iri("urn:m"), IMPORTS, iri("urn:none")), (iri("urn:m"), IMPORTS, literal("text"))], "s string, p string, o string")
    assert env.list_closure(mine) == ["urn:m", "urn:o3", "urn:o1", "urn:o2"]
    assert env.list_closure(mine, 0) == ["urn:m"] and env.list_closure(mine, 1) == ["urn:m", "urn:o3"]
    assert env.list_closure(mine.where("s = 'none'")) == []
    assert env.missing_imports(mine) == ["urn:none"] and env.missing_imports("urn:o3") == []
    alone, names = env.get_dependencies(mine)
    assert names == ["urn:o1", "urn:o2", "urn:o3"]
    assert {r["s"] for r in alone.where(alone["o"] == ONTOLOGY).collect()} == {iri(n) for n in names}


def test_policies_and_checks_from_outside(spark):
    env = Environment(spark, config=Config(policy="last"), policies={"last": lambda found: found[-1]}, checks=[lambda e: [f"{len(e)} sources"]])
    for k in (1, 2):
        env.add(f"memory:{k}", (OWL + f'<urn:o> a owl:Ontology ; <urn:l> "{k}" .').encode())
    assert env.resolve("urn:o").location == "memory:2" and '"2"' in [r["o"] for r in env.copy_graph("urn:o").collect()]
    assert "2 sources" in env.doctor()
    view = env.get_dataset()
    env.add("memory:3", b"<urn:x> <urn:p> <urn:y> .")
    before = len(view)
    view.refresh_from_env(env)
    assert len(view) == before + 1
    with pytest.raises(ValueError):
        view.refresh_from_env(env, "store")


def test_version_properties_decide(spark):
    """Created, label and see-also tell versions, and metadata goes before the ontology's own."""
    quads = []
    for k, (created, label, meta) in enumerate([("2020", "a", None), ("2021", "a", None), ("2021", "b", None), ("2019", "z", "2022")]):
        g, s = iri(f"urn:g{k}"), iri("urn:o")
        quads += [("d", g, s, TYPE, ONTOLOGY), ("d", g, s, iri(DCTERMS + "created"), literal(created)), ("d", g, s, iri(RDFS + "label"), literal(label)), ("d", g, s, iri(DCTERMS + "issued"), literal("9999"))]
        if meta:
            quads += [("d", g, s, iri(VAEM + "hasGraphMetadata"), iri("urn:m")), ("d", g, iri("urn:m"), iri(DCTERMS + "created"), literal(meta))]
    found = catalog.describe(spark.createDataFrame(quads, QUAD_SCHEMA))
    assert {r["graph"]: sorted(r["version_properties"]) for r in found.collect()}["<urn:g0>"] == [DCTERMS + "created", RDFS + "label"]
    records = found.select("name", found["graph"].alias("location"), catalog.version_vector(found["version_properties"]).alias("version"))
    assert [r["location"] for r in catalog.choose(records, "version").collect()] == ["<urn:g3>"]
    assert [r["location"] for r in catalog.choose(records.where("location <> '<urn:g3>'"), "version").collect()] == ["<urn:g2>"]


def test_names_aliases_renames_and_failures(spark):
    env = Environment(spark, config=Config(policy="latest"))
    web = {"http://h/one#": "<urn:one> a owl:Ontology ; owl:imports <http://h/two>, <http://h/none>, <urn:one> .", "http://h/two": "<urn:two> a owl:Ontology ; owl:versionIRI <urn:two> ."}

    def fetcher(url):
        if url not in web:
            raise OSError("not found")
        return (OWL + web[url]).encode()

    env.fetcher = fetcher
    assert env.add("http://h/one#") == "urn:one"
    assert env.resolve("http://h/two/").name == "urn:two" and env.get_aliases_for("urn:two") == ["http://h/two"]
    assert env.missing_imports() == ["http://h/none"] and env.list_closure("urn:one") == ["urn:one", "urn:two"]
    with pytest.raises(UnresolvedImportError):
        env.get_graph("http://h/none")
    with pytest.raises(KeyError):
        env.add_alias("urn:x", "urn:nowhere")
    env.rename_graph_iri("urn:two", "urn:2")
    assert rows(env.copy_graph("urn:2")) == sorted([("<urn:2>", TYPE, "<http://www.w3.org/2002/07/owl#Ontology>"), ("<urn:2>", "<http://www.w3.org/2002/07/owl#versionIRI>", "<urn:two>")], key=str)
    assert env.list_closure("urn:one") == ["urn:one", "urn:2"]
    strict = Environment(spark, config=Config(strict=True), fetcher=fetcher)
    with pytest.raises(UnresolvedImportError):
        strict.add("http://h/one#")
    env.config.offline = True
    with pytest.raises(files.OfflineError):
        env.add("http://h/new")


def test_two_sources_of_one_name(spark):
    env = Environment(spark)
    for location, label in (("memory:b", "second"), ("memory:a", "first")):
        env.add(location, (OWL + f'<urn:o> a owl:Ontology ; <urn:l> "{label}" .').encode())
    assert '"first"' in [r["o"] for r in env.copy_graph("urn:o").collect()] and len(env.get_graph("urn:o")) == 2
    assert env.doctor() == ["urn:o has several sources: memory:a, memory:b"]


def test_dependencies_of_a_callers_graph(spark):
    env = Environment(spark, graph_store=MemoryGraphs(spark))
    env.add("memory:a", (OWL + "<urn:a> a owl:Ontology ; owl:imports <urn:b> . <urn:a/x> a owl:Class .").encode(), fetch_imports=False)
    env.add("memory:b", (OWL + "<urn:b> a owl:Ontology . <urn:b/x> a owl:Class .").encode())
    mine = spark.createDataFrame([(iri("urn:m"), IMPORTS, iri("urn:a"))], "s string, p string, o string")
    merged, names = env.import_dependencies(mine)
    assert names == ["urn:a", "urn:b"] and {r["s"] for r in merged.collect()} == {iri("urn:a/x"), iri("urn:b/x")}
    alone, _ = env.get_dependencies(mine)
    assert alone.count() == 4
    named, _ = env.get_dependencies(mine, "urn:n")
    assert named.count() == 3
    none = spark.createDataFrame([(iri("urn:m"), IMPORTS, iri("urn:zz"))], "s string, p string, o string")
    assert env.import_dependencies(none) == (none, [])
    imported = env.import_graph(mine.limit(0), "urn:a")
    assert {r["o"] for r in imported.where(f"p = '{IMPORTS}'").collect()} == {iri("urn:b")}


def test_sync_and_catalog(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "graph string, revision string")
    old, new = frame({"a": "1", "b": "1", "c": "1"}), frame({"b": "2", "c": "1", "d": "1"})
    assert rows(sync.diff(old, new)) == [("a", "removed"), ("b", "changed"), ("c", "unchanged"), ("d", "added")]
    assert sync.report(old, new, ["b"]).still_pending == ["a", "d"]
    named = spark.createDataFrame([("urn:a##",), ("urn:a/#",), ("urn:a//",)], "n string")
    assert {r[0] for r in named.select(catalog.normal_name(named["n"])).collect()} == {"urn:a"}


def test_stream(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.nt").write_text("<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:p> <urn:b> .\n")
    query = watch.watch(spark, str(folder), str(tmp_path / "state"), lambda quads, names: seen.append((quads.count(), len(names))), once=True)
    query.awaitTermination(60)
    assert seen == [(1, 1)]
