"""Every query that has SQL gives the same rows as DuckDB, on the small tables."""

import duckdb
import pytest

import __spark_entry__
from quadrille import queries as core

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(f"{r[k]:.6g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    found = core.queries()[name](spark, SF_DIR)
    answer = duck.execute(core.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain(map(tuple, found.collect()), found.columns) == plain(answer.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_paths_cover_all_parts(spark, monkeypatch):
    """Every part below the root of the tree begins a path, and the operator of both queries is given all edges."""
    edges = core.table(spark, SF_DIR, "part").where("p_partkey > 1").count()
    given, operator = [], core.sparql
    monkeypatch.setattr(core, "sparql", lambda quads, *a, **k: given.append(quads.count()) or operator(quads, *a, **k))
    assert core.queries()["path_plus_all"](spark, SF_DIR).count() == edges
    core.queries()["path_plus_variables"](spark, SF_DIR)
    assert given == [edges] * 2


def test_entry_and_dependencies_cover_all_graphs(spark):
    """The imports of the nations are one ring, so the closure of any of them holds all."""
    counts = {r["p"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert counts["<urn:p:n_name>"] == 25 and core.IMPORTS not in counts
    ring = {(f"<urn:nation/{k}>", f"<urn:nation/{(k + 1) % 25}>") for k in range(25)}
    assert {tuple(r) for r in core.queries()["dependency_edges_all"](spark, SF_DIR).select("src", "dst").collect()} == ring
