"""Where queries read their quads: a DataFrame, a store, or mapped tables.

A source gives ``scan(s, p, o)``, quads with bound terms by its cheapest path,
and says what it knows of them: ``unique``, that no triple stands in two rows
of one graph, and ``merged``, that none stands in two rows at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..operators.scan import matching
from ..plans.local import local_frame
from ..terms import QUAD_SCHEMA
from .mapping import TableMap, predicates_of, to_quads, triples_of
from .store import Store


class Source(Protocol):
    spark: SparkSession
    unique: bool
    merged: bool

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame: ...


class Frame:
    """Quads of a DataFrame."""

    def __init__(self, quads: DataFrame, unique: bool = False, merged: bool = False):
        self.quads, self.spark, self.unique, self.merged = quads, quads.sparkSession, unique or merged, merged

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        return matching(self.quads, s, p, o)


class Stored:
    """Quads of a store, from the copy that is sorted best for what is bound.  It keeps each quad of a dataset once."""

    merged = False

    def __init__(self, store: Store, names: Sequence[str] | None = None, one_dataset: bool = False):
        self.store, self.spark, self.names, self.unique = store, store.spark, names, one_dataset

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        return self.store.scan(s, p, o, self.names)


class Tables:
    """Tables mapped to quads.  A bound predicate reads the key and one column of the tables that have it.

    No triple stands in two rows where all keys are unique, as declared, and
    each table is mapped once.
    """

    def __init__(self, tables: Sequence[tuple[DataFrame, TableMap]], dataset: str = "db"):
        self.tables, self.dataset, self.spark = list(tables), dataset, tables[0][0].sparkSession
        maps = [m for _, m in self.tables]
        self.unique = self.merged = all(m.unique for m in maps) and len({m.table for m in maps}) == len(maps)

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        if p is None:
            found = [to_quads(df, m, self.dataset) for df, m in self.tables]
        else:
            found = [triples_of(df, m, p, self.dataset) for df, m in self.tables if p in predicates_of(m)]
        if not found:
            return local_frame(self.spark, [], QUAD_SCHEMA)
        return matching(reduce(DataFrame.unionByName, found), s, None, o)


def source_of(quads: DataFrame | Source, unique: bool = False, merged: bool = False) -> Source:
    return Frame(quads, unique, merged) if isinstance(quads, DataFrame) else quads
