"""Direct mapping of relational tables to quads.

A row of table t with key k becomes the subject ``urn:t/k`` of graph
``urn:g:t``, typed ``urn:c:t``; each mapped column becomes the predicate
``urn:p:<column>``.  A column that refers to another table gives its subject;
others give a literal of the column's type.  Nulls give no triple.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import TYPE, XSD, iri, iri_of, literal_of


@dataclass(frozen=True)
class TableMap:
    """``unique``: whether no two rows of the table have one key."""

    table: str
    key: tuple[str, ...]
    values: tuple[str, ...] = ()
    refers: dict[str, str] = field(default_factory=dict)
    unique: bool = True


def subject(table: str, *key: Column) -> Column:
    parts: list[Column | str] = [f"urn:{table}/"]
    for k, column in enumerate(key):
        parts += ["/", column] if k else [column]
    return iri_of(*parts)


def _object(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return literal_of(F.col(name), XSD + "integer")
    if isinstance(kind, T.BooleanType):
        return literal_of(F.col(name), XSD + "boolean")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return literal_of(F.col(name), XSD + "double")
    if isinstance(kind, T.DecimalType):
        return literal_of(F.col(name), XSD + "decimal")
    if isinstance(kind, T.DateType):
        return literal_of(F.col(name), XSD + "date")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return literal_of(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")
    return literal_of(F.col(name))


def _objects(df: DataFrame, mapping: TableMap) -> dict[str, Column]:
    """The object of each predicate, for a row."""
    out = {TYPE: F.lit(iri(f"urn:c:{mapping.table}"))}
    out |= {iri(f"urn:p:{c}"): _object(df, c) for c in mapping.values}
    return out | {iri(f"urn:p:{c}"): subject(t, F.col(c)) for c, t in mapping.refers.items()}


def predicates_of(mapping: TableMap) -> list[str]:
    return [TYPE, *(iri(f"urn:p:{c}") for c in (*mapping.values, *mapping.refers))]


def triples_of(df: DataFrame, mapping: TableMap, p: str, dataset: str = "db") -> DataFrame:
    """Quads of one predicate: of the table only its key and one column are read."""
    s = subject(mapping.table, *map(F.col, mapping.key))
    rows = df.select(F.lit(dataset).alias("dataset"), F.lit(iri(f"urn:g:{mapping.table}")).alias("graph"), s.alias("s"), F.lit(p).alias("p"), _objects(df, mapping)[p].alias("o"))
    return rows.where(F.col("s").isNotNull() & F.col("o").isNotNull())


def to_quads(df: DataFrame, mapping: TableMap, dataset: str = "db") -> DataFrame:
    """One pass over the table: each row is turned into its triples by one generator."""
    s = subject(mapping.table, *map(F.col, mapping.key))
    objects = [F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in _objects(df, mapping).items()]
    rows = df.select(s.alias("s"), F.inline(F.array(*objects)))
    named = rows.select(F.lit(dataset).alias("dataset"), F.lit(iri(f"urn:g:{mapping.table}")).alias("graph"), "s", "p", "o")
    return named.where(F.col("s").isNotNull() & F.col("o").isNotNull())
